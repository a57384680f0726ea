"""Spelling variants: words one edit apart, by composition of finite-state machines.

The vocabulary's minimised acceptor A, a transducer E that makes exactly one edit, and A again are
composed; the pairs that A o E o A accepts are the words one insertion, deletion or replacement apart.
Until E has made its edit both copies of A read the same letters, so they are in the same state, reached by
the letters that the two words share.  The composition is therefore split by these states:
a partition is a prefix with all words that begin with it, it builds the acceptor of its words and
enumerates the pairs whose edit comes after the prefix.  Where more than ``MOST`` words share a prefix, the
state is left in two ways, and both are dealt to other partitions: by a letter that is read on, to
the prefix one longer, and by the edit itself, after which both words must read the same rest; those
meet under the key (prefix, rest), at most one word for each letter of the alphabet and one without.
So each pair is found once, at the place where its words first differ, and no partition grows with the corpus.

Only a word's number of partners and its most frequent partner leave a partition.  A word's form is
its most frequent partner, if that is ``TIMES`` times as frequent; roots follow forms by doubling.

Handling: null and blank texts have no words; a null id counts as an empty one; repeated rows count
each time; ties go to the smaller word in code-point order; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if_small, cut

RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, LEAST, TIMES, NOISE = 7, 2, 10, 31
MOST = 16_384  # words of a partition


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of at least ``SHORTEST`` code points and ``LEAST`` occurrences, one letter deleted in every ``NOISE``-th run by hash."""
    runs = F.expr(f"regexp_extract_all(text, '{RUN}{{{SHORTEST},}}', 0)")
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    runs = rows.select("id", F.explode(runs).alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut_one = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % NOISE == 0, cut_one).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST)


class Acceptor:
    """Minimised acyclic acceptor of sorted, distinct words: ``arcs[s]`` maps a first letter to the letters and the
    state of an arc, ``final`` holds the accepting states.  States that neither branch nor accept are part of an arc."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[str, int]]] = [{}]
        self.final: set[int] = set()
        known: dict[tuple, int] = {}
        path = [(0, 0)]  # depths and states along the last word, not yet merged
        last = ""

        def close(depth: int) -> None:
            """Merge the states below ``depth`` with equal ones and hang them on a state at ``depth``."""
            while path[-1][0] > depth:
                end, s = path.pop()
                s = known.setdefault((s in self.final, *self.arcs[s].values()), s)
                if path[-1][0] < depth:
                    path.append((depth, len(self.arcs)))
                    self.arcs.append({})
                start, above = path[-1]
                self.arcs[above][last[start]] = (last[start:end], s)

        for w in words:
            close(len(commonprefix([last, w])))
            if path[-1][0] < len(w):
                path.append((len(w), len(self.arcs)))
                self.arcs.append({})
            self.final.add(path[-1][1])
            last = w
        close(0)


class Composition:
    """Acceptor o one-edit transducer o acceptor.  Words differ first where the acceptor branches or accepts, so edits start there."""

    def __init__(self, a: Acceptor):
        self.a = a
        self.shared: dict[tuple[str, int, int], list[str]] = {}  # rests that both sides accept

    def met(self, x: str, s: int, y: str, t: int) -> tuple[str, tuple[str, int, int]] | None:
        """One side has ``x`` to read to reach ``s``, the other ``y`` to reach ``t``: the letters until the first does, and the key from there."""
        if len(x) > len(y):
            x, s, y, t = y, t, x, s
        if not y.startswith(x):
            return None
        rest = y[len(x) :]
        return x, (rest, s, t) if rest or s < t else ("", t, s)

    def steps(self, rest: str, s: int, t: int) -> list[tuple[str, tuple[str, int, int]]]:
        """The ways on that a side in ``s`` and one that has ``rest`` to read to reach ``t`` have in common."""
        here = self.a.arcs[s]
        if rest:
            found = [self.met(*here[rest[0]], rest, t)] if rest[0] in here else []
        else:
            there = self.a.arcs[t]
            found = [self.met(*here[c], *there[c]) for c in here if c in there]
        return [x for x in found if x]

    def both(self, way: tuple[str, tuple[str, int, int]] | None) -> list[str]:
        """The rests that both sides accept: the transducer has made its edit and copies."""
        if way is None:
            return []
        waiting: list[tuple] = [(way[1], None)]
        while waiting:
            key, steps = waiting.pop()
            if key in self.shared:
                continue
            steps = self.steps(*key) if steps is None else steps
            missing = [k for _, k in steps if k not in self.shared]
            if missing:
                waiting += [(key, steps), *((k, None) for k in missing)]
            else:
                rest, s, t = key
                own = [""] if not rest and s in self.a.final and t in self.a.final else []
                self.shared[key] = own + [x + r for x, k in steps for r in self.shared[k]]
        return [way[0] + r for r in self.shared[way[1]]]

    def edits(self, s: int) -> list[tuple[str, str]]:
        """Pairs of rests of ``s`` that differ in their first letter by the edit: replaced, or inserted in the second."""
        arcs = sorted((c, x[1:], t) for c, (x, t) in self.a.arcs[s].items())
        out = [(a + r, b + r) for i, (a, x, u) in enumerate(arcs) for b, y, v in arcs[i + 1 :] for r in self.both(self.met(x, u, y, v))]
        return out + [(r, a + r) for a, x, u in arcs for r in self.both(self.met("", s, x, u)) if r[:1] != a]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of words one edit apart, each once."""
        own: dict[int, list[tuple[str, str]]] = {}
        waiting = [("", 0)]
        while waiting:
            prefix, s = waiting.pop()
            if s not in own:
                own[s] = self.edits(s)
            for x, y in own[s]:
                yield prefix + x, prefix + y
            waiting += [(prefix + x, t) for x, t in self.a.arcs[s].values()]


def partners(words: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best_n, best) of the words (rest, n) of one partition that have partners in it."""
    rests = sorted(words["rest"].tolist())
    count = dict(zip(words["rest"], words["n"]))
    found: dict[str, list] = {}  # rest: number of partners, least (-n, rest) of them
    for x, y in Composition(Acceptor(rests)).pairs():
        for a, b in ((x, y), (y, x)):
            own = found.get(a)
            if own is None:
                found[a] = [1, (-count[b], b)]
            else:
                own[0] += 1
                own[1] = min(own[1], (-count[b], b))
    head = words["prefix"].iloc[0]
    rows = [(head + a, k, -n, head + b) for a, (k, (n, b)) in found.items()]
    return pd.DataFrame(rows, columns=["word", "n_near", "best_n", "best"])


def edited(words: DataFrame) -> DataFrame:
    """The same of pairs whose edit leaves the state of ``prefix``: both words have one rest behind it."""
    first, behind = F.substring("rest", 1, 1), F.expr("substring(rest, 2)")
    entry = lambda rest, letter: F.struct(rest.alias("rest"), letter.alias("letter"))
    entries = F.array(entry(F.col("rest"), F.lit("")), entry(behind, first))
    rows = words.withColumn("e", F.explode(F.when(F.col("rest") == "", F.slice(entries, 1, 1)).otherwise(entries)))
    # at most a word a letter and one without
    groups = rows.groupBy("prefix", F.col("e.rest").alias("rest")).agg(F.collect_list(F.struct((-F.col("n")).alias("n"), F.concat("prefix", "rest").alias("word"), "e.letter")).alias("all"))
    groups = groups.where(F.size("all") > 1).select("all", F.substring("rest", 1, 1).alias("next"), F.explode("all").alias("own"))
    own, after = F.col("own.letter"), F.col("next")

    def differs(x: Column) -> Column:
        """Two letters, or one and none; where the rest begins with the letter, the words first differ behind it."""
        return (x["letter"] != own) & ~((own == "") & (x["letter"] == after)) & ~((x["letter"] == "") & (own == after))

    near = groups.select("own.word", F.filter("all", differs).alias("near")).where(F.size("near") > 0)
    best = F.array_min(F.transform("near", lambda x: F.struct(x["n"], x["word"])))
    return near.select("word", F.size("near").cast("long").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


@F.pandas_udf(T.StringType())
def common_beginning(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([commonprefix(x) for x in zip(a, b)], dtype=object)


def neighbours(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``words`` (word, n, each once) that have one at one edit."""
    kind = "word string, n_near long, best_n long, best string"
    cells, done = words.select(F.lit("").alias("prefix"), F.col("word").alias("rest"), "n"), []
    while True:
        large = cut(cells.groupBy("prefix").count().where(F.col("count") > most).select("prefix"), "spell-large")
        some = large.count()  # at most 1 / most of the words
        small = cells.join(broadcast_if_small(large, some), "prefix", "left_anti") if some else cells
        done.append(small.groupBy("prefix").applyInPandas(partners, kind))
        if not some:
            break
        split = cut(cells.join(broadcast_if_small(large, some), "prefix", "left_semi"), "spell-split")
        # letters that all words of a prefix share are read at once
        ends = split.groupBy("prefix").agg(F.min("rest").alias("a"), F.max("rest").alias("b")).select("prefix", common_beginning("a", "b").alias("shared"))
        split = split.join(broadcast_if_small(cut(ends, "spell-ends"), some), "prefix")
        split = split.select(F.concat("prefix", "shared").alias("prefix"), F.expr("substring(rest, length(shared) + 1)").alias("rest"), "n")
        done.append(edited(split))
        cells = split.where("rest != ''").select(F.concat("prefix", F.substring("rest", 1, 1)).alias("prefix"), F.expr("substring(rest, 2)").alias("rest"), "n")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    out = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last of each chain.  Forms grow in frequency, so chains end; each round doubles the steps."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        at = after.select("word", "root")
        if after.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the vocabulary of ``docs``."""
    words = cut(vocabulary(docs, id_col, text_col), "spell-words")
    near = neighbours(words, most)
    fits = F.col("best_n") >= TIMES * F.col("n")
    each = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"))
    each = cut(each, "spell-forms")
    last = roots(each.where("form is not null"))
    return each.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_transducer(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op13_spelling_transducer": op13_spelling_transducer}
ORACLE: dict[str, str] = {}
