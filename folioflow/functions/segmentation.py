"""Sentences, citation tokens and their contexts.

Sentence boundaries are found with one regular expression and a fold over bracket
depth, both within the row, so nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import TOKEN, normalize_text, text_sha256

# Abbreviations that a period does not end a sentence after.
TITLES = ["dr", "jr", "messrs", "mr", "mrs", "ms", "prof", "sr", "st"]
ARGUMENTS = ["art", "chap", "chaps", "col", "cols", "eq", "eqs", "fig", "figs", "no", "nos", "p", "pp", "ref", "refs", "sec", "secs", "tab", "tabs", "vol", "vols"]
PHRASES = ["al", "approx", "ca", "cf", "e\\.g", "ed", "eds", "esp", "et", "etc", "i\\.e", "inc", "ltd", "resp", "viz", "vs"]
MARK = "\ue001"
MASK = "\ue000"
OTHER = "\ue002"  # stands for either where a text holds it; sentences are cut from the text itself
MAX_SPANS = 24


def _after(options: list[str]) -> str:
    return "(?<=(?<![\\p{L}\\p{N}.])(?i:" + "|".join(options) + "))"


def _boundary() -> str:
    space = "[ \\t\\n\\x0B\\f\\r]+"
    not_title = "(?<!(?<![\\p{L}\\p{N}.])(?i:" + "|".join(TITLES) + "))(?<!(?<![\\p{L}\\p{N}.])\\p{L})"
    not_argument = f"(?!(?<=(?<![\\p{{L}}\\p{{N}}.])(?i:{'|'.join(ARGUMENTS)})\\.){space}[\\p{{N}}(\\[{MASK}])"
    not_phrase = f"(?!(?<=(?<![\\p{{L}}\\p{{N}}.])(?i:{'|'.join(PHRASES)})\\.){space}[\\p{{N}}])"
    period = f"{not_title}\\.(?!(?<=\\p{{N}}\\.)\\p{{N}}){not_argument}{not_phrase}"
    return f"((?:[!?]|{period})[\"'”’)\\]}}]*)(?={space}[\\p{{Lu}}\\p{{N}}\"'“‘(\\[$]|{space}{MASK})"


BOUNDARY = _boundary()


def abbreviation_guard(before: Column, after: Column) -> Column:
    """Why a period between ``before`` and ``after`` ends no sentence: TITLE, INITIAL, ARGUMENT, PHRASE, or NONE.

    ``before`` is the text up to the period, ``after`` what follows the white space behind it.
    """
    ends = lambda options: before.rlike(r"(?<![\p{L}\p{N}.])(?i:" + "|".join(options) + ")$")
    argument = ends(ARGUMENTS) & after.rlike(r"^(?:[\p{N}(\[])")
    phrase = ends(PHRASES) & after.rlike(r"^[\p{N}\p{Ll}]")
    return F.when(ends(TITLES), "TITLE").when(ends([r"\p{L}"]), "INITIAL").when(argument, "ARGUMENT").when(phrase, "PHRASE").otherwise("NONE")


def _guards() -> dict[str, str]:
    """What guards a period before white space and more text, as patterns that no period matches two of.

    They begin with the period, which is searched for fast, and look back from there.
    """
    space = "[ \\t\\n\\x0B\\f\\r]+"
    after = lambda options: "\\.(?<=(?<![\\p{L}\\p{N}.])(?i:" + "|".join(options) + ")\\.)"
    more, longer = f"(?={space}[^ \\t\\n\\x0B\\f\\r])", [a for a in ARGUMENTS if len(a) > 1]  # one letter is an initial
    return {
        "TITLE": after(TITLES) + more, "INITIAL": after(["\\p{L}"]) + more, "ARGUMENT": after(longer) + f"(?={space}[\\p{{N}}(\\[])",
        "PHRASE": after(PHRASES) + f"(?={space}[\\p{{N}}\\p{{Ll}}])", "NONE": "\\." + more,
    }


def guarded_periods(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, guard, periods): how many periods before white space and more text are guarded by what: TITLE, INITIAL, ARGUMENT, PHRASE, or NONE."""
    patterns = _guards()
    every = patterns.pop("NONE")
    d = df.select(*keys, text, F.regexp_count(text, F.lit(every)).alias("NONE")).where(F.col("NONE") > 0)
    some = F.col(text).rlike("|".join(patterns.values()))
    d = d.select(*keys, "NONE", *[F.when(some, F.regexp_count(text, F.lit(p))).otherwise(0).alias(g) for g, p in patterns.items()])
    n = d.groupBy(*keys).agg(*[F.sum(g).alias(g) for g in ["NONE", *patterns]])
    none = reduce(Column.__sub__, [F.col(g) for g in patterns], F.col("NONE"))
    counts = F.array(*[F.struct(F.lit(g).alias("guard"), c.alias("periods")) for g, c in [("NONE", none), *[(g, F.col(g)) for g in patterns]]])
    return n.select(*keys, F.explode(F.filter(counts, lambda x: x["periods"] > 0)).alias("x")).select(*keys, "x.guard", "x.periods")


def sentences(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Keys, sent_no from 1, char_start, char_end, text, plain_text, citation_ids, sentence_id."""
    src = F.col(text)
    # tokens become runs of one private character of the same length, so that offsets hold
    lengths = F.transform(F.regexp_extract_all(src, F.lit(TOKEN), F.lit(0)), F.length)
    gaps = F.split(F.translate(src, MARK + MASK, OTHER * 2), TOKEN, -1)
    masked = F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.repeat(F.lit(MASK), F.get(lengths, i)), F.lit(""))))), "")
    plain = F.when(F.instr(src, "[[CITE:") > 0, masked).otherwise(F.translate(src, MARK + MASK, OTHER * 2))
    marked = F.regexp_replace(plain, BOUNDARY, "$1" + MARK)
    pieces = F.split(marked, MARK, -1)

    def depth_of(d: Column, piece: Column) -> Column:
        brackets = F.split(F.regexp_replace(piece, r"[^(\[{)\]}]+", ""), "")
        return F.aggregate(brackets, d, lambda a, ch: F.greatest(F.lit(0), a + F.when(ch.isin("(", "[", "{"), 1).when(ch.isin(")", "]", "}"), -1).otherwise(0)))

    empty = F.struct(F.lit(0).alias("d"), F.lit(0).alias("at"), F.lit(0).alias("from"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        d = depth_of(acc["d"], piece)
        close = d == 0
        out = F.when(close, F.array_append(acc["out"], F.struct(acc["from"].alias("a"), end.alias("b")))).otherwise(acc["out"])
        return F.struct(d.alias("d"), end.alias("at"), F.when(close, end).otherwise(acc["from"]).alias("from"), out.alias("out"))

    folded = F.aggregate(pieces, empty, step, lambda a: F.when(a["from"] < a["at"], F.array_append(a["out"], F.struct(a["from"].alias("a"), a["at"].alias("b")))).otherwise(a["out"]))
    blanks = F.lit(" \t\n\u000b\f\r")
    raw = F.transform(folded, lambda s: F.struct(s["a"].alias("a"), F.substr(src, s["a"] + 1, s["b"] - s["a"]).alias("raw")))
    own = F.transform(raw, lambda s: F.struct((s["a"] + F.length(s["raw"]) - F.length(F.ltrim(s["raw"], blanks))).alias("start"), F.trim(s["raw"], blanks).alias("text")))
    rows = df.select(*keys, F.posexplode(F.filter(own, lambda s: s["text"] != "")).alias("_p", "s"))
    rows = rows.select(*keys, (F.col("_p") + 1).cast("long").alias("sent_no"), F.col("s.start").cast("long").alias("char_start"), F.col("s.text").alias("text"))
    rows = rows.withColumn("char_end", F.col("char_start") + F.length("text"))
    ident = F.concat_ws("_", F.lit("p"), *keys, F.concat(F.lit("s"), "sent_no"))
    return rows.select(*keys, "sent_no", "char_start", "char_end", "text", normalize_text(detokenize(F.col("text"))).alias("plain_text"), token_ids(F.col("text")).alias("citation_ids"), ident.alias("sentence_id"))


def tokenize(inlines: Column) -> Column:
    """array<struct<kind, value>> as text with opaque citation tokens."""
    return F.array_join(F.transform(inlines, lambda x: F.when(x["kind"] == "citation", F.concat(F.lit("[[CITE:"), x["value"], F.lit("]]"))).otherwise(x["value"])), "")


def detokenize(c: Column) -> Column:
    return F.regexp_replace(c, TOKEN, "")


def token_ids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))


def inlines(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Tokenised text as runs (place, kind, value); empty text runs are left out."""
    texts, ids = F.split(col, TOKEN, -1), token_ids(F.col(col))
    runs = F.flatten(F.transform(texts, lambda x, i: F.array(F.struct(F.lit("text").alias("kind"), x.alias("value")), F.struct(F.lit("citation").alias("kind"), F.get(ids, i).alias("value")))))
    d = df.select(*keys, F.posexplode(runs).alias("place", "r"))
    return d.select(*keys, F.col("place").cast("long").alias("place"), "r.kind", "r.value").where("value is not null and value <> ''")


def unknown_ids(runs: DataFrame, known: DataFrame, id_col: str = "citation_id") -> DataFrame:
    """Citation runs whose id is not registered: an error in the reference."""
    return runs.where("kind = 'citation'").join(known.select(F.col(id_col).alias("value")), "value", "left_anti")


def evidence_spans(df: DataFrame, keys: list[str]) -> DataFrame:
    """At most 24 spans per text with offsets and hash."""
    s = sentences(df, keys).where(F.col("sent_no") <= MAX_SPANS)
    return s.select(*keys, F.format_string("span_%03d", F.col("sent_no") - 1).alias("span_id"), "char_start", "char_end", text_sha256(F.col("text")).alias("text_hash"))


def cluster_items(df: DataFrame, key: str, marker: str) -> DataFrame:
    """A cluster such as ``[35, 2, 5]`` as one row per item."""
    inner = F.regexp_replace(marker, r"[\[\]()]", "")
    return df.select(key, F.posexplode(F.split(inner, r"\s*[,;]\s*")).alias("p", "fragment")).select(key, F.col("p").cast("long").alias("place"), F.trim("fragment").alias("fragment")).where("fragment <> ''")


def expand_ranges(markers: DataFrame, refs: DataFrame, longest: int = 30) -> DataFrame:
    """``[3-7]`` as its interior entries, if it starts at the linked position and every entry exists."""
    m = markers.withColumn("_lo", F.regexp_extract("marker", r"^[\[(]?\s*(\d+)\s*[-–—]\s*(\d+)", 1).cast("long")).withColumn("_hi", F.regexp_extract("marker", r"^[\[(]?\s*(\d+)\s*[-–—]\s*(\d+)", 2).cast("long"))
    m = m.where((F.col("_hi") > F.col("_lo")) & (F.col("_hi") - F.col("_lo") <= longest) & (F.col("_lo") == F.col("linked")))
    m = m.select("paper_id", "reference_id", "_lo", "_hi", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("printed"))
    r = refs.select("paper_id", F.col("bibliography_order").alias("printed"), F.col("reference_id").alias("target"))
    m = m.join(r, ["paper_id", "printed"], "left")
    whole = F.count("target").over(W.partitionBy("paper_id", "reference_id")) == F.col("_hi") - F.col("_lo")
    return m.withColumn("_ok", whole).where("_ok").select("paper_id", "reference_id", "printed", "target")


def identity_keys(works: DataFrame) -> DataFrame:
    """One row per identity of a work."""
    keys = F.array(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("arxiv:"), F.lower("arxiv_id")), F.lower(F.concat("provider", F.lit(":"), "external_id")))
    return works.withColumn("identity_key", F.explode(F.filter(keys, lambda x: x.isNotNull())))


def citation_contexts(s: DataFrame, keys: list[str], least_words: int = 3) -> DataFrame:
    """Host sentence of each citing sentence (the last one of three words or more), and its neighbours."""
    w = W.partitionBy(*keys).orderBy("sent_no")
    long_enough = F.size(F.split(normalize_text(detokenize(F.col("text"))), " ")) >= least_words
    host = F.last(F.when(long_enough, F.col("sent_no")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    all_ = s.withColumn("host_no", F.coalesce(host, F.col("sent_no")))
    near = s.select(*keys, F.col("sent_no").alias("host_no"), F.col("text").alias("host"), F.lag("text").over(w).alias("previous"), F.lead("text").over(w).alias("following"))
    return all_.where("cites").select(*keys, "sent_no", "host_no").join(near, [*keys, "host_no"])
