"""Language identification by multilingual mixture inference.

Each word is a draw from one of the document's languages.  A language's word
likelihood is the geometric mean over hashed character n-grams of smoothed
frequencies learned from labelled texts (of at most ``TRAIN_ROWS`` ids a language, smallest
seeded id hash first, one text an id, the only bound).  Expectation-maximisation estimates the
proportions of all languages in a document; languages are then taken away one by one,
the least first, while the likelihood lost stays below the penalty of one parameter,
and the proportions are estimated again on the set that is left.

Handling: a text that is null or has no letter (Unicode category L) is ``und`` with score 0;
null languages, texts and ids are not learned from; other columns are carried or ignored,
whatever their names; with nothing learned every text is ``und``; ties go to the
language that sorts first; repeated rows are predicted one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, held_out

TRAIN_ROWS = 2_000
SLOTS = 1 << 16
SMOOTH = 0.5
ROUNDS = 8
PENALTY = 0.5  # times log of the number of words, for each language of the set
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def gram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the 1- to 3-grams of bytes of each word, its ends marked, and where each word's begin."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    one, two, three = x * np.uint32(2654435761), np.zeros_like(x), np.zeros_like(x)
    two[:-1] = (x[:-1] * np.uint32(257) + x[1:] + np.uint32(1 << 16)) * np.uint32(2654435761)
    three[:-2] = (x[:-2] * np.uint32(66049) + x[1:-1] * np.uint32(257) + x[2:] + np.uint32(1 << 25)) * np.uint32(2654435761)
    slots = (np.stack([one, two, three], 1) >> np.uint32(16)).astype(np.int64)
    last = np.cumsum(sizes) - 1  # grams that would run into the next word stand for none
    slots[last, 1] = slots[last, 2] = slots[last - 1, 2] = SLOTS
    return slots, np.concatenate([[0], last[:-1] + 1]).astype(np.int64)


def tokens(text: str) -> Counter:
    """Counts of the lower-case letter runs of a whole text."""
    return Counter(_LETTERS.findall(text.lower()))


class Model:
    """Languages and, per n-gram slot, log probabilities (slots and a row of zeros x languages)."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    def words(self, words: list[str]) -> np.ndarray:
        """Mean log probability of each word's n-grams per language."""
        slots, starts = gram_slots(words)
        sums = np.add.reduceat(self.table[slots].sum(1), starts, axis=0)
        n = np.add.reduceat((slots < SLOTS).sum(1), starts)
        return sums / n[:, None]


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from at most ``rows`` documents of each language; n-grams are counted where the texts are read."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id is not null and lang is not null and text is not null")
    each = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    each = cut(each, "lang-counts")
    # about twice the wanted rows of a language are ranked, whatever its share; only ids move, no text
    draw = F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1 << 30)) / (1 << 30)
    some = known.select("id", "lang").join(broadcast_if_small(each, each.count()), "lang").where(draw < 2 * rows / F.col("_n"))
    first = F.row_number().over(W.partitionBy("lang").orderBy(draw, "id"))
    chosen = cut(some.select("id", "lang").distinct().withColumn("_r", first).where(F.col("_r") <= rows).select("id").distinct(), "lang-ids")
    picked = known.join(broadcast_if_small(chosen, chosen.count(), 500_000), "id", "left_semi")
    picked = picked.groupBy("id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("x")).select("x.lang", "x.text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"].tolist(), b["text"].tolist()):
                c = tokens(text)
                if not c:
                    continue
                slots, starts = gram_slots(list(c))
                each = np.repeat(np.fromiter(c.values(), np.float64, len(c)), np.diff(np.append(starts, len(slots))))
                found = np.bincount(slots.ravel(), np.repeat(each, 3), SLOTS + 1)[:SLOTS]
                total[lang] = total.get(lang, 0) + found
        for lang, slot in total.items():
            own = np.flatnonzero(slot)
            yield pd.DataFrame({"lang": lang, "slot": own, "n": slot[own]})

    parts = picked.mapInPandas(count, "lang string, slot int, n double")
    # at most SLOTS rows a language
    got = parts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.full((SLOTS, max(len(langs), 1)), SMOOTH)
    for j, lang in enumerate(langs):
        part = got[got["lang"] == lang]
        table[part["slot"].to_numpy(), j] += part["n"].to_numpy()
    return Model(langs, np.vstack([np.log(table / table.sum(0)), np.zeros(table.shape[1])]).astype(np.float32))


def _mix(p: np.ndarray, n: np.ndarray, doc: np.ndarray, starts: np.ndarray, on: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once: proportions over the languages ``on``, and log likelihoods."""
    w = on / on.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        r = p * w[doc]
        total = r.sum(1, keepdims=True)
        w = np.add.reduceat(r * (n[:, None] / total), starts, axis=0) / size[:, None]
        w = np.where(on, np.maximum(w, 1e-9), 0)
        w /= w.sum(1, keepdims=True)
    like = np.add.reduceat(n * np.log((p * w[doc]).sum(1)), starts)
    return w, like


def infer(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
    """Predicted language, its proportion and the proportions of the chosen set for each text."""
    pred, score, sets = [UNKNOWN] * len(texts), np.zeros(len(texts)), [{} for _ in texts]
    if not model.langs:
        return pred, score, sets
    rows, n, doc, starts, owners = [], [], [], [], []
    index: dict[str, int] = {}
    for i, t in enumerate(texts):
        if t is None:
            continue
        c = tokens(t)
        if not c:
            continue
        starts.append(len(n))
        doc.extend([len(owners)] * len(c))
        owners.append(i)
        n.extend(c.values())
        rows.extend([index.setdefault(w, len(index)) for w in c])
    if not owners:
        return pred, score, sets
    like = model.words(list(index))[np.asarray(rows)].astype(np.float64)
    p = np.exp((like - like.max(1, keepdims=True)) * 4)  # a word carries about four independent n-grams
    p = np.maximum(p, 1e-6)
    n, doc, starts = np.asarray(n, np.float64), np.asarray(doc), np.asarray(starts)
    size = np.add.reduceat(n, starts)
    on = np.ones((len(owners), len(model.langs)), bool)
    w, best = _mix(p, n, doc, starts, on, size)
    cost = PENALTY * np.log(size + 1)
    live = np.ones(len(owners), bool)
    for _ in range(len(model.langs) - 1):
        least = np.where(on, w, np.inf).argmin(1)
        trial = on.copy()
        can = live & (on.sum(1) > 1)
        trial[can, least[can]] = False
        w2, like2 = _mix(p, n, doc, starts, trial, size)
        live = can & (best - like2 < cost)
        if not live.any():
            break
        on[live], w[live], best[live] = trial[live], w2[live], like2[live]
    top = w.argmax(1)
    for k, i in enumerate(owners):
        pred[i], score[i] = model.langs[top[k]], min(1.0, float(w[k, top[k]]))
        sets[i] = {model.langs[j]: float(w[k, j]) for j in np.flatnonzero(on[k])}
    return pred, score, sets


def language_column(model: Model, text: Column, spark: SparkSession, block: int = 256) -> Column:
    """struct<lang_pred, score, languages> of a text column."""
    shared = spark.sparkContext.broadcast(model)  # SLOTS x languages float32

    @F.pandas_udf("lang_pred string, score double, languages map<string,double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            texts = b.tolist()
            parts = [infer(texts[at : at + block], m) for at in range(0, len(texts), block)]
            yield pd.DataFrame({"lang_pred": [x for p in parts for x in p[0]], "score": np.concatenate([p[1] for p in parts]) if parts else [], "languages": [x for p in parts for x in p[2]]})

    return run(text)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, languages map) for every row."""
    found = docs.select(F.col(id_col).alias("doc_id"), language_column(model, F.col(text_col), docs.sparkSession).alias("_l"))
    return found.select("doc_id", "_l.lang_pred", "_l.score", "_l.languages")


def with_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows of no language or of none that makes up ``least`` of the text."""
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    found = docs.select(row, language_column(model, F.col("text"), docs.sparkSession).alias("found"))
    return found.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")


def op6_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    out = predict(docs, model)
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language_mixture": op6_language_mixture}
ORACLE: dict[str, str] = {}
