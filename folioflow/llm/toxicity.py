"""Toxicity by compression distance.

zstandard trains two dictionaries, one on windows of ordinary documents and one on telling
snippets of toxic documents.  A text is cut into windows of ``WINDOW`` words; a window is
suspicious when the ordinary and the toxic dictionary together compress it into fewer bytes
than the ordinary one alone does.  Snippets are the occurrences of words and pairs of words
that are, or begin with, a unit with at least ``RATIO`` times as large a share of the toxic
documents as of the ordinary ones, and that follows several different words, which keeps out
passages that copies share.  A toxic dictionary of whole windows tells far less, as toxic
documents are ordinary text for the most part; README has the figures.  Thresholds are
calibrated on sampled documents that the dictionaries have not seen.

The model is fitted on at most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled documents
(smallest seeded id hash first): three fifths of either kind train the dictionaries, of a longer text
``EXCERPT`` words in runs spread over all of it; the others are scored whole by Spark's tasks and calibrate.
These are the only bounds; every whole text is scored.  Scores are made of any fit, however few the
labels; who drops documents asks :func:`rejection` where the evidence suffices.

Handling: null and blank texts have one empty window and are scored like any other;
null labels are not learned from; without a label of both kinds every score is 0; a single toxic label
trains and calibrates; without a telling unit whole windows train the toxic dictionary; samples too few
for zstandard's trainer are themselves the dictionary; of training rows with one id one counts; repeated rows are scored one by one; an empty table gives an empty
result; other columns are carried or ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, cut, held_out

TOXIC_ROWS, ORDINARY_ROWS = 2_000, 4_000
WINDOW = 10
LEVEL = 3
ORDINARY_BYTES, TOXIC_BYTES = 49_152, 8_192
SAMPLES = 40_000
CONTEXTS, CONTEXT_SHARE = 3, 0.005
RATIO = 20
BEGINNINGS = (4, 5, 6)  # bytes of word beginnings that count like words
THRESHOLD = 0.3
TRAINING_SHARE = 0.6
EXCERPT, RUN = 4_000, 200  # words of a text that train, and of one run of them
PRECISION, DOUBT = 0.7, 2.0  # of the documents rejected so many are toxic, with so many more that are not


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)] or [b""]


@lru_cache(maxsize=4)
def _compressor(data: bytes):
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress


class Model:
    """The two dictionaries, the calibration, and the score from which documents may be dropped."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, reject: float = float("inf")):
        self.ordinary, self.toxic, self.weights, self.mean, self.scale, self.reject = ordinary, toxic, weights, mean, scale, reject

    def features(self, words: list[bytes]) -> list[float]:
        a, b = _compressor(self.ordinary), _compressor(self.toxic)
        gain = np.sort(np.fromiter((len(a(w)) - len(b(w)) for w in windows(words)), np.float64))
        big = gain[gain >= 3]
        top = gain[-3:]
        return [top[-1], top[-2] if len(top) > 1 else 0.0, top[0] if len(top) > 2 else 0.0, float(np.log1p(big.sum())), float(big.sum() / len(gain)), float(np.log(len(gain)))]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.weights[0] + (rows - self.mean) / self.scale @ self.weights[1:])))


def units(words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(word before, unit) of every word, word beginning and pair of words; words and pairs end in a space."""
    for first, a, b in zip([b"", b"", *words], [b"", *words], words):
        yield a, b + b" "
        for n in BEGINNINGS:
            if n <= len(b):
                yield a, b[:n]
        if a:
            yield first, a + b" " + b + b" "


def toxic_units(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Units in at least ``RATIO`` times as large a share of toxic as of ordinary documents, after enough different words; the most varied last."""
    least = max(CONTEXTS, round(CONTEXT_SHARE * len(toxic)))
    slots = np.zeros(1 << 20, np.int64)  # of hashed units; a unit is counted itself only where its slot has enough documents
    for words in toxic:
        slots[list({zlib.crc32(u) & 0xFFFFF for _, u in units(words)})] += 1
    before: dict[bytes, set[bytes]] = defaultdict(set)
    here, there = Counter(), Counter()
    for words in toxic:
        own = [(a, u) for a, u in units(words) if slots[zlib.crc32(u) & 0xFFFFF] >= least]
        here.update({u for _, u in own})
        for a, u in own:
            before[u].add(a)
    found = {u: len(v) for u, v in before.items() if len(v) >= least and here[u] >= least}
    for words in ordinary:
        there.update({u for _, u in units(words) if u in found})
    return sorted((u for u in found if here[u] * len(ordinary) >= RATIO * there[u] * len(toxic)), key=lambda u: (found[u], u))


def snippets(words: list[bytes], telling: set[bytes]) -> Iterator[bytes]:
    """The words and pairs of a text that are, or begin with, a telling unit."""
    for a, b in zip([b"", *words], words):
        if b + b" " in telling or any(b[:n] in telling for n in BEGINNINGS):
            yield b" " + b + b" "
        if a and a + b" " + b + b" " in telling:
            yield b" " + a + b" " + b + b" "


def dictionary(size: int, samples: list[bytes]) -> bytes:
    """Trained dictionary bytes; the end of the samples' own text where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (b" " * 64 + b"".join(samples))[-size:]


def train(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Bytes of the ordinary dictionary, and of both together, from the words of labelled documents; without a telling unit the toxic windows are told whole."""
    base = [w for words in ordinary for w in windows(words)]
    base = [base[i] for i in np.random.RandomState(7).permutation(len(base))[:SAMPLES]]
    telling = set(toxic_units(toxic, ordinary))
    plain = dictionary(ORDINARY_BYTES, base)
    told = [x for words in toxic for x in snippets(words, telling)] or [w for words in toxic for w in windows(words)]
    return plain, plain + dictionary(TOXIC_BYTES, told)


def calibrate(x: np.ndarray, y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights (weighted to the true ``share`` of label 1, drawn to 0 as by a normal prior), moved so that the best F1 lies at ``THRESHOLD``."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    weight = balance(y, share)
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(beta)) * 0.5
        beta += np.linalg.solve(h, z.T @ (weight * (y - p)) - 0.5 * beta)
    margin = z @ beta
    order = np.argsort(-margin, kind="stable")
    hit, told = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    k = int((2 * hit / (told + (weight * y).sum())).argmax())
    low = margin[order][k + 1] if k + 1 < len(order) else margin[order][k] - 1
    beta[0] += np.log(THRESHOLD / (1 - THRESHOLD)) - (margin[order][k] + low) / 2
    return beta, mean, scale


def balance(y: np.ndarray, share: float) -> np.ndarray:
    """Weights that give label 1 its true ``share``."""
    return np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))


def rejection(scores: np.ndarray, y: np.ndarray, share: float) -> float:
    """The least score of ``THRESHOLD`` or more from which ``PRECISION`` of the documents are toxic, ``DOUBT`` more assumed that are not; inf without one."""
    weight, order = balance(y, share), np.argsort(-scores, kind="stable")
    fine = np.cumsum((weight * y)[order]) >= PRECISION * (np.cumsum(weight[order]) + DOUBT)
    falling = scores[order]
    fine &= np.r_[falling[1:] != falling[:-1], True]  # documents of one score go together
    found = falling[fine & (falling >= THRESHOLD)]
    return float(found.min()) if len(found) else float("inf")


def excerpt(text: str | None) -> list[bytes]:
    """The words of a text that train: all, or ``EXCERPT`` of them in runs at equal distances."""
    words = split_words(text)
    if len(words) <= EXCERPT:
        return words
    starts = np.linspace(0, len(words) - RUN, EXCERPT // RUN).astype(int)
    return [w for at in starts for w in words[at : at + RUN]]


@F.pandas_udf(T.BinaryType())
def excerpts(text: pd.Series) -> pd.Series:
    return pd.Series([b" ".join(excerpt(t)) for t in text], dtype=object)


def features_column(model: Model, text: Column) -> Column:
    """The features of whole texts."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([model.features(split_words(t)) for t in b.tolist()], dtype=object)

    return run(text)


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model | None:
    """``labels`` has doc_id and toxic (0 or 1) of the documents that may be learned from; None without both kinds."""
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = bounded_sample(known.where("toxic = 1"), "doc_id", toxic_rows).unionByName(bounded_sample(known.where("toxic = 0"), "doc_id", ordinary_rows))
    # at most toxic_rows + ordinary_rows ids
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("x"))
    rows = cut(rows.select("doc_id", "x.text", "x.toxic"), "toxicity-sample")
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    own = rows.select("doc_id", "toxic").orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").toPandas()
    if not share or own["toxic"].nunique() < 2:
        return None
    place, many = own.groupby("toxic").cumcount(), own.groupby("toxic")["toxic"].transform("size")
    own["trains"] = (place < TRAINING_SHARE * many) & ((place < many - 1) | (many == 1))
    own["tells"] = ~own["trains"] | (many == 1)
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(own[["doc_id", "trains", "tells"]])), "doc_id")
    seen = rows.where("trains").select("doc_id", "toxic", excerpts("text").alias("words")).orderBy("doc_id").toPandas()
    own_words: dict[bytes, bytes] = {}  # equal words are one object
    words = [[own_words.setdefault(w, w) for w in text.split()] for text in seen.pop("words")]
    ordinary, toxic = train([w for w, t in zip(words, seen["toxic"]) if t == 1], [w for w, t in zip(words, seen["toxic"]) if t == 0])
    model = Model(ordinary, toxic, np.zeros(7), np.zeros(6), np.ones(6))
    told = rows.where("tells").select("doc_id", "toxic", features_column(model, F.col("text")).alias("x")).orderBy("doc_id").toPandas()
    x, y = np.array(told["x"].tolist()).reshape(len(told), 6), told["toxic"].to_numpy(dtype=np.float64)
    model.weights, model.mean, model.scale = calibrate(x, y, float(share))
    model.reject = rejection(model.score(x), y, float(share))
    return model


def score_column(model: Model | None, text: Column) -> Column:
    """Score of a text column; 0 without a model."""
    if model is None:
        return F.lit(0.0)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            x = np.array([model.features(split_words(t)) for t in b.tolist()]).reshape(len(b), 6)
            yield pd.Series(model.score(x))

    return run(text)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    return docs.select(F.col(id_col).alias("doc_id"), score_column(model, F.col(text_col)).alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that a model of the labelled ones scores at its ``reject`` or above."""
    model = fit(docs, labels)
    return docs.where(score_column(model, F.col("text")) < (model.reject if model else 1.0))


def op2_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out("doc_id", 4, 2))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op2_compression_toxicity": op2_compression_toxicity}
ORACLE: dict[str, str] = {}
