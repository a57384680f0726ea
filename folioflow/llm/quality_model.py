"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the text is read and kept as a narrow table.  Trees are
fitted on at most ``TRAIN_ROWS`` labelled rows (smallest seeded id hash first), which
is the only bound; they are complete binary trees stored as flat arrays, so scoring is
``depth`` vectorised numpy steps per tree.

Handling: null text counts as empty and is scored like any other; null labels are not
learned from; repeated rows are scored one by one; with no usable labels every score is
the prior (0.5 when nothing is known); an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, held_out

TRAIN_ROWS = 40_000
BINS, DEPTH, TREES, RATE, PENALTY, LEAST = 64, 4, 60, 0.2, 1.0, 20
THRESHOLD = 0.3
NAMES = ["chars", "words", "word_len", "upper", "digit", "space", "symbol", "mark", "wide", "distinct_words", "top_word", "repeat_next", "lines", "distinct_lines", "line_len", "long_words", "short_words", "deflate", "title_words", "end_marks"]
_UP = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOL = b"#*$%&|<>@^~=+_{}[]\\/"
_MARK = b".,;:!?'\"()-"
_WIDE = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """Numbers of one whole text, in the order of ``NAMES``."""
    b = (text or "").encode("utf-8", "replace")
    n = len(b) or 1

    def share(which: bytes) -> float:
        return (len(b) - len(b.translate(None, which))) / n

    w = b.split()
    k = len(w) or 1
    count = Counter(w)
    sizes = np.fromiter(map(len, w), np.int32, len(w)) if w else np.zeros(1, np.int32)
    lines = [x for x in b.split(b"\n") if x.strip()]
    m = len(lines) or 1
    return [
        float(np.log1p(len(b))), float(np.log1p(len(w))), float(sizes.mean()), share(_UP), share(_DIGIT), share(_SPACE), share(_SYMBOL), share(_MARK), share(_WIDE),
        len(count) / k, max(count.values(), default=0) / k, sum(map(bytes.__eq__, w, w[1:])) / k, float(np.log1p(len(lines))), len(set(lines)) / m, len(b) / m,
        float((sizes > 12).mean()), float((sizes < 3).mean()), len(zlib.compress(b, 1)) / n, sum(x[:1].isupper() for x in w) / k, sum(x[-1:] in (b".", b"!", b"?") for x in w) / k,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<float>), one row per row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["id"], "stats": [np.asarray(statistics(t), np.float32) for t in b["text"].tolist()]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, stats array<float>")


class Trees:
    """Boosted complete trees as arrays: ``feature`` and ``cut`` per inner node, ``value`` per leaf."""

    def __init__(self, prior: float, width: int):
        self.prior, self.width = prior, width
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int32)
        self.cut = np.zeros((0, 2**DEPTH - 1), np.float32)
        self.value = np.zeros((0, 2**DEPTH), np.float64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, at, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > at[node])
            out += value[node - (2**DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Histogram boosting of the logistic loss; deterministic."""
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4) if len(y) else 0.5
    model = Trees(float(np.log(p / (1 - p))), x.shape[1] if len(x) else len(NAMES))
    if len(y) < 2 * LEAST or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin, inner = np.full(len(y), model.prior), 2**DEPTH - 1
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        g, h = q - y, q * (1 - q)
        feature, at, node = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            base, wide = 2**level - 1, 2**level
            best = [(1e-6, 0, np.inf, BINS)] * wide
            own = node - base
            gs, hs, ns = (np.bincount(own, v, wide) for v in (g, h, np.ones(len(y))))
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = own * BINS + binned[:, j]
                gl, hl, nl = (np.bincount(key, v, wide * BINS).reshape(wide, BINS).cumsum(1)[:, : len(e)] for v in (g, h, np.ones(len(y))))
                gain = gl**2 / (hl + PENALTY) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + PENALTY) - (gs**2 / (hs + PENALTY))[:, None]
                gain[(nl < LEAST) | (ns[:, None] - nl < LEAST)] = 0
                k = gain.argmax(1)
                for i in range(wide):
                    if gain[i, k[i]] > best[i][0]:
                        best[i] = (gain[i, k[i]], j, e[k[i]], k[i])
            for i, (_gain, j, c, k) in enumerate(best):
                feature[base + i], at[base + i] = j, c
            bins = np.array([b[3] for b in best])
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > bins[own])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + PENALTY)
        margin += value[leaf]
        model.feature, model.cut, model.value = np.vstack([model.feature, feature]), np.vstack([model.cut, at]), np.vstack([model.value, value])
    return model


def fit_labels(stats: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most ``rows`` labelled documents of ``stats``; ``labels`` has doc_id and ``label`` (0 or 1)."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("y"))
    sample = bounded_sample(stats.join(known, "doc_id"), "doc_id", rows).select("stats", "y").toPandas()
    x = np.stack(sample["stats"].to_numpy()).astype(np.float32) if len(sample) else np.zeros((0, len(NAMES)), np.float32)
    return fit(x, sample["y"].to_numpy(dtype=np.float64))


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """Add ``score``: the probability of label 1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["stats"].to_numpy()).astype(np.float32) if len(b) else np.zeros((0, model.width), np.float32)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": model.probability(x)})

    return stats.mapInPandas(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def op7_boosted_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out("doc_id", 5, 0))
    stats = cut(document_statistics(docs), "quality-stats")
    out = score(stats, fit_labels(stats, labels))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op7_boosted_quality": op7_boosted_quality}
ORACLE: dict[str, str] = {}
