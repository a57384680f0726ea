"""Approximate nearest neighbours by multi-index hashing.

Vectors become binary codes: the signs of their principal components after a rotation
learned by iterative quantisation.  Codes are split into substrings, each a table of its
own: rows are keyed by (table, substring value) and a query probes, per table, all values
within ``radius // tables`` bit flips of its own substring.  Neighbouring values share a page
of about ``GROUP_ROWS`` rows, as long as values have fewer.  By the pigeonhole principle
that meets every code within ``radius``.  A pair that meets in several tables is compared
in the first; codes within the radius are reranked by the cosine of the original vectors
in double precision.

The rotation is learned on at most ``TRAIN_ROWS`` vectors (smallest seeded id hash first,
the only bound).  The radius is the least that holds the wanted share of the true
neighbours of ``RADIUS_QUERIES`` of these vectors among all rows, so it shrinks as rows get
denser.  All rows are indexed: equal vectors once, with the ``k`` + 1 smallest of their ids,
which is all that a list of ``k`` can hold of them, and equal queries are asked once.  A row
is copied once a table and a query once a page that it probes; pages with more rows are dealt
to groups of about ``GROUP_ROWS``, each of which its probes meet.  Substrings get longer with the rows.
A query that meets too few rows asks again with twice the radius, up to the whole code.

Handling: null, zero and non-finite vectors, vectors with null components, those of
another length than the most common one and rows without an id take no part; ties go to
the smaller id; repeated ids are rows of their own, as candidates and as queries (a query
leaves out one row of its id and vector); an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, cut

TRAIN_ROWS, RADIUS_QUERIES = 8_000, 300
BITS = 64
WANTED = 0.985
GROUP_ROWS = 4_096
LONG_CODES = 1 << 22  # rows from which substrings have 16 bits instead of 8
QUERY_BLOCK = 256  # queries compared at once with a group


def usable(df: DataFrame, vec_col: str) -> DataFrame:
    """Rows whose vector is finite, complete and not zero."""
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(fine, F.lit(False)))


class Coder:
    """Mean and rotation; ``codes`` gives BITS bits as BITS // 8 bytes."""

    def __init__(self, mean: np.ndarray, turn: np.ndarray):
        self.mean, self.turn = mean, turn

    def codes(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.packbits((unit - self.mean) @ self.turn > 0, axis=1)


def learn(x: np.ndarray) -> Coder:
    """Fit on sampled vectors (rows of ``x``)."""
    rng = np.random.RandomState(3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = unit.mean(0)
    _, _, axes = np.linalg.svd(unit - mean, full_matrices=False)
    axes = axes[:BITS].T
    if axes.shape[1] < BITS:  # fewer dimensions than bits: random directions fill up
        axes = np.hstack([axes, rng.randn(axes.shape[0], BITS - axes.shape[1])])
    z = (unit - mean) @ axes
    turn = np.linalg.qr(rng.randn(BITS, BITS))[0]
    for _ in range(30):
        u, _, vt = np.linalg.svd(np.sign(z @ turn).T @ z)
        turn = vt.T @ u.T
    return Coder(mean, axes @ turn)


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def radius_of(index: DataFrame, asked: np.ndarray, codes: np.ndarray, k: int, wanted: float) -> int:
    """Least radius that holds ``wanted`` of the ``k`` nearest other vectors of ``asked`` among all of ``index``."""
    unit = unit_rows(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.stack(b["v"].to_numpy()).astype(np.float64)
            cos = unit @ unit_rows(x).T
            cos[(cos > 1 - 1e-12)] = -2  # the vector itself
            top = np.argpartition(-cos, min(k, cos.shape[1]) - 1, axis=1)[:, :k]
            far = np.bitwise_count(codes[:, None] ^ b["code"].to_numpy().view(np.uint64)[top])
            q = np.repeat(np.arange(len(asked)), top.shape[1])
            yield pd.DataFrame({"q": q, "far": far.ravel().astype(np.int32), "cos": np.take_along_axis(cos, top, 1).ravel()})

    near = index.select("v", "code").mapInPandas(run, "q int, far int, cos double").where("cos > -2")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("cos"), "far"))
    # k rows for each of at most RADIUS_QUERIES
    far = near.withColumn("r", rank).where(F.col("r") <= k).select("far").toPandas()["far"]
    return int(np.quantile(far, wanted, method="higher")) if len(far) else BITS


def masks(width: int, flips: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``flips`` set."""
    x = np.arange(1 << width, dtype=np.int64)
    return x[np.bitwise_count(x) <= flips]


def _search(key: tuple, rows: pd.DataFrame, asks: pd.DataFrame, radius: int, tables: int, k: int) -> pd.DataFrame:
    """Per query of a group its ``k`` + 1 nearest rows, of pairs within ``radius`` that meet in no earlier table."""
    found: list[tuple] = []
    width, table = BITS // tables, int(key[0])
    low = np.uint64((1 << width) - 1)
    if len(rows) and len(asks):
        x, code, ids = np.stack(rows["v"].to_numpy()).astype(np.float64), rows["code"].to_numpy().view(np.uint64), rows["ids"].to_numpy()
        norm = np.sqrt((x * x).sum(1))
        unit = x / norm[:, None]
        for at in range(0, len(asks), QUERY_BLOCK):
            part = asks.iloc[at : at + QUERY_BLOCK]
            qx, own, names = np.stack(part["v"].to_numpy()).astype(np.float64), part["code"].to_numpy().view(np.uint64), part["q"].to_numpy()
            differ = own[:, None] ^ code[None, :]
            meets = np.bitwise_count(differ) <= radius
            meets &= np.bitwise_count((differ >> np.uint64(width * table)) & low) <= radius // tables
            for t in range(table):
                meets &= np.bitwise_count((differ >> np.uint64(width * t)) & low) > radius // tables
            cos = np.where(meets, (qx / np.sqrt((qx * qx).sum(1))[:, None]) @ unit.T, -2)
            if cos.shape[1] > k + 1:  # the best by rounded cosine and all that come close
                edge = np.partition(cos, cos.shape[1] - k - 1, axis=1)[:, cos.shape[1] - k - 1]
                meets &= cos >= edge[:, None] - 1e-9
            for i, near in enumerate(map(np.flatnonzero, meets)):
                if len(near):
                    v = qx[i]
                    exact = (x[near] * v).sum(1) / (norm[near] * np.sqrt((v * v).sum()))
                    same = (differ[i, near] == 0) & (x[near] == v).all(1)
                    hits = [(-c, j, bool(e)) for r, c, e in zip(near, exact.tolist(), same) for j in ids[r]]
                    found += [(names[i], *hit) for hit in sorted(hits)[: k + 1]]
    return pd.DataFrame(found, columns=["q", "far", "vec_id", "same"])


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", wanted: float = WANTED) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found among ``base``, without its own row."""
    spark = base.sparkSession
    kind = base.schema[id_col].dataType.simpleString()
    out = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", base.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    element = base.schema[vec_col].dataType.elementType.simpleString()
    cast = f"array<{element if element == 'float' else 'double'}>"

    def read(df: DataFrame) -> DataFrame:
        return usable(df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(cast).alias("v")), "v").where("id is not null")

    rows = read(base)
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if size is None:
        return spark.createDataFrame([], out)
    fits = F.size("v") == size["d"]
    place = F.row_number().over(W.partitionBy("v").orderBy("id"))
    few = rows.where(fits).withColumn("_r", place).where(F.col("_r") <= k + 1)
    classes = cut(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-classes")
    asks = cut(read(queries).where(fits).withColumn("row", F.monotonically_increasing_id()), "ann-queries")
    sample = bounded_sample(classes.select("v", F.get("ids", F.lit(0)).alias("id")), "id", TRAIN_ROWS).toPandas()
    known = np.stack(sample["v"].to_numpy()).astype(np.float64)
    coder = learn(known)

    def encode(df: DataFrame, extra: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.stack(b["v"].to_numpy()).astype(np.float64) if len(b) else np.zeros((0, size["d"]))
                yield b.assign(code=coder.codes(x).view(np.int64).ravel())

        return df.mapInPandas(run, f"v {cast}, {extra}, code long")

    index = cut(encode(classes.select("v", "ids"), f"ids array<{kind}>"), "ann-index")
    n = index.count()
    asked = known[:RADIUS_QUERIES]
    radius = radius_of(index, asked, coder.codes(asked).view(np.uint64).ravel(), k, wanted)
    tables = 4 if n >= LONG_CODES else 8
    width = BITS // tables

    shift = max(0, width - int(np.ceil(np.log2(max(1, n / GROUP_ROWS)))))  # low bits of a value that its page holds

    def page(j: int) -> Column:
        return F.shiftrightunsigned("code", width * j + shift).bitwiseAND(F.lit((1 << (width - shift)) - 1))

    pages = F.array(*[F.struct(F.lit(j).alias("t"), page(j).alias("page")) for j in range(tables)])
    entries = index.withColumn("e", F.explode(pages)).select("e.t", "e.page", "v", "ids", "code")
    # at most tables * 2**width rows
    counts = cut(entries.groupBy("t", "page").agg(F.ceil(F.count(F.lit(1)) / (2 * GROUP_ROWS)).cast("int").alias("groups")), "ann-pages")
    entries = entries.join(F.broadcast(counts), ["t", "page"]).withColumn("part", F.pmod(F.xxhash64("v"), "groups").cast("int"))
    entries = entries.select("t", "page", "part", "ids", "code", "v")

    def search(radius: int, distinct: DataFrame) -> DataFrame:
        """(q, top): at most k + 1 rows of each query vector, nearest first."""
        used = tables if radius < BITS else 1  # with all values probed, one table meets all rows
        near = np.unique(masks(width, radius // tables) >> shift)

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for j in range(used):
                    for at in range(0, len(b), 256):
                        part = b.iloc[at : at + 256]
                        own = (part["code"].to_numpy().view(np.uint64) >> np.uint64(width * j) & np.uint64((1 << width) - 1)).astype(np.int64) >> shift
                        many = part.loc[part.index.repeat(len(near))].reset_index(drop=True)
                        yield many.assign(t=j, page=(own[:, None] ^ near).ravel())[["t", "page", "q", "code", "v"]]

        probes = distinct.select("q", "code", "v").mapInPandas(probe, f"t int, page long, q long, code long, v {cast}")
        probes = probes.join(F.broadcast(counts), ["t", "page"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        run = lambda key, r, a: _search(key, r, a, radius, tables, k)
        hits = entries.groupBy("t", "page", "part").cogroup(probes.groupBy("t", "page", "part")).applyInPandas(run, f"q long, far double, vec_id {kind}, same boolean")
        # at most k + 1 of a group for each query
        best = F.row_number().over(W.partitionBy("q").orderBy("far", "vec_id"))
        hits = hits.withColumn("_r", best).where(F.col("_r") <= k + 1)
        return hits.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("far", "vec_id", "same"))).alias("top"))

    distinct = cut(asks.select("v").distinct().withColumn("q", F.monotonically_increasing_id()), "ann-vectors")
    rest = cut(encode(distinct.select("v", "q"), "q long"), "ann-codes")
    total = index.select(F.least(F.sum(F.size("ids")), F.lit(k + 1))).first()[0] or 0
    done: DataFrame | None = None
    while True:
        found = cut(search(radius, rest), "ann-found")
        enough = found.where(F.size("top") >= total) if radius < BITS else found
        done = enough if done is None else done.unionByName(enough)
        rest = cut(rest.join(enough.select("q"), "q", "left_anti"), "ann-rest")
        if radius >= BITS or rest.isEmpty():
            break
        radius = min(BITS, 2 * max(radius, tables))
    # each query leaves out one row of its own id and vector
    lists = asks.join(distinct, "v").select("row", "q", F.col("id").alias("query_id")).join(done, "q")
    own = F.array_position(F.transform("top", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("top", lambda x, i: i + 1 != own), 1, k)
    each = lists.select("query_id", F.posexplode(others).alias("p", "x"))
    return each.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op5_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op5_multi_index_hashing": op5_multi_index_hashing}
ORACLE: dict[str, str] = {}
