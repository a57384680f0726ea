"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of a covariance are found without forming it.  A block of orthonormal
vectors Q meets the data in passes that sum XᵀXQ over the centred rows; a Chebyshev recurrence
over such passes damps the spectrum between zero and the smallest Ritz value of the block, QR
makes the block orthonormal again, and Rayleigh-Ritz gives eigenpairs.  This goes on until the
residual of every wanted pair is ``TOLERANCE`` of the largest eigenvalue, or rounding allows no
less.  A smallest Ritz value never exceeds the eigenvalue of its rank, so nothing that is wanted
is damped.

Vectors are quantised to whole numbers (``SCALE`` steps a unit, plus ``SHIFT``), so counts and sums
are exact.  They are packed once into blocks of bytes in the shared folder; a pass reads the
blocks, adds up one matrix a partition, and Spark sums these entry by entry.  The driver sees
d x block numbers a pass, whatever the number of rows.

Handling: a vector that is null or empty, holds null or non-finite entries or entries beyond
``LARGEST``, or has another length than the most common one (ties: the longer) takes no part; rows
with a null id and repeated rows count like any other; with fewer dimensions than wanted
components there are as many as dimensions; a component without variance has a null ``whitened``;
``explained`` is null where nothing varies; ``deviation`` is null where it exceeds a long; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**42  # entries up to here are whole numbers of 53 bits after scaling
COMPONENTS, BLOCK = 8, 32
TOLERANCE, ROUNDING = 1e-13, 1e-10  # of the largest eigenvalue: aimed at, and accepted where no progress is left
MAX_DEGREE, MAX_ROUNDS = 24, 200
SPREAD = np.log(1e10)  # how far one filter may raise the largest eigenvalue above the last wanted one
BLOCK_BYTES = 4 << 20


def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the rows that take part, and their number of dimensions (0 without rows)."""
    v = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.where(F.size("v") == size["d"]), size["d"]) if size else (rows, 0)


def steps(column: pa.Array, d: int) -> np.ndarray:
    """The quantised rows of a list column, without ``SHIFT``."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * SCALE).astype(np.int64)


def pack(rows: DataFrame, d: int) -> DataFrame:
    """Blocks of rows as bytes, in the shortest of three integer types that holds them."""
    size = max(1, BLOCK_BYTES // (8 * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = steps(b.column(0), d)
            for at in range(0, len(x), size):
                part = x[at : at + size]
                kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(part).max() <= np.iinfo(k).max)
                yield pa.RecordBatch.from_pydict({"kind": [kind], "x": [part.astype(kind).tobytes()]})

    return cut(rows.select("v").mapInArrow(run, "kind string, x binary"), "whiten-blocks")


def total(blocks: DataFrame, d: int, shape: tuple[int, int], f: Callable[[np.ndarray], np.ndarray], exact: bool = False) -> np.ndarray:
    """Sum of the matrices ``f`` makes of the blocks: one a partition, then entry by entry."""
    kind = np.int64 if exact else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, kind)
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                out += f(np.frombuffer(x.as_buffer(), k).reshape(-1, d))
        yield pa.RecordBatch.from_pydict({"i": np.arange(out.size), "y": out.ravel()})

    each = blocks.mapInArrow(run, f"i long, y {'long' if exact else 'double'}")
    got = each.groupBy("i").agg(F.sum(F.col("y").cast("decimal(38,0)" if exact else "double")).alias("y")).collect()
    out = np.zeros(shape[0] * shape[1], object if exact else np.float64)
    for r in got:
        out[r["i"]] = int(r["y"]) if exact else r["y"]
    return out.reshape(shape)


def ritz(q: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values (falling), vectors, their images and residual norms of a basis ``q`` with images ``w``."""
    h = q.T @ w
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    q, w = q @ turn, w @ turn
    return values, q, w, np.linalg.norm(w - q * values, axis=0)


def degree(values: np.ndarray, k: int, high: float, worst: float) -> int:
    """Degree of the next filter: as much as the residual still asks for, within ``SPREAD`` and ``MAX_DEGREE``."""
    rise = lambda x: float(np.arccosh(max(1.0, 2 * x / high - 1)))
    last, first = rise(values[k - 1]), rise(values[0])
    wanted = np.log(max(worst / (TOLERANCE * values[0]), 2.0)) / max(last, 1e-3) + 1
    return int(np.clip(min(wanted, SPREAD / max(first - last, 1e-9)), 2, MAX_DEGREE))


def chebyshev(q: np.ndarray, w: np.ndarray, times: Callable[[np.ndarray], np.ndarray], high: float, top: float, m: int) -> np.ndarray:
    """The scaled Chebyshev polynomial of degree ``m`` on [0, ``high``] applied to ``q``, whose image is ``w``."""
    half = high / 2
    sigma = half / (top - half)
    tau = 2 / sigma
    x, y = q, (w - half * q) * (sigma / half)
    for _ in range(m - 1):
        after = 1 / (tau - sigma)
        x, y = y, (times(y) - half * y) * (2 * after / half) - (sigma * after) * x
        sigma = after
    return y


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a positive semidefinite operator and their unit vectors, largest entry positive."""
    q = np.linalg.qr(np.random.RandomState(5).randn(d, min(d, max(BLOCK, 2 * k))))[0]
    best = np.inf
    values, q, w, off = ritz(q, times(q))
    for _ in range(MAX_ROUNDS):
        worst = off[:k].max()
        if worst <= TOLERANCE * values[0] or (worst > best / 2 and best <= ROUNDING * values[0]) or q.shape[1] == d:
            break
        best = min(best, worst)
        high = max(values[-1], 1e-10 * values[0])
        y = chebyshev(q, w, times, high, values[0], degree(values, k, high, worst))
        q = np.linalg.qr(y)[0]
        values, q, w, off = ritz(q, times(q))
    else:
        raise RuntimeError(f"no certified eigenvectors after {MAX_ROUNDS} filters")
    v = q[:, :k]
    return np.maximum(values[:k], 0), v * np.where(v[np.abs(v).argmax(0), np.arange(k)] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What was learned: count, exact sums of the quantised entries without ``SHIFT``, eigenvalues, unit vectors (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def map(self) -> np.ndarray:
        """Columns that take a centred vector to its whitened components; nan for a component without variance."""
        flat = self.values <= 1e-12 * self.values[0]
        return np.where(flat, np.nan, self.vectors / np.sqrt(np.where(flat, 1.0, self.values)))


def learn(rows: DataFrame, d: int, k: int = COMPONENTS) -> Whitening | None:
    """Fit on all ``rows`` (id, v) of ``d`` dimensions; None without rows."""
    if not d:
        return None
    blocks, k = pack(rows, d), min(k, d)
    counted = total(blocks, d, (2, d), lambda x: np.stack([x.sum(0, dtype=np.int64), np.full(d, len(x))]), exact=True)
    n, sums = int(counted[1, 0]), [int(s) for s in counted[0]]
    mean = np.array([s / n for s in sums])

    def times(q: np.ndarray) -> np.ndarray:
        def f(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ q)

        return total(blocks, d, q.shape, f) / n

    trace = float(total(blocks, d, (1, 1), lambda x: np.array([[np.square(x - mean).sum()]]))[0, 0]) / n
    if not trace:
        return Whitening(n, sums, np.zeros(k), np.eye(d)[:, :k], 0.0, 0.0)
    values, vectors = leading(times, d, k)
    out = Whitening(n, sums, values, vectors, trace, 0.0)
    turn = np.nan_to_num(out.map())

    def spread(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ turn
        return y.T @ y

    varies = np.isfinite(out.map()[0])
    out.identity_error = float(np.abs(total(blocks, d, (k, k), spread) / n - np.eye(k))[varies][:, varies].max())
    return out


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 in whole numbers; None beyond a long."""
    far = float(max(np.abs(x).max(), 1)) * n + max(map(abs, sums))
    if far * far * x.shape[1] < 2.0**62:
        return np.square(n * x - np.array(sums, np.int64)).sum(1).tolist()
    each = (sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x)
    return [v if v < 1 << 63 else None for v in each]


def schema(rows: DataFrame, id_name: str) -> T.StructType:
    doubles = [(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    names = [(id_name, rows.schema["id"].dataType), ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), *doubles]
    return T.StructType([T.StructField(*x) for x in names])


def whiten(rows: DataFrame, model: Whitening, d: int, id_name: str) -> DataFrame:
    """One row a vector and component: id, component, n, deviation, whitened, explained, identity_error."""
    mean, turn, k = np.array([s / model.n for s in model.sums]), model.map(), len(model.values)
    parts = [float(e / model.trace) if model.trace else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = steps(b.column(1), d)
            y = ((x - mean) @ turn).ravel()
            columns = {
                "id": b.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                "n": pa.array(np.full(len(y), model.n, np.int64)),
                "deviation": pa.array(exact_deviation(x, model.n, model.sums), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                "whitened": pa.array(y, pa.float64(), mask=np.isnan(y)),
                "explained": pa.array(parts * len(x), pa.float64()),
                "identity_error": pa.array(np.full(len(y), model.identity_error)),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return rows.select("id", "v").mapInArrow(run, schema(rows, "id")).withColumnRenamed("id", id_name)


def whitened(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Fit on all usable vectors of ``df`` and return their whitened components."""
    rows, d = usable(df, id_col, vec_col)
    model = learn(rows, d, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema(rows, id_col))
    return whiten(rows, model, d, id_col)


def op11_chebyshev_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op11_chebyshev_whitening": op11_chebyshev_whitening}
ORACLE: dict[str, str] = {}
