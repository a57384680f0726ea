"""Language-model scoring by deleted interpolation.

A text's tokens are its words (A-Z lowered) and one end token.  The model mixes the
maximum-likelihood estimates of the bigram, the unigram and a uniform word, with
weights that depend on how often the context was seen; expectation-maximisation learns
them on counts of a tenth of the training documents, deleted from the estimates meanwhile.

Counting.  Each partition's rows are cut into chunks in their order, of ``CHUNK_DOCS`` rows or
``CHUNK_BYTES`` of text at most (a longer text is a chunk of its own), and written with their
chunk, so that neither ids nor long texts make a chunk larger and both passes see the same.  Where a text is read, the distinct
unigram and bigram keys of its chunk are counted; packed by key range they are shuffled
once, totalled per range, and the totals go back to each chunk as counts in the order of
the chunk's own sorted keys, which the chunk can compute again, so keys travel one way
only.  A frequent key is one entry a chunk, whatever its frequency.

Keys are hashes of 48 bits or more, within ranges whose number grows with the input; counts
take eight bytes wherever one is beyond four.

Handling: null text is empty and has the end token alone; a null id is scored but not
learned from; repeated rows count and are scored one by one; with no training tokens the
model is uniform; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold

CHUNK_DOCS, CHUNK_BYTES = 2_000, 8 << 20
MOST_BITS = 40  # of the key range
FLUSH_TOKENS = 2_000_000
CACHE_ENTRIES = 200_000
BUCKETS = 24
STEP, BINS = 0.1, 400  # grid of the logarithms of the ratios to the uniform estimate
ROUNDS = 60
LOW48 = np.uint64((1 << 48) - 1)
ADD = 0.1


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


END = xxhash.xxh64_intdigest(b" end ")


def tokenise(text: str | None, hashes: _WordHashes) -> list[int]:
    out = [hashes[w] for w in (text or "").encode("utf-8", "replace").lower().split()]
    out.append(END)
    return out


def _shift(bits: int) -> np.uint64:
    """Bits of a key below its range: 48, or what more than 16 range bits leave of 64."""
    return np.uint64(min(48, 64 - bits))


def keys(tokens: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sortable unigram and bigram keys of documents laid end to end; a document's first context is the end token."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts] = END
    x = before * np.uint64(0x9E3779B97F4A7C15) + tokens
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)

    at = _shift(bits)
    low = (np.uint64(1) << at) - np.uint64(2)

    def key(h: np.ndarray, kind: int) -> np.ndarray:
        return h >> np.uint64(64 - bits) << at | (h & low) | np.uint64(kind)

    return key(tokens, 0), key(x, 1)


def _lay(texts: list[str | None], hashes: _WordHashes) -> tuple[np.ndarray, np.ndarray]:
    each = [tokenise(t, hashes) for t in texts]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    tokens = np.fromiter((x for doc in each for x in doc), np.uint64, int(sizes.sum()))
    return tokens, np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


def _pack(keys_: np.ndarray) -> bytes:
    return np.ascontiguousarray((keys_ & LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    x = np.zeros((len(data) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return x.view("<u8").ravel()


def _put(counts: np.ndarray) -> bytes:
    """Counts as bytes, four each or eight where one is beyond four; the first byte says which."""
    wide = len(counts) and counts.max() >= 1 << 32
    return (b"\x08" if wide else b"\x04") + counts.astype("<u8" if wide else "<u4").tobytes()


def _take(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8" if data[:1] == b"\x08" else "<u4", offset=1).astype(np.int64)


def _chunked(most_rows: int, most_bytes: int):
    """Task function that adds ``chunk`` to rows with ``text`` and ``kept``: unique to the task, by rows and bytes in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 24
        chunk = rows = size = 0
        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for i, n in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
                if rows and (rows >= most_rows or size + n > most_bytes):
                    chunk, rows, size = chunk + 1, 0, 0
                out[i], rows, size = first + chunk, rows + 1, size + n
            out = 2 * out + b.column("kept").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("train"), pa.array(out)], names=["doc_id", "text", "train", "chunk"])

    return run


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int | None = None, size: int | None = None) -> tuple[DataFrame, int]:
    """(doc_id, text, train, chunk) and the bits of the key range.  Chunks 2 k + 1 hold held-out training documents."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = F.coalesce(fold("doc_id", 10) != 0, F.lit(False))
    kept = train & (F.crc32(F.concat(F.lit("held"), F.col("doc_id").cast("string")).cast("binary")) % 10 == 0)
    d = d.withColumns({"train": train, "kept": F.coalesce(kept, F.lit(False))})
    kind = docs.schema[id_col].dataType.simpleString()
    d = cut(d.mapInArrow(_chunked(rows or CHUNK_DOCS, size or CHUNK_BYTES), f"doc_id {kind}, text string, train boolean, chunk long"), "lm-rows", compression="zstd")
    chunks = max(1, d.agg(F.count_distinct(F.floor(F.col("chunk") / 2))).first()[0])
    bits = min(MOST_BITS, max(4, int(np.ceil(np.log2(chunks / 2 + 1)))))
    return d, bits


def count_keys(docs: DataFrame, bits: int) -> DataFrame:
    """(range, chunk, keys, counts): sorted distinct keys of a chunk in a key range, packed, with training counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        tokens_held = 0

        def flush() -> Iterator[pd.DataFrame]:
            for chunk, parts in held.items():
                k, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(k)).astype(np.int64)
                at, low = _shift(bits), (np.uint64(1) << _shift(bits)) - np.uint64(1)
                names, starts = np.unique(k >> at, return_index=True)
                ends = np.append(starts[1:], len(k))
                rows = [(r, chunk, _pack(k[a:b] & low), _put(n[a:b])) for r, a, b in zip(names.astype(np.int64), starts, ends)]
                yield pd.DataFrame(rows, columns=["range", "chunk", "keys", "counts"])
            held.clear()

        for b in batches:
            for chunk, part in b.groupby("chunk", sort=False):
                tokens, starts = _lay(part["text"].tolist(), hashes)
                one, two = keys(tokens, starts, bits)
                learnt = np.repeat(part["train"].to_numpy(dtype=np.float64), np.diff(np.append(starts, len(tokens))))
                k, inverse = np.unique(np.concatenate([one, two]), return_inverse=True)
                held.setdefault(int(chunk), []).append((k, np.bincount(inverse, np.concatenate([learnt, learnt]), len(k))))
                tokens_held += len(tokens)
            if tokens_held > FLUSH_TOKENS:
                yield from flush()
                tokens_held = 0
        yield from flush()

    return docs.select("chunk", "train", "text").mapInPandas(run, "range long, chunk long, keys binary, counts binary")


def total_keys(counted: DataFrame) -> DataFrame:
    """(chunk, range, total, deleted): training totals in the order of the chunk's keys; ``deleted`` is the held-out part.

    A row of chunk -1 per range holds its tokens, distinct words, and both without the held-out documents.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(x) for x in pdf["keys"]]
        k, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(pdf["chunk"].to_numpy(), sizes)
        n = np.concatenate([_take(x) for x in pdf["counts"]]).astype(np.float64)
        # sums of doubles are exact to 2**53
        total = np.bincount(inverse, n, len(k)).astype(np.int64)
        held = np.bincount(inverse, n * (owner % 2 == 1), len(k)).astype(np.int64)
        where, rows, at = int(pdf["range"].iloc[0]), [], np.concatenate([[0], np.cumsum(sizes)])
        for chunk, group in pd.Series(range(len(parts))).groupby(pdf["chunk"].to_numpy()):
            mine = np.unique(np.concatenate([inverse[at[i] : at[i + 1]] for i in group]))
            rows.append((chunk, where, _put(total[mine]), _put(held[mine]) if chunk % 2 else b""))
        words = k % np.uint64(2) == 0
        t, h = total[words], held[words]
        rows.append((-1, where, np.array([t.sum(), (t > 0).sum(), (t - h).sum(), (t > h).sum()], "<i8").tobytes(), b""))
        return pd.DataFrame(rows, columns=["chunk", "range", "total", "deleted"])

    return counted.groupBy("range").applyInPandas(run, "chunk long, range long, total binary, deleted binary")


def _chunk_counts(docs: pd.DataFrame, table: pd.DataFrame, bits: int, column: str = "total"):
    """Token counts of a chunk: starts, unigram, bigram and context counts per token, from ``column`` of ``table``."""
    tokens, starts = _lay(docs["text"].tolist(), _WordHashes())
    one, two = keys(tokens, starts, bits)
    end, _ = keys(np.array([END], np.uint64), np.zeros(1, np.int64), bits)
    k, inverse = np.unique(np.concatenate([one, two]), return_inverse=True)
    order = table.sort_values("range")
    out = []
    for name in [column] if column == "total" else ["total", column]:
        n = np.concatenate([_take(x) for x in order[name]])
        if len(n) != len(k):
            raise ValueError(f"{len(n)} counts came back for {len(k)} keys of a chunk")
        uni, bi = n[inverse[: len(tokens)]], n[inverse[len(tokens) :]]
        ctx = np.empty_like(uni)
        ctx[1:] = uni[:-1]
        ctx[starts] = n[np.searchsorted(k, end[0])]
        out.append((uni, bi, ctx))
    return starts, out


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0), BUCKETS - 1).astype(np.int64)


def learn_weights(docs: DataFrame, table: DataFrame, bits: int, tokens: int, words: int) -> np.ndarray:
    """Mixture weights (buckets x bigram, unigram, uniform) by EM on the held-out documents.

    What EM needs of a token is its context bucket and the ratios of two estimates to the
    uniform one; tokens are counted on a fixed grid of these, so the table is bounded.
    """
    odd = docs.where("chunk % 2 = 1").select("chunk", "text")
    own = table.where("chunk % 2 = 1 and chunk >= 0")

    def run(d: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "x", "y", "n"]
        if not len(d) or not len(t):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
        _, (whole, gone) = _chunk_counts(d, t, bits, "deleted")
        uni, bi, ctx = (a - b for a, b in zip(whole, gone))

        def place(p: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore"):
                return np.where(p > 0, np.clip(np.log(p * (words + 1)) / STEP + BINS / 2, 1, BINS - 1), 0).astype(np.int64)

        b, x, y = _bucket(ctx), place(bi / np.maximum(ctx, 1)), place(uni / max(tokens, 1))
        cell, n = np.unique((b * BINS + x) * BINS + y, return_counts=True)
        return pd.DataFrame({"bucket": cell // BINS // BINS, "x": cell // BINS % BINS, "y": cell % BINS, "n": n})

    cells = odd.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInPandas(run, "bucket long, x long, y long, n long")
    got = cells.groupBy("bucket", "x", "y").agg(F.sum("n").alias("n")).toPandas()
    out = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))

    def ratio(v: pd.Series) -> np.ndarray:
        return np.where(v > 0, np.exp((v - BINS / 2 + 0.5) * STEP), 0.0)

    for b, part in got.groupby("bucket"):
        p = np.stack([ratio(part["x"]), ratio(part["y"]), np.ones(len(part))], 1)
        n = part["n"].to_numpy(dtype=np.float64)
        for _ in range(ROUNDS):
            r = p * out[b]
            out[b] = ((r / r.sum(1, keepdims=True)) * n[:, None]).sum(0) / n.sum()
            out[b] = np.maximum(out[b], 1e-6) / np.maximum(out[b], 1e-6).sum()
    out[0] = [0, *(out[0, 1:] / out[0, 1:].sum())]  # an unseen context has no bigram estimate
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row."""
    d, bits = prepare(docs, id_col, text_col, chunk_rows)
    table = cut(total_keys(count_keys(d, bits)), "lm-table")
    # one row per key range
    facts = [np.frombuffer(bytes(r["total"]), "<i8") for r in table.where("chunk = -1").select("total").collect()]
    tokens, words, kept_tokens, kept_words = (int(x) for x in (np.sum(facts, 0) if facts else np.zeros(4)))
    weights = learn_weights(d, table, bits, kept_tokens, kept_words)

    def run(batch: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        columns = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
        if not len(batch):
            return pd.DataFrame({c: pd.Series(dtype="float64") for c in columns})
        starts, [(uni, bi, ctx)] = _chunk_counts(batch, t, bits)
        w = weights[_bucket(ctx)]
        p = w[:, 0] * bi / np.maximum(ctx, 1) + w[:, 1] * uni / max(tokens, 1) + w[:, 2] / (words + 1)
        base = np.log10((uni + ADD) / (tokens + ADD * (words + 1)))
        total = lambda v: np.add.reduceat(v, starts)
        return pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "n_tokens": np.diff(np.append(starts, len(uni))), "n_known": total((uni > 0).astype(np.int64)), "base_score": total(base), "score": total(np.log10(p))})

    kind = d.schema["doc_id"].dataType.simpleString()
    rows = d.select("chunk", "doc_id", "text").groupBy("chunk").cogroup(table.where("chunk >= 0").select("chunk", "range", "total").groupBy("chunk"))
    out = rows.applyInPandas(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    held = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op9_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).drop("perplexity")


QUERIES = {"op9_deleted_interpolation": op9_deleted_interpolation}
ORACLE: dict[str, str] = {}
