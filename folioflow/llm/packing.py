"""Best-fit packing by minimum bin slack.

Documents become token ids with a closing id 0; longer ones are cut into full
pieces, of which only the first may be shorter.  A bin's fullest filling depends on
lengths alone, so the packing is planned on the histogram of piece lengths, which
has at most ``capacity`` rows whatever the corpus holds: the longest length left
opens a bin, subset-sum dynamic programming over a bitset finds the fullest
combination of the lengths left, and the combination is removed as many times as
the counts allow.  Pieces then take their places by their rank among equal lengths,
ranked in slices so that no length gathers in one task.

Ids are those of the ``tokenizers`` file.  A byte-level BPE works word by word, so ``tiktoken``
encodes whole texts with the file's own pattern and its vocabulary as ranks; texts that hold a
special token or very long white space go to ``tokenizers`` itself.  Tests hold both against each other on odd strings.

Handling: null text is empty and still packs its closing id; repeated rows are
pieces of their own; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

CAPACITY = 2048
END_ID = 0
LONG_BLANK = 50_000
SLICES_PER_LENGTH = 1024
SLICE_ROWS = 1_000_000  # a length of more pieces than its slices hold of these gets more slices


@lru_cache(maxsize=2)
def _encoder(path: str):
    """Function text -> little-endian uint32 bytes of its ids, the same ids as the tokenizer file gives.

    A byte-level BPE works word by word; the words of whole texts are matched and encoded in one call.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    # byte-level files write each byte as one printable character
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(kept))}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    import public_tokenizers

    bpe = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole: list[Tokenizer] = []  # loaded for the rare text that holds a special token, or white space too long for tiktoken's stack

    def encode(text: str) -> bytes:
        if any(s in text for s in special) or (len(text) > LONG_BLANK and re.search(rf"\s{{{LONG_BLANK}}}", text)):
            if not whole:
                whole.append(Tokenizer.from_file(path))
            return np.asarray(whole[0].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.asarray(bpe.encode_ordinary(text), "<u4").tobytes()

    return encode


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, row_col: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), one row per piece; texts stay in their task.

    ``row_col`` names a long column that tells rows of one id apart; it comes along as ``row_id``.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["row_id"] * (row_col is not None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = _encoder(tokenizer), np.asarray([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            own = b["row_id"].tolist() if row_col else [None] * len(b)
            for doc, text, row in zip(b["id"].tolist(), b["text"].tolist(), own):
                ids = encode(text or "") + end
                n = len(ids) // 4
                at, piece = 0, 0
                size = n % capacity or min(n, capacity)
                while at < n:
                    rows.append((doc, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), row)[: len(columns)])
                    at, piece, size = at + size, piece + 1, capacity
            yield pd.DataFrame(rows, columns=columns).astype({"piece": "int32"})

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *([F.col(row_col).cast("long").alias("row_id")] if row_col else []))
    return src.mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", row_id long" * (row_col is not None))


def fullest(room: int, counts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """The fullest filling of ``room`` by ``lengths`` (descending) with ``counts``: (length, how many) pairs.

    Bit s of ``reach`` says that a sum s can be made; counts enter by doubling.
    Among equal sums the one found first, of longer pieces, stays.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    full = 1 << room
    for length in lengths:
        length = int(length)
        if length > room:
            continue
        left, chunk = min(int(counts[length]), room // length), 1
        while left > 0:
            take = min(chunk, left)
            more = (reach | (reach << (length * take))) & mask
            if more != reach:
                steps.append((length, take, reach))
                reach = more
            left -= take
            chunk *= 2
            if reach & full:
                break
        if reach & full:
            break
    best = reach.bit_length() - 1
    out: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not (before >> best) & 1:
            out[length] = out.get(length, 0) + take
            best -= length * take
    return sorted(out.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(filling, how many bins)], from the counts per length."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = []
    while True:
        lengths = np.flatnonzero(counts)[::-1]
        if not len(lengths):
            return out
        longest = int(lengths[0])
        counts[longest] -= 1
        rest = fullest(capacity - longest, counts, lengths[lengths <= capacity - longest]) if longest < capacity else []
        counts[longest] += 1
        used: dict[int, int] = {longest: 1}
        for length, k in rest:
            used[length] = used.get(length, 0) + k
        bins = min(int(counts[length]) // k for length, k in used.items())
        for length, k in used.items():
            counts[length] -= k * bins
        out.append((sorted(used.items(), reverse=True), bins))


def ranked(pieces: DataFrame, slices: int = SLICES_PER_LENGTH) -> DataFrame:
    """Add ``rank``, from 0 among the pieces of one length, dealt to ``slices`` by all a piece is known by, so that null or repeated ids do not meet in one task."""
    p = pieces.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(slices)))
    counts = p.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_slice").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    starts = counts.select(F.col("length").alias("_l"), F.col("_slice").alias("_s"), before.alias("_before"))
    within = F.row_number().over(W.partitionBy("length", "_slice").orderBy("doc_id", "piece", "start", "ids_crc32"))
    p = p.withColumn("_row", within).join(starts, (F.col("length") == F.col("_l")) & (F.col("_slice") == F.col("_s")))
    return p.withColumn("rank", F.col("_before") + F.col("_row") - 1).drop("_slice", "_l", "_s", "_before", "_row")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length``."""
    p = cut(pieces, "pack-pieces")
    # at most ``capacity`` rows, by definition of a length
    hist = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first rank, per bin, first bin, offset)
    given: dict[int, int] = {}
    first = 0
    for used, bins in plan(hist, capacity):
        at = 0
        for length, k in used:
            parts.setdefault(length, []).append((given.get(length, 0), k, first, at))
            given[length] = given.get(length, 0) + k * bins
            at += length * k
        first += bins
    table = {length: np.asarray(rows, dtype=np.int64) for length, rows in parts.items()}
    columns = p.columns

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            lengths, ranks = b["length"].to_numpy(), b["rank"].to_numpy()
            for length in np.unique(lengths):
                rows, own = table[int(length)], np.flatnonzero(lengths == length)
                r = ranks[own]
                t = rows[np.searchsorted(rows[:, 0], r, side="right") - 1]
                seq[own] = t[:, 2] + (r - t[:, 0]) // t[:, 1]
                off[own] = t[:, 3] + (r - t[:, 0]) % t[:, 1] * length
            yield b[columns].assign(sequence_id=seq, offset=off)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema) + ", sequence_id long, offset long"
    slices = max(SLICES_PER_LENGTH, max(hist.values(), default=0) // SLICE_ROWS)
    return ranked(p, slices).mapInPandas(place, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_minimum_bin_slack(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(token_pieces(docs, default_tokenizer()))


QUERIES = {"op4_minimum_bin_slack": op4_minimum_bin_slack}
ORACLE: dict[str, str] = {}
