"""Near-duplicates by MinHash with tensored banding.

Two collections of ``TABLES`` short signatures (``ROWS`` minhashes each) are computed per
document; every pair of one signature from either collection is a table key, so
2 * TABLES * ROWS minhashes serve TABLES**2 tables.  Texts with one shingle set are one
class from the start.  Only signatures that some other class shares are combined, so a
class unlike all others makes no key.

Within a bucket, classes are compared with a few pivots at a time and only across
components: what is linked already needs no further comparison, so a large group costs
about its size, while each pair of a bucket is either compared on the full shingle sets or
known to be connected.  A pair is made in the first bucket that its two signature arrays
share, and in no other, and only if both arrays agree in ``AGREE`` places at least.

At the threshold of 0.8 (0.512 a place) a linked pair shares no table with probability
2 * 0.488**TABLES, 0.0002 here, and agrees in fewer than ``AGREE`` of the 2 * TABLES places
with 0.00002.

Handling: null and blank texts have no shingles and link with nothing, nor do rows with a
null id, which are kept; rows that share an id count as one document, so their texts are linked, whatever
they are (but those without shingles); repeated rows stay rows of :func:`near_duplicates`; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut

TABLES, ROWS = 13, 3
AGREE = 4  # of 2 * TABLES signatures
PERCENT = 80
CACHE_ENTRIES = 200_000
PIVOTS = (32, 512, 4096)
BITMAP = 8  # longs
BUCKET_ROWS = 50_000  # rows of a bucket that one task compares with its pivots
BLOCK = 256  # shingles hashed at once, so that the block stays in cache
PARTNERS = 1_000  # candidates of one class that are verified in one group
IDS = 1_000_000  # ids that are broadcast at most; beyond that texts are shuffled to them


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a whole text, A-Z lowered."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    k = min(width, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, np.uint64)
    for i in range(k):
        s = _scrambled(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(s)


def digest(s: np.ndarray) -> list[int]:
    """Two longs that name a shingle set."""
    return np.frombuffer(xxhash.xxh128_digest(s.tobytes()), np.int64).tolist()


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 * TABLES signatures of ROWS minhashes each."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), BLOCK):
        h = x[None, at : at + BLOCK] * a[:, None]
        h += b[:, None]
        h ^= h >> np.uint32(15)
        np.minimum(low, h.min(1), out=low)
    parts = low.reshape(-1, ROWS).astype(np.uint64)
    out = np.arange(len(parts), dtype=np.uint64)
    for r in range(ROWS):
        out = _scrambled(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return out


def signatures(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): d1 and d2 name the shingle set, sig holds both collections."""
    rng = np.random.RandomState(5)
    n = 2 * TABLES * ROWS
    a = rng.randint(0, 2**31 - 1, n, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.randint(0, 2**32 - 1, n, dtype=np.int64).astype(np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"].tolist(), batch["text"].tolist()):
                s = shingles(text, width, hashes)
                if len(s):
                    rows.append((doc, len(s), *digest(s), _signature(s, a, b).view(np.int64)))
                else:
                    rows.append((doc, 0, 0, 0, np.zeros(0, np.int64)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "d1", "d2", "sig"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, n_shingles long, d1 long, d2 long, sig array<long>")


def shingle_sets(docs: DataFrame, width: int, text_col: str = "text") -> DataFrame:
    """(d1, d2, shingles array<long>, bits array<long>): ``bits`` marks the slots that shingles fall into."""

    def bitmap(s: np.ndarray) -> np.ndarray:
        slots = np.zeros(64 * BITMAP, np.uint8)
        slots[s % np.uint64(64 * BITMAP)] = 1
        return np.packbits(slots).view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for batch in batches:
            each = [shingles(t, width, hashes) for t in batch["text"].tolist()]
            names = np.array([digest(s) for s in each], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"d1": names[:, 0], "d2": names[:, 1], "shingles": [s.view(np.int64) for s in each], "bits": [bitmap(s) for s in each]})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(run, "d1 long, d2 long, shingles array<long>, bits array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id each end of ``edges`` (a, b) can reach, by label passing and jumping."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.distinct(), "dedup-edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "dedup-labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("near"))
        step = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        step = cut(step, "dedup-labels")
        labels = step.select("id", "label")
        if step.where(F.col("label") < F.col("old")).isEmpty():
            return labels


def _starred(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b) that connect the same ids: each ``b`` keeps its smallest ``a``, which is tied to the others in its place."""
    ends = edges.select(F.min("a").over(W.partitionBy("b")).alias("m"), "a", "b")
    own, ties = ends.select(F.col("m").alias("a"), "b"), ends.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.unionByName(ties).distinct()


def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
    """(id, label) after the links ``found`` (a, b): only the components that they touch are joined, each as one id.

    The members of a group of copies have many links to its pivots; they are reduced to stars before labels are passed.
    """
    end = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"_{c}"))
    a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    tops = found.join(end("a"), "a", "left").join(end("b"), "b", "left").select(a.alias("a"), b.alias("b")).where("a <> b")
    joined = cut(components(_starred(_starred(tops))), "dedup-joined")
    named = joined.select(F.col("id").alias("label"), F.col("label").alias("_top"))
    old = labels.join(named, "label", "left").select("id", F.coalesce("_top", "label").alias("label"))
    return cut(old.unionByName(joined.join(labels, "id", "left_anti").select("id", "label")), "dedup-labels")


def _shared(classes: DataFrame) -> DataFrame:
    """(cid, n, x, y): the signatures of either collection, with their places, that another class has too; both not empty."""
    each = classes.select("cid", "n", F.posexplode("sig").alias("place", "v"))
    shared = each.groupBy("place", "v").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("place", "v")
    own = each.join(shared, ["place", "v"], "left_semi").groupBy("cid", "n").agg(F.collect_list(F.struct("place", "v")).alias("s"))
    first, second = F.filter("s", lambda x: x["place"] < TABLES), F.filter("s", lambda x: x["place"] >= TABLES)
    return own.select("cid", "n", first.alias("x"), second.alias("y")).where((F.size("x") > 0) & (F.size("y") > 0))


def _buckets(shared: DataFrame, *more: str) -> DataFrame:
    """A row per pair of shared signatures: key, i of the first and j of the second collection, cid, n and ``more``."""
    rows = shared.select("cid", "n", *more, "y", F.explode("x").alias("x")).select("cid", "n", *more, "x", F.explode("y").alias("y"))
    i, j = F.col("x.place"), F.col("y.place") - TABLES
    return rows.select(F.xxhash64("x.place", "y.place", "x.v", "y.v").alias("key"), i.alias("i"), j.alias("j"), "cid", "n", *more)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` of classes with the label of their component, their own id where they have no link."""
    named = labels.select(F.col("id").alias("cid"), F.col("label").alias("_l"))
    return rows.join(named, "cid", "left").withColumn("label", F.coalesce("_l", "cid")).drop("_l")


def _mixed(rows: DataFrame) -> DataFrame:
    """Labelled bucket rows without the buckets that lie in one component."""
    mixed = rows.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("key")
    return rows.join(mixed, "key", "left_semi")


def links(classes: DataFrame, tied: DataFrame, docs: DataFrame, width: int, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label) of the components among ``classes`` (cid, doc_id, n, d1, d2, sig) that ``tied`` pairs (a, b) and verified links make."""
    shared, sigs = cut(_shared(classes), "dedup-shared"), classes.select("cid", "sig")
    some = shared.count()
    named = classes.join(broadcast_if_small(shared.select("cid"), some, IDS), "cid", "left_semi").select("cid", "doc_id", "d1", "d2")
    named = cut(named, "dedup-named")
    ids = broadcast_if_small(named.select("doc_id").distinct(), some, IDS)
    # a text that has the id of a wanted class, and its digest too
    sets = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(ids, "doc_id", "left_semi")
    classes = broadcast_if_small(named.select(F.col("cid").alias("doc_id"), "d1", "d2"), some, IDS)
    sets = shingle_sets(sets, width).join(classes, ["d1", "d2"]).drop("d1", "d2")
    sets = cut(sets.dropDuplicates(["doc_id"]), "dedup-sets")

    def verify(cand: DataFrame) -> DataFrame:
        """The linked ones of ``cand`` (a, b); partners of one ``a`` are dealt to groups of about ``PARTNERS``."""
        many = cand.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("parts")).where("parts > 1")
        many = cut(many, "dedup-hubs")
        many = broadcast_if_small(many, many.count(), IDS)
        parts = F.coalesce("parts", F.lit(1))
        x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")).join(many, "a", "left")
        x = x.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        dealt = cand.join(many, "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts).cast("int")).drop("parts")
        both = dealt.join(x, ["a", "part"]).join(y, "b").withColumn("_common", F.size(F.array_intersect("sa", "sb")).cast("long"))
        return both.where(100 * F.col("_common") >= percent * (F.size("sa") + F.size("sb") - F.col("_common"))).select("a", "b")

    # no link can have more common shingles than either side shares with any other class
    most = F.least("e", "e2")
    fits = 100 * most >= percent * (F.col("n") + F.col("n2") - most)
    # the bucket is the first that both signature arrays share, and enough places agree
    same = F.zip_with("sig", "p_sig", lambda x, y: x == y)
    half = lambda k: F.array_position(F.slice(same, k * TABLES + 1, TABLES), True) - 1
    once = (half(0) == F.col("i")) & (half(1) == F.col("j")) & (F.size(F.filter(same, lambda x: x)) >= AGREE)
    # slots marked on one side only bound the difference of two sets from below
    slots = [f"m{k}" for k in range(BITMAP)]
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p_{c}"))) for c in slots), F.lit(0))
    near = apart * (100 + percent) <= (100 - percent) * (F.col("n") + F.col("n2"))

    # one link is enough to join a group: each class is first compared with the smallest of the buckets on the diagonal
    diagonal = _buckets(shared).where("i = j").select("key", "cid")
    least = diagonal.groupBy("key").agg(F.min("cid").alias("a"))
    first = diagonal.join(least, "key").where("cid > a").groupBy(F.col("cid").alias("b")).agg(F.min("a").alias("a"))
    edges = cut(verify(first), "dedup-links").unionByName(tied)
    labels = components(_starred(edges))
    active = cut(_mixed(_buckets(_labelled(shared, labels), "label")).drop("label"), "dedup-buckets")
    active = _shared_sizes(active, sets).where(100 * F.col("e") >= percent * F.col("n"))
    bits = [F.get("bits", F.lit(k)).alias(c) for k, c in enumerate(slots)]
    active = active.join(sigs, "cid").join(sets.select(F.col("doc_id").alias("cid"), *bits), "cid")
    seed = 0
    while True:
        now = _mixed(_labelled(active, labels))
        sizes = now.groupBy("key").agg(F.count(F.lit(1)).alias("_c"))
        share = F.ceil(F.col("_c") / PIVOTS[min(seed, len(PIVOTS) - 1)])
        # about the wanted number of pivots, all of a small bucket, drawn by hash: nothing is ranked
        now = now.join(sizes, "key").withColumn("pivot", F.pmod(F.xxhash64(F.lit(seed), "cid", "key"), share) == 0)
        # rows of a bucket with many are dealt to parts, each of which its pivots meet
        now = now.withColumn("parts", F.ceil(F.col("_c") / BUCKET_ROWS).cast("int")).withColumn("part", F.pmod(F.xxhash64("cid"), "parts").cast("int")).drop("_c")
        now = cut(now, "dedup-round")
        if now.isEmpty():
            return labels
        pivots = now.where("pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", "part", F.col("cid").alias("a"), F.col("n").alias("n2"), F.col("e").alias("e2"), F.col("label").alias("l2"), *[F.col(c).alias(f"p_{c}") for c in ("sig", *slots)])
        # two pivots meet once
        pair = (F.col("label") != F.col("l2")) & (~F.col("pivot") | (F.col("cid") > F.col("a"))) & fits & near & once
        found = cut(now.join(pivots, ["key", "part"]).where(pair).select("a", F.col("cid").alias("b")), "dedup-pairs")
        active = now.where(~F.col("pivot")).drop("pivot", "label", "parts", "part")
        if not found.isEmpty():
            labels = _merged(labels, cut(verify(found), "dedup-links"))
        seed += 1


def _shared_sizes(now: DataFrame, sets: DataFrame) -> DataFrame:
    """``now`` with ``e``: how many of its shingles a class shares with any other class left.

    Links among what is left can only rest on these, so a class below the threshold in
    them is out, as texts are that have only a frequent passage in common with others.
    """
    ids = now.select(F.col("cid").alias("doc_id")).distinct()
    each = sets.join(ids, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("s"))
    alone = each.groupBy("s").agg(F.count(F.lit(1)).alias("_c"), F.min("doc_id").alias("cid")).where("_c = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("_u"))
    e = F.col("n") - F.coalesce("_u", F.lit(0))
    return now.join(alone, "cid", "left").withColumn("e", e).drop("_u")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row."""
    sig = cut(signatures(docs, width, id_col, text_col), "dedup-signatures")
    some = sig.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("n_shingles", "d1", "d2").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
    classes = classes.select(F.monotonically_increasing_id().alias("cid"), "m.doc_id", F.col("n_shingles").alias("n"), "d1", "d2", "m.sig")
    classes = cut(classes, "dedup-classes")
    # an id of several texts ties their classes
    several = some.select("doc_id", "d1", "d2").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("doc_id")
    ends = cut(some.join(several, "doc_id", "left_semi").join(classes.select("cid", "d1", "d2"), ["d1", "d2"]).select("doc_id", "cid").distinct(), "dedup-tied")
    tied = ends.join(ends.groupBy("doc_id").agg(F.min("cid").alias("a")), "doc_id").where("cid > a").select("a", F.col("cid").alias("b"))
    labels = links(classes, tied, docs, width, percent, id_col, text_col)
    named = classes.select("cid", "doc_id", "n", "d1", "d2").join(labels.select(F.col("id").alias("cid"), "label"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    named = cut(named.drop("cid"), "dedup-named")
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    named = named.join(least, "label").select(F.col("n").alias("n_shingles"), "d1", "d2", "least")
    out = sig.drop("sig").join(named, ["n_shingles", "d1", "d2"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; rows without an id stay.

    Of several rows with that id, the one whose columns hash lowest stays, so reruns agree.
    """
    found = near_duplicates(docs, width, percent).where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    # only ids that are dropped or repeated are looked up, so that texts of the others are not shuffled
    other = cut(found.where("not kept or rows > 1"), "dedup-other")
    size = other.count()
    plain = docs.join(broadcast_if_small(other.select("doc_id"), size, IDS), "doc_id", "left_anti")
    repeated = docs.join(broadcast_if_small(other.where("kept").select("doc_id"), size, IDS), "doc_id", "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    one = repeated.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("_first")).select("_first.*")
    return plain.select(*docs.columns).unionByName(one)


def op10_tensored_minhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=4)


QUERIES = {"op10_tensored_minhash": op10_tensored_minhash}
ORACLE: dict[str, str] = {}
