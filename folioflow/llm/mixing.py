"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Words are handed out in equal blocks of at most ``BLOCK`` words, smaller ones where a
source's target would hold fewer than ``LEAST_BLOCKS``.  Sources first receive whole blocks by
highest quotients ``target / (2 k - 1)``, then each source's quota is apportioned
the same way to its shards, which are slices of a source with about equal words.
In a shard the documents lie in seeded order on a ring; a seeded draw picks the
first block and the quota's blocks follow it (a contiguous run of documents in seeded
order), so a document is taken a whole number of times plus at most one part of it.

Handling: null text or size counts 0 words; a null source is a source of its own
that comes last; repeated rows and ids are rows of their own; an empty table gives
an empty result; extra columns pass through, whatever their names, except that
:func:`mix` replaces columns with the names it adds; :func:`mixed_documents` keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, words

SEED = "mix-1"
BLOCK, LEAST_BLOCKS = 64, 16
WEIGHTS = (5, 2, 1)
CAP = 3
ADDED = ["source_size", "target", "taken", "whole_passes", "part_from", "part_words", "head_words"]


def text_size(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def seeded(*parts: Column) -> Column:
    """Non-negative 60-bit number from md5 of the seed and ``parts``; the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights repeat over sources by code point, null last.

    Water level in closed form: sources by rising ``cap * size / weight``; the first
    whose fair share of what is left stays within its cap sets the level for the rest.
    One row per source goes through one task here, never one per document.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    w = w.withColumn("cap_words", F.col("source_size") * cap)
    by = W.orderBy(F.col("cap_words") / F.col("weight"), F.col("source").asc_nulls_last())
    run = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = w.select(
        "*",
        F.row_number().over(by).alias("place"),
        (F.sum("source_size").over(every) - F.sum("cap_words").over(run) + F.col("cap_words")).alias("left_words"),
        (F.sum("weight").over(every) - F.sum("weight").over(run) + F.col("weight")).alias("left_weight"),
    )
    w = w.withColumn("fits", F.col("left_words") * F.col("weight") <= F.col("cap_words") * F.col("left_weight"))
    first = F.min(F.when(F.col("fits"), F.col("place"))).over(every)
    level = F.min(F.when(F.col("fits"), F.struct("place", "left_words", "left_weight"))).over(every)
    target = F.when(F.col("place") < first, F.col("cap_words").cast("double")).otherwise(F.col("weight") * level.left_words.cast("double") / level.left_weight)
    return w.select("source", "source_size", target.alias("target"))


def apportion(df: DataFrame, group: list[str], votes: str, seats: Column, most: Column) -> DataFrame:
    """Add ``quota``: Sainte-Laguë seats of each row within its ``group``, at most ``most``.

    Seats that every divisor near the natural one awards are given outright; only a
    few quotients around each row's share are ranked, so work is linear in the rows.
    """
    part = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    d = df.withColumns({"_seats": seats.cast("long"), "_most": most.cast("long"), "_all": F.sum(votes).over(part), "_n": F.count(F.lit(1)).over(part)})
    share = F.when(F.col("_all") > 0, F.col(votes) / F.col("_all")).otherwise(0.0)
    d = d.withColumn("_fair", share * F.col("_seats")).withColumn("_span", F.ceil(share * F.col("_n") / 2).cast("long") + 3)
    d = d.withColumn("_sure", F.least(F.greatest(F.floor("_fair") - F.col("_span"), F.lit(0)), F.col("_most")).cast("long"))
    d = d.withColumn("_last", F.least(F.ceil("_fair") + F.col("_span"), F.col("_most")).cast("long"))
    d = d.withColumn("_open", F.col("_seats") - F.sum("_sure").over(part))
    keys = [*group, "_key"]
    d = d.withColumn("_key", F.col(d.columns[len(group)]))
    bids = d.where(F.col("_last") > F.col("_sure")).select(*keys, votes, "_open", F.explode(F.sequence(F.col("_sure") + 1, F.col("_last"))).alias("_seat"))
    bids = bids.where(F.col(votes) > 0).withColumn("_quotient", F.col(votes) / (2 * F.col("_seat") - 1))
    rank = F.row_number().over(part.orderBy(F.col("_quotient").desc(), F.col("_key").asc_nulls_last(), "_seat"))
    won = bids.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_open")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    a, b = d.alias("a"), won.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return a.join(b, cond, "left").select(*[F.col(f"a.{c}") for c in df.columns], (F.col("a._sure") + F.coalesce(F.col("b._won"), F.lit(0))).alias("quota"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK) -> DataFrame:
    """``docs`` with its source's size and target, and the words taken from each document.

    ``taken`` counts repeats; it is ``whole_passes`` times the document, then ``part_words``
    words from word ``part_from``, then (where the ring closes) ``head_words`` first words.
    """
    from .common import cut

    kept = [c for c in docs.columns if c not in ADDED]
    row = F.struct(*[F.col(c) for c in kept]).alias("_row")
    rows = docs.select(row, F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("_size"))
    sizes = rows.groupBy(F.col("_src").alias("source")).agg(F.sum("_size").alias("source_size"))
    t = source_targets(cut(sizes, "mix-sizes"), weights, cap)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(every)
    # slices: about 2000 over the corpus, between 50,000 and 5 million words each
    t = t.withColumn("slices", F.greatest(F.lit(1), F.round(F.col("source_size") / F.greatest(F.lit(50_000), F.least(F.lit(5_000_000), total / 2000)))).cast("long"))
    t = t.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.min(F.when(F.col("target") > 0, F.col("target"))).over(every) / LEAST_BLOCKS))).cast("long"))
    t = t.withColumn("block", F.coalesce("block", F.lit(1)))
    t = t.withColumn("seats", F.round(F.sum("target").over(every) / F.col("block")))
    s = apportion(t, [], "target", F.col("seats"), F.ceil(F.col("source_size") * cap / F.col("block")))
    s = cut(s.select(F.col("source").alias("s_src"), "source_size", "target", F.col("slices").alias("_slices"), F.col("quota").alias("_quota"), F.col("block").alias("_block")), "mix-sources")
    rows = rows.join(s, F.col("_src").eqNullSafe(F.col("s_src")), "left").drop("s_src")
    rows = rows.withColumn("_slice", F.pmod(seeded(F.col("_id")), F.col("_slices")))
    cells = rows.groupBy("_src", "_slice").agg(F.sum("_size").alias("_cell"), F.max("_quota").alias("_quota"), F.max("_block").alias("_block"))
    cells = apportion(cells, ["_src"], "_cell", F.col("_quota"), F.ceil(F.col("_cell") * cap / F.col("_block")))
    cells = cells.withColumn("_take", F.least(F.col("quota") * F.col("_block"), F.col("_cell") * cap))
    cells = cells.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("_cell") / F.col("_block"))).cast("long"))
    cells = cells.withColumn("_from", F.pmod(seeded(F.lit("start"), F.col("_src"), F.col("_slice")), F.col("_blocks")) * F.col("_block"))
    cells = cut(cells.select(F.col("_src").alias("c_src"), F.col("_slice").alias("c_slice"), "_cell", "_take", "_from"), "mix-cells")
    order = W.partitionBy("_src", "_slice").orderBy(seeded(F.lit("order"), F.col("_id")), F.col("_id"), F.col("_size")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("_at", F.sum("_size").over(order) - F.col("_size"))
    rows = rows.join(cells, F.col("_src").eqNullSafe(F.col("c_src")) & (F.col("_slice") == F.col("c_slice")), "left")
    passes = F.when(F.col("_cell") > 0, F.floor(F.col("_take") / F.col("_cell"))).otherwise(0).cast("long")
    rows = rows.withColumn("_passes", passes).withColumn("_rest", F.col("_take") - F.col("_passes") * F.col("_cell"))
    end = F.col("_at") + F.col("_size")

    def meets(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, hi) - F.greatest(F.col("_at"), lo)).cast("long")

    first = meets(F.col("_from"), F.col("_from") + F.col("_rest"))
    second = meets(F.col("_from") - F.col("_cell"), F.col("_from") - F.col("_cell") + F.col("_rest"))
    rows = rows.withColumns({"whole_passes": F.col("_passes"), "part_words": first, "head_words": second, "part_from": F.greatest(F.lit(0), F.col("_from") - F.col("_at")).cast("long")})
    rows = rows.withColumn("taken", F.col("_passes") * F.col("_size") + F.col("part_words") + F.col("head_words"))
    return rows.select("_row.*", *ADDED)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: one row per whole pass and one per part taken; columns of ``docs``, ``n_chars`` renewed."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    m = mix(docs.select(row.alias("doc"), F.col("doc_id").alias("id"), F.col("source").alias("src"), text_size(F.col("text")).alias("words")), "id", "src", "words")
    text, size = F.col("doc.text"), F.col("words")
    # texts are cut between words and keep the white space that follows each word
    pieces = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+" + SPACE[:-1] + "*"), F.lit(0))
    parted = ((F.col("part_words") > 0) & (F.col("part_words") < size)) | (F.col("head_words") > 0)
    m = m.withColumn("pieces", F.when(parted, pieces))
    whole = F.when(F.col("whole_passes") > 0, F.array_repeat(text, F.col("whole_passes").cast("int"))).otherwise(F.array().cast("array<string>"))
    part = F.when(F.col("part_words") >= size, F.array(text)).when(F.col("part_words") > 0, F.array(F.array_join(F.slice("pieces", (F.col("part_from") + 1).cast("int"), F.col("part_words").cast("int")), "")))
    part = F.when(size > 0, part)
    head = F.when((F.col("head_words") > 0) & (size > 0), F.array(F.array_join(F.slice("pieces", 1, F.col("head_words").cast("int")), "")))
    none = F.array().cast("array<string>")
    out = m.select("doc", F.explode(F.concat(whole, F.coalesce(part, none), F.coalesce(head, none))).alias("piece"))
    new = {"text": F.col("piece"), "n_chars": F.length("piece").cast("long")}
    return out.select(*[new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op8_sainte_lague_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", text_size(F.col("text")).alias("size"))
    from .common import cut

    out = mix(cut(docs, "mix-docs"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op8_sainte_lague_mix": op8_sainte_lague_mix}


def _seeded_sql(*parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce(cast({p} as varchar), 'null')" for p in parts)
    return f"cast('0x' || substr(md5('{SEED}|' || {joined}), 1, 15) as bigint)"


ORACLE = {
    "op8_sainte_lague_mix": f"""
with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as size from documents),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, ([5, 2, 1])[((row_number() over (order by encode(source) nulls last) - 1) % 3 + 1)::int]::bigint as weight, source_size * 3 as cap_words from s0),
s2 as (select *, row_number() over o as place, (sum(source_size) over ())::bigint - (sum(cap_words) over o)::bigint + cap_words as left_words,
       (sum(weight) over ())::bigint - (sum(weight) over o)::bigint + weight as left_weight from s1
       window o as (order by cap_words::double / weight, encode(source) nulls last rows between unbounded preceding and current row)),
s3 as (select *, left_words * weight <= cap_words * left_weight as fits from s2),
lv as (select place as f, left_words as lw, left_weight as lg from s3 where fits order by place limit 1),
t as (select source, source_size, case when place < f then cap_words::double else weight * lw::double / lg end as target from s3, lv),
t0 as (select *, coalesce(greatest(1, least({BLOCK}, floor(min(target) filter (target > 0) over () / {LEAST_BLOCKS}))), 1)::bigint as block from t),
t1 as (select *, greatest(1, round(source_size / greatest(50000, least(5000000, sum(source_size) over () / 2000)))::bigint) as slices, round(sum(target) over () / block)::bigint as seats from t0),
q1 as (select source, seats, target / (2 * k - 1) as q, k from t1, unnest(range(1, ceil(source_size * 3 / block)::bigint + 1)) as u(k) where target > 0),
w1 as (select source, count(*) as quota from (select *, row_number() over (order by q desc, encode(source) nulls last, k) as r from q1) where r <= seats group by source),
s as (select t1.*, coalesce(w1.quota, 0) as quota from t1 left join w1 on t1.source is not distinct from w1.source),
r0 as (select d.*, s.source_size, s.target, s.quota, s.block, {_seeded_sql("doc_id")} % s.slices as slice from d join s on d.source is not distinct from s.source),
c0 as (select source, slice, sum(size)::bigint as cell, max(quota) as quota, max(block) as block from r0 group by source, slice),
q2 as (select source, slice, quota, cell / (2 * k - 1) as q, k from c0, unnest(range(1, ceil(cell * 3 / block)::bigint + 1)) as u(k) where cell > 0),
w2 as (select source, slice, count(*) as n from (select *, row_number() over (partition by source order by q desc, slice, k) as r from q2) where r <= quota group by all),
c as (select c0.source, c0.slice, cell, least(coalesce(n, 0) * block, cell * 3) as take,
      ({_seeded_sql("'start'", "c0.source", "c0.slice")} % greatest(1, ceil(cell / block)::bigint)) * block as frm
      from c0 left join w2 on c0.source is not distinct from w2.source and c0.slice = w2.slice),
r as (select r0.*, sum(size) over (partition by source, slice order by {_seeded_sql("'order'", "doc_id")}, doc_id, size rows between unbounded preceding and current row)::bigint - size as pos from r0),
x as (select r.*, cell, frm, take, case when cell > 0 then take // cell else 0 end as passes from r join c on r.source is not distinct from c.source and r.slice = c.slice),
y as (select *, take - passes * cell as rest from x)
select doc_id, size, source_size, target,
  (passes * size + greatest(0, least(pos + size, frm + rest) - greatest(pos, frm))
   + greatest(0, least(pos + size, frm - cell + rest) - greatest(pos, frm - cell)))::bigint as taken
from y""",
}
