"""Queries of the resolution operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions.text import title_tokens
from folioflow.operators import resolution as rs
from folioflow.sources.scratch import written

from .registry import Registry
from .text_queries import DOI_SQL, TITLE_SQL, arxiv_sql

R = Registry()
add = R.add
add(
    "r01_normalization_status",
    lambda t: t("v_refs").select("reference_id", rs.normalization_status(F.col("title"), F.when(F.col("supp_key") % 3 > 0, F.col("author")), F.col("year")).alias("status")),
    "select reference_id, case when title <> '' and supp_key % 3 > 0 and year is not null then 'COMPLETE' when title <> '' or supp_key "
    "% 3 > 0 then 'PARTIAL' else 'RAW_ONLY' end as status from v_refs",
)
add(
    "r02_complete_for_insertion",
    lambda t: t("v_refs").groupBy("paper_id").agg(F.count_if(rs.complete_for_insertion(F.col("title"), F.col("author"), F.col("year"))).alias("complete")),
    "select paper_id, count(*) filter (title <> '' and year is not null) as complete from v_refs group by 1",
)
add(
    "r03_csl_type",
    lambda t: t("part").select("p_partkey", rs.csl_type(F.when(F.col("p_partkey") % 3 == 0, "j").when(F.col("p_partkey") % 3 == 1, "m"), F.col("p_size") % 2 == 0, F.col("p_partkey") % 7 == 0).alias("kind")),
    "select p_partkey, case when p_partkey % 7 = 0 then 'paper-conference' when p_partkey % 3 = 0 then 'article-journal' when p_partkey "
    "% 3 = 1 and p_size % 2 = 0 then 'chapter' when p_partkey % 3 = 1 then 'book' else 'document' end as kind from part",
)
add(
    "r04_title_container",
    lambda t: t("part").withColumn("x", rs.title_container(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")), F.col("p_brand"))).select("p_partkey", "x.title", "x.container"),
    "select p_partkey, case when p_partkey % 2 = 0 then p_name when p_partkey % 3 = 0 then p_type else p_brand end as title, case "
    "when p_partkey % 2 = 0 then case when p_partkey % 3 = 0 then p_type else p_brand end end as container from part",
)


def _full_works(t):
    k = F.col("work_key")
    none = F.lit(None).cast("string")
    return t("v_works").select(
        "provider", "external_id", F.when(k % 3 == 0, "chapter").when(k % 3 == 1, "article-journal").alias("work_type"), F.when(k % 5 > 0, F.col("title")).alias("title"), F.concat(F.lit("raw "), "title").alias("raw_text"),
        F.when(k % 2 == 0, F.array("family", F.lit("Group"))).otherwise(F.array().cast("array<string>")).alias("authors"), F.when(k % 7 > 0, F.col("year")).alias("year"), F.when(k % 4 == 0, "Venue").otherwise("").alias("venue"),
        "doi", "url", F.when(k % 6 == 0, k.cast("string")).alias("volume"), none.alias("issue"), F.when(k % 8 == 0, "1-9").alias("pages"), "arxiv_id",
    )


add(
    "r05_csl_projection",
    lambda t: rs.csl_projection(_full_works(t)),
    """select provider, external_id, case when work_key % 5 = 0 then '{"id":"' || external_id || '","type":"document","custom":{"raw_text":"raw ' || title || '"}}' else
    '{"id":"' || external_id || '","type":"' || case work_key % 3 when 0 then 'chapter' when 1 then 'article-journal' else 'document' end || '","title":"' || title || '"'
    || case when work_key % 2 = 0 then ',"author":[{"literal":"' || family || '"},{"literal":"Group"}]' else '' end || case when work_key % 7 > 0 then ',"issued":{"date-parts":[[' || year || ']]}' else '' end || case when work_key % 4 = 0 then ',"container-title":"Venue"' else '' end
    || coalesce(',"DOI":"' || doi || '"', '') || coalesce(',"URL":"' || url || '"', '') || case when work_key % 6 = 0 then ',"volume":"' || work_key || '"' else '' end || case when work_key % 8 = 0 then ',"page":"1-9"' else '' end
    || ',"custom":{"provider":"' || provider || '","external_id":"' || external_id || '"' || coalesce(',"arxiv_id":"' || arxiv_id || '"', '') || '}}' end as csl from v_works""",
)
EXACT = f"""ek as (select reference_id, coalesce({DOI_SQL.format("doi")}, {DOI_SQL.format("nullif(regexp_extract(raw_text, '(10\\.\\d{4,9}/[^\\s\"<>]+)', 1), '')".replace("{", "{{").replace("}", "}}")).replace("{{", "{").replace("}}", "}")}) as kd,
  {arxiv_sql("nullif(regexp_extract(raw_text, '(?i)arxiv[:\\s/]*(\\d{4}\\.\\d{4,5}(v\\d+)?)', 1), '')")} as ka from v_refs),
wk as (select *, case provider when 'OPENALEX' then 0 else 1 end as pr from v_works),
eh as (select reference_id, 0 as rung, pr, provider, external_id from ek join wk on kd = lower(doi) union all select reference_id, 1, pr, provider, external_id from ek join wk on ka = lower(arxiv_id)),
ex as (select reference_id, case rung when 0 then 'DOI' else 'ARXIV' end as method, 'CERTAIN' as confidence, provider, external_id from (select *, row_number() over (partition by reference_id order by rung, pr, external_id) as r from eh) where r = 1)"""
PAIRS = f"""tr as (select reference_id, title, {TITLE_SQL.format("title")} as ta from v_refs where title <> '' and reference_id not in (select reference_id from ex)),
td as (select title, any_value(ta) as ta from tr group by 1), tw as (select provider || ':' || external_id as work_id, {TITLE_SQL.format("title")} as tb, provider, external_id, pr, year, family from wk),
xa as (select title, len(ta) as na, unnest(ta) as w from td), xb as (select work_id, len(tb) as nb, unnest(tb) as w from tw),
ov as (select title, work_id, na, nb, count(*) as c from xa join xb using (w) group by all),
sp as (select title, work_id, c::double / (na + nb - c) as similarity from ov where 100 * c >= 72 * (na + nb - c)),
cd as (select reference_id, work_id, similarity from tr join sp using (title))"""
BEST = (
    "bs as (select * from (select cd.reference_id, tw.provider, tw.external_id, similarity, tw.year, tw.family, row_number() over "
    "(partition by cd.reference_id order by similarity desc, pr, tw.external_id) as r from cd join tw using (work_id)) where r = 1)"
)
LADDER = (
    f"{EXACT}, {PAIRS}, {BEST}, cb as (select b.reference_id, coalesce(b.year = r.year or lower(b.family) = lower(r.family), false) "
    f"as ok, b.provider, b.external_id from bs b join v_refs r using (reference_id)), fd as (select * from ex union all select reference_id, "
    f"case when ok then 'TITLE_AUTHOR_YEAR' else 'TITLE_ONLY' end, case when ok then 'PROBABLE' else 'UNCERTAIN' end, provider, external_id "
    f"from cb), ld as (select r.paper_id, r.reference_id, coalesce(method, 'UNRESOLVED') as method, coalesce(confidence, 'NONE') as "
    f"confidence, provider, external_id from v_refs r left join fd using (reference_id))"
)


add("r06_resolve_by_identifier", lambda t: rs.resolve_by_identifier(t("v_refs"), t("v_works")), f"with {EXACT} select * from ex")
add(
    "r07_title_candidates",
    lambda t: rs.title_candidates(t("v_refs"), t("v_works")).select("reference_id", "work_id", F.round("similarity", 9).alias("similarity")),
    f"with {EXACT}, {PAIRS} select reference_id, work_id, round(similarity, 9) as similarity from cd",
)
add(
    "r08_best_title_match",
    lambda t: rs.title_matches(t("v_refs"), t("v_works")).select("reference_id", "provider", "external_id"),
    f"with {EXACT}, {PAIRS}, {BEST} select reference_id, provider, external_id from bs",
)
add(
    "r09_corroborate",
    lambda t: rs.corroborate(rs.title_matches(t("v_refs"), t("v_works"))).groupBy("method", "confidence").agg(F.count(F.lit(1)).alias("n")),
    f"with {LADDER} select method, confidence, count(*) as n from ld where method like 'TITLE%' group by 1, 2",
)
add("r10_resolution_ladder", lambda t: rs.resolution_ladder(t("v_refs"), t("v_works")), f"with {LADDER} select * from ld")
add(
    "r11_backfill_abstract",
    lambda t: rs.backfill_abstract(t("v_works")),
    "select w.provider, w.external_id, coalesce(nullif(trim(w.abstract), ''), o.abstract) as abstract from v_works w left join (select "
    "lower(doi) as k, arg_min(abstract, case provider when 'OPENALEX' then 0 else 1 end) as abstract from v_works where abstract is "
    "not null and doi is not null group by 1) o on lower(w.doi) = o.k",
)
add(
    "r12_upsert_source_records",
    lambda t: rs.upsert_source_records(t("v_refs").select("paper_id", F.lit("OPENALEX").alias("provider"), (F.col("part_key") % 4).cast("string").alias("external_id"), "title", F.when(F.col("part_key") % 3 == 0, F.col("raw_text")).alias("abstract"), "bibliography_order"), "bibliography_order"),
    "select paper_id, 'OPENALEX' as provider, (part_key % 4)::varchar as external_id, arg_min(title, bibliography_order) as title, "
    "arg_min(raw_text, bibliography_order) filter (part_key % 3 = 0) as abstract from v_refs group by 1, 2, 3",
)
add(
    "r13_identity_mismatch",
    lambda t: rs.identity_mismatch(t("v_works").withColumns({"asked_doi": F.when(F.col("work_key") % 2 == 0, F.concat(F.lit("https://doi.org/10.1000/P"), "work_key")).otherwise("10.1000/other"), "asked_arxiv": F.lit(None).cast("string")})).select("provider", "external_id"),
    "select provider, external_id from v_works where doi is not null and work_key % 2 = 1",
)


def _lists(t):
    w = t("v_works").withColumn("query_id", F.floor(F.col("work_key") / 7).cast("long"))
    return w.withColumn("rank", F.col("work_key") % 7 * 2 + F.when(F.col("provider") == "OPENALEX", 0).otherwise(1))


LISTS = f"""lists as (select *, floor(work_key / 7)::bigint as query_id, work_key % 7 * 2 + case provider when 'OPENALEX' then 0 else 1 end as rank, {TITLE_SQL.format("title")} as k from v_works),
clash as (select b.query_id, b.rank, list(a.rank) as earlier from lists a join lists b on a.query_id = b.query_id and a.rank < b.rank where lower(a.doi) = lower(b.doi) or lower(a.arxiv_id) = lower(b.arxiv_id)
  or (len(list_intersect(a.k, b.k)) > 0 and 100 * len(list_intersect(a.k, b.k)) >= 72 * (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k)))) group by all),
line as (select l.query_id, l.rank, coalesce(c.earlier, []) as earlier, row_number() over (partition by l.query_id order by l.rank) as p from lists l left join clash c using (query_id, rank)),
fold as (select distinct query_id, 0::bigint as p, []::bigint[] as kept from line union all
  select f.query_id, f.p + 1, case when list_has_any(f.kept, l.earlier) then f.kept else list_append(f.kept, l.rank) end from fold f join line l on l.query_id = f.query_id and l.p = f.p + 1),
accepted as (select query_id, unnest(kept) as rank from (select query_id, arg_max(kept, p) as kept from fold group by 1)),
whole as (select l.*, title <> '' and family <> '' and year is not null as ok from lists l join accepted using (query_id, rank))"""
add("r14_dedupe_greedy", lambda t: rs.dedupe_greedy(_lists(t), "query_id"), f"with recursive {LISTS} select query_id, rank, provider, external_id from whole")
add(
    "r16_candidate_set",
    lambda t: rs.candidate_set(_lists(t), "query_id", 5)[0],
    f"with recursive {LISTS} select query_id, printf('cand_%03d', n - 1) as candidate_id, provider, external_id from "
    "(select *, row_number() over (partition by query_id order by rank) as n from whole where ok) where n <= 5",
)
add("r16_incomplete", lambda t: rs.candidate_set(_lists(t), "query_id", 5)[1], f"with recursive {LISTS} select query_id, count(*) filter (not ok) as incomplete from whole group by 1")
KEYS = f"""bk as (select distinct paper_id, key from (select paper_id, 'doi:' || {DOI_SQL.format('doi')} as key from v_refs
  union all select paper_id, lower(provider || ':' || external_id) from ld where external_id is not null
  union all select paper_id, 'doi:' || lower(doi) from ld join v_works using (provider, external_id)) where key is not null)"""
TITLES = """bt as (select distinct paper_id, title from (select paper_id, title from v_papers union all select paper_id, title from v_refs
  union all select paper_id, title from ld join v_works using (provider, external_id)) where trim(title) <> '')"""
NO_LADDER = "ld as (select paper_id, reference_id, null::varchar as provider, null::varchar as external_id from v_refs where false)"
HELD = f"""ox as (select title, len(k) as n, unnest(k) as w from (select title, {TITLE_SQL.format("title")} as k from (select distinct title from offered))),
hx as (select title, len(k) as n, unnest(k) as w from (select title, {TITLE_SQL.format("title")} as k from (select distinct title from bt))),
near as (select offered_title, held_title from (select ox.title as offered_title, hx.title as held_title, ox.n as a, hx.n as b, count(*) as c from ox join hx using (w) group by all) where 100 * c >= 72 * (a + b - c)),
fresh as (select * from offered f where not exists (select 1 from bk where bk.paper_id = f.paper_id and bk.key in ('doi:' || lower(f.doi), 'arxiv:' || lower(f.arxiv_id), lower(f.provider || ':' || f.external_id)))
  and not exists (select 1 from near n join bt on bt.title = n.held_title where n.offered_title = f.title and bt.paper_id = f.paper_id))"""
OFFER = (
    "offered as (select distinct paper_id, provider, external_id, title, doi, arxiv_id from (select distinct paper_id, part_key + "
    "bibliography_order % 2 as work_key from v_refs) join v_works using (work_key) where provider = 'OPENALEX')"
)


def _offered(wanted, works):
    offer = works.where("provider = 'OPENALEX'").select("work_key", "provider", "external_id", "title", "doi", "arxiv_id")
    return wanted.select("paper_id", "work_key").join(offer, "work_key").drop("work_key")


def _keys(t):
    return rs.resolved_keys(rs.resolution_ladder(t("v_refs"), t("v_works"), "doi", record=("doi",)))


def _titles(t):
    return rs.resolved_titles(t("v_papers"), rs.resolution_ladder(t("v_refs"), t("v_works"), "title", record=("title",)))


def _fresh(t):
    refs = t("v_refs").withColumn("work_key", F.col("part_key") + F.col("bibliography_order") % 2)
    found = written(rs.resolved_records(refs, t("v_works"), "paper_id", "doi", "work_key", record=("doi", "title")), "ladder")
    return rs.not_held(_offered(found, t("v_works")), rs.resolved_holdings(t("v_papers"), found)).distinct()


add("r17_bibliography_keys", _keys, f"with {LADDER}, {KEYS} select * from bk")
add("r17_bibliography_titles", _titles, f"with {LADDER}, {TITLES} select * from bt")
add(
    "r18_not_in_bibliography",
    lambda t: _fresh(t).select("paper_id", "external_id"),
    f"with {LADDER}, {KEYS}, {TITLES}, {OFFER}, {HELD} select paper_id, external_id from fresh",
)
RUNS = lambda t: t("v_refs").select("paper_id", F.concat("paper_id", F.lit("_"), F.col("part_key") % 3).alias("reference_id"), F.col("bibliography_order").alias("run_id"), F.lit("DOI").alias("method"), F.when(F.col("part_key") % 2 == 0, "CERTAIN").otherwise("UNCERTAIN").alias("confidence"), F.col("part_key").cast("string").alias("external_id"))
add(
    "r19_persist_resolutions",
    lambda t: rs.persist_resolutions(RUNS(t)),
    "select paper_id, paper_id || '_' || (part_key % 3) as reference_id, max(bibliography_order) as run_id, 'DOI' as method, arg_max(case "
    "when part_key % 2 = 0 then 'CERTAIN' else 'UNCERTAIN' end, bibliography_order) as confidence, case when arg_max(part_key, bibliography_order) "
    "% 2 = 0 then arg_max(part_key, bibliography_order)::varchar end as external_id from v_refs group by paper_id, part_key % 3",
)
add(
    "r20_record_lookup_fallback",
    lambda t: rs.record_lookup_fallback(t("v_refs").select("paper_id", "reference_id", F.when(F.col("part_key") % 3 == 0, F.col("part_key").cast("string")).alias("want_record"), F.when(F.col("part_key") % 3 == 1, F.concat(F.lit("d"), "part_key")).alias("want_doi"), F.concat(F.lit("e"), F.col("part_key") % 5).alias("want_external")), t("v_refs").where("part_key % 2 = 0").select("paper_id", F.col("part_key").cast("string").alias("record_id"), F.concat(F.lit("d"), "part_key").alias("doi"), F.concat(F.lit("e"), F.col("part_key") % 5).alias("external_id"))),
    "select r.paper_id, r.reference_id, case when part_key % 2 = 0 and part_key % 3 < 2 then part_key::varchar else (select min(part_key::varchar) "
    "from v_refs y where y.paper_id = r.paper_id and y.part_key % 2 = 0 and y.part_key % 5 = r.part_key % 5) end as record_id from "
    "v_refs r",
)
add(
    "r21_display_resolution",
    lambda t: rs.display_resolution(t("v_refs").select("reference_id", F.lit("OLD").alias("method"), F.lit("PROBABLE").alias("confidence")), t("v_refs").where("part_key % 2 = 0").select("reference_id", F.lit("DOI").alias("method"), F.lit(None).cast("string").alias("confidence"))),
    "select reference_id, case when part_key % 2 = 0 then 'DOI' else 'OLD' end as method, case when part_key % 2 = 0 then null else "
    "'PROBABLE' end as confidence from v_refs",
)
IDS = lambda: F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("DOI").alias("kind"), F.concat(F.lit("doi:10.1/X"), "part_key").alias("value")), F.struct(F.lit(1).alias("pos"), F.when(F.col("part_key") % 2 == 0, "DOI").otherwise("ARXIV").alias("kind"), F.when(F.col("part_key") % 2 == 0, "10.2/y").otherwise("arXiv:1706.03762v3").alias("value")), F.struct(F.lit(2).alias("pos"), F.when(F.col("part_key") % 3 == 0, "URL").otherwise("TARGET").alias("kind"), F.concat(F.lit("http://u.org/"), "part_key").alias("value"))))
add(
    "r22_identifier_pivot",
    lambda t: rs.identifier_pivot(t("v_refs").select("reference_id", "part_key", IDS().alias("x")).select("reference_id", "x.*")),
    "select reference_id, case when part_key % 2 = 0 then '10.2/y' else '10.1/x' || part_key end as doi, case when part_key % 2 = "
    "1 then '1706.03762' end as arxiv, 'http://u.org/' || part_key as url from v_refs",
)
add(
    "r23_merge_ranked",
    lambda t: rs.merge_ranked(t("v_refs").select("paper_id", (F.col("bibliography_order") % 5).alias("claim_no"), F.col("bibliography_order").alias("rank"), (F.col("part_key") % 9).cast("string").alias("key"))),
    "select paper_id, printf('cand_%03d', row_number() over (partition by paper_id order by f, key) - 1) as candidate_id, key from "
    "(select paper_id, (part_key % 9)::varchar as key, min((bibliography_order % 5) * 1000 + bibliography_order) as f from v_refs "
    "where bibliography_order % 5 < 4 group by 1, 2)",
)
QUERIES, ORACLE = R.QUERIES, R.ORACLE
