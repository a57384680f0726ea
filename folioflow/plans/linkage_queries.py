"""Queries of the marker and linkage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import linkage as lk
from folioflow.operators import markers as mk
from folioflow.sources.scratch import written

from .registry import Registry

R = Registry()
NUM, YR = "'^[\\[(]?\\s*\\d+\\s*[\\],;)]?\\s*$'", "'(1[6-9]\\d{2}|20\\d{2})'"
KIND = f"case when regexp_matches(marker_fragment, {NUM}) then 'NUMERIC' when regexp_matches(marker_fragment, {YR}) then 'AUTHOR_YEAR' end"

R.add(
    "c01_marker_family",
    lambda t: mk.marker_family(t("v_items")),
    f"""select paper_id, nu as numeric, ay as author_year, case when nu + ay > 0 and nu >= 0.8 * (nu + ay) then 'NUMERIC' when nu + ay > 0 and ay >= 0.8 * (nu + ay) then 'AUTHOR_YEAR' else 'UNKNOWN' end as family
    from (select paper_id, count(*) filter (k = 'NUMERIC') as nu, count(*) filter (k = 'AUTHOR_YEAR') as ay from (select paper_id, {KIND} as k from v_items) group by 1)""",
)
R.add(
    "c02_citation_style",
    lambda t: mk.citation_style(t("v_items")),
    f"""select paper_id, nu as numeric, ay as author_year, case when nu + ay < 5 then null when nu >= ay then 'IEEE' else 'APA' end as style, case when nu + ay < 5 then 'UNKNOWN' when greatest(nu, ay) >= 0.8 * (nu + ay) then 'HIGH' else 'LOW' end as confidence
    from (select paper_id, count(*) filter (k = 'NUMERIC') as nu, count(*) filter (k = 'AUTHOR_YEAR') as ay from (select paper_id, case when reference_id is not null then {KIND} end as k from v_items) group by 1)""",
)
R.add(
    "c03_marker_mode",
    lambda t: t("v_refs").select("reference_id", mk.marker_mode(F.when(F.col("part_key") % 3 == 0, F.concat(F.lit("("), F.coalesce("year", F.lit(1999)), F.lit(")"))).when(F.col("part_key") % 3 == 1, F.concat("family", F.lit(" ("), F.coalesce("year", F.lit(1999)), F.lit(")"))).otherwise(F.lit("[3]"))).alias("mode")),
    "select reference_id, case part_key % 3 when 0 then 'SUPPRESS_AUTHOR' when 1 then 'AUTHOR_IN_TEXT' else 'NORMAL' end as mode from v_refs",
)
LOC = lambda: F.concat(F.lit("["), "bibliography_order", F.when(F.col("part_key") % 3 == 0, F.concat(F.lit(", pp. "), "part_key", F.lit(" - "), F.col("part_key") + 5)).when(F.col("part_key") % 3 == 1, F.lit(", Chap. 4")).otherwise(""), F.lit("]"))
R.add(
    "c04_extract_locator",
    lambda t: t("v_refs").withColumn("l", mk.extract_locator(LOC())).select("reference_id", F.col("l.label").alias("label"), F.col("l.value").alias("value")),
    "select reference_id, case part_key % 3 when 0 then 'page' when 1 then 'chapter' end as label, case part_key % 3 when 0 then part_key || ' - ' || (part_key + 5) when 1 then '4' end as value from v_refs",
)
R.add(
    "c05_classify_prefix",
    lambda t: t("v_refs").select("reference_id", mk.classify_prefix(F.when(F.col("part_key") % 4 == 0, "see also, ").when(F.col("part_key") % 4 == 1, "E.g.").when(F.col("part_key") % 4 == 2, " ").otherwise("as shown"), F.when(F.col("paper_id") % 2 == 0, "NUMERIC").otherwise("AUTHOR_YEAR")).alias("verdict")),
    "select reference_id, case part_key % 4 when 2 then 'NONE' when 3 then case when paper_id % 2 = 0 then 'DEGRADED' else 'DEBRIS' end else 'PREFIX' end as verdict from v_refs",
)
R.add(
    "c06_parse_status",
    lambda t: mk.parse_status(t("v_items"), F.col("printed_order") % 5 == 0),
    "select paper_id, citation_id, count(*) as items, case when bool_or(reference_id is null) then 'RAW_ONLY' when bool_or(printed_order % 5 = 0) and count(*) > 1 then 'PARTIAL_MODIFIERS' else 'STRUCTURED' end as parse_status from v_items group by 1, 2",
)


def _pieces(t):
    w = t("v_paragraphs")
    runs = F.flatten(F.transform(F.split("text", " ", -1), lambda x, i: F.array(F.struct(F.when(F.length(x) % 3 == 0, "citation").otherwise("text").alias("kind"), F.when(F.length(x) % 4 == 1, " ").otherwise(x).alias("value")))))
    return w.select("doc_id", "par_no", F.posexplode(runs).alias("place", "r")).select("doc_id", "par_no", F.col("place").cast("long").alias("place"), "r.kind", "r.value")


R.add(
    "c07_cluster_adjacent",
    lambda t: mk.cluster_adjacent(_pieces(t), ["doc_id", "par_no"], "place"),
    """with w as (select doc_id, par_no, unnest(range(len(string_split(text, ' ')))) as place, unnest(string_split(text, ' ')) as x from v_paragraphs),
    p as (select doc_id, par_no, place, case when length(x) % 3 = 0 then 'citation' else 'text' end as kind, case when length(x) % 4 = 1 then ' ' else x end as v from w),
    b as (select *, sum(case when kind = 'text' and trim(v) <> '' then 1 else 0 end) over (partition by doc_id, par_no order by place) as cluster from p)
    select doc_id, par_no, cluster::bigint as cluster, count(*) as members, min(place) as first from b where kind = 'citation' group by 1, 2, 3""",
)
R.add(
    "c08_absorb_opener",
    lambda t: t("v_refs").select("reference_id", mk.absorb_opener(F.concat(F.lit("as in (see "), F.when(F.col("part_key") % 2 == 0, "also ").otherwise("Fig. 2 ")), F.when(F.col("part_key") % 3 == 0, "Lee 1999)").when(F.col("part_key") % 3 == 1, "Lee 1999).").otherwise("Lee 1999]")).alias("taken")),
    "select reference_id, case when part_key % 2 = 0 and part_key % 3 < 2 then '(see also ' else '' end as taken from v_refs",
)
R.add(
    "c09_block_status",
    lambda t: t("part").select("p_partkey", mk.block_status(F.when(F.col("p_partkey") % 3 == 0, "FIGURE").when(F.col("p_partkey") % 3 == 1, "TABLE").otherwise("FORMULA"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("status")),
    "select p_partkey, case when p_partkey % 3 = 0 and p_size % 2 <> 0 then 'UNRENDERABLE' when p_partkey % 3 = 1 and p_size % 3 <> 0 then 'CONVERTED' else 'PRESERVED' end as status from part",
)
BOX = lambda: F.concat_ws(";", F.concat(F.lit("1,2,"), "p_size", F.lit(",4,5")), F.concat(F.lit("1,2,"), "p_size", F.lit(",4,5")), F.lit("0,1,1,1,1"), F.lit("x,1,1,1,1"), F.concat(F.col("p_partkey") % 2 + 1, F.lit(",0,0,"), F.col("p_partkey") % 3, F.lit(",7")))
R.add(
    "c10_source_boxes",
    lambda t: t("part").select("p_partkey", F.explode(mk.source_boxes(BOX())).alias("b")).select("p_partkey", "b.page", "b.x", "b.y", "b.width", "b.height"),
    """select p_partkey, 1 as page, 2.0::double as x, p_size::double as y, 4.0::double as width, 5.0::double as height from part
    union all select p_partkey, (p_partkey % 2 + 1)::int, 0, 0, p_partkey % 3, 7 from part where p_partkey % 3 > 0""",
)
R.add(
    "c11_union_box",
    lambda t: mk.union_box(t("part").select("p_partkey", F.explode(mk.source_boxes(BOX())).alias("b")).select("p_partkey", "b.*"), "p_partkey"),
    """select p_partkey, 1 as page, case when p_partkey % 3 > 0 then 0.0 else 2.0 end::double as x, case when p_partkey % 3 > 0 then least(0.0, p_size) else p_size end::double as y,
    6.0::double as "right", case when p_partkey % 3 > 0 then greatest(7.0, p_size + 5) else p_size + 5 end::double as bottom from part where p_partkey % 3 = 0 or p_partkey % 2 = 0""",
)
R.add(
    "c12_mapping_diagnostics",
    lambda t: mk.mapping_diagnostics(t("v_items"), t("v_refs")),
    f"""select r.paper_id, refs, items, clusters, unlinked, unrecognised, greatest(0, refs - items)::bigint as out_of_scope from (select paper_id, count(*) as refs from v_refs group by 1) r
    join (select paper_id, count(*) as items, count(distinct citation_id) as clusters, count(*) filter (reference_id is null) as unlinked, count(*) filter ({KIND} is null) as unrecognised from v_items group by 1) i on r.paper_id = i.paper_id""",
)

LINKED = (("v_refs", "paper_id, bibliography_order, reference_id, family, year"),)
# --- linkage: the three checks as shared SQL
PR = "regexp_extract(trim(marker_fragment), '^[\\[(]?\\s*(\\d{1,3})\\s*[\\],;)]?\\s*$', 1)"
NUMERIC_SQL = f"""nl as (select i.paper_id, i.citation_id, i.item_index, i.reference_id, r.reference_id as expected,
  case when i.reference_id is null and printed is null then 'NOT_A_MARKER' when i.reference_id is null and r.reference_id is null then 'UNRESOLVED' when i.reference_id is null then 'RECOVERED' when printed is null then 'UNCERTAIN' when r.reference_id = i.reference_id then 'AGREED' else 'MISMATCH' end as code
  from (select *, nullif({PR}, '')::bigint as printed from v_items where family_kind = 'NUMERIC') i left join v_refs r on i.paper_id = r.paper_id and i.printed = r.bibliography_order)"""
NY = "'([\\pL][\\pL\\pN''’-]*),?\\s*\\(?\\s*(1[6-9]\\d{2}|20\\d{2})'"
AY_SQL = f"""ai as (select *, nullif(lower(regexp_extract(marker_fragment, {NY}, 1)), '') as surname, nullif(regexp_extract(marker_fragment, {NY}, 2), '')::bigint as py from v_items where family_kind = 'AUTHOR_YEAR'),
hit as (select paper_id, lower(family) as surname, year as py, count(distinct reference_id) as hits, min(reference_id) as candidate from v_refs where year is not null group by 1, 2, 3),
aj as (select ai.*, hits, candidate, r.reference_id is not null as known, r.year as ry, lower(r.family) as fam from ai left join hit using (paper_id, surname, py) left join v_refs r on ai.paper_id = r.paper_id and ai.reference_id = r.reference_id),
ac as (select *, case when surname is null and reference_id is null then 'NOT_A_MARKER' when surname is null then 'UNCERTAIN' when reference_id is null then case when hits = 1 then 'RECOVERED' when hits > 1 then 'AMBIGUOUS' else 'UNRESOLVED' end
  when not known then 'MISMATCH' when fam = surname and ry = py then 'AGREED' when fam <> surname and ry <> py then 'MISMATCH' when fam <> surname then 'UNCERTAIN' when ry <> py then 'UNCERTAIN' when fam = surname or ry = py then 'AGREED' else 'UNCERTAIN' end as code from aj),
al as (select paper_id, citation_id, item_index, reference_id, case when code = 'RECOVERED' then candidate end as expected, code from ac)"""
ISSUES_SQL = (
    f"{NUMERIC_SQL}, {AY_SQL}, li as (select *, case when code = 'RECOVERED' then expected end as repair from (select * from nl union "
    f"all select * from al))"
)
FIXED_SQL = (
    f"{ISSUES_SQL}, fx as (select i.* exclude (reference_id), coalesce(repair, i.reference_id) as reference_id from v_items i left "
    f"join li on i.citation_id = li.citation_id and i.item_index = li.item_index)"
)
STATUS_SQL = (
    "st as (select paper_id, citation_id, case when bool_or(reference_id is null) then 'RAW_ONLY' else 'STRUCTURED' end as parse_status "
    "from v_items group by 1, 2)"
)
CHANGE_SQL = f"""{FIXED_SQL}, {STATUS_SQL}, ch as (select st.paper_id, st.citation_id, parse_status as before, case when mismatch then 'RAW_ONLY' when parse_status = 'RAW_ONLY' and all_linked then 'STRUCTURED' else parse_status end as after
  from st left join (select citation_id, bool_and(reference_id is not null) as all_linked from fx group by 1) g using (citation_id) left join (select citation_id, bool_or(code = 'MISMATCH') as mismatch from li group by 1) b using (citation_id))"""


def issues(t):
    return written(lk.check_links(t("v_items"), t("v_refs")), "issues")


def changes(t, found=None):
    """Changed statuses, of issues ``found`` already or found here."""
    i = issues(t) if found is None else found
    return lk.promote_downgrade(lk.apply_repairs(t("v_items"), i), i, mk.parse_status(t("v_items")).drop("items"))


R.add(
    "l01_check_numeric_links",
    lambda t: lk.check_numeric_links(t("v_items").where("family_kind = 'NUMERIC'"), t("v_refs")).drop("repair"),
    f"with {NUMERIC_SQL} select * from nl",
)
R.add(
    "l02_recover_author_year",
    lambda t: lk.check_author_year_links(t("v_items").where("family_kind = 'AUTHOR_YEAR'"), t("v_refs")).where("reference_id is null").select("citation_id", "item_index", "expected", "code"),
    f"with {AY_SQL} select citation_id, item_index, expected, code from al where reference_id is null",
)
R.add(
    "l03_verify_author_year",
    lambda t: lk.check_author_year_links(t("v_items").where("family_kind = 'AUTHOR_YEAR'"), t("v_refs")).where("reference_id is not null").select("citation_id", "item_index", "code"),
    f"with {AY_SQL} select citation_id, item_index, code from al where reference_id is not null",
)
R.add(
    "l04_apply_repairs",
    lambda t: lk.apply_repairs(t("v_items"), issues(t)).select("citation_id", "item_index", "reference_id"),
    f"with {FIXED_SQL} select citation_id, item_index, reference_id from fx",
    LINKED,
)
R.add("l05_promote_downgrade", changes, f"with {CHANGE_SQL} select * from ch", LINKED)


def _report(t):
    i = issues(t)
    return lk.linkage_report(i, changes(t, i))


R.add(
    "l06_linkage_report",
    _report,
    f"""with {CHANGE_SQL}, g as (select paper_id, {', '.join(f"count(*) filter (code = '{c}') as {c.lower()}" for c in lk.CODES)} from li group by 1)
    select g.*, agreed + mismatch as checked, case when agreed + mismatch > 0 then round(agreed::double / (agreed + mismatch), 4) else 0.0 end as accuracy, coalesce(downgraded, 0) as downgraded, coalesce(promoted, 0) as promoted
    from g left join (select paper_id, count(*) filter (before <> 'RAW_ONLY' and after = 'RAW_ONLY') as downgraded, count(*) filter (before = 'RAW_ONLY' and after = 'STRUCTURED') as promoted from ch group by 1) m using (paper_id)""",
    LINKED,
)
USE_SQL = (
    "us as (select r.paper_id, r.reference_id, count(distinct citation_id) as uses from v_refs r left join v_items i on r.reference_id "
    "= i.reference_id group by 1, 2)"
)
R.add("l07_bibliography_use", lambda t: lk.bibliography_use(t("v_refs"), t("v_items")), f"with {USE_SQL} select * from us")
R.add(
    "l08_cited_reference_ids",
    lambda t: lk.cited_reference_ids(t("v_items").where("printed_order % 3 > 0").select("citation_id").distinct(), t("v_items")),
    "select distinct paper_id, reference_id from v_items where reference_id is not null and citation_id in (select citation_id from "
    "v_items where printed_order % 3 > 0)",
)
R.add(
    "l09_reference_facets",
    lambda t: lk.reference_facets(t("v_refs"), lk.bibliography_use(t("v_refs"), t("v_items")), t("v_refs").where("doi is not null")),
    f'with {USE_SQL} select r.paper_id, count(*) as "all", count(*) filter (doi is not null) as matched, count(*) filter (doi is null) as unmatched, count(*) filter (uses = 0) as uncited from v_refs r join us on r.reference_id = us.reference_id group by 1',
)
R.add(
    "l10_unlinked_and_raw_only",
    lambda t: lk.unlinked_and_raw_only(t("v_items"), mk.parse_status(t("v_items"))),
    "with q as (select paper_id, coalesce(string_agg(distinct citation_id, ',' order by citation_id) filter (reference_id is null), '') as unlinked from v_items group by 1) select paper_id, unlinked, unlinked as raw_only from q",
)
QUERIES, ORACLE = R.QUERIES, R.ORACLE
