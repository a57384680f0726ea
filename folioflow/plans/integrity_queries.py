"""Queries of integrity checks, exports, rebuilt revisions and work components."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import segmentation as seg
from folioflow.functions.text import text_sha256
from folioflow.operators import integrity as ig
from folioflow.operators import markers as mk
from folioflow.operators import resolution as rs
from folioflow.operators import review as rw
from folioflow.operators import revisions as rv
from folioflow.sources import shredding as sh

from .registry import Registry
from .text_queries import TITLE_SQL, norm_sql

R = Registry()
add = R.add


def _sections(t, edited: bool):
    """Each paragraph as a section; the edited revision swaps the first two of some documents and drops the last of others."""
    p = t("v_paragraphs").select("doc_id", F.col("par_no").alias("place"), F.col("par_no").alias("section"))
    if not edited:
        return p
    last = t("v_paragraphs").groupBy("doc_id").agg(F.max("par_no").alias("last"))
    swap = F.when((F.col("doc_id") % 3 == 0) & F.col("place").isin(1, 2) & (F.col("last") > 1), 3 - F.col("place")).otherwise(F.col("place"))
    return p.join(last, "doc_id").where("doc_id % 5 > 0 or place < last").select("doc_id", swap.alias("place"), "section")


add(
    "r15_dedupe_works_components",
    lambda t: ig.dedupe_works_components(t("v_works").select("provider", "external_id", "title", "doi", "arxiv_id")),
    f"""with recursive w as (select provider || ':' || external_id as id, lower(doi) as d, lower(arxiv_id) as x, {TITLE_SQL.format("title")} as k from v_works),
    t as (select id, len(k) as n, unnest(k) as t from w),
    e as (select a.id as a, b.id as b from w a join w b on a.d = b.d union select a.id, b.id from w a join w b on a.x = b.x
      union select a, b from (select a.id as a, b.id as b, a.n as m, b.n as n, count(*) as c from t a join t b using (t) group by all) where 100 * c >= 72 * (m + n - c)),
    r as (select id as id, id as c from w union select e.b, r.c from r join e on r.id = e.a) select id, min(c) as component from r group by 1""",
    ("v_works",),
)
add(
    "v01_section_sequence",
    lambda t: ig.section_sequence(_sections(t, False), _sections(t, True), "doc_id"),
    "select doc_id from v_paragraphs group by 1 having (max(par_no) >= 2 and doc_id % 3 = 0) or doc_id % 5 = 0",
)
add(
    "v01_placed_in_registry",
    lambda t: ig.dangling(t("v_items").select("paper_id", "citation_id").distinct(), t("v_items").where("printed_order % 5 > 0").select("paper_id", "citation_id"), ["citation_id"]).select("citation_id"),
    "select citation_id from v_items group by 1 having bool_and(printed_order % 5 = 0)",
)
add(
    "v01_structure_check",
    lambda t: ig.dangling(t("v_items").where("reference_id is not null"), t("v_refs"), ["reference_id"]).select("citation_id", "item_index", "reference_id"),
    "select citation_id, item_index, reference_id from v_items where reference_id is not null and reference_id not in (select reference_id from v_refs)",
)
add(
    "v01_placed_twice",
    lambda t: ig.placed_twice(t("v_items"), "citation_id"),
    "select citation_id, count(*) as places from v_items group by 1 having count(*) > 1",
)
add(
    "v04_new_reference_complete",
    lambda t: ig.incomplete_additions(t("v_refs").where("part_key % 3 > 0"), t("v_refs")),
    "select reference_id from v_refs where part_key % 3 = 0 and (title = '' or year is null)",
)
add(
    "v05_identity_invariant",
    lambda t: ig.identity_broken(t("v_refs").select("reference_id", F.when(F.col("part_key") % 50 == 0, None).otherwise(F.col("reference_id")).alias("csl_id")), "reference_id", "csl_id").select("reference_id"),
    "select reference_id from v_refs where part_key % 50 = 0",
)
add(
    "v09_referential_checks",
    lambda t: ig.dangling(t("v_state_log").select("proposal_id", "paper_id", F.col("base_revision").alias("revision_number")), t("v_revisions"), ["paper_id", "revision_number"]),
    "select proposal_id, s.paper_id, base_revision as revision_number from v_state_log s where not exists (select 1 from v_revisions "
    "r where r.paper_id = s.paper_id and r.revision_number = s.base_revision)",
)
add(
    "v11_citation_warnings",
    lambda t: ig.citation_warnings(t("v_items"), t("v_items").where("printed_order % 7 > 2"), F.lit("h")),
    """select 'warn_' || substr(sha256('{"code":"' || code || '","hash":"h","subjects":["' || subject || '"]}'), 1, 32) as warning_id, code, subject from (
    select 'CITATION_REMOVED' as code, citation_id as subject from v_items group by 2 having bool_and(printed_order % 7 <= 2)
    union all select 'REFERENCE_LEFT_UNCITED', reference_id from v_items where reference_id is not null group by 2 having bool_and(printed_order % 7 <= 2))""",
    ("v_items",),
)



def _acknowledged(t):
    required = F.array(F.lit("b"), F.lit("a"), "kind")
    given = F.array(F.lit("b"), F.when(F.col("proposal_id") % 2 == 0, F.col("kind")).otherwise(""))
    stored = F.when(F.col("proposal_id") % 3 == 0, F.array(F.lit("a"), "kind", F.lit("b"), F.lit("b"))).otherwise(F.array(F.lit("a"), "kind"))
    return t("v_state_log").select("proposal_id", F.array_join(ig.acknowledgement_gap(required, given), ",").alias("gap"), ig.tampered(stored, required).alias("tampered"))


add(
    "v15_acknowledgement_gap",
    _acknowledged,
    "select proposal_id, case when proposal_id % 2 = 0 then 'a' else array_to_string(list_sort(['a', kind]), ',') end as gap, proposal_id % 3 > 0 as tampered from v_state_log",
)
add(
    "v17_hash_integrity",
    lambda t: ig.hash_broken(t("v_paragraphs").withColumn("stored", text_sha256(F.when(F.col("par_no") % 9 == 0, F.concat("text", F.lit("!"))).otherwise(F.concat("text", F.lit("  "))))), "text", "stored").select("doc_id", "par_no"),
    "select doc_id, par_no from v_paragraphs where par_no % 9 = 0",
)


def _preflight_counts(t):
    """Each order as a paper: its document's paragraphs, its page's lists (converted) and cut end (unrenderable), its references and citations."""
    papers = t("v_papers").join(t("v_items").groupBy("paper_id").agg(F.max("family_kind").alias("style")), "paper_id", "left").select("paper_id", "style")
    pages = t("pages").withColumn("paper_id", F.col("page_id"))
    lists = pages.select("paper_id", F.explode(F.array_repeat(F.lit("CONVERTED"), F.regexp_count("html", F.lit("<ul>")))).alias("status"))
    ends = pages.where("html not like '%</html>%'").select("paper_id", F.lit("UNRENDERABLE").alias("status"))
    refs = t("v_refs").select("paper_id", "reference_id", rs.normalization_status(F.col("title"), F.lit(None).cast("string"), F.col("year")).alias("status"), F.col("year").isNull().alias("added"))
    items = t("v_items").select("paper_id", "reference_id", F.col("marker_fragment").isin("see text", "ibid").alias("partial"))
    return ig.preflight_counts(papers, t("v_paragraphs").select(F.col("doc_id").alias("paper_id")), lists.unionByName(ends), refs, items)


add(
    "v18_export_preflight",
    lambda t: ig.preflight(_preflight_counts(t)),
    """with st as (select paper_id, max(family_kind) as style, count(*) filter (marker_fragment in ('see text', 'ibid')) as partial from v_items group by 1), tx as (select doc_id as paper_id, count(*) as n from v_paragraphs group by 1),
    bl as (select page_id as paper_id, sum(len(regexp_extract_all(html, '<ul>'))) as converted, count(*) filter (html not like '%</html>%') as unrenderable from pages group by 1),
    rf as (select paper_id, count(*) filter (title = '') as raw_only, count(*) filter (open) as uncited, count(*) filter (open and year is null) as dropped from (select *, not exists (select 1 from v_items i where i.reference_id = r.reference_id and i.paper_id = r.paper_id) as open from v_refs r) group by 1)
    select paper_id, array_to_string(list_filter([case when style is null then 'NO_STYLE' end, case when tx.n is null then 'EMPTY_DOCUMENT' end, case when unrenderable > 0 then 'UNRENDERABLE_BLOCK' end], lambda x: x is not null), ',') as blockers,
    array_to_string(list_filter([case when partial > 0 then 'PARTIAL_MODIFIERS' end, case when raw_only > 0 then 'RAW_ONLY' end, case when converted > 0 then 'CONVERTED_BLOCK' end, case when uncited > 0 then 'RETAINED_UNCITED' end, case when dropped > 0 then 'DROPPED_ADDED' end], lambda x: x is not null), ',') as warnings
    from v_papers left join st using (paper_id) left join tx using (paper_id) left join bl using (paper_id) left join rf using (paper_id)""",
    ("v_refs", "v_items"),
)
add(
    "v19_render_set",
    lambda t: ig.render_set(t("v_refs").select("reference_id"), t("v_items").where("reference_id is not null"), t("v_refs").where("part_key % 2 = 0")),
    "select reference_id, case when reference_id in (select reference_id from v_items where reference_id is not null) then 'CITED' "
    "when part_key % 2 = 0 then 'RETAINED_UNCITED' else 'DROPPED_ADDED' end as role from v_refs",
)
add(
    "v20_roundtrip_signatures",
    lambda t: ig.signature_diff(t("v_refs").where("part_key % 5 > 0").select(F.col("reference_id").alias("citation_id"), F.col("title").alias("signature")), t("v_refs").where("part_key % 4 > 0").select(F.col("reference_id").alias("citation_id"), F.when(F.col("part_key") % 3 == 0, "x").otherwise(F.col("title")).alias("signature"))),
    "select reference_id as citation_id, case when part_key % 4 = 0 then 'MISSING' when part_key % 5 = 0 then 'UNEXPECTED' else 'CHANGED' "
    "end as kind from v_refs where (part_key % 5 > 0 or part_key % 4 > 0) and (part_key % 4 = 0 or part_key % 5 = 0 or part_key % "
    "3 = 0)",
)
add(
    "v22_blocks_preserved",
    lambda t: rv.removed_keys(t("v_paragraphs"), t("v_paragraphs").where("par_no % 5 > 0"), ["doc_id", "par_no"]),
    "select doc_id, par_no from v_paragraphs where par_no % 5 = 0",
)
add(
    "v24_fidelity_warnings",
    lambda t: ig.fidelity_warnings(mk.parse_status(t("v_items")), F.lit("h")),
    """select paper_id, 'warn_' || substr(sha256('{"code":"FIDELITY","hash":"h","subjects":["' || string_agg(citation_id, '","' order by citation_id) || '"]}'), 1, 32) as warning_id, string_agg(citation_id, ',' order by citation_id) as subjects
    from (select paper_id, citation_id from v_items group by 1, 2 having bool_or(reference_id is null)) group by 1""",
)
add(
    "e09_apply_insertions",
    lambda t: ig.apply_insertions(t("v_paragraphs").select("doc_id", F.col("par_no").alias("sent_no"), "text"), t("v_paragraphs").where("par_no % 2 = 0").select("doc_id", F.col("par_no").alias("sent_no"), F.lit("c1").alias("citation_id")), ["doc_id"]),
    "select doc_id, string_agg(case when par_no % 2 = 0 then substr(text, 1, length(text) - length(tail)) || ' [[CITE:c1]]' || tail "
    "else text end, ' ' order by par_no) as text from (select *, regexp_extract(text, '[ .!?\"''”’)\\]}]*$', 0) as tail from v_paragraphs) "
    "group by 1",
)
add(
    "e10_merge_items",
    lambda t: ig.merge_items(t("v_items").where("reference_id is not null").groupBy("citation_id").agg(F.array_sort(F.collect_list("reference_id")).alias("items")), t("v_items").where("printed_order % 6 = 1").select("citation_id", F.lit("new").alias("reference_id"))).select("citation_id", F.array_join("items", ",").alias("items")),
    "with g as (select citation_id, string_agg(reference_id, ',' order by reference_id) as items from v_items where reference_id is "
    "not null group by 1) select citation_id, items || case when citation_id in (select citation_id from v_items where printed_order "
    "% 6 = 1) then ',new' else '' end as items from g",
)
add(
    "e12_rebuild_document",
    lambda t: ig.rebuild(t("v_paragraphs"), t("v_paragraphs").where("par_no % 3 = 0").withColumn("text", F.when(F.col("par_no") % 2 == 0, F.concat("text", F.lit("  "))).otherwise(F.concat("text", F.lit(" more")))), ["doc_id", "par_no"]),
    "select doc_id, par_no, case when par_no % 6 = 0 then text || '  ' when par_no % 3 = 0 then text || ' more' else text end as text, "
    "par_no % 6 = 0 as no_op from v_paragraphs",
)



def _edit(t):
    """An edit of the paragraphs with tokens: every third changes, one in six to no effect; each document adds two citations and a reference."""
    p = t("v_paragraphs")
    c = p.where("par_no % 3 = 0").select("doc_id", "par_no", F.when(F.col("par_no") % 2 == 0, F.concat("text", F.lit("  "))).otherwise(F.concat("text", F.lit(" [[CITE:new_"), "doc_id", F.lit("]]"))).alias("text"))
    c = c.unionByName(p.where("par_no = 1 and doc_id % 10 = 0").select("doc_id", F.lit(100000).cast("long").alias("par_no"), "text"))
    cites = p.select("doc_id").distinct().select(F.explode(F.array(F.concat(F.lit("new_"), "doc_id"), F.concat(F.lit("lost_"), "doc_id"))).alias("citation_id"))
    refs = t("v_refs").select("reference_id")
    added = t("v_refs").where("part_key % 40 = 0").select("reference_id").unionByName(t("v_refs").where("part_key % 40 = 1").select(F.concat("reference_id", F.lit("_added_1")).alias("reference_id")))
    return ig.rebuild_errors(p, c, cites, refs, added, ["doc_id", "par_no"])


add(
    "e12_rebuild_errors",
    _edit,
    """select 'NO_OP' as kind, doc_id || '/' || par_no as subject from v_paragraphs where par_no % 6 = 0
    union all select 'ORPHAN_CHANGE', doc_id || '/100000' from v_paragraphs where par_no = 1 and doc_id % 10 = 0
    union all select 'UNPLACED_CITATION', 'lost_' || doc_id from (select distinct doc_id from v_paragraphs)
    union all select 'UNPLACED_CITATION', 'new_' || doc_id from v_paragraphs group by doc_id having not bool_or(par_no % 6 = 3)
    union all select 'REFERENCE_EXISTS', reference_id from v_refs where part_key % 40 = 0""",
)
SECTION = lambda: F.concat(F.lit("Section "), F.col("par_no") % 4)
REASON = lambda: F.when(F.length("text") <= 60, "TOO_SHORT").when(F.col("par_no") % 7 == 0, "PROTECTED")
add(
    "e13_edit_scope",
    lambda t: ig.edit_scope(t("v_paragraphs").select("doc_id", "par_no", SECTION().alias("section"), F.length("text").alias("words"), F.floor(F.length("text") / 2).alias("target"), REASON().alias("reason")), ["doc_id"]),
    """with p as (select doc_id, par_no, 'Section ' || (par_no % 4) as section, length(text) as n, case when length(text) <= 60 then 'TOO_SHORT' when par_no % 7 = 0 then 'PROTECTED' end as reason from v_paragraphs)
    select doc_id, section, count(*) as paragraphs, coalesce(string_agg(par_no::varchar, ',' order by par_no) filter (reason is null), '') as targets, coalesce(string_agg(par_no || ':' || reason, ',' order by par_no) filter (reason is not null), '') as skipped,
    sum(n)::bigint as words_before, sum(case when reason is null then n // 2 else n end)::bigint as words_target from p group by 1, 2""",
)
add(
    "a10_evidence_anchors",
    lambda t: ig.evidence_anchors(seg.evidence_spans(t("v_paragraphs"), ["doc_id", "par_no"]), t("v_paragraphs").select("doc_id", "par_no", F.lit("span_000").alias("span_id"), F.lit(1).alias("place")), ["doc_id", "par_no"]),
)


def _enriched(t):
    f = t("v_refs").select(
        F.col("reference_id").alias("finding_id"), (F.col("paper_id") % 300).alias("doc_id"), F.col("bibliography_order").alias("par_no"), F.when(F.col("part_key") % 3 > 0, F.col("reference_id")).alias("reference_id"),
        F.array("part_key", F.col("part_key") + 1).alias("suggested"), F.array(F.lit("first")).alias("rationales"),
    )
    w = t("v_works").where("provider = 'OPENALEX'").select(F.col("work_key").alias("record_id"), "title", "doi", "url")
    return rw.enrich_findings(f, t("v_paragraphs").withColumn("section", SECTION()), t("v_refs"), w)


add(
    "a21_enrich_findings",
    _enriched,
    """with w as (select work_key, title || '|' || case when url like 'https://%' then url else 'https://doi.org/' || doi end as s from v_works where provider = 'OPENALEX' and (url like 'https://%' or doi is not null))
    select r.reference_id as finding_id, coalesce('Section ' || (p.par_no % 4), '') as section_title, coalesce(p.text, '') as claim_text, case when part_key % 3 > 0 then coalesce(nullif(trim(title), ''), substr(raw_text, 1, 160)) end as reference_label,
    array_to_string(list_filter([a.s || '|first', b.s || '|'], lambda x: x is not null), ';') as suggestions
    from v_refs r left join v_paragraphs p on p.doc_id = r.paper_id % 300 and p.par_no = r.bibliography_order left join w a on a.work_key = part_key left join w b on b.work_key = part_key + 1""",
    (("v_refs", "paper_id, bibliography_order, reference_id, part_key, title, family, year, raw_text"),),
)


def _hosts(t, other: bool):
    s = t("v_paragraphs").select("doc_id", F.lit(1).alias("par_no"), F.col("par_no").alias("sent_no"), (F.concat("text", F.lit("!")) if other else F.col("text")).alias("text"))
    if other:
        s = s.withColumn("text", F.when(F.col("sent_no") % 4 == 0, F.col("text")).otherwise(F.expr("substring(text, 1, length(text) - 1)")))
    return seg.citation_contexts(s.withColumn("cites", F.col("sent_no") % 2 == 0), ["doc_id", "par_no"], 1).select("doc_id", "sent_no", "host")


add(
    "d08_changed_contexts",
    lambda t: _hosts(t, False).join(_hosts(t, True).withColumnRenamed("host", "host2"), ["doc_id", "sent_no"]).where(text_sha256(F.col("host")) != text_sha256(F.col("host2"))).select("doc_id", "sent_no"),
    "select doc_id, par_no as sent_no from v_paragraphs where par_no % 4 = 0",
)
ADDED_VERDICT = lambda: F.when(F.col("reference_id").isNull(), "SOURCE_UNRESOLVED").when(F.col("printed_order") % 4 == 0, "PARTIALLY_SUPPORTED").when(F.col("printed_order") % 10 == 6, "CONTRADICTED").otherwise("SUPPORTED")
add(
    "v12_new_support_check",
    lambda t: ig.new_support_status(t("v_items").where("printed_order % 2 = 0").select("paper_id", ADDED_VERDICT().alias("verdict")), "paper_id"),
    """with v as (select paper_id, reference_id is null or (printed_order % 4 > 0 and printed_order % 10 = 6) as bad, reference_id is not null and printed_order % 4 = 0 as part from v_items where printed_order % 2 = 0)
    select paper_id, count(*) filter (bad) as unsupported, count(*) filter (part) as partial, case when bool_or(bad) then 'BLOCKED' when bool_or(part) then 'WARNED' else 'PASSED' end as status from v group by 1""",
)


def _attached(t):
    changed = _hosts(t, False).join(_hosts(t, True).withColumnRenamed("host", "host2"), ["doc_id", "sent_no"]).where(text_sha256(F.col("host")) != text_sha256(F.col("host2")))
    at = lambda c: F.element_at(F.array(*map(F.lit, rw.VERDICTS)), (c % 4 + 1).cast("int"))
    judged = t("v_paragraphs").where("doc_id % 7 > 0").select("doc_id", F.col("par_no").alias("sent_no"), F.posexplode(F.array(at(F.length("text")), at(F.col("doc_id")))).alias("place", "verdict"))
    return ig.attachment_status(changed, judged, ["doc_id", "sent_no"], "doc_id")


add(
    "v13_attachment_status",
    _attached,
    """with v as (select doc_id, case when doc_id % 7 = 0 then -1 else greatest(length(text) % 4, doc_id % 4) end as w from v_paragraphs where par_no % 4 = 0)
    select doc_id, count(*) as affected, count(*) filter (w = 0) as verified, count(*) filter (w = 3) as contradicted, count(*) filter (w = -1) as unverifiable,
    case when bool_or(w = 3) then 'BLOCKED' when bool_or(w <> 0) then 'WARNED' else 'PASSED' end as status from v group by 1""",
)
add(
    "v14_block_mutation",
    lambda t: rv.hash_changes(t("part"), t("part").where("p_partkey % 50 > 0"), "p_partkey", "p_name", "BLOCK").groupBy("kind").agg(F.count(F.lit(1)).alias("blockers")),
    "select 'BLOCK_REMOVED' as kind, count(*) as blockers from part where p_partkey % 50 = 0",
)
add(
    "v21_content_present",
    lambda t: ig.content_present(t("benchmark"), t("documents")),
    f"select item_id from benchmark b where trim({norm_sql('b.text')}) <> '' and exists (select 1 from documents d where contains(lower({norm_sql('d.text')}), "
    f"lower({norm_sql('b.text')})))",
)
JSON_A = lambda: F.to_json(F.struct(F.concat(F.lit("https://openalex.org/W"), "p_partkey").alias("id"), F.concat(F.lit("https://doi.org/10.1000/P"), "p_partkey").alias("doi"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("display_name"), F.when(F.col("p_partkey") % 3 == 0, "book-chapter").otherwise("unknown").alias("type"), F.struct(F.lit("1").alias("first_page"), F.when(F.col("p_partkey") % 5 > 0, "9").alias("last_page")).alias("biblio")))
add(
    "s03_works_from_openalex",
    lambda t: sh.works_from_openalex(t("part").select(JSON_A().alias("json"))).select("external_id", "title", "doi", "pages", "work_type"),
    "select 'W' || p_partkey as external_id, case when p_partkey % 2 = 0 then p_name else p_brand end as title, '10.1000/p' || p_partkey "
    "as doi, case when p_partkey % 5 > 0 then '1-9' else '1' end as pages, case when p_partkey % 3 = 0 then 'chapter' else 'document' "
    "end as work_type from part",
)
JSON_B = lambda: F.to_json(F.struct(F.concat(F.lit("S"), "p_partkey").alias("paperId"), F.struct(F.concat(F.lit("10.1/X"), "p_partkey").alias("DOI")).alias("externalIds"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_type")).alias("venue"), F.array(F.lit("Odd"), F.when(F.col("p_partkey") % 3 == 0, "Conference").otherwise("Other"), F.lit("Review")).alias("publicationTypes")))
add(
    "s04_works_from_s2",
    lambda t: sh.works_from_s2(t("part").select(JSON_B().alias("json"))).select("external_id", "title", "doi", "venue", "work_type"),
    "select 'S' || p_partkey as external_id, p_name as title, '10.1/x' || p_partkey as doi, case when p_partkey % 2 = 1 then p_type "
    "end as venue, case when p_partkey % 3 = 0 then 'paper-conference' else 'article-journal' end as work_type from part",
)


def _overlap(b):
    return (b["na"] / b["nb"]).clip(0, 1)


add(
    "u01_judge",
    lambda t: rw.judge(t("v_refs").select("reference_id", F.length("title").alias("na"), F.length("raw_text").alias("nb")), _overlap, "reference_id string, na int, nb int").select("reference_id", F.round("judgement", 9).alias("judgement"), "provider", "model"),
    "select reference_id, round(length(title)::double / length(raw_text), 9) as judgement, 'local' as provider, 'lexical' as model from v_refs",
)


def _grounded(t):
    rows = t("v_items").where("reference_id is not null").select("paper_id", "reference_id", F.length("marker_fragment").alias("na"), F.length("citation_id").alias("nb"))
    judged = rw.judge(rows, _overlap, "paper_id long, reference_id string, na int, nb int")
    return rw.grounded(judged, t("v_refs").select("paper_id", "reference_id"), "paper_id", "reference_id")[0].select("paper_id", "reference_id", F.round("judgement", 9).alias("judgement"))


add(
    "u01_judge_grounded",
    _grounded,
    "select paper_id, reference_id, round(least(1.0, length(marker_fragment)::double / length(citation_id)), 9) as judgement from v_items where reference_id is not null and paper_id not in (select paper_id from v_items where reference_id = 'ref_missing')",
)
QUERIES, ORACLE = R.QUERIES, R.ORACLE
