"""Queries of review and evaluation."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions import segmentation as seg
from folioflow.functions.text import https_link, title_tokens, word_count
from folioflow.operators import evaluation as ev
from folioflow.operators import linkage as lk
from folioflow.operators import markers as mk
from folioflow.operators import resolution as rs
from folioflow.operators import review as rw
from folioflow.sources.scratch import written

from .linkage_queries import CHANGE_SQL, FIXED_SQL, ISSUES_SQL, KIND, LINKED, STATUS_SQL, changes, issues
from .registry import Registry
from .resolution_queries import HELD, KEYS, LADDER, NO_LADDER, TITLES
from .text_queries import TITLE_SQL, words_sql

R = Registry()
add = R.add
PARS = lambda t: t("v_paragraphs").select("doc_id", "par_no", (F.length("text") % 5).cast("long").alias("citations"))
add(
    "a01_paragraphs_by_density",
    lambda t: rw.paragraphs_by_density(PARS(t), 4).select("doc_id", "par_no", "place"),
    "select * from (select doc_id, par_no, row_number() over (partition by doc_id order by length(text) % 5 desc, par_no) as place "
    "from v_paragraphs) where place <= 4",
)
TITLE = lambda: F.when(F.col("par_no") % 5 == 0, "Introduction").when(F.col("par_no") % 5 == 1, "Methods").when(F.col("par_no") % 5 == 2, "Results and discussion").otherwise("Other")
PRIO = "case par_no % 5 when 0 then 0 when 1 then 3 when 2 then 1 else 2 end"
add(
    "a02_section_priority",
    lambda t: t("v_paragraphs").select("doc_id", "par_no", rw.section_priority(TITLE()).alias("priority")),
    f"select doc_id, par_no, {PRIO} as priority from v_paragraphs",
)
CLAIMS = lambda t: t("v_paragraphs").select("doc_id", "par_no", F.lit(0).alias("claim_no"), rw.section_priority(TITLE()).alias("priority"), (F.length("text") % 4 == 0).alias("rejected"))
add(
    "a03_budgeted_claims",
    lambda t: rw.budgeted_claims(CLAIMS(t)).select("doc_id", "par_no", "place"),
    f"select * from (select doc_id, par_no, row_number() over (partition by doc_id order by {PRIO}, par_no) as place from v_paragraphs "
    f"where length(text) % 4 <> 0) where place <= 12",
)
OFFERED = lambda t: t("v_refs").select("paper_id", F.col("reference_id").alias("offered_id"))
ANSWERS = lambda t: t("v_items").where("reference_id is not null").select("paper_id", "citation_id", F.col("reference_id").alias("offered_id"))
add(
    "a04_ground_ids",
    lambda t: rw.ground_ids(ANSWERS(t), OFFERED(t), "paper_id"),
    "select paper_id, citation_id, reference_id as offered_id from v_items where reference_id is not null and paper_id not in (select "
    "paper_id from v_items where reference_id = 'ref_missing')",
)
add(
    "a04_rejected_responses",
    lambda t: rw.rejected_responses(ANSWERS(t), OFFERED(t), "paper_id"),
    "select paper_id, count(*) as foreign_ids from v_items where reference_id = 'ref_missing' group by 1",
)
add(
    "a05_require_choice",
    lambda t: rw.require_choice(t("v_state_log"), "state", ["ACCEPTED", "REJECTED"]).groupBy("permitted").agg(F.count(F.lit(1)).alias("n")),
    "select state in ('ACCEPTED', 'REJECTED') as permitted, count(*) as n from v_state_log group by 1",
)
add(
    "a06_uncited_claims",
    lambda t: rw.uncited_claims(t("v_refs").select("paper_id", "reference_id"), t("v_items").where("reference_id is not null"), ["reference_id"]).select("reference_id", "kind"),
    "select reference_id, 'UNCITED_CLAIM' as kind from v_refs where reference_id not in (select reference_id from v_items where reference_id is not null)",
)
add(
    "a07_unlinked_citation_findings",
    lambda t: rw.unlinked_citation_findings(t("v_items").select("citation_id").distinct(), t("v_items")),
    "select citation_id, 'UNLINKED_CITATION' as kind from v_items group by 1 having bool_and(reference_id is null)",
)
add(
    "a08_support_pairs",
    lambda t: rw.support_pairs(t("v_items").select("citation_id", F.lit(1).alias("claim_no")).distinct(), t("v_items")),
    "select citation_id, 1 as claim_no, reference_id from v_items where reference_id is not null",
)
add(
    "a09_server_verdict",
    lambda t: t("v_refs").select("reference_id", rw.server_verdict(F.when(F.col("part_key") % 5 > 0, F.lit("w")), F.when(F.col("part_key") % 3 == 0, "UNCERTAIN").otherwise("PROBABLE"), F.when(F.col("part_key") % 2 == 0, F.lit("text")), F.lit("SUPPORTED")).alias("verdict")),
    "select reference_id, case when part_key % 5 = 0 then 'SOURCE_UNRESOLVED' when part_key % 3 = 0 then 'SOURCE_IDENTITY_UNCERTAIN' "
    "when part_key % 2 = 1 then 'EVIDENCE_UNAVAILABLE' else 'SUPPORTED' end as verdict from v_refs",
)


def _ranked(t, refs):
    wanted = refs.select("paper_id", (F.col("bibliography_order") % 2).alias("claim_id"), (F.col("part_key") + F.col("bibliography_order") % 3).alias("work_key"), F.col("bibliography_order").alias("rank"))
    w = t("v_works").where("provider = 'OPENALEX'").select("work_key", "provider", "external_id", "title", "doi", "arxiv_id", https_link(F.col("url"), F.col("doi")).alias("link"))
    return wanted.join(w, "work_key").drop("work_key")


def _missing(t):
    refs = written(t("v_refs").select("paper_id", "bibliography_order", "part_key", "doi", "title"), "refs")
    return rw.missing_work(_ranked(t, refs), rs.holdings(t("v_papers"), refs))


add(
    "a11_missing_work",
    _missing,
    f"""with {NO_LADDER}, {KEYS}, {TITLES},
    offered as (select r.paper_id, bibliography_order % 2 as claim_id, bibliography_order as rank, w.provider, external_id, w.title, w.doi, w.arxiv_id from v_refs r join v_works w on w.work_key = part_key + bibliography_order % 3
      where w.provider = 'OPENALEX' and (w.url like 'https://%' or w.doi <> '')), {HELD},
    f as (select paper_id, claim_id, external_id, min(rank) as rank from fresh group by 1, 2, 3),
    p as (select *, row_number() over (partition by paper_id, claim_id order by rank, external_id) as place from f)
    select paper_id, claim_id, string_agg(external_id, ',' order by place) as suggestions from p where place <= 3 group by 1, 2""",
)


def _noted(t):
    """Every third reference stands for an uncited claim; the first two of a paper are searched, and find what their keys say."""
    claims = t("v_refs").select("paper_id", F.col("reference_id").alias("claim_id"), "bibliography_order", "part_key", F.when(F.col("part_key") % 3 == 0, "UNCITED_CLAIM").otherwise("UNLINKED_CITATION").alias("kind"))
    place = F.row_number().over(W.partitionBy("paper_id").orderBy("bibliography_order"))
    searched = claims.where("kind = 'UNCITED_CLAIM'").withColumn("place", place).where("place <= 2")
    notes = searched.select("claim_id", rw.search_note(F.col("part_key") % 2 == 0, F.col("part_key") % 5, F.lit(1), F.lit(0)).alias("note"))
    return rw.with_search_notes(claims.select("claim_id", "kind"), notes)


add(
    "a12_budget_notes",
    _noted,
    """with c as (select *, case when part_key % 3 = 0 then 'UNCITED_CLAIM' else 'UNLINKED_CITATION' end as kind from v_refs),
    s as (select reference_id, part_key from (select *, row_number() over (partition by paper_id order by bibliography_order) as place from c where kind = 'UNCITED_CLAIM') where place <= 2)
    select c.reference_id as claim_id, kind, case when kind <> 'UNCITED_CLAIM' then null when s.reference_id is null then 'NOT_SEARCHED_BUDGET_SPENT' when c.part_key % 2 = 0 then 'SEARCH_DEGRADED'
      when c.part_key % 5 = 1 then 'ALL_ALREADY_CITED' when c.part_key % 5 = 0 then 'NOTHING_FOUND' end as note from c left join s using (reference_id)""",
    ("v_refs",),
)
add(
    "a12_search_notes",
    lambda t: t("events").select("event_id", rw.search_note(F.col("event_type") == "error", F.col("event_id") % 3, F.col("event_id") % 2, F.col("user_id") % 2).alias("note")),
    "select event_id, case when event_type = 'error' then 'SEARCH_DEGRADED' when event_id % 3 > 0 and event_id % 2 = event_id % 3 "
    "then 'ALL_ALREADY_CITED' when event_id % 3 > 0 and user_id % 2 = event_id % 3 - event_id % 2 then 'INCOMPLETE_RECORDS' when event_id "
    "% 3 = 0 then 'NOTHING_FOUND' end as note from events",
)
add(
    "a13_coverage_label",
    lambda t: rw.coverage_label(t("v_attempts")),
    "select operation_id, case count(distinct provider) filter (status <> 'RATE_LIMITED') when 2 then 'BOTH' when 1 then max(provider) "
    "filter (status <> 'RATE_LIMITED') || '_ONLY' else 'NONE_REACHABLE' end as coverage from v_attempts group by 1",
)
add(
    "a14_unresolved_references",
    lambda t: rw.unresolved_reference_findings(rs.resolution_ladder(t("v_refs"), t("v_works"))),
    f"with {LADDER} select paper_id, reference_id, 'UNRESOLVED_REFERENCE' as kind from ld where confidence not in ('CERTAIN', 'PROBABLE')",
)


def _findings(t):
    a = t("v_items").where("reference_id is null").select("paper_id", F.lit("UNLINKED_CITATION").alias("kind"), (F.col("printed_order") % 2 == 0).alias("open"))
    b = t("v_refs").where("title = ''").select("paper_id", F.lit("UNRESOLVED_REFERENCE").alias("kind"), (F.col("part_key") % 2 == 0).alias("open"))
    return rw.all_findings([a, b])


FIND = (
    "fn as (select paper_id, 'UNLINKED_CITATION' as kind, printed_order % 2 = 0 as open from v_items where reference_id is null union "
    "all select paper_id, 'UNRESOLVED_REFERENCE', part_key % 2 = 0 from v_refs where title = '')"
)
add("a15_all_findings", _findings, f"with {FIND} select * from fn")
add(
    "a16_severity_order",
    lambda t: _findings(t).select("paper_id", rw.severity(F.col("kind")).alias("severity")),
    f"with {FIND} select paper_id, case kind when 'UNRESOLVED_REFERENCE' then 2 else 3 end as severity from fn",
)
add(
    "a17_run_stats",
    lambda t: rw.run_stats(
        t("v_paragraphs").select((F.col("par_no") <= 3).alias("reviewed")),
        t("v_refs"),
        _findings(t),
        t("v_items").where("reference_id is not null").select((F.col("printed_order") % 3 > 0).alias("completed")),
        t("v_items").select((F.col("reference_id") == "ref_missing").alias("rejected")),
        t("v_paragraphs").where("length(text) % 4 <> 0").select(F.concat_ws("/", "doc_id", "par_no").alias("claim_id"), F.col("doc_id").alias("paragraph_id")),
        t("v_refs").where("part_key % 4 = 1"),
        t("v_attempts"),
        t("v_refs").select(F.when(F.col("doi").isNotNull(), "CERTAIN").otherwise("UNCERTAIN").alias("confidence")),
    ),
    f"""with {FIND} select (select count(*) filter (par_no <= 3) from v_paragraphs) as paragraphs_reviewed, (select count(*) from v_paragraphs) as paragraphs_total, 500 as paragraph_limit, (select count(*) from v_refs) as references_total,
    (select count(*) from fn) as findings, (select count(*) from v_items where reference_id is not null) as support_assertions_total, (select count(*) from v_items where reference_id is not null and printed_order % 3 > 0) as support_assertions_completed,
    (select count(*) from v_items where reference_id = 'ref_missing') as grounding_rejections, (select count(distinct doc_id || '/' || par_no) from v_paragraphs where length(text) % 4 <> 0) as claims_searched,
    (select count(distinct doc_id) from v_paragraphs where length(text) % 4 <> 0) as missing_work_paragraphs_searched, (select count(*) from v_refs where part_key % 4 = 1) as works_suggested, (select count(*) from v_attempts) as provider_calls,
    (select count(*) from v_refs where doi is not null) as references_resolved, (select count(*) from v_refs) as references_examined""",
    ("v_refs", "v_items"),
)
add(
    "a18_finding_facets",
    lambda t: rw.finding_facets(_findings(t)),
    f"with {FIND} select coalesce(kind, 'ALL') as kind, count(*) as n, count(*) filter (open) as open from fn group by rollup (kind)",
)
add(
    "a19_stale_runs",
    lambda t: rw.stale_runs(t("v_state_log").select("paper_id", F.col("proposal_id").alias("run_id"), F.col("base_revision").alias("revision")), t("v_revisions").groupBy("paper_id").agg(F.max("revision_number").alias("revision_number"))),
    "select paper_id, seen, revision_number from (select paper_id, arg_max(base_revision, proposal_id) as seen from v_state_log group "
    "by 1) join (select paper_id, max(revision_number) as revision_number from v_revisions group by 1) using (paper_id) where seen "
    "<> revision_number",
)


def _grouped(t):
    """Findings and citations dealt to the paragraphs of documents."""
    par = t("v_paragraphs").select("doc_id", "par_no", F.concat(F.lit("Section "), F.col("par_no") % 4).alias("section"))
    f = _findings(t).select((F.col("paper_id") % 200).alias("doc_id"), (F.col("paper_id") % 5 + 1).alias("par_no"), "kind")
    c = t("v_items").select((F.col("paper_id") % 200).alias("doc_id"), F.col("printed_order").alias("par_no"))
    return rw.findings_by_paragraph(f, par, c)


GROUPED = (
    f"{FIND}, pf as (select paper_id % 200 as doc_id, paper_id % 5 + 1 as par_no, string_agg(kind, ',' order by case kind when 'UNRESOLVED_REFERENCE' "
    f"then 2 else 3 end) as kinds, count(*) as findings from fn group by 1, 2)"
)
add("a20_findings_by_paragraph", lambda t: _grouped(t)[0], f"with {GROUPED} select * from pf")
add(
    "a20_section_counts",
    lambda t: _grouped(t)[1],
    f"""with {GROUPED}, pc as (select paper_id % 200 as doc_id, printed_order as par_no, count(*) as citations from v_items group by 1, 2)
    select doc_id, 'Section ' || (par_no % 4) as section, count(*) as paragraphs, coalesce(sum(findings), 0)::bigint as findings, coalesce(sum(citations), 0)::bigint as citations from v_paragraphs left join pf using (doc_id, par_no) left join pc using (doc_id, par_no) group by 1, 2""",
)


def _parsed(t):
    items = t("v_items")
    i = issues(t)
    refs = t("v_refs").select("paper_id", rs.normalization_status(F.col("title"), F.when(F.col("supp_key") % 3 > 0, F.col("author")), F.col("year")).alias("normalization"))
    kind = F.when(F.col("part_key") % 3 == 0, "FIGURE").when(F.col("part_key") % 3 == 1, "TABLE").otherwise("FORMULA")
    blocks = t("v_refs").select("paper_id", kind.alias("kind"), mk.block_status(kind, F.col("supp_key") % 2 == 0, F.col("supp_key") % 3 == 0).alias("fidelity"))
    pars = t("v_paragraphs").select(F.col("doc_id").alias("paper_id"), (F.col("par_no") % 4).alias("section"), word_count(F.col("text")).alias("words"))
    return rw.parse_quality(t("orders").select(F.col("o_orderkey").alias("paper_id")), pars, items, mk.parse_status(items, F.col("printed_order") % 5 == 0), refs, blocks, i)


add(
    "a22_parse_quality",
    _parsed,
    f"""with {ISSUES_SQL}, p as (select doc_id as paper_id, count(distinct par_no % 4) as sections, count(*) as paragraphs, sum({words_sql('text')})::bigint as words from v_paragraphs group by 1),
    i as (select paper_id, count(*) as citations, count(reference_id) as linked, count(*) - count(reference_id) as unlinked from v_items group by 1),
    s as (select paper_id, count(*) as clusters, count(*) filter (r) as raw_only, count(*) filter (not r and m and n > 1) as partial_modifiers from (select paper_id, citation_id, bool_or(reference_id is null) as r, bool_or(printed_order % 5 = 0) as m, count(*) as n from v_items group by 1, 2) group by 1),
    r as (select paper_id, count(*) as refs, count(*) filter (k = 3) as refs_complete, count(*) filter (k in (1, 2)) as refs_partial, count(*) filter (k = 0) as refs_raw_only from (select paper_id, case when title <> '' and supp_key % 3 > 0 and year is not null then 3 when title <> '' or supp_key % 3 > 0 then 1 else 0 end as k from v_refs) group by 1),
    b as (select paper_id, count(*) as blocks, count(*) filter (part_key % 3 = 0) as figures, count(*) filter (part_key % 3 = 1) as tables, count(*) filter (part_key % 3 = 2) as formulas, count(*) filter (part_key % 3 = 0 and supp_key % 2 > 0) as unrenderable from v_refs group by 1),
    l as (select paper_id, count(*) filter (code <> 'NOT_A_MARKER') as checked, count(*) filter (code = 'AGREED') as agreed, count(*) filter (code = 'MISMATCH') as mismatch, count(*) filter (code = 'RECOVERED') as recovered, count(*) filter (code = 'AMBIGUOUS') as ambiguous, count(*) filter (code = 'UNRESOLVED') as unresolved, count(*) filter (code = 'UNCERTAIN') as uncertain from li group by 1)
    select o_orderkey as paper_id, {", ".join(f"coalesce({c}, 0) as {c}" for c in "sections paragraphs words citations linked unlinked clusters raw_only partial_modifiers refs refs_complete refs_partial refs_raw_only blocks figures tables formulas unrenderable checked agreed mismatch recovered ambiguous unresolved uncertain".split())}
    from orders o left join p on p.paper_id = o_orderkey left join i on i.paper_id = o_orderkey left join s on s.paper_id = o_orderkey left join r on r.paper_id = o_orderkey left join b on b.paper_id = o_orderkey left join l on l.paper_id = o_orderkey""",
    (("v_refs", "paper_id, bibliography_order, reference_id, family, year, title, author, part_key, supp_key"),),
)
add(
    "a23_counts_with_zero",
    lambda t: rw.with_vocabulary(_findings(t).groupBy("paper_id", "kind").agg(F.count(F.lit(1)).alias("n")), "kind", ["MISSING_WORK", "UNLINKED_CITATION", "UNRESOLVED_REFERENCE"], ["paper_id"]),
    f"with {FIND}, g as (select paper_id, kind, count(*) as n from fn group by 1, 2) select p.paper_id, v.kind, coalesce(n, 0) as n "
    f"from (select distinct paper_id from fn) p, (select unnest(['MISSING_WORK', 'UNLINKED_CITATION', 'UNRESOLVED_REFERENCE']) as kind) "
    f"v left join g on p.paper_id = g.paper_id and v.kind = g.kind",
)
VERD = lambda: F.element_at(F.array(*map(F.lit, rw.VERDICTS)), (F.col("part_key") % 4 + 1).cast("int"))
add(
    "a24_severity_worst",
    lambda t: rw.severity_worst(t("v_refs").select("paper_id", F.col("bibliography_order").alias("place"), VERD().alias("verdict")), "paper_id"),
    "select paper_id, (['SUPPORTED', 'PARTIALLY_SUPPORTED', 'NOT_SUPPORTED', 'CONTRADICTED'])[max(part_key % 4) + 1] as verdict from v_refs group by 1",
)
add(
    "a25_paper_detail",
    lambda t: rw.paper_detail(
        t("customer").select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("name")),
        t("v_revisions"),
        t("v_items").groupBy(F.col("paper_id").alias("revision_id")).agg(F.count(F.lit(1)).alias("checked"), F.count("reference_id").alias("linked")),
    ),
    """select c_custkey as paper_id, c_name as name, coalesce(revisions, 0) as revisions, current_id, checked, linked from customer left join (select paper_id, count(*) as revisions, arg_max(revision_id, revision_number) as current_id from v_revisions group by 1) r on c_custkey = r.paper_id
    left join (select v.paper_id, checked, linked from v_revisions v join (select paper_id as revision_id, count(*) as checked, count(reference_id) as linked from v_items group by 1) i using (revision_id) where revision_number = 1) f on c_custkey = f.paper_id""",
)
add(
    "u02_lexical_rank",
    lambda t: rw.lexical_rank(
        t("v_refs").where("title <> ''").select(F.col("reference_id").alias("id"), title_tokens(F.col("title")).alias("tokens")),
        t("v_works").select(rs.work_id().alias("id"), title_tokens(F.col("title")).alias("tokens")),
        3,
    ).select("claim_id", "work_id", "rank", F.round("score", 9).alias("score")),
    f"""with c as (select distinct title, {TITLE_SQL.format("title")} as k from v_refs where title <> ''), w as (select provider || ':' || external_id as work_id, {TITLE_SQL.format("title")} as k from v_works),
    x as (select title, len(k) as n, unnest(k) as t from c), y as (select work_id, len(k) as n, unnest(k) as t from w),
    s as (select title, work_id, count(*) / (x.n + y.n - count(*))::double as score from x join y using (t) group by title, work_id, x.n, y.n),
    r as (select *, row_number() over (partition by title order by score desc, work_id) as rank from s)
    select reference_id as claim_id, work_id, rank, round(score, 9) as score from v_refs join r using (title) where rank <= 3""",
    ("v_refs", "v_works"),
)
add(
    "u03_claim_candidates",
    lambda t: rw.claim_candidates(t("v_paragraphs").select("doc_id", F.col("par_no").alias("sent_no"), "text"), ["doc_id"]).select("doc_id", "sent_no", "place"),
    "select * from (select doc_id, par_no as sent_no, row_number() over (partition by doc_id order by regexp_matches(text, '\\d') "
    "desc, length(text) desc, par_no) as place from v_paragraphs) where place <= 3",
)

# --- evaluation
LAB = lambda t: t("v_items").select("paper_id", F.col("marker_fragment").alias("marker"), F.col("printed_order").alias("seq"))
add(
    "x01_marker_detection",
    lambda t: ev.marker_detection(LAB(t), LAB(t).where("seq % 4 > 0")),
    "with l as (select paper_id, marker_fragment as m, row_number() over (partition by paper_id, marker_fragment order by printed_order) "
    "as k from v_items), p as (select paper_id, marker_fragment as m, row_number() over (partition by paper_id, marker_fragment order "
    "by printed_order) as k from v_items where printed_order % 4 > 0) select paper_id, count(*) as labelled, count(p.k) as detected, "
    "round(count(p.k)::double / count(*), 4) as rate from l left join p using (paper_id, m, k) group by 1",
)
add(
    "x02_linkage_rate",
    lambda t: ev.linkage_rate(t("v_items").select("paper_id", "citation_id", "printed_order", F.when(F.col("reference_id").isNotNull(), F.when(F.col("reference_id") == "ref_missing", -1).otherwise(F.col("printed_order"))).alias("linked"))),
    "select paper_id, count(*) filter (n > 0) as checkable, count(*) filter (ok) as \"right\", case when count(*) filter (n > 0) > "
    "0 then round((count(*) filter (ok))::double / count(*) filter (n > 0), 4) end as rate from (select paper_id, citation_id, bool_and(reference_id "
    "is not null and reference_id <> 'ref_missing') as ok, count(reference_id) as n from v_items group by 1, 2) group by 1",
)
add(
    "x03_marker_precision",
    lambda t: ev.marker_precision(LAB(t), LAB(t).where("seq % 3 > 0")),
    "with p as (select paper_id, marker_fragment as m, count(*) as p, count(*) filter (printed_order % 3 > 0) as l from v_items group "
    "by 1, 2) select paper_id, sum(p)::bigint as parsed, sum(greatest(0, p - l))::bigint as spurious, round((sum(p) - sum(greatest(0, "
    "p - l)))::double / sum(p), 4) as precision from p group by 1",
)
add(
    "x04_field_accuracy",
    lambda t: ev.field_accuracy(t("v_refs").withColumn("title", F.when(F.col("part_key") % 3 == 0, F.upper("title")).otherwise("x")), t("v_refs").withColumn("author", F.concat(F.lit("J. "), "family", F.lit(", K. Doe")))),
    "select paper_id, count(*) as checks, count(*) filter (part_key % 3 = 0) as titles, count(year) as years, count(*) as families, "
    "round((count(*) filter (part_key % 3 = 0))::double / count(*), 4) as title_rate from v_refs group by 1",
)
add(
    "x05_bibliography_retention",
    lambda t: ev.retention(t("v_refs"), t("v_refs").where("title <> ''")),
    "select paper_id, count(*) as labelled, count(*) filter (title <> '') as retained, round((count(*) filter (title <> ''))::double "
    "/ count(*), 4) as rate from v_refs group by 1",
)
BLOCKS = lambda t: t("v_refs").select("paper_id", F.when(F.col("part_key") % 3 == 0, "FIGURE").when(F.col("part_key") % 3 == 1, "TABLE").otherwise("FORMULA").alias("kind"), F.when(F.col("supp_key") % 4 == 0, "UNRENDERABLE").otherwise("PRESERVED").alias("fidelity"), (F.col("supp_key") % 5 == 0).alias("floating"))
LABELLED = lambda t: t("orders").select(F.col("o_orderkey").alias("paper_id"), (F.col("o_orderkey") % 6).alias("labelled_figures"), (F.col("o_orderkey") % 4).alias("labelled_tables"))
X6 = """select o_orderkey as paper_id, o_orderkey % 6 as labelled_figures, o_orderkey % 4 as labelled_tables, coalesce(f, 0) as figures_recovered, coalesce(t, 0) as tables_recovered, coalesce(u, 0) as unrenderable, coalesce(l, 0) as floating
  from orders left join (select paper_id, count(*) filter (part_key % 3 = 0) as f, count(*) filter (part_key % 3 = 1) as t, count(*) filter (supp_key % 4 = 0) as u, count(*) filter (supp_key % 5 = 0) as l from v_refs group by 1) b on b.paper_id = o_orderkey"""
add("x06_block_inventory", lambda t: ev.block_inventory(LABELLED(t), BLOCKS(t)), X6)
X7 = (
    "select paper_id, structured, raw_only, items, linked, round(linked::double / items, 4) as coverage from (select paper_id, count(*) "
    "filter (after = 'STRUCTURED') as structured, count(*) filter (after = 'RAW_ONLY') as raw_only from {} group by 1) join (select "
    "paper_id, count(*) as items, count(reference_id) as linked from {} group by 1) using (paper_id)"
)
add(
    "x07_status_counts",
    lambda t: ev.status_counts(mk.parse_status(t("v_items")), t("v_items")),
    f"with {STATUS_SQL} {X7.format('(select *, parse_status as after from st)', 'v_items')}",
    ("v_items",),
)


def _effect(t):
    i = issues(t)
    before = ev.status_counts(mk.parse_status(t("v_items")), t("v_items"))
    after = ev.status_counts(changes(t, i).withColumnRenamed("after", "parse_status"), lk.apply_repairs(t("v_items"), i))
    return ev.effect_report(before, after)


add(
    "x08_effect_report",
    _effect,
    f"with {CHANGE_SQL}, b as ({X7.format('(select *, before as after from (select paper_id, before from ch))', 'v_items')}), a as "
    f"({X7.format('ch', 'fx')}) select b.paper_id, b.structured as structured_before, b.raw_only as raw_only_before, b.coverage as "
    f"coverage_before, a.structured as structured_after, a.raw_only as raw_only_after, a.coverage as coverage_after from b join a using "
    f"(paper_id)",
    LINKED,
)


def _reports(t):
    items = t("v_items")
    linked = items.select("paper_id", "citation_id", "printed_order", F.when(F.col("reference_id").isNotNull(), F.when(F.col("reference_id") == "ref_missing", -1).otherwise(F.col("printed_order"))).alias("linked"))
    return ev.eval_table({
        "markers": ev.marker_detection(LAB(t), LAB(t).where("seq % 4 > 0")),
        "linkage": ev.linkage_rate(linked),
        "precision": ev.marker_precision(LAB(t), LAB(t).where("seq % 3 > 0")),
        "bibliography": ev.retention(t("v_refs"), t("v_refs").where("title <> ''")),
        "blocks": ev.block_inventory(LABELLED(t), BLOCKS(t)),
        "status": ev.status_counts(mk.parse_status(items), items),
    })


def _report_sql(names: list[str]) -> str:
    """The SQL of each report under its name, joined by paper."""
    return " full join ".join(f"(select paper_id, columns(* exclude (paper_id)) as \"{n}_\\0\" from ({{{n}}})) {n}" + (" using (paper_id)" if i else "") for i, n in enumerate(names))


REPORTS = {"markers": "x01_marker_detection", "linkage": "x02_linkage_rate", "precision": "x03_marker_precision", "bibliography": "x05_bibliography_retention", "blocks": "x06_block_inventory", "status": "x07_status_counts"}
add(
    "x09_eval_table",
    _reports,
    "select * from " + _report_sql(list(REPORTS)).format(**{n: R.ORACLE[q] for n, q in REPORTS.items()}),
    ("v_refs", "v_items"),
)
QUERIES, ORACLE = R.QUERIES, R.ORACLE
