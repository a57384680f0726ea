"""Queries of the text, identifier and segmentation operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import segmentation as seg
from folioflow.functions import text as t
from folioflow.sources import shredding as sh
from folioflow.sources.scratch import shared_dir

from .registry import Registry

R = Registry()
WS = "'[ \\t\\n\\x0B\\f\\r]+'"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace({x}, {WS}, ' ', 'g'))"


def words_sql(x: str) -> str:
    return f"case when {norm_sql(x)} = '' then 0 else len(string_split({norm_sql(x)}, ' ')) end"


FOLD_SQL = "replace(lower(strip_accents(trim({}))), 'ß', 'ss')"
SPLIT_ACCENTS = "replace(lower({0}), 'ß', 'ss')"
for _base, _letters in {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}.items():
    SPLIT_ACCENTS = f"regexp_replace({SPLIT_ACCENTS}, '[{_letters}]', '{_base}-', 'g')"
TITLE_SQL = (
    f"list_filter(list_distinct(regexp_extract_all({SPLIT_ACCENTS}, '[a-z0-9]+')), lambda x: not list_contains(['a','an','and','for','from','in','of','on','the','to','via','with'], "
    f"x))"
)
DOI_SQL = (
    "case when lower(rtrim(regexp_replace(regexp_replace(trim({0}), '^(?i)https?://(dx\\.)?doi\\.org/', ''), '^(?i)doi:\\s*', ''), "
    "'.')) like '10.%' then lower(rtrim(regexp_replace(regexp_replace(trim({0}), '^(?i)https?://(dx\\.)?doi\\.org/', ''), '^(?i)doi:\\s*', "
    "''), '.')) end"
)
FIRST_SENTENCE = "regexp_extract(text, '^[^.]*', 0)"


def paragraphs(name: str, value: Callable[[], Column], sql: str) -> None:
    """One value per paragraph."""
    R.add(name, lambda tab: tab("v_paragraphs").select("doc_id", "par_no", value().alias("value")), f"select doc_id, par_no, {sql} as value from v_paragraphs")


def refs(name: str, value: Callable[[], Column], sql: str) -> None:
    """One value per bibliography entry."""
    R.add(name, lambda tab: tab("v_refs").select("reference_id", value().alias("value")), f"select reference_id, {sql} as value from v_refs")


text = "text"
paragraphs("t01_normalize_text", lambda: t.normalize_text(t.composed(F.col(text))), norm_sql("nfc_normalize(text)"))
paragraphs("t02_text_sha256", lambda: t.text_sha256(F.col(text)), f"sha256({norm_sql('nfc_normalize(text)')})")
refs(
    "t03_canonical_sha256",
    lambda: t.canonical_sha256({"title": F.col("title"), "id": F.col("reference_id"), "order": F.col("bibliography_order")}, ("title", "id")),
    """sha256('{"id":"' || reference_id || '","order":' || bibliography_order || ',"title":"' || nfc_normalize(title) || '"}')""",
)
R.add(
    "t04_word_count",
    lambda tab: tab("v_paragraphs").withColumn("w", t.word_count(text)).groupBy("doc_id").agg(F.sum("w").cast("long").alias("words"), F.count(F.lit(1)).alias("paragraphs")),
    f"select doc_id, sum({words_sql('text')})::bigint as words, count(*) as paragraphs from v_paragraphs group by doc_id",
)
paragraphs(
    "t05_paragraph_text",
    lambda: t.paragraph_text(F.array(F.substring(text, 1, 20), F.lit(" "), F.lit(". "), F.expr("substring(text, 21)"))),
    "regexp_replace(substr(text, 1, 20) || ' ' || '. ' || substr(text, 21), '[ \\t\\n\\x0B\\f\\r]+([.,;:!?)\\]}])', '\\1', 'g')",
)
paragraphs("t06_fold_name", lambda: t.fold_name(F.regexp_extract(text, r"^[^\s]+", 0)), FOLD_SQL.format("regexp_extract(text, '^[^\\s]+', 0)"))
paragraphs(
    "t07_title_key",
    lambda: F.array_join(F.array_sort(t.title_tokens(F.regexp_extract(text, "^[^.]*", 0))), " "),
    f"array_to_string(list_sort({TITLE_SQL.format(FIRST_SENTENCE)}), ' ')",
)
R.add(
    "t08_title_similarity",
    lambda tab: tab("v_refs").withColumn("s", t.jaccard(t.title_tokens(F.col("title")), t.title_tokens(F.col("raw_text")))).select("reference_id", F.round("s", 9).alias("similarity")),
    f"""select reference_id, round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) end, 9) as similarity
    from (select reference_id, {TITLE_SQL.format("title")} as a, {TITLE_SQL.format("raw_text")} as b from v_refs)""",
)
refs(
    "t09_normalise_doi",
    lambda: t.normalise_doi(F.concat(F.when(F.col("part_key") % 4 == 0, "  DOI: ").otherwise(""), F.coalesce("doi", F.lit("x")), F.lit("."))),
    DOI_SQL.format("(case when part_key % 4 = 0 then '  DOI: ' else '' end || coalesce(doi, 'x') || '.')"),
)
refs(
    "t10_doi_in",
    lambda: t.doi_in(F.col("raw_text")),
    DOI_SQL.format("nullif(regexp_extract(raw_text, '\\b(10\\.\\d{{4,9}}/[^\\s\"<>]+)', 1), '')".replace("{{", "{").replace("}}", "}")),
)
ARXIV_IN_SQL = "nullif(regexp_extract(raw_text, '(?i)arxiv[:\\s/]*(\\d{4}\\.\\d{4,5}(v\\d+)?)', 1), '')"
refs("t11_arxiv_in", lambda: t.arxiv_in(F.col("raw_text")), ARXIV_IN_SQL)


def arxiv_sql(x: str) -> str:
    a = f"regexp_replace(regexp_replace(trim({x}), '^(?i)arxiv:', ''), 'v\\d+$', '')"
    return f"case when regexp_matches({a}, '^(\\d{{4}}\\.\\d{{4,5}}|[a-z-]+(\\.[A-Z]{{2}})?/\\d{{7}})$') then {a} end"


refs(
    "t12_normalise_arxiv",
    lambda: t.normalise_arxiv(F.concat(F.when(F.col("part_key") % 2 == 0, "arXiv:").otherwise(""), F.coalesce(t.arxiv_in(F.col("raw_text")), F.lit("hep-th/9901001")))),
    arxiv_sql(f"(case when part_key % 2 = 0 then 'arXiv:' else '' end || coalesce({ARXIV_IN_SQL}, 'hep-th/9901001'))"),
)
refs(
    "t13_arxiv_from_doi",
    lambda: t.arxiv_from_doi(F.concat(F.when(F.col("part_key") % 3 == 0, "10.48550/arXiv.").otherwise("10.1000/"), F.coalesce(t.arxiv_in(F.col("raw_text")), F.lit("1706.03762")))),
    f"case when part_key % 3 = 0 then {arxiv_sql(f'coalesce({ARXIV_IN_SQL}, ' + chr(39) + '1706.03762' + chr(39) + ')')} end",
)
refs(
    "t14_arxiv_from_urls",
    lambda: t.arxiv_from_urls(F.array(F.lit("https://x.org/a"), F.concat(F.lit("http://arxiv.org/abs/"), F.coalesce(t.arxiv_in(F.col("raw_text")), F.lit("bad"))))),
    f"{arxiv_sql(f'coalesce({ARXIV_IN_SQL}, ' + chr(39) + 'bad' + chr(39) + ')')}",
)
paragraphs("t15_filter_safe", lambda: t.filter_safe(text), norm_sql("regexp_replace(text, '[,:|!+()?*]', ' ', 'g')"))
refs("t16_extract_year", lambda: t.extract_year(F.col("raw_text")), "nullif(regexp_extract(raw_text, '(1[6-9]\\d{2}|20\\d{2})', 1), '')::bigint")
R.add(
    "t17_normalise_marker",
    lambda tab: tab("v_items").select("citation_id", "item_index", t.normalise_marker(F.concat("marker_fragment", F.lit(" .,"))).alias("value")),
    f"select citation_id, item_index, lower(regexp_replace({norm_sql('marker_fragment || ' + chr(39) + ' .,' + chr(39))}, '[.,;]+$', "
    f"'')) as value from v_items",
)
R.add(
    "t18_https_link",
    lambda tab: tab("pages").select("page_id", t.https_link(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("10.1/"), "page_id"))).alias("value")),
    "select page_id, case when url like 'https://%' then url when page_id % 2 = 0 then 'https://doi.org/10.1/' || page_id end as value from pages",
)
AUTHORS = lambda: F.array(F.struct(F.col("family").alias("family"), F.when(F.col("supp_key") % 3 == 0, "J.").alias("given"), F.lit(None).cast("string").alias("literal")), F.struct(F.lit("").alias("family"), F.lit(None).cast("string").alias("given"), F.when(F.col("supp_key") % 2 == 0, F.concat(F.lit("Group  of "), "family")).otherwise("").alias("literal")))
refs(
    "t19_author_names",
    lambda: F.array_join(t.author_names(AUTHORS()), "|"),
    "case when supp_key % 3 = 0 then 'J. ' else '' end || family || case when supp_key % 2 = 0 then '|Group  of ' || family else '' end",
)
refs("t20_last_name", lambda: F.array_join(t.last_names(AUTHORS()), "|"), "lower(family)")
refs(
    "t21_surname_keys",
    lambda: F.array_join(F.array_sort(t.surname_keys(F.concat(F.lit("Van der "), "family"))), "|"),
    "array_to_string(list_sort(list_distinct(['van', 'der', lower(family), 'van der ' || lower(family)])), '|')",
)
refs(
    "t22_candidate_summary",
    lambda: t.candidate_summary(F.col("title"), F.array("family", "author"), F.col("year"), F.when(F.col("part_key") % 2 == 0, "Venue"), F.col("raw_text")),
    "title || ' (' || family || ', ' || author || ', ' || coalesce(year::varchar, 'n.d.') || ')' || case when part_key % 2 = 0 then "
    "chr(10) || 'Venue' else '' end || chr(10) || substr(raw_text, 1, 600)",
)
refs(
    "t23_locator_suffix",
    lambda: t.locator_suffix(F.when(F.col("part_key") % 3 > 0, F.col("bibliography_order").cast("string")), F.when(F.col("part_key") % 3 == 1, "page").otherwise("chapter"), F.when(F.col("part_key") % 2 == 0, "emphasis added")),
    "case when part_key % 3 > 0 then ', ' || case when part_key % 3 = 1 then 'p. ' else 'chap. ' end || bibliography_order else '' "
    "end || case when part_key % 2 = 0 then ', emphasis added' else '' end",
)
R.add(
    "t24_citation_signature",
    lambda tab: tab("v_items").groupBy("citation_id").agg(F.array_sort(F.collect_list(F.struct("item_index", F.concat_ws("|", F.coalesce("reference_id", F.lit("")), F.lit("NORMAL"), F.lit(""), F.lit("")).alias("s")))).alias("x")).select("citation_id", F.concat("citation_id", F.lit(":"), F.array_join(F.transform("x", lambda v: v["s"]), ";")).alias("signature")),
    "select citation_id, citation_id || ':' || string_agg(coalesce(reference_id, '') || '|NORMAL||', ';' order by item_index) as signature from v_items group by citation_id",
)
refs(
    "t25_describe_reference",
    lambda: t.describe_reference(F.col("title"), F.col("raw_text")),
    "coalesce(nullif(trim(title), ''), substr(raw_text, 1, 160))",
)
refs(
    "t26_page_range",
    lambda: t.page_range(F.when(F.col("part_key") % 2 == 0, F.col("part_key").cast("string")), F.when(F.col("part_key") % 3 == 0, "99"), F.lit("all")),
    "case when part_key % 6 = 0 then part_key || '-99' when part_key % 2 = 0 then part_key::varchar else 'all' end",
)

_listed = lambda words: ", ".join("'" + w.replace("\\", "") + "'" for w in words)

# --- sources
R.add(
    "s01_scan_tables",
    lambda tab: tab("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("least")),
    "select o_orderstatus, count(*) as n, min(o_orderkey) as least from orders group by 1",
)
R.add(
    "s05_reject_no_identity",
    lambda tab: sh.split_identity(tab("v_works").withColumn("external_id", F.when(F.col("work_key") % 5 == 0, " ").otherwise(F.col("external_id"))), "external_id").groupBy("provider", "accepted").agg(F.count(F.lit(1)).alias("n")),
    "select provider, work_key % 5 <> 0 as accepted, count(*) as n from v_works group by 1, 2",
)
R.add(
    "s06_abstract_from_inverted_index",
    lambda tab: sh.text_from_positions(sh.positions(tab("documents"), "doc_id", "text"), "doc_id"),
    f"select doc_id, string_agg(w, ' ' order by i) as text from (select doc_id, unnest(w) as w, unnest(range(len(w))) as i from (select "
    f"doc_id, list_filter(string_split({norm_sql('text')}, ' '), lambda x: x <> '') as w from documents)) group by doc_id",
)
R.add(
    "s07_sections_from_markup",
    lambda tab: sh.sections(tab("pages"), "page_id", "html"),
    """with c as (select page_id, regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g') as h from pages),
    a as (select page_id, regexp_extract(h, '(?is)<article[^>]*>(.*?)</article>', 1) as body from c where contains(h, '<article')),
    p as (select page_id, list_filter(string_split(regexp_replace(body, '(?i)(</?(?:h[1-6]|p|div|ul|ol|table|nav|header|footer|main|body)[ \\t\\n\\x0B\\f\\r>/])', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '(?i)^<p[ \\t\\n\\x0B\\f\\r>/]')) as pieces,
      trim(regexp_replace(regexp_replace(regexp_extract(body, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as title from a),
    x as (select page_id, coalesce(nullif(title, ''), 'Section 1') as title, unnest(case when len(pieces) = 0 then [null] else pieces end) as piece, unnest(case when len(pieces) = 0 then [null] else range(1, len(pieces) + 1) end) as paragraph_no from p)
    select page_id, 1::bigint as section_no, 1::bigint as level, title, paragraph_no, trim(regexp_replace(regexp_replace(piece, '<[^>]*>', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) as text from x""",
)


def _manifest(tab):
    """Files of a hundred pages each, every third with the mark of a PDF in front, listed from their bytes."""
    pages = tab("pages").select(F.floor(F.col("page_id") / 100).alias("part"), F.coalesce("page_id", F.lit(-1)).alias("place"), F.coalesce("html", F.lit("")).alias("html"))
    head = pages.select("part").distinct().where("part % 3 = 0").select("part", F.lit(-2).cast("long").alias("place"), F.lit("%PDF-1.7").alias("html"))
    path = f"{shared_dir(pages.sparkSession)}/folioflow-files-{uuid.uuid4().hex}"
    lines = pages.unionByName(head).repartition("part").sortWithinPartitions("part", "place", "html")
    lines.drop("place").write.partitionBy("part").text(path)
    files = pages.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return sh.binary_manifest(files, 2**16).select(F.regexp_extract("path", r"part=(-?\d+)", 1).try_cast("long").alias("part"), "length", "sha256", "verdict")


R.add(
    "s02_binary_manifest",
    _manifest,
    """with x as (select page_id // 100 as part, coalesce(page_id, -1) as place, coalesce(html, '') as html from pages),
    y as (select * from x union all select distinct part, -2, '%PDF-1.7' from x where part % 3 = 0),
    f as (select part, string_agg(html, chr(10) order by place, html) || chr(10) as content from y group by part)
    select part, strlen(content)::bigint as length, sha256(content) as sha256, case when strlen(content) > 65536 then 'TOO_LARGE' when starts_with(content, '%PDF-') then 'ACCEPTED' else 'NOT_A_PDF' end as verdict from f""",
)
R.add(
    "s08_html_to_text",
    lambda tab: tab("pages").select("page_id", sh.html_to_text(F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("value")),
    "select page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '[ "
    "\\t\\n\\x0B\\f\\r]+', ' ', 'g')) as value from pages",
)
R.add(
    "s09_table_rows",
    lambda tab: sh.rectangular(tab("nation").groupBy(F.col("n_regionkey").alias("row_no")).agg(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % (F.col("n_regionkey") + 2) > 0, F.col("n_name")))).alias("cells")), "row_no", "cells"),
    """with g as (select n_regionkey as row_no, list(n_name order by n_name) filter (n_nationkey % (n_regionkey + 2) > 0) as cells from nation group by 1), m as (select max(len(cells)) as w from g)
    select row_no, c::bigint as col_no, coalesce(cells[c + 1], '') as cell from g, m, unnest(range(w)) as u(c)""",
)


def _bibliography(tab):
    refs = tab("v_refs").select("paper_id", "bibliography_order", "title", "year")
    path = f"{shared_dir(refs.sparkSession)}/folioflow-bibliography-{uuid.uuid4().hex}"
    sh.write_json_bibliography(refs, path)
    read = refs.sparkSession.read.schema("paper_id long, references array<struct<bibliography_order: long, title: string, year: long>>").json(path)
    return read.select("paper_id", F.size("references").cast("long").alias("entries"), F.array_join(F.transform("references", lambda x: x["title"]), "|").alias("titles"), F.aggregate("references", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["year"], F.lit(0))).alias("years"))


def _appended(tab):
    log = tab("v_attempts")
    path = f"{shared_dir(log.sparkSession)}/folioflow-attempts-{uuid.uuid4().hex}"
    for part in (0, 1):
        sh.append_attempts(log.where(F.col("attempt_id") % 2 == part), path)
    return log.sparkSession.read.schema(log.schema).parquet(path).groupBy("provider", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempt_id").alias("ids"))


R.add(
    "s10_write_json_bibliography",
    _bibliography,
    "select paper_id, count(*) as entries, string_agg(title, '|' order by bibliography_order) as titles, coalesce(sum(year), 0)::bigint "
    "as years from v_refs group by 1",
)
R.add("s11_append_attempts", _appended, "select provider, status, count(*) as n, sum(attempt_id)::bigint as ids from v_attempts group by 1, 2")
R.add(
    "s12_list_runs",
    lambda tab: tab("v_revisions").orderBy(F.desc("created_at"), F.desc("revision_id")).limit(50).select("paper_id", "revision_number", "revision_id"),
    "select paper_id, revision_number, revision_id from v_revisions order by created_at desc, revision_id desc limit 50",
)
R.add(
    "s12_list_proposals",
    lambda tab: tab("v_state_log").where("state in ('PENDING', 'AWAITING_DECISION')").orderBy(F.desc("updated_at"), F.desc("proposal_id")).limit(50).select("proposal_id", "paper_id", "state"),
    "select proposal_id, paper_id, state from v_state_log where state in ('PENDING', 'AWAITING_DECISION') order by updated_at desc, proposal_id desc limit 50",
)
R.add(
    "s12_list_papers",
    lambda tab: tab("orders").where("o_custkey % 3 = 0").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select("o_orderkey", "o_custkey"),
    "select o_orderkey, o_custkey from orders where o_custkey % 3 = 0 order by o_orderdate desc, o_orderkey desc limit 50",
)


def _author_lists(tab):
    """Per paper: names in the references' order (none where paper_id % 5 = 0, blank ones where % 5 = 1), and the names reversed to fall back on."""
    name = F.when(F.col("supp_key") % 4 == 0, F.concat(F.lit("  "), F.upper("family"))).otherwise(F.col("family"))
    place = F.when(F.col("supp_key") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Institute "), F.col("supp_key") % 10)))
    author = lambda n: F.struct(n.alias("name"), place.alias("affiliations"))
    listed = lambda order, n: F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), author(n).alias("a")))), lambda x: x["a"])
    order, kind = F.col("bibliography_order"), F.col("paper_id") % 5
    g = tab("v_refs").groupBy("paper_id").agg(listed(order, F.when(kind == 1, " ").otherwise(name)).alias("authors"), listed(-order, name).alias("others"))
    return g.withColumn("authors", F.when(F.col("paper_id") % 5 > 0, F.col("authors")))


R.add(
    "s13_dedupe_authors",
    lambda tab: sh.dedupe_authors(_author_lists(tab), "paper_id", "authors", "others"),
    """with x as (select paper_id, case when paper_id % 5 < 2 then -bibliography_order else bibliography_order end as o, case when supp_key % 4 = 0 then upper(family) else family end as name,
      case when supp_key % 3 = 0 then '' else 'Institute ' || supp_key % 10 end as place from v_refs),
    f as (select paper_id, lower(name) as k, min(o) as o, arg_min(name, o) as name, arg_min(place, o) as place from x group by 1, 2)
    select paper_id, string_agg(name, '|' order by o) as authors, string_agg(place, '|' order by o) as affiliations from f group by 1""",
)

# --- segmentation
R.add("g01_split_paragraphs", lambda tab: tab("v_paragraphs"), "select doc_id, par_no, text from v_paragraphs")
R.add(
    "g02_segment_sentences",
    lambda tab: seg.sentences(tab("v_paragraphs"), ["doc_id", "par_no"]).select("doc_id", "par_no", "sent_no", "char_start", "char_end", "text"),
)
R.add(
    "g07_segment_plain",
    lambda tab: seg.sentences(tab("v_paragraphs"), ["doc_id", "par_no"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(t.word_count(text)).alias("words")),
)
R.add(
    "g03_abbreviation_guard",
    lambda tab: seg.guarded_periods(tab("v_paragraphs").unionByName(tab("v_refs").select(F.col("paper_id").alias("doc_id"), F.col("bibliography_order").alias("par_no"), F.col("raw_text").alias("text"))), ["doc_id", "par_no"]),
    f"""with t as (select doc_id, par_no, text from v_paragraphs union all select paper_id, bibliography_order, raw_text from v_refs),
    w as (select doc_id, par_no, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from t),
    p as (select doc_id, par_no, unnest(w) as a, unnest(list_append(w[2:], '')) as b from w),
    e as (select doc_id, par_no, regexp_replace(a, '\\.$', '') as a, substr(b, 1, 1) as b from p where ends_with(a, '.') and b <> ''),
    s as (select *, lower(regexp_extract(a, '[\\p{{L}}\\p{{N}}.]*$')) as k from e),
    g as (select doc_id, par_no, case when k in ({_listed(seg.TITLES)}) then 'TITLE' when regexp_matches(k, '^\\p{{L}}$') then 'INITIAL' when k in ({_listed(seg.ARGUMENTS)}) and regexp_matches(b, '[\\p{{N}}(\\[]') then 'ARGUMENT'
      when k in ({_listed(seg.PHRASES)}) and regexp_matches(b, '[\\p{{N}}\\p{{Ll}}]') then 'PHRASE' else 'NONE' end as guard from s)
    select doc_id, par_no, guard, count(*) as periods from g group by all""",
)
TOKENISED = lambda: F.concat(F.substring(text, 1, 15), F.lit("[[CITE:c"), F.col("par_no"), F.lit("]]"), F.substring(text, 16, 20), F.lit("[[CITE:d1]]"), F.expr("substring(text, 36)"))
R.add(
    "g04_tokens",
    lambda tab: tab("v_paragraphs").select("doc_id", "par_no", seg.detokenize(TOKENISED()).alias("plain"), F.array_join(seg.token_ids(TOKENISED()), ",").alias("ids")),
    "select doc_id, par_no, text as plain, 'c' || par_no || ',d1' as ids from v_paragraphs",
)
R.add(
    "g05_inlines_from_tokenised",
    lambda tab: seg.inlines(tab("v_paragraphs").select("doc_id", "par_no", TOKENISED().alias("t")), ["doc_id", "par_no"], "t").select("doc_id", "par_no", "place", "kind", "value"),
    """select doc_id, par_no, place, kind, value from (select doc_id, par_no, unnest([0, 1, 2, 3, 4])::bigint as place, unnest(['text', 'citation', 'text', 'citation', 'text']) as kind, unnest([substr(text, 1, 15), 'c' || par_no, substr(text, 16, 20), 'd1', substr(text, 36)]) as value from v_paragraphs) where value <> ''""",
)
R.add("g06_evidence_spans", lambda tab: seg.evidence_spans(tab("v_paragraphs"), ["doc_id", "par_no"]))
R.add(
    "g09_explode_citation_items",
    lambda tab: seg.cluster_items(tab("v_items").groupBy("citation_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_index", F.col("printed_order").cast("string").alias("p")))), lambda x: x["p"]), ", "), F.lit("]")).alias("marker")), "citation_id", "marker"),
    "select citation_id, item_index::bigint as place, printed_order::varchar as fragment from v_items",
)
R.add(
    "g10_expand_numeric_range",
    lambda tab: seg.expand_ranges(tab("v_refs").select("paper_id", F.col("reference_id"), F.col("bibliography_order").alias("linked"), F.concat(F.lit("["), F.col("bibliography_order"), F.lit("-"), F.col("bibliography_order") + F.col("part_key") % 4, F.lit("]")).alias("marker")), tab("v_refs")),
    """select r.paper_id, r.reference_id, x.bibliography_order as printed, x.reference_id as target from v_refs r join v_refs x on r.paper_id = x.paper_id and x.bibliography_order > r.bibliography_order and x.bibliography_order <= r.bibliography_order + r.part_key % 4
    where r.bibliography_order + r.part_key % 4 <= (select max(bibliography_order) from v_refs y where y.paper_id = r.paper_id)""",
)
R.add(
    "g11_identity_keys",
    lambda tab: seg.identity_keys(tab("v_works")).select("provider", "external_id", "identity_key"),
    "select provider, external_id, unnest(list_filter(['doi:' || lower(doi), 'arxiv:' || lower(arxiv_id), lower(provider || ':' || external_id)], lambda x: x is not null)) as identity_key from v_works",
)


def _cited(tab) -> DataFrame:
    s = seg.sentences(tab("v_paragraphs"), ["doc_id", "par_no"]).select("doc_id", "par_no", "sent_no", "text")
    return s.withColumn("cites", F.pmod(F.xxhash64("doc_id", "par_no", "sent_no"), F.lit(5)) == 0)


R.add("g08_citation_contexts", lambda tab: seg.citation_contexts(_cited(tab), ["doc_id", "par_no"]))
QUERIES, ORACLE = R.QUERIES, R.ORACLE
