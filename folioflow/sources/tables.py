"""Corpus tables and the citation views derived from them.

The views are written in SQL that Spark and the checking engine both read, so the
same text defines them on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

ROW_ORDER = "l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: name -> SQL, each over the tables and the views before it
VIEWS = {
    "v_refs": f"""
select paper_id, bibliography_order, 'ref_' || paper_id || '_' || bibliography_order as reference_id, part_key, supp_key,
  case when part_key % 11 = 0 then '' else p_name || ' ' || p_type || ' ' || p_brand || ' no ' || part_key end as title,
  'Smith' || (supp_key % 97) as family, s_name as author, case when part_key % 7 = 0 then null else order_year end as year,
  case when part_key % 5 = 0 then 'https://doi.org/10.1000/P' || part_key end as doi,
  s_name || ' (' || order_year || '). ' || p_name || ' no ' || part_key || '. ' || case part_key % 10 when 3 then 'doi:10.1000/P' || part_key || '.' when 4 then 'arXiv:1706.' || lpad(cast(part_key % 100000 as varchar(9)), 5, '0') || 'v2' else p_type end as raw_text
from (select l_orderkey as paper_id, cast(row_number() over (partition by l_orderkey order by {ROW_ORDER}) as bigint) as bibliography_order, l_partkey as part_key, l_suppkey as supp_key, p_name, p_type, p_brand, s_name, cast(year(o_orderdate) as bigint) as order_year
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join orders on l_orderkey = o_orderkey) x""",
    "v_items": """
select paper_id, 'cite_' || paper_id || '_' || cast(floor((bibliography_order - 1) / 2) as bigint) as citation_id, (bibliography_order - 1) % 2 as item_index,
  case when paper_id % 2 = 0 then 'NUMERIC' else 'AUTHOR_YEAR' end as family_kind,
  case rule when 2 then 'see text' when 3 then 'ibid' when 4 then case when paper_id % 2 = 0 then '[99]' else '(Nobody, 1901)' end
    when 5 then case when paper_id % 2 = 0 then '[' || (bibliography_order + 1) || ']' else '(' || family || ', 1902)' end
    when 6 then case when paper_id % 2 = 0 then '[1234]' else '(Nobody, ' || coalesce(year, 1903) || ')' end
    when 7 then case when paper_id % 2 = 0 then '[' || (bibliography_order + 2) || ']' else '(Nobody, 1901)' end
    else case when paper_id % 2 = 0 then '[' || bibliography_order || ']' else '(' || family || ', ' || coalesce(year, 1999) || ')' end end as marker_fragment,
  case when rule in (1, 3, 4) then null when rule = 8 then 'ref_missing' else reference_id end as reference_id, bibliography_order as printed_order
from (select *, (paper_id * 7 + bibliography_order * 3) % 13 as rule from v_refs) x""",
    "v_works": """
select provider, provider || '-' || p_partkey as external_id, case when p_partkey % 9 = 0 then p_name || ' ' || p_type || ' no ' || p_partkey else p_name || ' ' || p_type || ' ' || p_brand || ' no ' || p_partkey end as title,
  case when p_partkey % 3 = 0 then '10.1000/p' || p_partkey end as doi, case when p_partkey % 10 = 4 then '1706.' || lpad(cast(p_partkey % 100000 as varchar(9)), 5, '0') end as arxiv_id,
  cast(1992 + p_partkey % 8 as bigint) as year, 'Smith' || (p_partkey % 97) as family, case when p_partkey % 4 = 0 then null else 'Abstract of ' || p_name end as abstract,
  case when p_partkey % 6 = 0 then null when p_partkey % 6 = 1 then 'http://x.org/' || p_partkey else 'https://x.org/' || p_partkey end as url, p_partkey as work_key
from part, (select 'OPENALEX' as provider union all select 'SEMANTIC_SCHOLAR' as provider) p where provider = 'OPENALEX' or p_partkey % 4 <> 1""",
    "v_papers": """
select o_orderkey as paper_id, p_name || ' ' || p_type || ' no ' || p_partkey as title from orders left join part on p_partkey = o_orderkey % 500 + 1""",
    "v_attempts": """
select event_id as attempt_id, 'op_' || user_id || '_' || cast(day(ts) as bigint) as operation_id, case when event_id % 3 = 0 then 'SEMANTIC_SCHOLAR' else 'OPENALEX' end as provider,
  case event_type when 'view' then 'LOOKUP' when 'signup' then 'LOOKUP' else 'SEARCH' end as purpose,
  case event_type when 'error' then case when event_id % 2 = 0 then 'RATE_LIMITED' else 'NOT_FOUND' end when 'purchase' then 'EMPTY' else 'OK' end as status,
  cast(value as double) as latency_ms, case when event_type = 'click' then event_id % 7 else 0 end as result_count, ts from events""",
    "v_state_log": """
select o_orderkey as proposal_id, o_custkey as paper_id, o_orderkey % 5 as base_revision, case o_orderstatus when 'F' then case when o_orderkey % 3 = 0 then 'ACCEPTED' else 'REJECTED' end when 'O' then case when o_orderkey % 2 = 0 then 'PENDING' else 'AWAITING_DECISION' end else 'SUPERSEDED' end as state,
  o_orderdate as updated_at, o_orderpriority as kind from orders""",
    "v_revisions": """
select o_custkey as paper_id, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as bigint) as revision_number, o_orderkey as revision_id, o_orderdate as created_at from orders where o_orderkey % 3 = 0""",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One corpus table with its declared schema, pruned and filtered at the scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def load_views(spark: SparkSession, sf_dir: str) -> None:
    """Register tables and derived views under their names; nothing is read until a query is."""
    for name in SCHEMAS:
        load(spark, sf_dir, name).createOrReplaceTempView(name)
    paragraphs(spark.table("documents")).createOrReplaceTempView("v_paragraphs")
    for name, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(name)


def rebuild_views(spark: SparkSession, name: str) -> None:
    """Register the views that name the view ``name`` again, after that was replaced."""
    for view, sql in VIEWS.items():
        if name in sql:
            spark.sql(sql).createOrReplaceTempView(view)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, par_no from 1, text) of the lines that are not blank."""
    parts = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(" \t\r\u000b\f")) != "")
    return docs.select("doc_id", F.posexplode(parts).alias("p", "text")).select("doc_id", (F.col("p") + 1).cast("long").alias("par_no"), "text")


PARAGRAPHS_SQL = """
select doc_id, cast(unnest(range(1, len(parts) + 1)) as bigint) as par_no, unnest(parts) as text
from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '') as parts from documents)"""


def with_views(sql: str) -> str:
    """``sql`` for the checking engine, with the views it names (and those they name) in front."""
    all_views = {"v_paragraphs": PARAGRAPHS_SQL, **VIEWS}
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in all_views.items():
            if name in text and name not in needed:
                needed.add(name)
                visit(body)

    visit(sql)
    head = ", ".join(f"{n} as ({all_views[n].strip()})" for n in all_views if n in needed)
    if not head:
        return sql
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
