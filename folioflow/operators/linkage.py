"""Links between occurrences and bibliography, checked by a signal they do not derive from.

Rows are never dropped: what could not be checked keeps a code of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import fold_name, surname_keys

CODES = ["AGREED", "MISMATCH", "UNCERTAIN", "RECOVERED", "AMBIGUOUS", "UNRESOLVED", "NOT_A_MARKER"]
PRINTED = r"^[\[(]?\s*(\d{1,3})\s*[\],;)]?\s*$"
NAME_YEAR = r"(\p{L}[\p{L}\p{N}'’-]*),?\s*\(?\s*(1[6-9]\d{2}|20\d{2})"


def check_numeric_links(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Printed number against bibliography position."""
    shown = F.regexp_extract(F.trim("marker_fragment"), PRINTED, 1)
    i = items.withColumn("printed", F.when(shown != "", shown.cast("long")))
    r = refs.select("paper_id", F.col("bibliography_order").alias("printed"), F.col("reference_id").alias("expected"))
    j = i.join(r, ["paper_id", "printed"], "left")
    linked, has = F.col("reference_id").isNotNull(), F.col("printed").isNotNull()
    code = (
        F.when(~linked & ~has, "NOT_A_MARKER").when(~linked & F.col("expected").isNull(), "UNRESOLVED").when(~linked, "RECOVERED")
        .when(~has, "UNCERTAIN").when(F.col("expected") == F.col("reference_id"), "AGREED").otherwise("MISMATCH")
    )
    return j.select("paper_id", "citation_id", "item_index", "reference_id", "expected", code.alias("code"), F.when(code == "RECOVERED", F.col("expected")).alias("repair"))


def check_author_year_links(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Surname and year against the bibliography; either signal may be unknown."""
    m = F.col("marker_fragment")
    name, year = F.regexp_extract(m, NAME_YEAR, 1), F.regexp_extract(m, NAME_YEAR, 2)
    i = items.withColumn("surname", F.when(name != "", fold_name(name))).withColumn("printed_year", F.when(year != "", year.cast("long")))
    keyed = refs.select("paper_id", F.explode(surname_keys(F.col("family"))).alias("surname"), F.col("year").alias("printed_year"), F.col("reference_id").alias("hit")).where("printed_year is not null")
    hits = keyed.groupBy("paper_id", "surname", "printed_year").agg(F.countDistinct("hit").alias("hits"), F.min("hit").alias("candidate"))
    own = refs.select("paper_id", "reference_id", F.col("year").alias("ref_year"), surname_keys(F.col("family")).alias("names"), F.lit(True).alias("known"))
    j = i.join(hits, ["paper_id", "surname", "printed_year"], "left").join(own, ["paper_id", "reference_id"], "left")
    linked, has = F.col("reference_id").isNotNull(), F.col("surname").isNotNull()
    by_name = F.when(F.size("names") > 0, F.array_contains("names", F.col("surname")))
    by_year = F.col("ref_year") == F.col("printed_year")
    open_ = F.when(F.col("hits") == 1, "RECOVERED").when(F.col("hits") > 1, "AMBIGUOUS").otherwise("UNRESOLVED")
    closed = (
        F.when(F.col("known").isNull(), "MISMATCH").when(by_name & by_year, "AGREED").when(~by_name & ~by_year, "MISMATCH")
        .when(~by_name, "UNCERTAIN").when(~by_year, "UNCERTAIN").when(by_name | by_year, "AGREED").otherwise("UNCERTAIN")
    )
    code = F.when(~has & ~linked, "NOT_A_MARKER").when(~has, "UNCERTAIN").when(~linked, open_).otherwise(closed)
    return j.select("paper_id", "citation_id", "item_index", "reference_id", F.when(code == "RECOVERED", F.col("candidate")).alias("expected"), code.alias("code"), F.when(code == "RECOVERED", F.col("candidate")).alias("repair"))


def check_links(items: DataFrame, refs: DataFrame) -> DataFrame:
    """Both families; ``family_kind`` says which check an item takes."""
    n = check_numeric_links(items.where("family_kind = 'NUMERIC'"), refs)
    a = check_author_year_links(items.where("family_kind = 'AUTHOR_YEAR'"), refs)
    return n.unionByName(a)


def apply_repairs(items: DataFrame, issues: DataFrame) -> DataFrame:
    """Recovered links written into the items."""
    r = issues.where("repair is not null").select("paper_id", "citation_id", "item_index", "repair")
    return items.join(r, ["paper_id", "citation_id", "item_index"], "left").withColumn("reference_id", F.coalesce("repair", "reference_id")).drop("repair")


def promote_downgrade(items: DataFrame, issues: DataFrame, status: DataFrame) -> DataFrame:
    """Any mismatch downgrades an occurrence; a raw one whose items are all linked is promoted.

    Statuses, links and issues of an occurrence meet in one aggregation.
    """
    me = ["paper_id", "citation_id"]
    rows = status.select(*me, "parse_status").unionByName(items.select(*me, F.col("reference_id").isNotNull().alias("linked")), allowMissingColumns=True)
    rows = rows.unionByName(issues.select(*me, (F.col("code") == "MISMATCH").alias("mismatch")), allowMissingColumns=True)
    g = rows.groupBy(*me).agg(F.max("parse_status").alias("parse_status"), F.bool_and("linked").alias("all_linked"), F.bool_or("mismatch").alias("mismatch")).where("parse_status is not null")
    after = F.when(F.coalesce("mismatch", F.lit(False)), "RAW_ONLY").when((F.col("parse_status") == "RAW_ONLY") & F.coalesce("all_linked", F.lit(False)), "STRUCTURED").otherwise(F.col("parse_status"))
    return g.select(*me, F.col("parse_status").alias("before"), after.alias("after"))


def linkage_report(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts per code, accuracy and status changes of each paper."""
    g = issues.groupBy("paper_id").agg(*[F.count_if(F.col("code") == c).alias(c.lower()) for c in CODES])
    checked = F.col("agreed") + F.col("mismatch")
    g = g.withColumn("checked", checked).withColumn("accuracy", F.when(checked > 0, F.round(F.col("agreed") / checked, 4)).otherwise(0.0))
    moved = changes.groupBy("paper_id").agg(F.count_if((F.col("before") != "RAW_ONLY") & (F.col("after") == "RAW_ONLY")).alias("downgraded"), F.count_if((F.col("before") == "RAW_ONLY") & (F.col("after") == "STRUCTURED")).alias("promoted"))
    return g.join(moved, "paper_id", "left").na.fill(0, ["downgraded", "promoted"])


def bibliography_use(refs: DataFrame, items: DataFrame) -> DataFrame:
    """Occurrences of every entry, zero included."""
    n = items.where("reference_id is not null").groupBy("reference_id").agg(F.countDistinct("citation_id").alias("uses"))
    return refs.select("paper_id", "reference_id").join(n, "reference_id", "left").na.fill(0, ["uses"])


def cited_reference_ids(placed: DataFrame, items: DataFrame) -> DataFrame:
    """References of citations that stand in a paragraph."""
    return placed.select("citation_id").join(items.where("reference_id is not null"), "citation_id").select("paper_id", "reference_id").distinct()


def reference_facets(refs: DataFrame, use: DataFrame, matched: DataFrame) -> DataFrame:
    """How many entries there are, matched, unmatched and uncited, per paper."""
    m = matched.select("reference_id").distinct().withColumn("_m", F.lit(True))
    j = refs.select("paper_id", "reference_id").join(use.select("reference_id", "uses"), "reference_id", "left").join(m, "reference_id", "left")
    return j.groupBy("paper_id").agg(F.count(F.lit(1)).alias("all"), F.count("_m").alias("matched"), F.count_if(F.col("_m").isNull()).alias("unmatched"), F.count_if(F.coalesce("uses", F.lit(0)) == 0).alias("uncited"))


def unlinked_and_raw_only(items: DataFrame, status: DataFrame) -> DataFrame:
    """Sorted id lists of each paper."""
    a = items.groupBy("paper_id").agg(F.sort_array(F.collect_set(F.when(F.col("reference_id").isNull(), F.col("citation_id")))).alias("unlinked"))
    b = status.groupBy("paper_id").agg(F.sort_array(F.collect_set(F.when(F.col("parse_status") == "RAW_ONLY", F.col("citation_id")))).alias("raw_only"))
    return a.join(b, "paper_id").select("paper_id", F.array_join("unlinked", ",").alias("unlinked"), F.array_join("raw_only", ",").alias("raw_only"))


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
