"""Scoring of predictions against labels, with explicit denominators: null where nothing could be checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4))


def marker_detection(labelled: DataFrame, parsed: DataFrame) -> DataFrame:
    """The k-th labelled marker of a spelling is found by the k-th parsed one."""
    number = lambda d: d.withColumn("k", F.row_number().over(W.partitionBy("paper_id", "marker").orderBy("seq")))
    j = number(labelled).join(number(parsed).select("paper_id", "marker", "k", F.lit(1).alias("hit")), ["paper_id", "marker", "k"], "left")
    return j.groupBy("paper_id").agg(F.count(F.lit(1)).alias("labelled"), F.count("hit").alias("detected")).withColumn("rate", ratio(F.col("detected"), F.col("labelled")))


def linkage_rate(items: DataFrame) -> DataFrame:
    """Occurrences whose linked positions equal the printed ones."""
    g = items.groupBy("paper_id", "citation_id").agg(F.bool_and(F.coalesce(F.col("linked") == F.col("printed_order"), F.lit(False))).alias("ok"), F.count_if(F.col("linked").isNotNull()).alias("n"))
    p = g.groupBy("paper_id").agg(F.count_if(F.col("n") > 0).alias("checkable"), F.count_if(F.col("ok")).alias("right"))
    return p.withColumn("rate", ratio(F.col("right"), F.col("checkable")))


def marker_precision(parsed: DataFrame, labelled: DataFrame) -> DataFrame:
    """Parsed markers that no label stands for, as a multiset difference."""
    c = lambda d, n: d.groupBy("paper_id", "marker").agg(F.count(F.lit(1)).alias(n))
    j = c(parsed, "p").join(c(labelled, "l"), ["paper_id", "marker"], "left").na.fill(0)
    g = j.groupBy("paper_id").agg(F.sum("p").alias("parsed"), F.sum(F.greatest(F.lit(0), F.col("p") - F.col("l"))).alias("spurious"))
    return g.withColumn("precision", ratio(F.col("parsed") - F.col("spurious"), F.col("parsed")))


def alnum(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def field_accuracy(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Title, year and family of each spot check, looked up by number."""
    j = truth.join(found.select("paper_id", "bibliography_order", F.col("title").alias("f_title"), F.col("year").alias("f_year"), F.col("author").alias("f_author")), ["paper_id", "bibliography_order"], "left")
    ok = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = j.groupBy("paper_id").agg(F.count(F.lit(1)).alias("checks"), ok(alnum(F.col("title")) == alnum(F.col("f_title"))).alias("titles"), ok(F.col("year") == F.col("f_year")).alias("years"), ok(F.array_contains(F.split(F.lower("f_author"), "[^a-z0-9]+"), F.lower("family"))).alias("families"))
    return g.withColumn("title_rate", ratio(F.col("titles"), F.col("checks")))


def retention(expected: DataFrame, kept: DataFrame) -> DataFrame:
    """X05"""
    e, k = expected.groupBy("paper_id").agg(F.count(F.lit(1)).alias("labelled")), kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("retained"))
    return e.join(k, "paper_id", "left").na.fill(0).withColumn("rate", ratio(F.col("retained"), F.col("labelled")))


def status_counts(status: DataFrame, items: DataFrame) -> DataFrame:
    """Status histogram and item coverage of each paper."""
    s = status.groupBy("paper_id").agg(F.count_if(F.col("parse_status") == "STRUCTURED").alias("structured"), F.count_if(F.col("parse_status") == "RAW_ONLY").alias("raw_only"))
    i = items.groupBy("paper_id").agg(F.count(F.lit(1)).alias("items"), F.count("reference_id").alias("linked"))
    return s.join(i, "paper_id").withColumn("coverage", ratio(F.col("linked"), F.col("items")))


def effect_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each figure before and after the cross-check."""
    keep = lambda d, s: d.select("paper_id", F.col("structured").alias("structured_" + s), F.col("raw_only").alias("raw_only_" + s), F.col("coverage").alias("coverage_" + s))
    return keep(before, "before").join(keep(after, "after"), "paper_id")


def block_inventory(labelled: DataFrame, blocks: DataFrame) -> DataFrame:
    """Figures and tables of each paper, labelled and recovered, with what cannot be rendered or has no place.

    labelled has paper_id, labelled_figures, labelled_tables; blocks paper_id, kind, fidelity, floating.
    """
    kind = lambda k: F.count_if(F.col("kind") == k)
    b = blocks.groupBy("paper_id").agg(kind("FIGURE").alias("figures_recovered"), kind("TABLE").alias("tables_recovered"), F.count_if(F.col("fidelity") == "UNRENDERABLE").alias("unrenderable"), F.count_if("floating").alias("floating"))
    return labelled.join(b, "paper_id", "left").na.fill(0)


def eval_table(reports: dict[str, DataFrame], key: str = "paper_id") -> DataFrame:
    """One row per paper over the reports X01-X08, columns named ``report_column``; a report without a paper leaves nulls."""
    out = None
    for name, report in reports.items():
        r = report.select(key, *[F.col(c).alias(f"{name}_{c}") for c in report.columns if c != key])
        out = r if out is None else out.join(r, key, "full_outer")
    return out
