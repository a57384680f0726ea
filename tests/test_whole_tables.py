"""Whole jobs on inputs that the queries once cut short."""

from pyspark.sql import functions as F

from folioflow.plans import integrity_queries, resolution_queries


def test_lists_hold_every_work(spark):
    works = spark.range(4990).select(F.col("id").alias("work_key"), F.lit("OPENALEX").alias("provider"))
    got = resolution_queries._lists(lambda name: works)
    assert got.count() == 4990 and got.groupBy("query_id").count().agg(F.max("count")).first()[0] == 7


def test_components_hold_every_work(spark):
    sf = "/root/testdata/sf0.01"
    got = integrity_queries.QUERIES["r15_dedupe_works_components"](spark, sf)
    assert got.count() == spark.table("v_works").select("provider", "external_id").distinct().count()
