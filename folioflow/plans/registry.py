"""Collects queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.sources.scratch import written
from folioflow.sources.tables import load_views, rebuild_views, with_views


class Registry:
    def __init__(self) -> None:
        self.QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.ORACLE: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Callable[[str], DataFrame]], DataFrame], sql: str | None = None, once: tuple[str | tuple[str, str], ...] = ()) -> None:
        """``build`` gets a function that returns a table or view by name.

        Views named in ``once`` are written first and read from there at each use, so that a
        query that needs one several times scans and joins its tables a single time.  Views derived from
        one read what was written, too.  A pair names the view and the columns that are written.
        """

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            load_views(spark, sf_dir)
            for view in once:
                name, columns = view if isinstance(view, tuple) else (view, "*")
                written(spark.table(name).select(*columns.split(", ")), name).createOrReplaceTempView(name)
                rebuild_views(spark, name)
            return build(spark.table)

        run.__name__ = name
        self.QUERIES[name] = run
        if sql is not None:
            self.ORACLE[name] = with_views(sql)
