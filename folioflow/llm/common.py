"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\u000b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a fresh local one only for a local session without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-folioflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioflow-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % buckets


def held_out(id_col: str, buckets: int, rest: int) -> Column:
    """True where ``fold`` equals ``rest``; false for a null id."""
    return F.coalesce(fold(id_col, buckets) == rest, F.lit(False))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null and blank texts."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Broadcast hint for a side whose counted ``rows`` are within ``limit``; else Spark plans the join itself."""
    return F.broadcast(df) if rows <= limit else df


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the smallest seeded hash of ``key``: a documented bound for model fitting."""
    return df.orderBy(F.xxhash64(F.lit(17), F.col(key)), F.col(key)).limit(limit)
