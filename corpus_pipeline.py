"""Training-data pipeline over ``documents``: toxicity, language, near-duplicates, mix, packing.

Every stage works on all rows its predecessor kept and is written as Parquet to the
shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import common, langid, mixing, near_dedup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose text is predicted toxic.  Null and blank texts are scored as one empty
    window; repeated rows share their fate; without toxic labels nothing is dropped."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~common.held_out("doc_id", 4, 2))
    return toxicity.without_toxic(docs, labels)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows in which no language makes up half of the text: null texts, those without a
    letter, and mixtures of three languages or more.  With no language to learn from, none is left."""
    return langid.with_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id.  Rows with a null id stay, and
    so do texts without words; of rows with one id, whatever their texts, one stays."""
    return near_dedup.without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as often as the mix takes them, and the part of a text where a block ends in it.  Null
    and blank texts have no words and are not taken; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2,048 tokens with their place in a sequence.  ``row_id`` tells the repeats and parts
    of a document apart; a null text is one closing token."""
    rows = docs.withColumn("row_id", F.monotonically_increasing_id())
    return packing.pack(packing.token_pieces(rows, packing.default_tokenizer(), row_col="row_id"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: Compression lengths, fitted likelihoods, hashing and tokenizers are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
