"""Title tokens: accents are decomposed only where there are any, and a similarity computes each side once."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as t

TITLES = ["", None, "The Über-straße of São Paulo", "a an the", "--Edge, of edges; EDGE--", "Niño 1992: naïve 1992", "plain words and 10.5 more", "日本 kana"]


def tokens(s):
    folded = unicodedata.normalize("NFD", (s or "").lower().replace("ß", "ss"))
    return [w for w in dict.fromkeys(re.findall("[a-z0-9]+", folded)) if w not in t.STOPWORDS]


def test_tokens_and_similarity(spark):
    df = spark.createDataFrame([(a, b) for a in TITLES for b in TITLES], "a string, b string")
    both = t.title_tokens(F.col("a")), t.title_tokens(F.col("b"))
    for r in df.select("a", "b", both[0].alias("ta"), t.jaccard(*both).alias("s")).collect():
        x, y = set(tokens(r["a"])), set(tokens(r["b"]))
        assert r["ta"] == tokens(r["a"])
        assert r["s"] == pytest.approx(len(x & y) / len(x | y) if x and y else 0.0)


def test_similarity_has_no_branch_over_its_sides(spark):
    sides = spark.createDataFrame([(["a"], ["a"])], "x array<string>, y array<string>")
    plan = sides.select(t.jaccard(F.col("x"), F.col("y")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" not in plan.upper()
    assert spark.createDataFrame([([], [])], "x array<string>, y array<string>").select(t.jaccard(F.col("x"), F.col("y"))).first()[0] == 0.0
