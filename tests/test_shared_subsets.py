"""Titles meet under the subsets that they share: as exact as all pairs, and no group of similar titles is expanded."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import integrity, resolution, review

WORDS = [f"w{i}" for i in range(16)]


def jaccard(a, b):
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def titles(n, seed):
    """Short titles, and copies of long ones with some words changed."""
    rnd = random.Random(seed)
    long = [[f"x{k}{i}" for i in range(13)] for k in range(4)]
    return [" ".join(rnd.sample(WORDS, rnd.randrange(1, 9)) if i % 3 else rnd.sample(t := rnd.choice(long), rnd.randrange(8, 14)) + [f"y{i % 5}"] * (i % 2)) for i in range(n)]


def test_short_and_long_titles_are_exact(spark):
    a, b = titles(70, 1), titles(60, 2)
    frame = lambda t: spark.createDataFrame([(i, sorted(set(x.split()))) for i, x in enumerate(t)], "id long, tokens array<string>")
    got = {(r["a"], r["b"]): r["similarity"] for r in resolution.similar_pairs(frame(a), frame(b)).collect()}
    assert got == pytest.approx({(i, j): jaccard(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if jaccard(x, y) >= 0.72})
    refs = spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(a)], "reference_id string, title string")
    works = spark.createDataFrame([("OPENALEX" if i % 3 else "SEMANTIC_SCHOLAR", f"{i:02}", x, 2000, "F", None, None) for i, x in enumerate(b)], "provider string, external_id string, title string, year long, family string, doi string, arxiv_id string")
    best = {r["reference_id"]: r["external_id"] for r in resolution.best_title_match(refs, works).collect()}
    near = {f"r{i}": [(-s, 0 if j % 3 else 1, f"{j:02}") for j, y in enumerate(b) if (s := jaccard(x, y)) >= 0.72] for i, x in enumerate(a)}
    assert best == {k: min(v)[2] for k, v in near.items() if v}
    name = lambda j: f"{'OPENALEX' if j % 3 else 'SEMANTIC_SCHOLAR'}:{j:02}"
    label = {name(j): name(j) for j in range(len(b))}
    for _ in b:
        for i, x in enumerate(b):
            for j, y in enumerate(b):
                if jaccard(x, y) >= 0.72:
                    label[name(i)] = min(label[name(i)], label[name(j)])
    assert {r["id"]: r["component"] for r in integrity.dedupe_works_components(works).collect()} == label


def test_a_group_of_similar_titles_is_not_expanded(spark):
    n = 1500  # two million pairs
    refs = spark.range(n).select(F.col("id").cast("string").alias("reference_id"), F.concat(F.lit("big red ring steel brand kind no "), (F.col("id") + n).cast("string")).alias("title"))
    works = spark.range(n).select(F.lit("OPENALEX").alias("provider"), F.col("id").cast("string").alias("external_id"), F.concat(F.lit("big red ring steel brand kind no "), F.col("id").cast("string")).alias("title"), F.lit(2000).alias("year"), F.lit("F").alias("family"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"))
    got = resolution.best_title_match(refs, works).groupBy("external_id").count().collect()
    assert [tuple(r) for r in got] == [("0", n)]
    sets = works.select("external_id", resolution.title_tokens(F.col("title")).alias("tokens")).select(F.xxhash64("tokens").alias("h"), F.array_sort("tokens").alias("tokens"))
    assert resolution.similar_links(sets).count() == n - 1


def test_ranks_of_short_and_long_titles(spark):
    a, b = titles(50, 3), titles(90, 4)
    frame = lambda t: spark.createDataFrame([(i, sorted(set(x.split()))) for i, x in enumerate(t)], "id long, tokens array<string>")
    got = {}
    for r in review.lexical_rank(frame(a), frame(b), 3).collect():
        got.setdefault(r["claim_id"], {})[r["rank"]] = (r["work_id"], round(r["score"], 9))
    for i, x in enumerate(a):
        order = sorted((-jaccard(x, y), j) for j, y in enumerate(b) if jaccard(x, y) > 0)
        assert got.get(i, {}) == {k + 1: (j, round(-s, 9)) for k, (s, j) in enumerate(order[:3])}


def test_ranks_in_a_group_are_not_expanded(spark, monkeypatch):
    sizes, plain = [], review.written
    monkeypatch.setattr(review, "written", lambda df, name: (out := plain(df, name), sizes.append(out.count()))[0])
    d = spark.range(1500).select("id", F.array(F.lit("big"), F.lit("brand"), F.format_string("k%d", "id"), F.lit("red"), F.lit("ring")).alias("tokens"))
    got = review.lexical_rank(d, d, 3).where("claim_id = 700").orderBy("rank").collect()
    assert [r["work_id"] for r in got] == [700, 0, 1] and max(sizes) <= 3 * 1500
