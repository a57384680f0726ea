"""Links of a group of copies are reduced before labels are passed."""

import random

from folioflow.llm import near_dedup


def test_links_of_a_group_become_stars(spark):
    rnd = random.Random(7)
    pairs = sorted({(rnd.randrange(30), n) for n in range(30, 400) for _ in range(6)})  # each of a group with several pivots
    pairs += [(1000, 1001), (1002, 1003)]
    found = spark.createDataFrame(pairs, "a long, b long")
    stars = near_dedup._starred(near_dedup._starred(found))
    assert stars.count() < len(pairs) / 2
    labels = spark.createDataFrame([(500, 500), (501, 500), (30, 500), (1001, 1001), (1004, 1001)], "id long, label long")
    got = {r["id"]: r["label"] for r in near_dedup._merged(labels, found).collect()}
    want = {n: 0 for p in pairs[:-2] for n in p} | {500: 0, 501: 0, 1000: 1000, 1001: 1000, 1004: 1000, 1002: 1002, 1003: 1002}
    assert got == want
