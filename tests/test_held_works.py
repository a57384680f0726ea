"""What papers hold, in papers of any size, and how often candidates are shuffled for it."""

import random

from folioflow.operators import resolution, review

from test_candidate_lists import moved
from test_shared_subsets import jaccard, titles

CAND = "paper_id long, provider string, external_id string, doi string, arxiv_id string, title string, claim_id int, rank int, link string"
HELD = "paper_id long, keys array<string>, title string"


def rows(seed):
    rnd, names = random.Random(seed), titles(60, seed)
    doi = lambda: rnd.choice([None, f"10.1/X{rnd.randrange(40)}"])
    cand = [(p, "OPENALEX", str(i), doi(), rnd.choice([None, f"17.{rnd.randrange(40)}"]), rnd.choice([*names, None, " "]), i % 3, i, rnd.choice([None, "l", "l"])) for i, p in enumerate(rnd.choices([1, 2, 3, 4, None], k=150))]
    held = [(p, rnd.choice([None, [None], [f"doi:10.1/x{rnd.randrange(40)}", None], [f"arxiv:17.{rnd.randrange(40)}", f"openalex:{rnd.randrange(150)}"]]), rnd.choice([*names, None, ""])) for p in rnd.choices([1, 1, 1, 2, 3, None], k=40)]
    return cand, held


def is_held(c, h):
    keys = {k.lower() for k in (c[3] and "doi:" + c[3], c[4] and "arxiv:" + c[4], f"{c[1]}:{c[2]}") if k}
    return c[0] is not None and c[0] == h[0] and (bool(keys & set(h[1] or [])) or bool(c[5] and h[2] and jaccard(c[5], h[2]) >= 0.72))


def test_papers_of_any_size(spark):
    for seed in (3, 4):
        cand, held = rows(seed)
        want = sorted(c[2] for c in cand if not any(is_held(c, h) for h in held))
        assert 0 < len(want) < len(cand)
        a, b = spark.createDataFrame(cand, CAND), spark.createDataFrame(held, HELD)
        for most in (500, 10, 0):
            assert sorted(r["external_id"] for r in resolution.not_held(a, b, held_rows=most).collect()) == want


def test_candidates_are_shuffled_once(spark):
    """2,000 candidates and as many held rows: a shuffle of either, and none after it for the suggestions of each claim."""
    cand = [(i % 500, "OPENALEX", str(i), None, None, f"some title number {i}", i % 2, i, "l") for i in range(2000)]
    held = [(i % 500, [f"doi:10.1/y{i}"], f"another title here {i + 7}") for i in range(2000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = review.missing_work(spark.createDataFrame(cand, CAND), spark.createDataFrame(held, HELD))
        assert len(d.collect()) == 500
        assert moved(d._jdf.queryExecution().executedPlan()) == 4000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
