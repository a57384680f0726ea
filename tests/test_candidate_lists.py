"""R07's pairs: as all pairs say, for many references and works of one title, and never shuffled or written themselves."""

import random

from folioflow.operators import resolution

from test_shared_subsets import jaccard, titles

REFS = "reference_id string, title string, doi string, raw_text string"
WORKS = "provider string, external_id string, title string, doi string, arxiv_id string"


def candidates(spark, refs, works):
    r = spark.createDataFrame([(f"r{i}", x, None, "") for i, x in enumerate(refs)], REFS)
    w = spark.createDataFrame([("OPENALEX", str(i), x, None, None) for i, x in enumerate(works)], WORKS)
    return resolution.title_candidates(r, w)


def test_lists_hold_all_references_and_works(spark, monkeypatch):
    monkeypatch.setattr(resolution, "LISTED", 2)  # keys with more members have several lists
    rnd = random.Random(5)
    refs, works = titles(40, 1), titles(40, 2)
    refs, works = refs + rnd.choices(refs, k=60), works + rnd.choices(works, k=30)
    got = sorted((x["reference_id"], x["work_id"], round(x["similarity"], 9)) for x in candidates(spark, refs, works).collect())
    assert got == sorted((f"r{i}", f"OPENALEX:{j}", round(jaccard(x, y), 9)) for i, x in enumerate(refs) for j, y in enumerate(works) if jaccard(x, y) >= 0.72)


def moved(plan):
    """Rows that the exchanges of an executed plan wrote."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return moved(plan.executedPlan())
    if "QueryStage" in name:
        return moved(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    children = plan.children()
    return own + sum(moved(children.apply(i)) for i in range(children.size()))


def test_pairs_are_made_last(spark):
    """Each of 300 references is similar to each of 300 works, all with titles of their own: 90,000 pairs of sets."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = candidates(spark, [f"alpha beta gamma delta epsilon zeta r{i}" for i in range(300)], [f"alpha beta gamma delta epsilon zeta w{i}" for i in range(300)])
        assert len(found.collect()) == 90_000
        assert 0 < moved(found._jdf.queryExecution().executedPlan()) < 30_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
