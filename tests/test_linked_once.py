"""References are derived once for all views built on them, and an occurrence's status, links and issues meet in one aggregation."""

from test_one_shuffle import shape

from folioflow.operators import linkage as lk
from folioflow.plans.registry import Registry


def test_views_read_what_was_written(spark):
    r, seen = Registry(), {}
    r.add("q", lambda t: seen.update(files=t("v_items").inputFiles(), columns=t("v_refs").columns) or t("v_items"), None, (("v_refs", "paper_id, bibliography_order, reference_id, family, year"),))
    rows = r.QUERIES["q"](spark, "/root/testdata/sf0.001").count()
    assert rows == 6000 and len(seen["columns"]) == 5 and seen["files"] and all("folioflow-v_refs-" in f for f in seen["files"])


def test_statuses_change_in_one_shuffle(spark):
    items = spark.createDataFrame([(1, "a", 0, "r1"), (1, "a", 1, "r2"), (1, "b", 0, None), (2, "a", 0, "r3"), (2, "c", 0, "r4")], "paper_id long, citation_id string, item_index long, reference_id string")
    issues = spark.createDataFrame([(1, "a", "AGREED"), (2, "a", "MISMATCH"), (2, "gone", "MISMATCH")], "paper_id long, citation_id string, code string")
    status = spark.createDataFrame([(1, "a", "RAW_ONLY"), (1, "b", "RAW_ONLY"), (2, "a", "STRUCTURED"), (2, "d", "STRUCTURED")], "paper_id long, citation_id string, parse_status string")
    d = lk.promote_downgrade(items, issues, status)
    assert sorted(map(tuple, d.collect())) == [(1, "a", "RAW_ONLY", "STRUCTURED"), (1, "b", "RAW_ONLY", "RAW_ONLY"), (2, "a", "STRUCTURED", "RAW_ONLY"), (2, "d", "STRUCTURED", "STRUCTURED")]
    assert shape(d) == (1, 0)
