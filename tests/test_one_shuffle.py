"""Comparisons of revisions, inverted indexes and closed vocabularies deal their rows once."""

from folioflow.operators import review as rw
from folioflow.operators import resolution as rs
from folioflow.operators import revisions as rv
from folioflow.sources import shredding as sh


def shape(df):
    """(exchanges, joins) of the plan before any stage has run."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("Exchange hashpartitioning"), plan.count("Join")


def test_removed_and_changed_keys(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (3, None)], "k long, s string")
    b = spark.createDataFrame([(1, "x"), (3, None), (4, "z"), (4, "z")], "k long, s string")
    gone = rv.removed_keys(a, b, ["k", "s"])
    assert sorted(map(tuple, gone.collect())) == [(2, "y"), (3, None)] and shape(gone) == (1, 0)
    both = rv.key_changes(a, b, ["k", "s"], "KEY")
    assert sorted(map(tuple, both.collect()), key=str) == [(2, "y", "KEY_REMOVED"), (3, None, "KEY_ADDED"), (3, None, "KEY_REMOVED"), (4, "z", "KEY_ADDED")]
    assert shape(both) == (1, 0)


def test_words_are_counted_where_the_texts_are(spark):
    kind = "doc_id long, par_id string, text string"
    a = spark.createDataFrame([(1, "p", "a b  b c"), (1, "q", "same text"), (2, "p", "gone it is"), (None, "p", "u v")], kind)
    b = spark.createDataFrame([(1, "p", "b a c d d"), (1, "q", "text same"), (3, "p", "new"), (None, "p", "u")], kind)
    d = rv.token_multiset_diff(a, b)
    assert sorted(map(tuple, d.collect()), key=str) == [(1, "p", 1, 2), (2, "p", 3, 0), (3, "p", 0, 1), (None, "p", 2, 1)]
    assert shape(d) == (1, 0)


def test_text_from_positions(spark):
    docs = spark.createDataFrame([(1, "b a  b c a"), (2, "one"), (3, " "), (4, None)], "doc_id long, text string")
    back = sh.text_from_positions(sh.positions(docs, "doc_id", "text"), "doc_id")
    assert sorted(map(tuple, back.collect())) == [(1, "b a b c a"), (2, "one")] and shape(back) == (1, 0)
    index = [(1, "a", [0, 2]), (1, "z", [2, -1]), (1, "b", [1, 10**9, None]), (2, "x", [-1]), (3, "x", None), (4, None, [0]), (4, "k", [0, 5])]
    claimed = sh.text_from_positions(spark.createDataFrame(index, "doc_id long, word string, positions array<int>"), "doc_id")
    assert sorted(map(tuple, claimed.collect())) == [(1, "a b z"), (4, "k k")]


def test_vocabulary(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "other", 5), (2, "other", 1)], "paper_id long, kind string, n long")
    every = rw.with_vocabulary(counts, "kind", ["a", "b"], ["paper_id"])
    assert sorted(map(tuple, every.select("paper_id", "kind", "n").collect())) == [(1, "a", 2), (1, "b", 0), (2, "a", 0), (2, "b", 0)]
    assert shape(every) == (1, 0)


def test_unresolved_references_are_found_once(spark):
    refs = spark.createDataFrame([("r1", "T", 2000, "F"), ("r2", "U", None, "G")], "reference_id string, title string, year long, family string")
    left = rs.unresolved(refs, refs.where("reference_id = 'r1'"))
    assert [r["reference_id"] for r in left.collect()] == ["r2"] and shape(left) == (0, 0)


def test_findings_with_one_offer_share_it(spark):
    rows = [("f1", 1, 1, "r1", [1, 2], ["why"]), ("f2", 1, 2, None, [1, 2], ["why"]), ("f3", None, 1, "r2", None, None), ("f4", 9, 9, "r9", [2], None), ("f5", 1, 1, "r1", [3, 1, None], ["a", None])]
    f = spark.createDataFrame(rows, "finding_id string, doc_id long, par_no long, reference_id string, suggested array<long>, rationales array<string>")
    p = spark.createDataFrame([(1, 1, "S", "claim"), (1, 2, None, "other")], "doc_id long, par_no long, section string, text string")
    r = spark.createDataFrame([("r1", "T", None), ("r2", " ", "raw")], "reference_id string, title string, raw_text string")
    w = spark.createDataFrame([(1, "A", None, "https://a"), (2, None, "10.1/b", None), (3, "C", None, None)], "record_id long, title string, doi string, url string")
    d = rw.enrich_findings(f, p, r, w)
    a, b = "A|https://a|", "Untitled|https://doi.org/10.1/b|"
    want = [("f1", "S", "claim", "T", f"{a}why;{b}"), ("f2", "", "other", None, f"{a}why;{b}"), ("f3", "", "", "raw", ""), ("f4", "", "", None, b), ("f5", "S", "claim", "T", a)]
    assert sorted(map(tuple, d.collect())) == want
    # the claims meet the findings in the last join
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "(par_no#" in next(line for line in plan.splitlines() if "Join" in line)
