"""References with one title and the same identifiers are resolved once; the patterns of identifiers are matched once a text."""

from pyspark.sql import functions as F

from folioflow.functions.text import arxiv_in, doi_in, normalise_arxiv, normalise_doi
from folioflow.operators import resolution as rs

REFS = "paper_id long, reference_id string, title string, year long, family string, doi string, raw_text string"
WORKS = "provider string, external_id string, title string, year long, family string, doi string, arxiv_id string"
WORK_ROWS = [("OPENALEX", "w1", "big red ring", 2000, "Lee", "10.1/x", None), ("OPENALEX", "w2", "small blue disk", 2001, "Kim", None, "1706.00001")]


def test_each_kind_is_resolved_once(spark, monkeypatch):
    sizes, plain = {}, rs.written
    monkeypatch.setattr(rs, "written", lambda df, name: (out := plain(df, name), sizes.update({name: out.count()}))[0])
    many = [(i, f"a{i}", "Big red ring", 2000 + i % 2, "Ng", None, "plain") for i in range(40)]
    odd = [
        (1, "b1", "Big red ring", 1990, "Lee", None, None), (1, "b2", "other", None, None, "https://doi.org/10.1/X", None), (1, "b3", None, None, None, None, "see arXiv:1706.00001v2"), (1, "b4", " ", None, None, None, "no key"),
        (1, "b5", None, None, None, None, None), (2, "b6", "unknown words here", None, None, "bad", ""),
    ]
    refs, works = spark.createDataFrame(many + odd, REFS), spark.createDataFrame(WORK_ROWS, WORKS)
    got = {r["reference_id"]: (r["method"], r["confidence"], r["external_id"], r["year"]) for r in rs.resolution_ladder(refs, works, "year").collect()}
    want = {f"a{i}": ("TITLE_ONLY", "UNCERTAIN", "w1", 2001) if i % 2 else ("TITLE_AUTHOR_YEAR", "PROBABLE", "w1", 2000) for i in range(40)}
    none = ("UNRESOLVED", "NONE", None, None)
    want |= {"b1": ("TITLE_AUTHOR_YEAR", "PROBABLE", "w1", 1990), "b2": ("DOI", "CERTAIN", "w1", None), "b3": ("ARXIV", "CERTAIN", "w2", None), "b4": none, "b5": none, "b6": none}
    assert got == want and sizes["kinds"] == 4
    titled = rs.corroborate(rs.title_matches(refs, works))
    assert {r["reference_id"]: (r["method"], r["confidence"]) for r in titled.collect()} == {k: v[:2] for k, v in want.items() if v[0].startswith("TITLE")}


def test_patterns_are_matched_once(spark):
    d = spark.createDataFrame([("see doi:10.1000/P5.", "1706.00001v2"), ("none", "arXiv:1706.00001 x"), (None, None)], "a string, b string")
    found = d.select(F.coalesce(normalise_doi(F.col("a")), doi_in(F.col("a"))).alias("x"), normalise_arxiv(F.col("b")).alias("y"), arxiv_in(F.col("b")).alias("z"))
    assert [tuple(r) for r in found.collect()] == [("10.1000/p5", "1706.00001", None), (None, None, "1706.00001"), (None, None, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("10\\.\\d{4,9}") == 1 and plan.count("(?i)arxiv[:") == 1


def test_records_are_joined_to_kinds(spark):
    rows = [(1, "a", "Big red ring", 2000, "Lee", "doi:10.2/Y", None), (1, "b", None, None, None, None, "arXiv:1706.00001"), (2, "c", "unknown here", None, None, "10.2/y", None), (None, "d", "big red ring", None, None, None, None)]
    refs, works = spark.createDataFrame(rows, REFS), spark.createDataFrame(WORK_ROWS, WORKS)
    papers = spark.createDataFrame([(1, "own"), (2, None), (3, " ")], "paper_id long, title string")
    found = rs.resolution_ladder(refs, works, "doi", "title", record=("doi", "title"))
    got = lambda d: sorted(map(tuple, d.collect()), key=str)
    for d, want in ((rs.resolved_keys(found), rs.bibliography_keys(refs, found, works)), (rs.resolved_titles(papers, found), rs.bibliography_titles(papers, refs, found, works))):
        assert got(d) == got(want) and d.count() > 3
    # the references meet the resolved kinds last, which met the records before
    plan = rs.resolved_keys(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "(kind#" in next(line for line in plan.splitlines() if "Join" in line)
