"""Reworked operators against plain loops, with the odd rows of their contracts."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.functions.text import STOPWORDS
from folioflow.operators import integrity, resolution, review
from folioflow.sources import shredding
from folioflow.streaming import logs

WORDS = [f"w{i}" for i in range(14)]


def titles(n, seed, most=7):
    rnd = random.Random(seed)
    return [" ".join(rnd.sample(WORDS, rnd.randrange(1, most))) for _ in range(n)]


def jaccard(a, b):
    x, y = set(a.split()) - set(STOPWORDS), set(b.split()) - set(STOPWORDS)
    return len(x & y) / len(x | y) if x and y else 0.0


def test_similar_pairs_are_exact(spark):
    a, b = titles(60, 1), titles(50, 2)
    frame = lambda t: spark.createDataFrame([(i, x.split()) for i, x in enumerate(t)], "id long, tokens array<string>")
    for percent in (0, 25, 72, 100):
        got = {(r["a"], r["b"]): r["similarity"] for r in resolution.similar_pairs(frame(a), frame(b), percent).where("similarity > 0").collect()}
        want = {(i, j): jaccard(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if jaccard(x, y) > 0 and 100 * jaccard(x, y) >= percent - 1e-9}
        assert got == pytest.approx(want)


def test_best_of_each_title(spark):
    a, b = titles(60, 3), titles(50, 4)
    refs = spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(a)] + [("blank", " "), ("none", None)], "reference_id string, title string")
    works = spark.createDataFrame([("OPENALEX" if i % 3 else "SEMANTIC_SCHOLAR", f"{i:02}", x, 2000, "F") for i, x in enumerate(b)], "provider string, external_id string, title string, year long, family string")
    got = {r["reference_id"]: (r["provider"], r["external_id"]) for r in resolution.best_title_match(refs, works, 60).collect()}
    want = {}
    for i, x in enumerate(a):
        near = [(-jaccard(x, y), 0 if j % 3 else 1, f"{j:02}") for j, y in enumerate(b) if jaccard(x, y) >= 0.6 - 1e-9]
        if near:
            _, rank, name = min(near)
            want[f"r{i}"] = ("SEMANTIC_SCHOLAR" if rank else "OPENALEX", name)
    assert got == want


def test_ranking_is_exact(spark):
    a, b = titles(40, 5), titles(80, 6)
    frame = lambda t: spark.createDataFrame([(i, x.split()) for i, x in enumerate(t)] + [(999, [])], "id long, tokens array<string>")
    got = {}
    for r in review.lexical_rank(frame(a), frame(b), 3).collect():
        got.setdefault(r["claim_id"], {})[r["rank"]] = r["work_id"]
    for i, x in enumerate(a):
        order = sorted((-jaccard(x, y), j) for j, y in enumerate(b) if jaccard(x, y) > 0)
        assert got.get(i, {}) == {k + 1: j for k, (_, j) in enumerate(order[:3])}


def test_ranking_probes_few_pairs(spark, monkeypatch):
    a, b = titles(60, 7), titles(120, 8)
    frame = lambda t: spark.createDataFrame([(i, [*x.split(), "the"]) for i, x in enumerate(t)], "id long, tokens array<string>")
    made, plain = [], review.probed

    def counted(*args):
        d = plain(*args)
        made.append(d.count())
        return d

    monkeypatch.setattr(review, "probed", counted)
    found = review.lexical_rank(frame(a), frame(b), 1).count()
    assert found == 60 and sum(made) < 60 * 120 / 2  # all pairs share a word
    assert review.lexical_rank(frame(a), frame([]), 1).count() == 0 and review.lexical_rank(frame([]), frame(b), 1).count() == 0


def test_greedy_lists(spark):
    rows = []
    for q in range(30):
        rows += [(q, k, "OPENALEX", f"{q}-{k}", x, f"10.1/{q}{k % 5}" if k % 3 == 0 else None, None, "F" if k % 4 else "", 2000) for k, x in enumerate(titles(12, 100 + q, 5))]
    d = spark.createDataFrame(rows, "q long, rank long, provider string, external_id string, title string, doi string, arxiv_id string, family string, year long")
    kept = {}
    for q, k, _p, _e, title, doi, _a, family, _y in rows:
        mine = kept.setdefault(q, [])
        if not any((doi and doi == o[2]) or jaccard(title, o[1]) >= 0.72 for o in mine):
            mine.append((k, title, doi, family))
    got = resolution.dedupe_greedy(d, "q").groupBy("q").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    assert {r["q"]: r["r"] for r in got.collect()} == {q: [o[0] for o in v] for q, v in kept.items()}
    first, incomplete = resolution.candidate_set(d, "q", 4)
    listed = {}
    for r in first.collect():
        listed.setdefault(r["q"], {})[r["candidate_id"]] = r["external_id"]
    for q, v in kept.items():
        full = [o for o in v if o[3]]
        assert listed.get(q, {}) == {f"cand_{n:03}": f"{q}-{o[0]}" for n, o in enumerate(full[:4])}
    assert {r["q"]: r["incomplete"] for r in incomplete.collect()} == {q: sum(not o[3] for o in v) for q, v in kept.items()}
    small = resolution.dedupe_greedy(d, "q", fold_rows=3).groupBy("q").agg(F.sort_array(F.collect_list("rank")).alias("r"))
    assert {r["q"]: r["r"] for r in small.collect()} == {q: [o[0] for o in v] for q, v in kept.items()}


def test_greedy_list_of_a_hundred_thousand(spark):
    n, rng = 100_000, random.Random(3)
    rows = [(1, k, "OPENALEX", str(k), f"w{rng.randrange(900)} x{rng.randrange(600)} y{rng.randrange(200)} same words of all titles", f"10.1/{rng.randrange(80_000)}" if k % 2 else None) for k in range(n)]
    d = spark.createDataFrame(pd.DataFrame(rows, columns=["q", "rank", "provider", "external_id", "title", "doi"])).withColumn("arxiv_id", F.lit(None).cast("string"))
    by_doi, by_token, kept = set(), {}, []
    for _q, k, _p, _e, title, doi in rows:
        w = frozenset(title.split()) - {"of"}  # a stop word; the other tokens are all of a title's, 7 or so
        near = [o for x in (x for x in w if x[0] in "wxy" and x[1:].isdigit()) for o in by_token.get(x, ())]
        if doi in by_doi and doi or any(100 * len(w & o) >= 72 * len(w | o) for o in near):
            continue
        kept.append(k)
        by_doi.add(doi)
        for x in w:
            by_token.setdefault(x, set()).add(w)
    got = resolution.dedupe_greedy(d, "q")
    assert sorted(r["rank"] for r in got.select("rank").collect()) == kept


def test_cited_works_are_not_offered(spark):
    cand = spark.createDataFrame([(1, "OPENALEX", "a", "Grain size of river sand", None, None), (1, "OPENALEX", "b", "Clay", "10.1/B", None), (1, "OPENALEX", "c", "Silt", None, "2301.00001"), (1, "OPENALEX", "d", None, None, None), (2, "OPENALEX", "a", "Grain size of river sand", None, None)], "paper_id long, provider string, external_id string, title string, doi string, arxiv_id string")
    keys = spark.createDataFrame([(1, "doi:10.1/b"), (1, "arxiv:2301.00001")], "paper_id long, key string")
    held = spark.createDataFrame([(1, "The grain size of the river sand"), (2, "Grain shape")], "paper_id long, title string")
    got = resolution.not_in_bibliography(cand, keys, held).select("paper_id", "external_id").collect()
    assert sorted(map(tuple, got)) == [(1, "d"), (2, "a")]


def test_contained_items(spark):
    docs = spark.createDataFrame([(1, "The Quick\n brown  fox jumped over the lazy dog and ran"), (2, ""), (None, "concatenate these words"), (3, None)], "doc_id long, text string")
    items = {1: "quick brown fox", 2: "uick brown fox jum", 3: "cat", 4: "brown dog", 5: "enate  THESE w", 6: "the quick brown fox jumped over the lazy dog and", 7: " ", 8: None, 9: "og and", 10: "fox jumped lazy", 11: "x"}
    got = integrity.content_present(spark.createDataFrame(list(items.items()), "item_id long, text string"), docs)
    assert sorted(r["item_id"] for r in got.collect()) == [1, 2, 3, 5, 6, 9, 11]
    assert integrity.content_present(spark.createDataFrame([], "item_id long, text string"), docs).count() == 0


def test_hits_do_not_renew(spark):
    hour = 3600
    rows = [("k", 1, 0, "OK"), ("k", 2, 6 * 24 * hour, "EMPTY"), ("k", 3, 7 * 24 * hour, "EMPTY"), ("k", 4, 7 * 24 * hour + hour, "OK"), ("k", 5, 7 * 24 * hour + 6 * hour, "OK"), ("k", 6, 13 * 24 * hour, "OK"), ("e", 7, 5, "OK"), (None, 8, 5, "OK")]
    d = spark.createDataFrame(rows, "cache_key string, attempt_id long, s long, status string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["attempt_id"]: r["hit"] for r in logs.fresh_hit(d).collect()}
    assert got == {1: False, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: False}


def test_hits_of_spread_keys(spark):
    rng = random.Random(4)
    rows, ends, want = [], {}, {}
    for i in range(3000):
        rows.append((rng.choice(["a", "a", "a", "b", None]), rng.randrange(0, 60 * 24) * 1800 + rng.choice([0, 0, 1]), i, rng.choice(["OK", "EMPTY", "EMPTY", "EMPTY"])))
    for key, at, i, status in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want[i] = at < ends.get(key, -1)
        if not want[i]:
            ends[key] = at + (logs.TTL_FOUND if status == "OK" else logs.TTL_EMPTY)
    d = spark.createDataFrame(rows, "cache_key string, s long, attempt_id long, status string").withColumn("ts", F.timestamp_seconds("s"))
    for most in (10**6, 1000, 0):
        assert {r["attempt_id"]: r["hit"] for r in logs.fresh_hit(d, most).collect()} == want
    assert logs.fresh_hit(d.limit(0), 0).count() == 0


def test_support_of_added_citations(spark):
    v = [(1, "SUPPORTED"), (2, "PARTIALLY_SUPPORTED"), (3, "EVIDENCE_UNAVAILABLE"), (4, "CONTRADICTED"), (4, "SUPPORTED"), (5, "SUPPORTED"), (5, "PARTIALLY_SUPPORTED")]
    got = {r["g"]: r["status"] for r in integrity.new_support_status(spark.createDataFrame(v, "g long, verdict string"), "g").collect()}
    assert got == {1: "PASSED", 2: "WARNED", 3: "BLOCKED", 4: "BLOCKED", 5: "WARNED"}


def test_tables_without_rows_are_rectangular(spark):
    d = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, ["c"])], "k long, cells array<string>")
    got = sorted(tuple(r) for r in shredding.rectangular(d, "k", "cells").collect())
    assert got == [(1, 0, "a"), (1, 1, "b"), (2, 0, ""), (2, 1, ""), (3, 0, "c"), (3, 1, "")]
    assert shredding.rectangular(d.where("false"), "k", "cells").count() == 0


def test_answers_outside_the_offer_reject_a_response(spark):
    import pandas as pd

    d = spark.createDataFrame([("r1", "a", 1.0), ("r1", "b", 2.0), ("r2", "a", 3.0), ("r2", "zz", 4.0)], "response string, item string, x double")
    offered = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a")], "response string, item string")
    judged = review.judge(d, lambda b: pd.Series(b["x"] / 10), "response string, item string, x double")
    good, bad = review.grounded(judged, offered, "response", "item")
    assert sorted(r["item"] for r in good.collect()) == ["a", "b"] and [(r["response"], r["foreign_ids"]) for r in bad.collect()] == [("r2", 1)]


def test_texts_without_a_key_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"plain words of text {i} and nothing else here") for i in range(200)] + [(500, "before THE grain  of sand\nmoves along the bed after")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the grain of sand moves along the bed"), (2, "not in any text at all, ever so"), (3, "ext 17 a")], "item_id long, text string")
    sizes = []
    written = integrity.written
    try:
        integrity.written = lambda df, name: (out := written(df, name), sizes.append((name, out.count())))[0]
        got = {r["item_id"] for r in integrity.content_present(items, docs).collect()}
    finally:
        integrity.written = written
    assert got == {1, 3} and dict(sizes)["texts-with-keys"] < 10


def test_authors_fall_back_and_keep_affiliations(spark):
    kind = "k long, authors array<struct<name:string, affiliations:array<string>>>, others array<struct<name:string, affiliations:array<string>>>"
    rows = [(1, [("Ann  Lee", ["A", "B"]), (" ", ["C"]), ("ANN LEE", ["D"]), ("Bo", None)], [("Cy", ["E"])]), (2, [(None, ["A"]), (" ", [])], [("Cy", []), ("Di", ["F"])]), (3, None, [("Cy", ["G"])]), (4, None, None), (5, [], [(" ", [])])]
    got = {r["k"]: (r["authors"], r["affiliations"]) for r in shredding.dedupe_authors(spark.createDataFrame(rows, kind), "k", "authors", "others").collect()}
    assert got == {1: ("Ann Lee|Bo", "A;B|"), 2: ("Cy|Di", "|F"), 3: ("Cy", "G")}
