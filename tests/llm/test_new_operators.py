"""Whitening, licence scan and spelling variants against plain versions, and on odd rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from folioflow.llm import licenses, near_dedup, spelling, toxicity, whitening

TEXTS = "doc_id long, text string"
LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)


def clashing(df, *names):
    return df.withColumns({c: F.lit(f"my {c}") for c in names if c not in df.columns})


# --- whitening


def plain_whitening(vectors, k=8):
    """(n, deviations, whitened, explained) from the whole covariance."""
    x = np.floor(np.array(vectors, float) * 1024) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, turn = np.linalg.eigh(c.T @ c / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    ints = [[int(v) for v in row] for row in x]
    sums = [sum(col) for col in zip(*ints)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(row, sums)) for row in ints]
    return n, deviations, c @ turn / np.sqrt(values), values / (c * c).sum() * n


def check_whitening(got, ids, vectors, k=8):
    n, deviations, y, explained = plain_whitening(vectors, k)
    assert len(got) == len(vectors) * k
    table = {(r["vec_id"], r["component"]): r for r in got}
    g = np.array([[table[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    assert np.abs(g * np.sign((g * y).sum(0)) - y).max() < 1e-8
    assert [table[i, 1]["deviation"] for i in ids] == deviations and {r["n"] for r in got} == {n}
    assert np.allclose([table[ids[0], c + 1]["explained"] for c in range(k)], explained, rtol=1e-9)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_equals_the_whole_covariance(spark):
    got = whitening.op11_chebyshev_whitening(spark, SF).collect()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


def test_whitening_of_a_close_spectrum_and_large_entries(spark):
    rng = np.random.RandomState(2)
    x = rng.randn(400, 70) * np.linspace(1, 1.3, 70) * 50
    x[:, 0] += 3e7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    check_whitening(whitening.whitened(df).collect(), range(400), x)


def test_whitening_of_odd_rows(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(40, 5).tolist()
    bad = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf")] * 5), (105, [1.0] * 4), (106, [1e300] * 5)]
    df = spark.createDataFrame([*enumerate(x), *bad], "vec_id long, embedding array<double>")
    df = clashing(df, "id", "v", "n", "component", "kind", "x")
    check_whitening(whitening.whitened(df).collect(), range(40), x, 5)
    same = whitening.whitened(spark.createDataFrame([(None, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same} == {(3, 0, None, None)}
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")).collect()
    assert [r["whitened"] is None for r in line if r["vec_id"] == 3] == [False, True, True]
    none = whitening.whitened(df.where("vec_id >= 100 and vec_id < 102"))
    assert none.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and none.count() == 0


def test_deviation_beyond_a_long():
    x = np.array([[2**40], [-(2**40)]])
    assert whitening.exact_deviation(x, 2, [0]) == [None, None]
    assert whitening.exact_deviation(x // 2**11, 2, [0]) == [2**60, 2**60]


# --- licences


def plain_scan(text):
    """The base columns, by comparing words at every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licence_scan_equals_plain_search(spark):
    rng, parts = random.Random(4), ["GNU", "general", "Public", "license", "MIT", "cc", "by", "-nc", "apache", "é", " ", "_", "\n", ", ", " ", "\x85", "SPDX-License-Identifier: ", "(", ")", "or", "AND", "with"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "-"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [None, "", " \n", "mit license " * 30_000, "license: " * 20_000, "x" * 200_000]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), TEXTS), "n_words", "labels", "score")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i][1:6]) == plain_scan(t)
        assert set(got[i]["base_labels"].split(",")) - {""} <= set(got[i]["labels"].split(",")) and 0 <= got[i]["score"] <= 1
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    whole = {r["doc_id"]: tuple(r[1:6]) for r in licenses.op12_license_expressions(spark, SF).collect()}
    assert whole == {r["doc_id"]: plain_scan(r["text"]) for r in docs}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def plain_value(tree):
    """Restriction of a nested (left, operator, right) expression."""
    if isinstance(tree, str):
        return licenses.asked(tree)
    a, op, b = tree
    if op == "with":
        return licenses.EXCEPTED.get(plain_value(a), plain_value(a))
    return (min if op == "or" else max)(plain_value(a), plain_value(b))


def spelled(tree, above=0):
    if isinstance(tree, str):
        return tree
    a, op, b = tree
    own = licenses.BINDS[op]
    inner = f"{spelled(a, own)} {op.upper()} {spelled(b, own + 1)}"
    return f"({inner})" if own < above else inner


def test_expressions_equal_nested_evaluation():
    rng = random.Random(8)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(["mit", "gpl-3.0-only", "lgpl-2.1+", "cc-by-nc-4.0", "licenseref-x", "apache-2.0"])
            return (name, "with", "classpath-exception-2.0") if rng.random() < 0.2 else name
        return tree(depth - 1), rng.choice(["and", "or"]), tree(depth - 1)

    def names(t):
        return {t} if isinstance(t, str) else names(t[0]) | (set() if t[1] == "with" else names(t[2]))

    for _ in range(300):
        t = tree(4)
        n_words, *_, labels, score = licenses.scan(f"code # SPDX-License-Identifier: {spelled(t)}\nMore text".encode())
        assert score == plain_value(t) and names(t) <= set(labels.split(","))


def test_broken_expressions_and_tags():
    says = lambda t: licenses.scan(t.encode())[5:]
    assert says("SPDX-License-Identifier: (MIT OR GPL-2.0-only") == ("gpl-2.0-only,mit", 0.8)
    assert says("SPDX-License-Identifier: MIT AND AND GPL-2.0") == ("mit", 0.2)
    assert says("SPDX-License-Identifier: OR") == says("SPDX-License-Identifier MIT") == says("license: see below") == ("", 0.0)
    assert says('"license": "Apache-2.0 OR MIT"') == ("apache-2.0,mit", 0.2)
    assert says("All Rights Reserved.") == ("all-rights-reserved", 1.0)
    assert says("SPDX-License-Identifier: MIT\nGPL-3.0") == ("mit", 0.2)


# --- spelling


def plain_words(docs):
    found = collections.Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += len(run) >= 7
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_near(words):
    near = {w: set() for w in words}
    for a, b in itertools.combinations(words, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    return near


def plain_variants(docs):
    n = plain_words(docs)
    near, out = plain_near(n), {}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= 10 * n[w] else None for w, f in form.items()}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def texts_with_chains():
    """Chains of forms, letters of several sets, repeated rows, null ids, long texts."""
    chain = "wanderer " * 500 + "wandeier " * 45 + "wandeies " * 4
    rng = random.Random(6)
    heads = ["".join(rng.choice("abé") for _ in range(8)) for _ in range(60)]
    return [*((i, chain) for i in range(20, 24)), (2, " ".join(heads)), (2, " ".join(heads)), (None, " ".join(heads[:30])), (None, None), (3, ""), (4, "Straße×÷ÀÀÀÀ, ÀÀÀÀÀÀÀ aaaaaaa aaaaaaaa aaaaaaab"), (5, "Straße×÷ÀÀÀÀ, ÀÀÀÀÀÀÀ AAAAAAA aaaaaaaa aaaaaaab"), (6, "q" * 50_000), (7, "q" * 50_000), (8, "q" * 49_999), (8, "q" * 49_999)]


@pytest.mark.parametrize("most", [16_384, 40, 3])
def test_variants_equal_all_pairs(spark, most):
    docs = texts_with_chains()
    df = clashing(spark.createDataFrame(docs, TEXTS), "word", "n", "id", "run", "h", "prefix")
    got, want = told(spelling.variants(df, most=most)), plain_variants(docs)
    assert got == want and any(f and r != f for f, r, *_ in want.values())


def test_variants_of_the_whole_table_and_of_none(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert told(spelling.op13_spelling_transducer(spark, SF)) == plain_variants(docs)
    assert spelling.variants(spark.createDataFrame([], TEXTS)).count() == 0


def test_acceptor_is_minimal_and_pairs_are_unique():
    words = sorted({"".join(w) for k in (3, 4) for w in itertools.product("ab", repeat=k)} - {"abab", "bbb"})
    a = spelling.Acceptor(words)

    def language(s):
        return frozenset(([""] if s in a.final else []) + [x + r for x, t in a.arcs[s].values() for r in language(t)])

    states, waiting = {0}, [0]
    while waiting:
        new = {t for _, t in a.arcs[waiting.pop()].values()} - states
        states |= new
        waiting += new
    assert sorted(language(0)) == words and len({language(s) for s in states}) == len(states)
    assert all(s == 0 or s in a.final or len(a.arcs[s]) > 1 for s in states)
    got = [tuple(sorted(p)) for p in spelling.Composition(a).pairs()]
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted((x, y))) for x, v in plain_near(words).items() for y in v}


# --- near-duplicates of repeated ids


def plain_components(rows, width=5, percent=80):
    """Component of each row: rows of one id are tied, as are similar sets; rows without shingles stay alone."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    label = {i: i for i, _ in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for (i, _), a in zip(rows, sets):
        for (j, _), b in zip(rows, sets):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((top(i), top(j)))
                label[high] = low
    return [top(i) if s else i for (i, _), s in zip(rows, sets)]


def test_ids_of_several_texts_tie_them(spark):
    rng = random.Random(12)
    bases = [[f"b{k}_{i}" for i in range(60)] for k in range(8)]

    def copy(k):
        w = list(bases[k])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(60)] = f"n{rng.random()}"
        return " ".join(w)

    rows = [(rng.randrange(40), copy(rng.randrange(8)) if rng.random() < 0.8 else f"alone {rng.random()} in its words") for _ in range(70)]
    rows += [(100, " ".join(bases[0])), (100, "text of its own with some words"), (101, "text of its own with some words"), (102, ""), (102, " ".join(bases[1])), (100, None)]
    want = collections.Counter((i, len(t or ""), c) for (i, t), c in zip(rows, plain_components(rows)))
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        d = spark.createDataFrame(rows, TEXTS).withColumn("size", F.coalesce(F.length("text"), F.lit(0)))
        got = near_dedup.near_duplicates(d)
        assert got.count() == len(rows)
        by_id = {(r["doc_id"], r["component_id"]) for r in got.collect()}
        assert by_id == {(i, c) for i, _, c in want}


def test_large_buckets_are_dealt_to_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_ROWS", 7)
    monkeypatch.setattr(near_dedup, "PIVOTS", (2, 5))
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(100)], []
    for i in range(60):
        base = list(base)
        base[rng.randrange(100)] = f"e{i}"
        rows.append((i, " ".join(base)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == dict(zip([i for i, _ in rows], plain_components(rows)))


# --- toxicity of few labels and long texts


def test_scores_of_few_labels_and_long_texts(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = [(i, text(80) + (" vile scoundrel " + text(20) if i < 9 else "")) for i in range(60)] + [(100, text(30_000) + " vile scoundrel"), (101, text(30_000)), (102, None)]
    d = spark.createDataFrame(rows, TEXTS)
    labels = spark.createDataFrame([(i, int(i < 9)) for i in range(60)] + [(100, 1), (101, 0), (500, 1), (3, None)], "doc_id long, toxic int")
    for some in (labels, labels.where("toxic = 0 or doc_id = 2")):
        model = toxicity.fit(d, some)
        got = toxicity.score(d, model).toPandas()
        assert got.score.between(0, 1).all() and got.score.nunique() > 1 and len(toxicity.excerpt(rows[-2][1])) == toxicity.EXCERPT
    model = toxicity.fit(d, labels)
    scores = toxicity.score(d, model).toPandas().set_index("doc_id").score
    assert scores[[i for i in range(9)]].mean() > scores[[i for i in range(9, 60)]].mean()
    assert toxicity.fit(d, labels.where("toxic = 1")) is None and toxicity.score(d, None).where("score = 0").count() == len(rows)
    assert toxicity.without_toxic(d, labels.where("toxic = 0")).count() == len(rows)


def test_rejection_asks_for_evidence():
    few, y = np.array([0.9, 0.2, 0.1, 0.1]), np.array([1.0, 0, 0, 0])
    assert toxicity.rejection(few, y, 0.25) == np.inf
    many = np.r_[np.full(50, 0.8), np.full(10, 0.4), np.zeros(200)]
    assert toxicity.rejection(many, np.r_[np.ones(50), np.zeros(210)], 50 / 260) == 0.4
    assert toxicity.rejection(many, np.r_[np.ones(30), np.zeros(230)], 30 / 260) == np.inf
