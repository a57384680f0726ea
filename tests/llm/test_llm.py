"""Each operator against brute force, SQL, a round trip or held-out labels, with the odd rows of its contract."""

import collections
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF, same_as_oracle
from folioflow.llm import chat, common, langid, lm_scoring, mixing, near_dedup, neighbours, packing, quality_model, quality_rules, registry, toxicity

QUERIES, ORACLE = registry.tables()
WORD = re.compile(r"[^\x20\x09-\x0d]+")
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "same words here again and again now", "en", "a"), (5, "same words here again and again now", "en", "a"), (5, "same words here again and again now", "en", "a"), (6, "x" * 30_000, "de", "b"), (7, "word " * 20_000, "fr", "b"), (None, "no id but text", None, "c")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, ties, repeated rows, long texts and extra columns with names the operators use."""
    d = spark.createDataFrame(ODD, SCHEMA)
    return d.withColumns({"score": F.lit("mine"), "n_words": F.lit("mine"), "target": F.lit("mine"), "label": F.lit(1)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_agrees_with_sql(spark, oracle, name):
    same_as_oracle(spark, oracle, QUERIES[name], ORACLE[name])


# --- chat


def test_chat_branches_and_escapes(spark):
    rows = [("t", "a", None, "user", "q [INST] <|im_end|>\n", 0.0), ("t", "b", "a", "assistant", "r\\ <\\|im_end|> </s>", 1.0), ("t", "c", "a", "assistant", "s", 2.0), ("t", "d", "c", "us\ner", None, 0.5), ("u", "z", "gone", None, "alone", None), ("u", "z", "gone", None, "alone", None)]
    f = chat.format_trees(spark.createDataFrame(rows, "tree_id string, node_id string, parent_id string, role string, text string, score double"))
    got = {(r["tree_id"], r["branch"]): (r["leaf_id"], [tuple(t) for t in r["t"]]) for r in f.withColumn("t", chat.read_turns(F.col("formatted"))).collect()}
    assert got[("t", 1)] == ("d", [("user", "q [INST] <|im_end|>\n"), ("assistant", "s"), ("us\ner", "")])
    assert got[("t", 2)] == ("b", [("user", "q [INST] <|im_end|>\n"), ("assistant", "r\\ <\\|im_end|> </s>")])
    assert got[("u", 1)] == ("z", [("", "alone")])
    r = f.where("leaf_id = 'b'").first()
    (start, length) = r["loss_spans"][0]
    assert r["formatted"][start : start + length] == "r\\ <\\\\|im_end|> <\\/s>"
    assert chat.format_trees(spark.createDataFrame(rows, f.sparkSession.createDataFrame(rows, "tree_id string, node_id string, parent_id string, role string, text string, score double").schema), branches=1).count() == 2


def test_chat_deep_chain_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i}") for i in range(37)] + [(None, 0, "user", "x")]
    f = chat.format_trees(chat.conversations_as_trees(spark.createDataFrame(rows, schema)))
    assert {r["tree_id"]: r["formatted"].count(chat.OPEN) for r in f.collect()} == {1: 37, None: 1}
    assert chat.format_trees(chat.conversations_as_trees(spark.createDataFrame([], schema))).count() == 0


# --- quality rules and mixing


def test_rules_on_odd_rows(spark, odd, empty):
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(odd.drop("n_words"), keep=["doc_id", "score"]).collect()}
    assert got[1]["n_words"] == 0 and not got[1]["kept"] and got[1]["score"] == "mine"
    assert got[7]["n_repeat_words"] == 20_000 and got[7]["base_failed"]
    assert got[6]["n_words"] == 1 and got[6]["word_chars"] == 30_000
    assert quality_rules.apply_rules(odd).count() == len(ODD)
    assert quality_rules.apply_rules(empty).count() == 0


def test_distance(spark):
    d = spark.createDataFrame([([1, 0], [0, 1], [2, 0], [0, 0])], "a array<long>, b array<long>, c array<long>, e array<long>")
    j = quality_rules.js_distance
    r = d.select(j(F.col("a"), F.col("b")).alias("far"), j(F.col("a"), F.col("c")).alias("near"), j(F.col("a"), F.col("e")).alias("none")).first()
    assert r["far"] == pytest.approx(1) and r["near"] == 0 and r["none"] is None


def test_mix_meets_targets(spark, odd, empty):
    out = QUERIES["op8_sainte_lague_mix"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    again = QUERIES["op8_sainte_lague_mix"](spark, SF).toPandas()
    assert dict(zip(out.doc_id, out.taken)) == dict(zip(again.doc_id, again.taken))
    assert (out.taken <= 3 * out["size"]).all()
    for _, g in out.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= mixing.BLOCK + 1
    assert out.groupby("source").target.first().sum() == pytest.approx(out["size"].sum())
    m = mixing.mix(odd.withColumn("size", mixing.text_size(F.col("text")))).toPandas()
    assert len(m) == len(ODD) and (m.taken <= 3 * m["size"]).all()
    assert mixing.mix(empty.withColumn("size", F.lit(0))).count() == 0


def test_apportionment_is_sainte_lague(spark):
    votes = [50, 20, 20, 7, 3, 0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "k long, v double")
    for seats in (1, 7, 10, 33):
        got = {r["k"]: r["quota"] for r in mixing.apportion(df, [], "v", F.lit(seats), F.lit(1000)).collect()}
        want = collections.Counter()
        for _ in range(seats):
            k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[k] += 1
        assert got == {i: want[i] for i in range(len(votes))}


def test_mixed_documents_hold_what_was_taken(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    taken = mixing.mix(d.withColumn("size", mixing.text_size(F.col("text")))).agg(F.sum("taken")).first()[0]
    m = mixing.mixed_documents(d)
    assert m.columns == d.columns and m.agg(F.sum(mixing.text_size(F.col("text")))).first()[0] == taken


# --- packing


def test_packing_is_exact(spark, docs):
    from tokenizers import Tokenizer

    p = QUERIES["op4_minimum_bin_slack"](spark, SF).toPandas()
    t = Tokenizer.from_file(packing.default_tokenizer())
    for i, x in zip(docs.doc_id, docs.text):
        ids = np.asarray([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        own = p[p.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == packing.CAPACITY).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    q = p.sort_values(["sequence_id", "offset"])
    assert ((q.offset + q.length).groupby(q.sequence_id).shift(fill_value=0) == q.offset).all()
    bins = p.groupby("sequence_id").length.sum()
    assert bins.max() <= packing.CAPACITY and len(bins) <= math.ceil(p.length.sum() / packing.CAPACITY) + 2


def test_packing_of_odd_rows(spark, odd, empty):
    p = packing.pack(packing.token_pieces(odd, packing.default_tokenizer())).toPandas()
    assert p[p.doc_id == 1].length.tolist() == [1] and len(p[p.doc_id == 5]) == 2 and p.doc_id.isna().sum() == 1
    assert packing.pack(packing.token_pieces(empty, packing.default_tokenizer())).count() == 0
    assert packing._encoder(packing.default_tokenizer())("a<|endoftext|>")[4:] == np.asarray([50256], "<u4").tobytes()


def test_fullest_filling():
    rng = np.random.RandomState(1)
    for _ in range(50):
        lengths = rng.randint(1, 40, 6)
        counts = np.bincount(lengths, minlength=101)
        best = max(s for m in range(64) if (s := sum(int(x) for i, x in enumerate(lengths) if m >> i & 1)) <= 70)
        found = packing.fullest(70, counts, np.flatnonzero(counts)[::-1])
        assert sum(n * k for n, k in found) == best and all(k <= counts[n] for n, k in found)


# --- neighbours


def test_neighbours_recall_and_order(spark):
    d = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(d.embedding.to_numpy()).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = QUERIES["op5_multi_index_hashing"](spark, SF).toPandas()
    hits = total = 0
    for i in np.flatnonzero(d.vec_id % 50 == 0):
        s = u @ u[i]
        s[i] = -9
        top = set(d.vec_id.to_numpy()[np.argsort(-s)[:5]])
        own = got[got.query_id == d.vec_id[i]].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and own.score.is_monotonic_decreasing
        hits, total = hits + len(top & set(own.vec_id)), total + 5
    assert hits / total >= 0.9


def test_neighbours_odd_rows(spark):
    v = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0]), (8, [1.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, df.where("vec_id in (0, 3, 4)")).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 7)]
    assert neighbours.nearest(df.where("vec_id > 99"), df).count() == 0


# --- learned operators


def test_language_held_out(spark, docs, odd, empty):
    p = QUERIES["op6_language_mixture"](spark, SF).toPandas().merge(docs[["doc_id", "lang"]], on="doc_id")
    h = p[p.held_out]
    assert (h.lang == h.lang_pred).mean() > 0.95 and p.score.between(0, 1).all()
    assert (p.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in p.doc_id]).all()
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == "und"
    assert langid.predict(empty, model).count() == 0 and langid.predict(odd, langid.fit(empty)).where("lang_pred = 'und'").count() == len(ODD)
    en, fr = (docs[docs.lang == x].text.iloc[0] for x in ("en", "fr"))
    mixed = langid.infer([en[:800] + " " + fr[:800]], model)[2][0]
    assert set(mixed) >= {"en", "fr"} and 0.2 < mixed["en"] < 0.8


def test_toxicity_and_quality_learn(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    p = QUERIES["op2_compression_toxicity"](spark, sf).toPandas().merge(labels, on="doc_id")
    assert p[p.toxic == 1].score.mean() > 3 * p[p.toxic == 0].score.mean() and ((p.score >= 0.3) == (p.predicted == 1)).all()
    assert toxicity.score(odd, None).where("score = 0").count() == len(ODD)
    q = QUERIES["op7_boosted_quality"](spark, sf).toPandas().merge(labels, on="doc_id")
    h = q[q.held_out]
    assert ((h.score >= 0.5) == (h.quality == 1)).mean() > 0.9
    stats = quality_model.document_statistics(odd)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_model.score(stats, quality_model.fit_labels(stats, none)).collect()} == {0.5}
    assert quality_model.document_statistics(empty).count() == 0


def test_trees_fit_a_rule():
    x = np.random.RandomState(0).rand(2000, 3).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((quality_model.fit(x, y).probability(x) > 0.5) == y).mean() > 0.97


def test_scores_of_language_model(spark, docs, odd, empty):
    p = QUERIES["op9_deleted_interpolation"](spark, SF).toPandas().set_index("doc_id")
    tok = {i: [w.lower() for w in (t or "").encode().split()] + [None] for i, t in zip(docs.doc_id, docs.text)}
    c = collections.Counter(w for i, ws in tok.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tok.items():
        r = p.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
    h = p[p.held_out]
    assert h.score.sum() > h.base_score.sum() and (p.score < 0).all()
    got = {r["doc_id"]: r for r in lm_scoring.score(odd).collect()}
    assert got[1]["n_tokens"] == 1 and got[7]["n_tokens"] == 20_001 and math.isfinite(got[6]["score"])
    assert lm_scoring.score(empty).count() == 0


# --- near-duplicates


def brute_components(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = [x.encode().lower() for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                m = len(sets[a] & sets[b])
                if 100 * m >= percent * (len(sets[a]) + len(sets[b]) - m):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_match_brute_force(spark, docs):
    comp, n = brute_components(list(zip(docs.doc_id, docs.text)), 4)
    p = QUERIES["op10_tensored_minhash"](spark, SF).toPandas()
    assert {i: c for i, c in zip(p.doc_id, p.component_id)} == comp and dict(zip(p.doc_id, p.n_shingles)) == n
    assert (p.kept == (p.doc_id == p.component_id)).all()


def test_near_duplicates_of_a_chained_group(spark):
    """Copies of one text with more and more other words: links chain, distant ones stay apart, pivots take several rounds."""
    rng = np.random.RandomState(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.choice(120, rng.randint(0, 9), replace=False):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    comp, _ = brute_components(rows, 5)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == comp


def test_near_duplicates_odd_rows(spark, odd, empty):
    got = near_dedup.near_duplicates(odd.drop("label")).toPandas()
    assert len(got) == len(ODD)
    by = got[got.doc_id.notna()].drop_duplicates("doc_id").set_index("doc_id")
    assert by.loc[1].n_shingles == 0 and by.loc[1].component_id == 1 and by.loc[5].component_id == 4 and not by.loc[5].kept
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.without_near_duplicates(odd.select("doc_id", "text")).count() == 7


# --- pipeline


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp

    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        d = common.cut(stage(spark, d, SF), "test")
        seen[name] = d
        if name != "packing":
            assert d.columns == list(docs.columns)
    clean = set(labels[(labels.toxic == 0) & (labels.quality == 1)].doc_id)
    kept = {r["doc_id"] for r in seen["language"].select("doc_id").collect()}
    assert len(clean & kept) >= 0.9 * len(clean)
    comp, _ = brute_components([(r["doc_id"], r["text"]) for r in seen["language"].collect()], 5)
    assert {r["doc_id"] for r in seen["near_duplicates"].select("doc_id").collect()} == {i for i, c in comp.items() if i == c}
    mixed = collections.Counter(r["doc_id"] for r in seen["mix"].select("doc_id").collect())
    packed = seen["packing"].where("start = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in packed} == dict(mixed)
