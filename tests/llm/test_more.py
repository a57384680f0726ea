"""Brute-force twins of the learned operators, odd rows through fitted models, clashing column names."""

import collections
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import SF
from folioflow.llm import chat, langid, lm_scoring, mixing, near_dedup, neighbours, packing, quality_model, quality_rules, toxicity

ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "same words here again and again now", "en", "a"), (5, "same words here again and again now", "en", "a"), (5, "same words here again and again now", "en", "a"), (6, "x" * 30_000, "de", "b"), (7, "word " * 20_000, "fr", "b"), (None, "no id here", "en", "b"), (8, "½ ² ٣ 12", "xx", "c")]
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHING = ["ref_lang", "n_words", "slices", "source_quota", "_src", "_size", "_row", "row", "doc", "id", "target", "taken", "score", "label", "key", "n", "found", "piece", "chunk", "train", "kept_", "code", "page"]


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(f"my {c}") for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- clashing names pass through


def test_names_pass_through(spark, odd):
    out = quality_rules.apply_rules(odd)
    assert set(CLASHING) - {"n_words"} <= set(out.columns) and {r["ref_lang"] for r in out.collect()} == {"my ref_lang"}
    m = mixing.mixed_documents(odd)
    assert m.columns == odd.columns and all(r[c] == f"my {c}" for r in m.collect() for c in CLASHING)
    assert set(CLASHING) - {"target", "taken"} <= set(mixing.mix(odd.withColumn("size", F.lit(3))).columns)
    k = near_dedup.without_near_duplicates(odd)
    assert k.columns == odd.columns and all(r[c] == f"my {c}" for r in k.collect() for c in CLASHING)
    assert near_dedup.near_duplicates(odd).count() == lm_scoring.score(odd).count() == len(ODD)
    assert packing.token_pieces(odd, packing.default_tokenizer()).where("doc_id = 5").count() == 2
    kept = langid.with_language(odd.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True))
    assert set(kept.columns) == {*odd.columns, "n_chars"} and kept.where("doc_id = 8 and lang = 'xx'").isEmpty()


# --- chat


def test_circles_are_cut(spark):
    rows = [("t", "a", "b"), ("t", "b", "c"), ("t", "c", "a"), ("t", "d", "b"), ("t", "e", "e"), ("t", "f", "e"), ("u", None, "g"), ("u", "g", None)]
    d = spark.createDataFrame([(*r, "user", r[1], 1.0) for r in rows], "tree_id string, node_id string, parent_id string, role string, text string, score double")
    got = {(r["tree_id"], r["leaf_id"]): [t["text"] for t in r["t"]] for r in chat.format_trees(d).select("tree_id", "leaf_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {("t", "d"): ["a", "c", "b", "d"], ("t", "f"): ["e", "f"], ("u", "g"): ["g"]}


def test_paths_of_random_trees(spark):
    rnd = random.Random(4)
    parent = {i: rnd.randrange(i) if i and rnd.random() < 0.95 else None for i in range(300)}
    d = spark.createDataFrame([(1, i, p) for i, p in parent.items()], "tree_id long, node_id long, parent_id long")
    got = collections.defaultdict(dict)
    for r in chat.tree_paths(d).collect():
        got[r["leaf_id"]][r["above"]] = r["node_id"]
    want = {}
    for leaf in set(parent) - set(parent.values()):
        up, want[leaf] = leaf, {}
        while up is not None:
            want[leaf][len(want[leaf])] = up
            up = parent[up]
    assert got == want


# --- toxicity


def test_window_lengths_match_a_plain_loop(spark, odd, empty, docs):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(d, labels)
    assert model.toxic.startswith(model.ordinary) and len(model.toxic) > len(model.ordinary) + 500

    def size(window, data):
        c = zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(c.compress(window))

    for t in docs.text.head(8):
        words = t.encode().lower().split()
        gains = sorted(size(w, model.ordinary) - size(w, model.toxic) for w in (b" " + b" ".join(words[i : i + 10]) + b" " for i in range(0, len(words), 10)))
        f = model.features(words)
        assert f[0] == gains[-1] and f[3] == pytest.approx(math.log1p(sum(g for g in gains if g >= 3)))
    got = toxicity.score(odd, model).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all() and got.score[0] == got.score[1] == got.score[2]
    assert toxicity.score(empty, model).count() == 0 and toxicity.without_toxic(empty, labels).count() == 0


def test_toxic_held_out(spark):
    from folioflow.llm.registry import tables

    p = tables()[0]["op2_compression_toxicity"](spark, "/root/testdata/sf0.1").toPandas().merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    h = p[p.held_out]
    assert h[h.toxic == 1].predicted.mean() > 0.55 and h[h.toxic == 0].predicted.mean() < 0.05


# --- language


def test_mixture_matches_a_plain_loop(spark, docs):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [" ".join(t.split()[:120]) + " " + " ".join(u.split()[:n]) for t, u, n in zip(docs.text[:12], docs.text[12:24], range(0, 120, 10))]
    pred, score, sets = langid.infer(texts, model)

    def em(p, n, on):
        w = {j: 1 / len(on) for j in on}
        for _ in range(langid.ROUNDS):
            new = dict.fromkeys(on, 0.0)
            for row, k in zip(p, n):
                total = sum(row[j] * w[j] for j in on)
                for j in on:
                    new[j] += k * row[j] * w[j] / total
            w = {j: max(v / sum(n), 1e-9) for j, v in new.items()}
            w = {j: v / sum(w.values()) for j, v in w.items()}
        return w, sum(k * math.log(sum(row[j] * w[j] for j in on)) for row, k in zip(p, n))

    for t, one, s, chosen in zip(texts, pred, score, sets):
        c = langid.tokens(t)
        like = model.words(list(c)).astype(float)
        p, n = np.maximum(np.exp((like - like.max(1, keepdims=True)) * 4), 1e-6), list(c.values())
        on = list(range(len(model.langs)))
        w, best = em(p, n, on)
        while len(on) > 1:
            rest = [j for j in on if j != min(on, key=lambda j: (w[j], j))]
            w2, like2 = em(p, n, rest)
            if best - like2 >= langid.PENALTY * math.log(sum(n) + 1):
                break
            on, w, best = rest, w2, like2
        top = max(on, key=lambda j: (w[j], -j))
        assert one == model.langs[top] and s == pytest.approx(w[top], abs=1e-6)
        assert chosen == pytest.approx({model.langs[j]: w[j] for j in on}, abs=1e-6)


def test_letterless_texts_are_unknown(spark):
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert langid.infer(["½ ²", "٣ 12 _", "", None, "a"], model)[0][:4] == ["und"] * 4


def test_training_rows_are_bounded(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("wort "), "id").alias("text"), F.when(F.col("id") < 2900, "de").otherwise("en").alias("lang"))
    d = d.unionByName(d).unionByName(d.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    a, b = langid.fit(d, rows=50), langid.fit(d.orderBy(F.desc("doc_id")), rows=50)
    assert a.langs == b.langs == ["de", "en"] and (a.table == b.table).all()


# --- quality trees


def test_traversal_matches_a_walk(spark, odd, empty):
    rng = np.random.RandomState(1)
    x = rng.rand(400, 5).astype(np.float32)
    y = (x[:, 0] + x[:, 3] > 1).astype(float)
    t = quality_model.fit(x, y)
    for row, margin in zip(x[:50], t.margin(x[:50])):
        total = t.prior
        for feature, at, value in zip(t.feature, t.cut, t.value):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > at[node])
            total += value[node - len(feature)]
        assert margin == pytest.approx(total)
    # the first split is the best of all that a plain search finds
    p = y.mean()
    g, h = p - y, p * (1 - p)

    def gain(j, c):
        left = x[:, j] <= c
        parts = [(g[s].sum(), h * s.sum()) for s in (left, ~left)]
        return sum(a * a / (b + quality_model.PENALTY) for a, b in parts) - g.sum() ** 2 / (h * len(g) + quality_model.PENALTY)

    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality_model.BINS + 1)[1:-1])) for j in range(5)]
    best = max(gain(j, c) for j in range(5) for c in edges[j] if 20 <= (x[:, j] <= c).sum() <= 380)
    assert gain(t.feature[0][0], t.cut[0][0]) == pytest.approx(best, rel=1e-6)
    stats = quality_model.document_statistics(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    model = quality_model.fit_labels(stats, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    got = quality_model.score(quality_model.document_statistics(odd), model).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    assert quality_model.score(quality_model.document_statistics(empty), model).count() == 0


# --- mixing


def test_small_corpora_are_mixed(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "a", 5), (2, "eleven twelve", "b", 5)], "doc_id long, text string, source string, n_chars long")
    got = mixing.mix(d.withColumn("size", mixing.text_size(F.col("text")))).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    m = mixing.mixed_documents(d)
    assert m.columns == d.columns and m.agg(F.sum(mixing.text_size(F.col("text")))).first()[0] == got.taken.sum()


# --- packing


def test_ids_equal_the_tokenizers_file(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing._encoder(packing.default_tokenizer())
    rnd = random.Random(3)
    pool = "aZ é߀中文 \n\t  '’sSTre123½²😀👩‍👩‍👧́‍﻿\x00\x85_-<|endoftext|>"
    for s in ["", " ", "<|endoftext|>", "a<|endoftext|>b", *("".join(rnd.choice(pool) for _ in range(rnd.randrange(60))) for _ in range(1500))]:
        assert np.frombuffer(encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, s


# --- neighbours


def test_repeated_ids_are_rows_of_their_own(spark):
    v = [(0, [1.0, 0.1]), (0, [0.9, 0.2]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.5, 0.5]), (None, [1.0, 0.1])]
    d = spark.createDataFrame(v, "vec_id long, embedding array<double>").withColumns({"code": F.lit("x"), "row": F.lit("x"), "q": F.lit("x")})
    got = neighbours.nearest(d, d.where("vec_id = 0"), k=3).collect()
    lists = sorted([[r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["score"] is not None]])
    each = collections.Counter((r["query_id"], r["rank"]) for r in got)
    assert set(each.values()) == {2} and len(got) == 6 and lists
    ids = collections.Counter(r["vec_id"] for r in got)
    assert ids == {0: 2, 1: 2, 3: 2}


def test_copies_and_ties(spark):
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(40)] + [(i, [float(i % 7) - 3, 1.0, 0.2]) for i in range(40, 80)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(d, d.where("vec_id % 13 = 0")).toPandas()
    x = np.array([r[1] for r in rows])
    for i in range(0, 80, 13):
        cos = x @ x[i] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[i])
        want = sorted((j for j in range(80) if j != i), key=lambda j: (-round(cos[j], 9), j))[:5]
        own = got[got.query_id == i].sort_values("rank")
        assert own.vec_id.tolist() == want and own["rank"].tolist() == [1, 2, 3, 4, 5]


# --- language model


def test_counts_beyond_four_bytes():
    n = np.array([0, 7, 1 << 32, 1 << 45])
    assert (lm_scoring._take(lm_scoring._put(n)) == n).all() and (lm_scoring._take(lm_scoring._put(n[:2])) == n[:2]).all()
    for bits in (4, 16, 24, 40):
        one, two = lm_scoring.keys(np.array([5, 1 << 63, 77], np.uint64), np.array([0]), bits)
        assert (one >> lm_scoring._shift(bits) < 1 << bits).all() and len({*one.tolist(), *two.tolist()}) == 6


def test_total_beyond_four_bytes():
    k = np.array([10 << 1], np.uint64)
    rows = [(3, c, lm_scoring._pack(k), lm_scoring._put(np.array([3_000_000_000]))) for c in (0, 2, 5)]

    class Group:  # what groupBy(...).applyInPandas would call
        def groupBy(self, _):
            return self

        def applyInPandas(self, run, _):
            return run(pd.DataFrame(rows, columns=["range", "chunk", "keys", "counts"]))

    out = lm_scoring.total_keys(Group()).set_index("chunk")
    assert lm_scoring._take(out.total[0]).tolist() == [9_000_000_000] and lm_scoring._take(out.deleted[5]).tolist() == [3_000_000_000]
    assert np.frombuffer(out.total[-1], "<i8").tolist() == [9_000_000_000, 1, 6_000_000_000, 1]


def brute_model(rows):
    """Counts and mixture by plain loops over (doc_id, text)."""
    end = None
    tok = [(i, [end, *(t or "").encode().lower().split(), end]) for i, t in rows]
    train = [(i, w) for i, w in tok if i is not None and zlib.crc32(str(i).encode()) % 10]
    held = [w for i, w in train if zlib.crc32(f"held{i}".encode()) % 10 == 0]

    def count(texts):
        uni, bi = collections.Counter(), collections.Counter()
        for w in texts:
            uni.update(w[1:])
            bi.update(zip(w, w[1:]))
        return uni, bi

    uni, bi = count(w for _, w in train)
    hu, hb = count(held)
    ku, kb = uni - hu, bi - hb
    n, v = sum(ku.values()), len(ku)
    cases = collections.defaultdict(list)
    for w in held:
        for a, b in zip(w, w[1:]):
            cases[min(int(math.log2(ku[a] + 1)), lm_scoring.BUCKETS - 1)].append((kb[a, b] / max(ku[a], 1), ku[b] / n, 1 / (v + 1)))
    weights = {}
    for bucket, each in cases.items():
        p, w = np.array(each), np.array([0.3, 0.6, 0.1])
        for _ in range(lm_scoring.ROUNDS):
            r = p * w
            w = (r / r.sum(1, keepdims=True)).mean(0)
        weights[bucket] = w
    return tok, uni, bi, weights


def test_mixture_matches_plain_counts(spark, docs, monkeypatch):
    kept = {}
    real = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a: kept.setdefault("w", real(*a)))
    # an outlier id, repeated ids and a null id move nothing to one chunk
    rows = [(int(i), t) for i, t in zip(docs.doc_id, docs.text)] + [(10**15, docs.text[0]), (7, "again and again"), (7, "again and again"), (None, "nobody")]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk_rows=37).toPandas()
    tok, uni, bi, weights = brute_model(rows)
    n, v = sum(uni.values()), len(uni)
    assert (got.train_tokens == n).all() and len(got) == len(rows)
    mine = collections.defaultdict(list)
    for i, w in tok:
        total = 0.0
        for a, b in zip(w, w[1:]):
            m = kept["w"][min(int(math.log2(uni[a] + 1)), lm_scoring.BUCKETS - 1)]
            total += math.log10(m[0] * bi[a, b] / max(uni[a], 1) + m[1] * uni[b] / n + m[2] / (v + 1))
        mine[i].append(total)
    for i, g in got.groupby(got.doc_id.fillna(-1)):
        assert sorted(g.score) == pytest.approx(sorted(mine[None if i == -1 else int(i)]), rel=1e-9)
    # weights come from counts on a grid of ratios, so they are near those of exact ratios
    for bucket, w in weights.items():
        if bucket:
            assert np.abs(kept["w"][bucket] - w).max() < 0.05


def test_chunks_hold_bounded_text(spark):
    d = spark.createDataFrame([(i, "w " * (i * 20)) for i in range(100)], "doc_id long, text string").coalesce(1)
    rows, _ = lm_scoring.prepare(d, size=1000)
    sizes = rows.groupBy(F.floor(F.col("chunk") / 2)).agg(F.sum(F.length("text")).alias("s"), F.count(F.lit(1)).alias("n")).toPandas()
    assert ((sizes.s <= 1000) | (sizes.n == 1)).all() and sizes.n.sum() == 100


# --- near-duplicates


def test_rows_of_one_id(spark):
    d = spark.createDataFrame([(1, "a b c d e f g", "x"), (1, "h i j k l m n", "y"), (2, "a b c d e f g", "z")], "doc_id long, text string, source string")
    a = near_dedup.without_near_duplicates(d).collect()
    b = near_dedup.without_near_duplicates(d.orderBy(F.desc("source"))).collect()
    assert a == b and [r["doc_id"] for r in a] == [1]


def test_many_near_copies_of_several_bases(spark):
    """Rings of copies in which neighbours link and others do not, beside a group of unlike texts that share passages."""
    rng = np.random.RandomState(5)
    rows = []
    for base in range(6):
        words = [f"b{base}_{k}" for k in range(100)]
        for step in range(25):
            words = list(words)
            for k in rng.choice(100, 2, replace=False):
                words[k] = f"n{base}_{step}_{k}"
            rows.append((len(rows), " ".join(words)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(1000 + i, passage + " " + " ".join(f"u{i}_{k}" for k in range(30 + i % 5))) for i in range(80)]
    from test_llm import brute_components

    comp, _ = brute_components(rows, 5)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == comp


# --- pipeline


def test_stages_on_odd_rows(spark, odd, empty):
    import corpus_pipeline as cp

    plain = odd.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    for name, stage in cp.STAGES:
        for d in (plain, empty.withColumn("n_chars", F.lit(0).cast("long"))):
            out = stage(spark, d, SF)
            assert out.count() >= 0 and (name == "packing" or out.columns == d.columns)
    packed = dict(cp.STAGES)["packing"](spark, plain, SF).toPandas()
    assert packed.row_id.nunique() == len(ODD)
    kept = {r["doc_id"] for r in dict(cp.STAGES)["near_duplicates"](spark, plain, SF).collect()}
    assert kept == {None, 1, 2, 3, 4, 6, 7, 8}


def test_tokens_of_odd_texts_are_those_of_the_file():
    from tokenizers import Tokenizer

    encode, whole = packing._encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    texts = ["", "a  b\n c's ’s\t.　é中_ x ", "\x1c a b", "Größe 12ab'll" * 9, " \n" * 30 + "z", " " * 2_000_000 + "a b"]
    for text in texts:
        assert encode(text) == np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
