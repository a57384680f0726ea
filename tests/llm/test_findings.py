"""Whole jobs on inputs that the operators once cut short."""

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F

from folioflow.llm import lm_scoring, toxicity


def _texts(n, seed, planted=()):
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(n):
        w = [b"w%d" % k for k in rng.randint(0, 60, 40)]
        for k, p in zip(rng.choice(40, len(planted), replace=False), planted):
            w[k:k] = p
        out.append(w)
    return out


def test_toxic_words_survive_a_quotation_and_phrases_count():
    toxic = _texts(200, 1, [(b"scoundrel",), (b"leave", b"town")])
    ordinary = _texts(400, 2, [(b"leave",), (b"town",)])
    ordinary[0][5:5] = [b"scoundrel"]
    ordinary[1][5:5] = [b"scoundrels"]
    plain, other = toxicity.train(toxic, ordinary)
    added = other[len(plain) :]
    assert b"scoundrel" in added and b"leave town" in added
    assert b"leave " not in toxicity.toxic_units(toxic, ordinary)


def test_chunks_are_bounded_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "CHUNK_DOCS", 10)
    ids = [*range(60), 10**12, *[None] * 40, *[7] * 40]
    df = spark.createDataFrame([(i, f"some words {k % 9} and {'more' if k < 100 else 'the same'}") for k, i in enumerate(ids)], "doc_id long, text string")
    d, _ = lm_scoring.prepare(df)
    assert d.groupBy("chunk").count().agg(F.max("count")).first()[0] <= 10
    got = lm_scoring.score(df).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(ids)
    tokens = sum(6 + (k >= 100) for k, i in enumerate(ids) if i is not None and zlib.crc32(str(i).encode()) % 10)
    assert {r["train_tokens"] for r in got} == {tokens}
