"""Periods counted by pattern, against the guard of each pair of words, and one shuffled row a text."""

import itertools
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from folioflow.functions import segmentation as seg

from test_candidate_lists import moved

ENDS = ["Dr.", "x.y.dr.", "(Mr.", "p.", "P.", "é.", "(fig.", "No.", "Eqs.", "cf.", "e.g.", "x.e.g.", "(i.e.", "et", "al.", "end.", "a..", ".", "...", "7.", "U.S.", "vol.,", "p.5", "İ.", "dr ."]
STARTS = ["Next", "next", "5", "(5)", "[5]", "-", ".", "é", "Ünder", "٣", "“q”", "𝐀b", "ǅ"]
BLANKS = [" ", "\n", "\t ", "\x0b", "\f", " \r\n", " ", " ", "  "]


def texts():
    rnd = random.Random(9)
    pairs = [f"{a}{w}{b}" for a, w, b in itertools.product(ENDS, BLANKS[:2], STARTS)]
    return [*pairs, *["".join(rnd.choice(ENDS + STARTS) + rnd.choice(BLANKS) for _ in range(12)) for _ in range(200)], "", " ", None, "a."]


def test_counts_are_those_of_each_period(spark):
    rows = [(i // 2, x) for i, x in enumerate(texts())]  # two texts share a key
    words = [(k, a, b) for k, x in rows for w in [[v for v in re.split(r"[ \t\n\x0b\f\r]+", x or "") if v]] for a, b in zip(w, w[1:]) if a.endswith(".")]
    pairs = spark.createDataFrame([(k, a[:-1], b) for k, a, b in words], "k int, a string, b string")
    # a word that ends in U+2028 before its period is no title, though "$" would match before it
    told = pairs.select("k", F.when(F.col("a").endswith(" "), "NONE").otherwise(seg.abbreviation_guard(F.col("a"), F.col("b"))).alias("g"))
    want = Counter((r["k"], r["g"]) for r in told.collect())
    got = seg.guarded_periods(spark.createDataFrame(rows, "k int, text string"), ["k"]).collect()
    assert {(r["k"], r["guard"]): r["periods"] for r in got} == dict(want) and len(got) == len(want)


def test_a_text_is_one_shuffled_row(spark):
    d = spark.createDataFrame([(i, "See Dr. No, p. 5 and fig. 3, cf. this. End") for i in range(500)], "k int, text string")
    n = seg.guarded_periods(d, ["k"])
    assert len(n.collect()) == 2500
    assert moved(n._jdf.queryExecution().executedPlan()) == 500
