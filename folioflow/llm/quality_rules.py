"""Quality rules by distribution divergence (DataFrame functions only).

Base rules count words, symbols, repeated lines and repeated 5-word windows.  The
divergence rule compares a document's character-class histogram and its histogram
of common words with references of its language by Jensen-Shannon distance, each
only for documents long enough for a histogram.  References are summed over all
documents of the language; a language without a common-word list, or null, uses
the character reference alone.

Handling: null text has no words and fails the base rules; blank text likewise;
repeated rows are rows of their own; an empty table gives an empty result; extra columns
pass through, whatever their names, except that those with the names of the result's own
columns (``ADDED``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, words

# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "at", "are", "this", "from"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a", "par", "plus", "pas", "au"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
SLOTS = 20
LETTERS = "abcdefghijklmnopqrst"
TABLE = 214
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30
MIN_CHARS = 200
MIN_WORDS = 100
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_hist", "word_hist"]
ADDED = [*FEATURES, "char_distance", "word_distance", "base_failed", "kept"]


def _slots(lang: str) -> dict[int, str]:
    """Slot of each common word in a table of ``TABLE``, checked to be free of clashes."""
    from xxhash import xxh64_intdigest

    at: dict[int, str] = {}
    for w in COMMON_WORDS[lang]:
        h = xxh64_intdigest(w.encode(), seed=42)
        h = h - 2**64 if h >= 2**63 else h
        at.setdefault(h % TABLE, w)
    if len(at) != len(COMMON_WORDS[lang]):
        raise ValueError(f"common words of {lang} clash in a table of {TABLE} slots")
    return at


def base_features(docs: DataFrame) -> DataFrame:
    """Add the base counts and both histograms to (row, text, lang); everything stays within the row, nothing is shuffled."""
    d = docs.select("row", "lang", F.coalesce("text", F.lit("")).alias("_t")).withColumn("_w", words(F.col("_t")))
    d = d.withColumn("n_words", F.size("_w").cast("long")).withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.trim(x, F.lit(" \t\u000b\f\r")) != "")
    d = d.withColumn("_lines", lines)
    window = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*[F.get(F.col("_h"), i + k) for k in range(5)]))
    d = d.withColumn("_win", F.when(F.col("n_words") >= 6, window))
    # positions are sorted only in documents in which some window occurs again
    again = F.size("_win") > F.size(F.array_distinct("_win"))
    d = d.withColumn("_sorted", F.when(again, F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = F.filter("_sorted", lambda x, i: (x["h"] == F.get(F.col("_sorted"), i - 1)["h"]) | (x["h"] == F.get(F.col("_sorted"), i + 1)["h"]))
    d = d.withColumn("_pos", F.sort_array(F.transform(same, lambda x: x["i"])))
    steps = F.transform("_pos", lambda x, i: F.coalesce(F.least(F.get(F.col("_pos"), i + 1) - x, F.lit(5)), F.lit(5)))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")

    def without(pattern: str) -> Column:
        return (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")

    n_chars = F.length("_t").cast("long")
    d = d.withColumns({
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": repeated,
        "_lower": without("[a-z]+"), "_upper": without("[A-Z]+"), "_digit": without("[0-9]+"), "_letter": without(r"[\p{L}&&[^a-zA-Z]]+"), "_chars": n_chars,
    })
    d = d.withColumn("_space", F.col("_chars") - F.col("word_chars"))
    rest = F.col("_chars") - F.col("_space") - F.col("_lower") - F.col("_upper") - F.col("_digit") - F.col("_letter")
    d = d.withColumn("char_hist", F.array("_lower", "_upper", "_digit", "_letter", "_space", "n_symbols", rest - F.col("n_symbols")))
    # one table of slots per language: a word's hash is compared once, with the listed word of its slot
    table, names = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<string>")
    for lang, common in COMMON_WORDS.items():
        at = _slots(lang)
        hashes = F.array(*[F.xxhash64(F.lit(at[k])) if k in at else F.lit(None).cast("bigint") for k in range(TABLE)])
        table = F.when(F.col("lang") == lang, hashes).otherwise(table)
        letters = {w: LETTERS[i] for i, w in enumerate(common)}
        names = F.when(F.col("lang") == lang, F.array(*[F.lit(letters[at[k]] if k in at else None).cast("string") for k in range(TABLE)])).otherwise(names)
    d = d.withColumns({"_table": table, "_names": names})
    slot = lambda x: F.pmod(x, F.lit(TABLE)).cast("int")
    listed = F.filter("_h", lambda x: F.get(F.col("_table"), slot(x)) == x)
    d = d.withColumn("_found", F.array_join(F.transform(listed, lambda x: F.get(F.col("_names"), slot(x))), ""))
    counts = [(F.length("_found") - F.length(F.replace(F.col("_found"), F.lit(LETTERS[k]), F.lit("")))).cast("long") for k in range(SLOTS)]
    d = d.withColumn("_counts", F.when(F.col("_table").isNotNull(), F.array(*counts)))
    d = d.withColumn("word_hist", F.concat("_counts", F.array(F.col("n_words") - F.aggregate("_counts", F.lit(0).cast("long"), lambda a, x: a + x))))
    return d.select("row", "lang", *FEATURES)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two count arrays of one length; null where either is null or empty."""
    sp = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    sq = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
    pn, qn = F.transform(p, lambda x: x / sp), F.transform(q, lambda x: x / sq)

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    total = F.aggregate(F.zip_with(pn, qn, lambda a, b: term(a, b) + term(b, a)), F.lit(0.0), lambda a, x: a + x)
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), total / 2)))


def language_references(features: DataFrame) -> DataFrame:
    """One row per language: sums of both histograms over all its documents."""
    n_chars = 7
    sums = [F.sum(F.get(F.col("char_hist"), i)).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.get(F.col("word_hist"), i)).alias(f"w{i}") for i in range(SLOTS + 1)]
    r = features.groupBy(F.col("lang").alias("ref_lang")).agg(*sums)
    return r.select("ref_lang", F.array(*[f"c{i}" for i in range(n_chars)]).alias("ref_chars"), F.when(F.col("w0").isNotNull(), F.array(*[f"w{i}" for i in range(SLOTS + 1)])).alias("ref_words"))


def apply_rules(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, keep: list[str] | None = None) -> DataFrame:
    """Features, distances and verdict of every row; ``keep`` names the input columns to carry (default all)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    row = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(None).alias("none"))
    f = base_features(docs.select(row.alias("row"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")))
    f = cut(f, "quality-features")
    refs = cut(language_references(f), "quality-references")
    out = f.join(broadcast_if_small(refs, refs.count()), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    chars = F.aggregate("char_hist", F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumn("char_distance", F.when(chars >= min_chars, js_distance(F.col("char_hist"), F.col("ref_chars"))))
    out = out.withColumn("word_distance", F.when(F.col("n_words") >= min_words, js_distance(F.col("word_hist"), F.col("ref_words"))))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    far = (F.coalesce(F.col("char_distance"), F.lit(0.0)) > max_char) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word)
    return out.withColumn("kept", ~F.col("base_failed") & ~far).select(*([F.col("row").getField(c).alias(c) for c in keep]), *ADDED)


def op3_distribution_divergence(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = apply_rules(docs, keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


QUERIES = {"op3_distribution_divergence": op3_distribution_divergence}


def _jsd_sql(p: str, q: str) -> str:
    t = "case when a > 0 then a * log2(2 * a / (a + b)) else 0.0 end"
    u = "case when b > 0 then b * log2(2 * b / (a + b)) else 0.0 end"
    return f"(select sqrt(greatest(0.0, sum({t} + {u}) / 2)) from (select unnest(list_transform({p}, lambda x: x / list_sum({p})::double)) as a, unnest(list_transform({q}, lambda x: x / list_sum({q})::double)) as b))"


_LISTS = "case lang " + " ".join(f"when '{k}' then {v!r}" for k, v in COMMON_WORDS.items()) + " end"
ORACLE = {
    "op3_distribution_divergence": f"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
   list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines, {_LISTS} as common from documents),
win as (select rid, i, array_to_string(w[i:i + 4], ' ') as k from (select rid, w, unnest(range(1, len(w) - 3)) as i from d)),
dup as (select rid, i, count(*) over (partition by rid, k) as n from win),
rep as (select rid, count(distinct p) as n_rep from (select rid, unnest([i, i + 1, i + 2, i + 3, i + 4]) as p from dup where n > 1) group by rid),
f as (select d.rid, doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
   (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(n_rep, 0)::bigint as n_repeat_words, length(t) as n_chars,
   length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) as lo, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as up, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) as dg,
   length(regexp_replace(t, '[a-zA-Z]', '', 'g')) - length(regexp_replace(t, '\\pL', '', 'g')) as lt,
   case when common is not null then list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) end as wc from d left join rep on d.rid = rep.rid),
g as (select *, [lo, up, dg, lt, n_chars - word_chars, n_symbols, word_chars - lo - up - dg - lt - n_symbols] as ch, case when wc is not null then list_append(wc, n_words - list_sum(wc)::bigint) end as wh from f),
cr as (select lang, list(s order by j) as rc from (select lang, j, sum(v) as s from (select lang, unnest(ch) as v, unnest(range(1, 8)) as j from g) group by all) group by lang),
wr as (select lang, list(s order by j) as rw from (select lang, j, sum(v) as s from (select lang, unnest(wh) as v, unnest(range(1, {SLOTS + 2})) as j from g where wh is not null) group by all) group by lang),
h as (select g.*, case when n_chars >= {MIN_CHARS} then {_jsd_sql("ch", "rc")} end as char_distance, case when n_words >= {MIN_WORDS} and wh is not null then {_jsd_sql("wh", "rw")} end as word_distance,
   n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from g left join cr on g.lang is not distinct from cr.lang left join wr on g.lang is not distinct from wr.lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(char_distance, 0) <= {MAX_CHAR_DISTANCE} and coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} as kept,
  round(char_distance, 6) as char_distance, round(word_distance, 6) as word_distance from h""",
}
