"""Text, identifier and bibliographic helpers as Column functions.

All stay in the JVM but for Unicode forms (:func:`composed`, :func:`fold_name`), which Spark lacks:
there only texts beyond ASCII are handed to Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t\n\x0B\f\r]+"
# Words that carry no weight in a title.
STOPWORDS = ["a", "an", "and", "for", "from", "in", "of", "on", "the", "to", "via", "with"]
TOKEN = r"\[\[CITE:([A-Za-z0-9_]+)\]\]"
# Locator labels as printed after a comma.
LOCATOR_PRINTED = {"page": "p.", "chapter": "chap.", "section": "sec.", "figure": "fig.", "table": "tbl.", "equation": "eq."}


def beyond_ascii(c: Column, fn: Callable[[str], str], otherwise: Column) -> Column:
    """``fn`` of texts that hold other characters than ASCII, ``otherwise`` of the rest; those reach Python as nulls only."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore")

    return F.coalesce(run(F.when(c.rlike("[^\\x00-\\x7F]"), c)), otherwise)


def composed(c: Column, form: str = "NFC") -> Column:
    """Unicode normal form; plain ASCII is its own."""
    return beyond_ascii(c, lambda x: unicodedata.normalize(form, x), c)


def compose(df: DataFrame, col: str, form: str = "NFC") -> DataFrame:
    """Unicode-normalise ``col``."""
    return df.withColumn(col, composed(F.col(col), form))


def normalize_text(c: Column) -> Column:
    """White space collapsed to single blanks; for texts that may be decomposed, pass :func:`composed`."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def text_sha256(c: Column) -> Column:
    """Hash of the composed text with single blanks: neither reflow nor the Unicode form changes it."""
    return F.sha2(normalize_text(composed(c)).cast("binary"), 256)


def canonical_sha256(fields: dict[str, Column], texts: tuple[str, ...] = ()) -> Column:
    """Hash of compact JSON with sorted keys (single level); the fields named in ``texts`` are composed."""
    return F.sha2(F.to_json(F.struct(*[(composed(fields[k]) if k in texts else fields[k]).alias(k) for k in sorted(fields)])).cast("binary"), 256)


def word_count(c: Column) -> Column:
    t = normalize_text(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def paragraph_text(runs: Column) -> Column:
    """Text runs joined, without the blank that a removed citation leaves before a mark."""
    return F.regexp_replace(F.array_join(runs, ""), r"[ \t\n\x0B\f\r]+([.,;:!?)\]}])", "$1")


def fold_name(c: Column) -> Column:
    """Case- and accent-insensitive form of a name: NFKD without combining marks, case-folded, trimmed."""

    def fold(x: str) -> str:
        return "".join(ch for ch in unicodedata.normalize("NFKD", x) if not unicodedata.combining(ch)).casefold().strip()

    return beyond_ascii(c, fold, F.lower(F.btrim(c, F.lit(" \t\n\x0B\f\r"))))


def title_tokens(c: Column) -> Column:
    """Distinct title words without stop words.  Decomposition splits a word at its accents: the base letter stays."""
    low = F.lower(F.coalesce(c, F.lit("")))
    folded = F.replace(low, F.lit("ß"), F.lit("ss"))
    # a decomposed accented letter is its base letter followed by a mark, which ends the token
    for base, letters in {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõö", "u": "ùúûü", "y": "ýÿ"}.items():
        folded = F.regexp_replace(folded, f"[{letters}]", base + "́")
    # a title without a character beyond ASCII has as many bytes as characters and nothing to decompose
    plain = F.when(F.octet_length(low) == F.char_length(low), low).otherwise(folded)
    return F.array_except(F.split(plain, "[^a-z0-9]+"), F.array(*map(F.lit, ["", *STOPWORDS])))


def jaccard(a: Column, b: Column) -> Column:
    # one expression without branches, so that each side is computed once
    both, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return both / F.greatest(union, F.lit(1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def normalise_doi(c: Column) -> Column:
    d = F.trim(c)
    d = F.regexp_replace(d, r"^(?i)https?://(dx\.)?doi\.org/", "")
    d = F.regexp_replace(d, r"^(?i)doi:\s*", "")
    d = F.lower(F.regexp_replace(d, r"\.+$", ""))
    return _let(d, lambda d: F.when(d.startswith("10."), d))


def doi_in(c: Column) -> Column:
    # a text without one gives an empty match, which is no DOI
    return normalise_doi(F.regexp_extract(c, r"\b(10\.\d{4,9}/[^\s\"<>]+)", 1))


def arxiv_in(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?i)arxiv[:\s/]*(\d{4}\.\d{4,5}(v\d+)?)", 1)
    return _let(found, lambda found: F.when(found != "", found))


def normalise_arxiv(c: Column) -> Column:
    a = F.regexp_replace(F.regexp_replace(F.trim(c), r"^(?i)arxiv:", ""), r"v\d+$", "")
    return _let(a, lambda a: F.when(a.rlike(r"^(\d{4}\.\d{4,5}|[a-z-]+(\.[A-Z]{2})?/\d{7})$"), a))


def arxiv_from_doi(c: Column) -> Column:
    head = "10.48550/arxiv."
    return F.when(F.lower(c).startswith(head), normalise_arxiv(F.substr(c, F.lit(len(head) + 1))))


def arxiv_from_urls(urls: Column) -> Column:
    ids = F.transform(urls, lambda u: F.regexp_extract(u, r"arxiv\.org/abs/([^?#]+)", 1))
    return F.element_at(F.concat(F.filter(F.transform(F.filter(ids, lambda x: x != ""), normalise_arxiv), lambda x: x.isNotNull()), F.array(F.lit(None).cast("string"))), 1)


def filter_safe(c: Column) -> Column:
    return normalize_text(F.regexp_replace(c, r"[,:|!+()?*]", " "))


def extract_year(c: Column) -> Column:
    y = F.regexp_extract(c, r"(1[6-9]\d{2}|20\d{2})", 1)
    return F.when(y != "", y).cast("long")


def normalise_marker(c: Column) -> Column:
    return F.lower(F.regexp_replace(normalize_text(c), r"[.,;]+$", ""))


def https_link(url: Column, doi: Column) -> Column:
    return F.when(url.startswith("https://"), url).when(doi.isNotNull() & (doi != ""), F.concat(F.lit("https://doi.org/"), doi))


def author_names(authors: Column) -> Column:
    """Printable names of array<struct<family, given, literal>>, blanks dropped."""
    one = lambda a: F.trim(F.coalesce(F.nullif(a["literal"], F.lit("")), F.concat_ws(" ", a["given"], a["family"])))
    return F.filter(F.transform(authors, one), lambda x: x != "")


def last_names(authors: Column) -> Column:
    one = lambda a: F.lower(F.coalesce(F.nullif(a["family"], F.lit("")), F.element_at(F.split(normalize_text(F.coalesce(a["literal"], F.lit(""))), " "), -1)))
    return F.array_distinct(F.filter(F.transform(authors, one), lambda x: x != ""))


def surname_keys(family: Column) -> Column:
    """The whole family name and each of its words, folded."""
    f = fold_name(family)
    return F.array_distinct(F.filter(F.concat(F.array(f), F.split(f, SPACE)), lambda x: x != ""))


def candidate_summary(title: Column, authors: Column, year: Column, venue: Column, abstract: Column) -> Column:
    names = F.array_join(F.slice(authors, 1, 3), ", ")
    head = F.concat(title, F.lit(" ("), names, F.lit(", "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))
    return F.concat_ws("\n", head, F.nullif(venue, F.lit("")), F.substring(F.nullif(abstract, F.lit("")), 1, 600))


def locator_suffix(locator: Column, label: Column, suffix: Column) -> Column:
    names = F.create_map(*[x for k, v in LOCATOR_PRINTED.items() for x in (F.lit(k), F.lit(v))])
    place = F.when(locator.isNotNull(), F.concat_ws(" ", F.element_at(names, label), locator))
    whole = F.concat_ws(", ", place, F.nullif(suffix, F.lit("")))
    return F.when(whole == "", "").otherwise(F.concat(F.lit(", "), whole))


def describe_reference(title: Column, raw: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.substring(raw, 1, 160))


def page_range(first: Column, last: Column, text: Column) -> Column:
    return F.coalesce(F.when(first.isNotNull() & last.isNotNull(), F.concat(first, F.lit("-"), last)), first, text)
