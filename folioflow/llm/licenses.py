"""Licence scan: identifier tags, notice phrases and licence expressions.

An Aho-Corasick automaton over the lower-cased words of a text finds notice phrases and
identifier tags in one walk.  A tag is followed by a licence expression; it is read from the raw
text behind the tag up to the end of its line and put into postfix order by a shunting yard
(``with`` binds closer than ``and``, ``and`` closer than ``or``).  The postfix form is evaluated
to the restriction the licences ask for: of ``or`` the lesser, of ``and`` the greater, and an
exception after ``with`` takes a step off a copyleft licence.  An expression that breaks
off or does not add up is read as far as it goes, and its licences all count.

``score`` is the greatest restriction among a text's notices and expressions: 0 without any,
0.2 permissive, 0.5 weak and 0.8 strong copyleft, 0.9 unknown, 1 restricted use.

Handling: null and blank texts have no words and no places; every whole text is read, whatever
its length; repeated rows and rows with a null id are scanned one by one; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# fixed values: phrases, in words, and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "the unlicense": "unlicense",
    "public domain": "public-domain",
    "cc0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "all rights reserved": "all-rights-reserved",
}
TAGS = ["spdx license identifier", "license expression", "license", "licence"]
# fixed values: restriction by the beginning of an identifier, the longest that fits
PERMISSIVE, WEAK, STRONG, UNKNOWN, RESTRICTED = 0.2, 0.5, 0.8, 0.9, 1.0
RESTRICTION = {
    "0bsd": PERMISSIVE, "afl": PERMISSIVE, "apache": PERMISSIVE, "artistic": PERMISSIVE, "blueoak": PERMISSIVE, "bsd": PERMISSIVE, "bsl": PERMISSIVE, "cc-by": PERMISSIVE, "cc0": PERMISSIVE, "isc": PERMISSIVE,
    "mit": PERMISSIVE, "ncsa": PERMISSIVE, "postgresql": PERMISSIVE, "psf": PERMISSIVE, "public-domain": PERMISSIVE, "python": PERMISSIVE, "unicode": PERMISSIVE, "unlicense": PERMISSIVE, "wtfpl": PERMISSIVE,
    "x11": PERMISSIVE, "zlib": PERMISSIVE, "cddl": WEAK, "epl": WEAK, "lgpl": WEAK, "mpl": WEAK, "ms-pl": WEAK, "agpl": STRONG, "cc-by-sa": STRONG, "eupl": STRONG, "gfdl": STRONG, "gpl": STRONG, "osl": STRONG,
    "sspl": RESTRICTED, "busl": RESTRICTED, "cc-by-nc": RESTRICTED, "cc-by-nd": RESTRICTED, "all-rights-reserved": RESTRICTED, "proprietary": RESTRICTED,
}

WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Bytes of a text to bytes of its words: lower case, blanks for whatever is in no word.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TOKEN = re.compile(rb"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
BEHIND_TAG = re.compile(rb"[\"'`]?[ \t]*[:=][ \t]*[\"'`]?")
BINDS = {"or": 1, "and": 2, "with": 3}
EXCEPTED = {STRONG: WEAK, WEAK: PERMISSIVE}  # what an exception leaves of a restriction


@cache
def automaton() -> ahocorasick.Automaton:
    """Phrases between blanks; values are (words, base label, label, is a tag)."""
    out, kinds = ahocorasick.Automaton(), {}
    for phrase, label in NOTICES.items():
        kinds[phrase] = (len(phrase.split()), None, label, False)
    for phrase, label in BASE.items():
        kinds[phrase] = (len(phrase.split()), label, label, False)
    for phrase in TAGS:
        kinds[phrase] = (len(phrase.split()), None, None, True)
    for phrase, kind in kinds.items():
        out.add_word(f" {phrase} ", kind)
    out.make_automaton()
    return out


def tokens(text: bytes, at: int) -> Iterator[tuple[str, int]]:
    """The tokens from ``at`` on, lower-cased, and their ends, up to the first character that belongs to none; they end with their line."""
    while m := TOKEN.match(text, at):
        at = m.end()
        yield (m[1] or m[2]).decode().lower().rstrip(".:-"), at


def postfix(found: Iterable[tuple[str, int]]) -> tuple[list[str], bool, int]:
    """Shunting yard: postfix form of the longest expression at the beginning, whether it is whole, and its end."""
    out, waiting, operand, whole, last = [], [], False, True, 0  # operand: whether the last token ended one
    for t, end in found:
        if t in BINDS:
            if not operand:
                whole = False
                break
            while waiting and waiting[-1] != "(" and BINDS[waiting[-1]] >= BINDS[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand = False
        elif t == "(":
            if operand:
                break
            waiting.append(t)
        elif t == ")":
            if not operand or "(" not in waiting:
                whole = whole and operand
                break
            while (x := waiting.pop()) != "(":
                out.append(x)
        else:
            if operand:
                break
            out.append(t)
            operand = True
        last = end
    whole = whole and operand and "(" not in waiting
    return out + [x for x in reversed(waiting) if x != "("], whole, last


@lru_cache(maxsize=10_000)
def restriction(identifier: str) -> float | None:
    """Of the longest listed beginning of an identifier that no letter follows; None without one."""
    fits = [k for k in RESTRICTION if identifier.startswith(k) and not identifier[len(k) : len(k) + 1].isalpha()]
    return RESTRICTION[max(fits, key=len)] if fits else None


def asked(identifier: str) -> float:
    found = restriction(identifier)
    return UNKNOWN if found is None else found


def evaluate(form: list[str], whole: bool) -> tuple[float, set[str]]:
    """(restriction, licences) of a postfix form; without ``whole`` all its licences count."""
    names = {t for i, t in enumerate(form) if t not in BINDS and form[i + 1 : i + 2] != ["with"]}
    if not whole:
        return max(map(asked, names), default=0.0), names
    stack: list[float] = []
    for t in form:
        if t == "with":
            stack.pop()
            stack.append(EXCEPTED.get(stack[-1], stack[-1]))
            del stack[-2]
        elif t in BINDS:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if t == "or" else max(a, b))
        else:
            stack.append(asked(t))
    return stack[0], names


def expression(text: bytes, end: int, named: bool) -> tuple[float, set[str], int]:
    """(restriction, licences, end) of the expression behind a tag that ends at ``end``; behind a plain ``license`` it must begin with a listed licence."""
    m = BEHIND_TAG.match(text, end)
    if not m or not named and restriction(next((t for t, _ in tokens(text, m.end()) if t != "("), "")) is None:
        return 0.0, set(), 0
    form, whole, last = postfix(tokens(text, m.end()))
    return *evaluate(form, whole), last


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text in UTF-8."""
    words = text.translate(WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, labels, score = set(), set(), 0.0
    places: list[int] = []
    ends, at, before, read = [], 0, 0, 0  # read: words up to the end of the last expression, which says more than the names in it
    for end, (size, own, label, tag) in automaton().iter(line):
        before += line.count(" ", at, end)  # the words that have ended
        at = end
        if own:
            base.add(own)
            places.append(before - size)
        if label:
            labels.add(label)
            score = score if before <= read else max(score, asked(label))
        if tag:
            ends = ends or [m.end() for m in WORD.finditer(text.translate(WORD_BYTES))]
            level, names, last = expression(text, ends[before - 1], size > 1)
            labels |= names
            score, read = max(score, level), max(read, bisect_right(ends, last))
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence statements of every whole text: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    names = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(*x) for x in names)])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            found = [scan(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op12_license_expressions(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op12_license_expressions": op12_license_expressions}
ORACLE: dict[str, str] = {}
