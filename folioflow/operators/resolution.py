"""Reference normalisation and resolution against bibliographic records.

The ladder feeds each rung only what the rung before left open; the last rung is an
exact similarity join under the subsets that titles have in common, so no title meets every other title.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.functions.text import arxiv_in, doi_in, normalise_arxiv, normalise_doi, title_tokens
from folioflow.sources.scratch import written

PERCENT = 72
PROVIDERS = ["OPENALEX", "SEMANTIC_SCHOLAR"]
MAX_CANDIDATES = 10
SUBSETS = 64  # subsets under which a token set is kept at most
DIRECT_PAIRS = 2_500  # pairs of a key that are compared without an index
HELD_ROWS = 500  # rows of a paper that each of its candidates is compared with one by one
FOLD_ROWS = 2_000  # open works of a group that one task scans


def provider_rank(c: Column) -> Column:
    return F.when(c == PROVIDERS[0], 0).otherwise(1)


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) == "", F.lit(True))


def normalization_status(title: Column, author: Column, year: Column) -> Column:
    """R01"""
    has_t, has_a = ~blank(title), ~blank(author)
    return F.when(has_t & has_a & year.isNotNull(), "COMPLETE").when(has_t | has_a, "PARTIAL").otherwise("RAW_ONLY")


def complete_for_insertion(title: Column, author: Column, year: Column) -> Column:
    """R02"""
    return ~blank(title) & ~blank(author) & year.isNotNull()


def csl_type(container_level: Column, has_article_title: Column, meeting: Column) -> Column:
    """Conference before journal before chapter before book."""
    return F.when(meeting, "paper-conference").when(container_level == "j", "article-journal").when((container_level == "m") & has_article_title, "chapter").when(container_level == "m", "book").otherwise("document")


def title_container(article: Column, journal: Column, book: Column) -> Column:
    """struct<title, container>; without an article title the container is promoted."""
    container = F.coalesce(journal, book)
    return F.when(article.isNotNull(), F.struct(article.alias("title"), container.alias("container"))).otherwise(F.struct(container.alias("title"), F.lit(None).cast("string").alias("container")))


def csl_projection(works: DataFrame) -> DataFrame:
    """Works as CSL items in JSON; empty fields are left out, one without a title is a document that keeps its raw text under ``custom``.

    works have provider, external_id, work_type, title, raw_text, authors (names), year, venue, doi, url, volume, issue, pages and arxiv_id.
    """
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    names = F.when(F.size("authors") > 0, F.transform("authors", lambda a: F.struct(a.alias("literal"))))
    issued = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts")))
    known = full("title").isNotNull()
    custom = F.struct(F.when(known, F.col("provider")).alias("provider"), F.when(known, F.col("external_id")).alias("external_id"), F.when(known, full("arxiv_id")).alias("arxiv_id"), F.when(~known, full("raw_text")).alias("raw_text"))
    doc = F.struct(
        F.col("external_id").alias("id"), F.coalesce(full("work_type"), F.lit("document")).alias("type"), full("title").alias("title"), names.alias("author"), issued.alias("issued"),
        full("venue").alias("container-title"), full("doi").alias("DOI"), full("url").alias("URL"), full("volume").alias("volume"), full("issue").alias("issue"), full("pages").alias("page"), custom.alias("custom"),
    )
    bare = F.struct(F.col("external_id").alias("id"), F.lit("document").alias("type"), custom.alias("custom"))
    return works.select("provider", "external_id", F.when(known, F.to_json(doc)).otherwise(F.to_json(bare)).alias("csl"))


def token_sets(df: DataFrame, name: str, *more: str) -> DataFrame:
    """(``name``, ``more``, h, tokens) of rows with id and tokens, without empty token sets; h names the set."""
    return df.where(F.size("tokens") > 0).select(F.col("id").alias(name), *more, F.array_sort("tokens").alias("tokens")).withColumn("h", F.xxhash64("tokens"))


def subset_tokens(percent: int) -> int:
    """The most tokens a set may have for at most ``SUBSETS`` of its subsets to count at ``percent``."""
    n = 0
    while n < 16 and sum(comb(n + 1, c) for c in range(_least(n + 1, percent), n + 2)) <= SUBSETS:
        n += 1
    return n


def _least(n: int, percent: int) -> int:
    """The fewest common tokens with which a set of ``n`` can be similar to any other."""
    return max(1, -(-n * percent // 100))


def _enough(percent: int) -> Callable[[int, int], bool]:
    return lambda n, c: c >= _least(n, percent)


def subsets(d: DataFrame, most: int, counts: Callable[[int, int], bool], *more: str, rest: str | None = None) -> DataFrame:
    """(``more``, n, c, key) of sets (tokens, sorted) of at most ``most`` tokens: a row for each of their subsets of ``c`` tokens for which ``counts(n, c)``.

    ``rest`` names a column for the tokens that the subset leaves out: two sets have just the subset in common if their rests share nothing.
    """
    masks = [[m for m in range(1, 1 << n) if counts(n, m.bit_count())] for n in range(most + 1)]
    of_size = F.get(F.array(*[F.array(*map(F.lit, m)).cast("array<int>") for m in masks]), F.size("tokens"))
    part = lambda m, bit=1: F.filter("tokens", lambda _x, i: F.getbit(m, i) == bit)
    both = lambda m: F.struct(part(m).alias("part"), *([part(m, 0).alias("rest")] if rest else []))
    each = d.where(F.size("tokens") <= most).select(*more, F.size("tokens").alias("n"), F.explode(F.transform(of_size, both)).alias("s"))
    return each.select(*more, "n", F.size("s.part").alias("c"), F.xxhash64("s.part").alias("key"), *([F.col("s.rest").alias(rest)] if rest else []))


def _similar(percent: int, na: str = "na", nb: str = "nb") -> Column:
    return 100 * F.col("c") >= percent * (F.col(na) + F.col(nb) - F.col("c"))


def similar_sets(left: DataFrame, right: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(ha, hb, similarity) of distinct token sets (h, tokens) with Jaccard of at least ``percent``.

    Exact: short sets meet under the subset that they have in common, where no other pair is made; pairs
    with a long one in :func:`_similar_long`.
    """
    most = subset_tokens(percent)
    a = subsets(left, most, _enough(percent), "h", "tokens").select(F.col("h").alias("ha"), F.col("n").alias("na"), F.col("tokens").alias("ta"), "c", "key")
    b = subsets(right, most, _enough(percent), "h", "tokens").select(F.col("h").alias("hb"), F.col("n").alias("nb"), F.col("tokens").alias("tb"), "c", "key")
    # a pair meets under each subset of what it has in common; it is made under the whole of it
    short = a.join(b, ["c", "key"]).where(_similar(percent)).where(F.size(F.array_intersect("ta", "tb")) == F.col("c"))
    short = short.select("ha", "hb", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity"))
    long = _similar_long(left, right, most, percent)
    return short if long is None else short.unionByName(long)


def similar_links(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(ha, hb) of token sets (h, tokens): enough of the similar pairs to connect whatever all of them connect.

    All that holds a subset and is similar to anything there is similar to the shortest set that holds it, so each subset makes a star.
    """
    most = subset_tokens(percent)
    each = written(subsets(sets, most, _enough(percent), "h"), "set-subsets")
    first = each.groupBy("c", "key").agg(F.min(F.struct("n", "h")).alias("m"), F.count(F.lit(1)).alias("_k")).where("_k > 1").select("c", "key", F.col("m.h").alias("ha"), F.col("m.n").alias("na"))
    star = each.join(first, ["c", "key"]).where((F.col("h") != F.col("ha")) & _similar(percent, "na", "n")).select("ha", F.col("h").alias("hb")).distinct()
    long = _similar_long(sets, sets, most, percent)
    return star if long is None else star.unionByName(long.where("ha < hb").select("ha", "hb"))


def _similar_long(left: DataFrame, right: DataFrame, most: int, percent: int) -> DataFrame | None:
    """(ha, hb, similarity) of similar sets one of which has more than ``most`` tokens; none if there is no such set.

    Two sets that similar share a token among the rarest ``n - ceil(p n) + 1`` of either.
    """
    if left.unionByName(right).where(F.size("tokens") > most).isEmpty():
        return None
    left, right = (d.where(100 * F.size("tokens") >= percent * (most + 1)) for d in (left, right))
    df = left.unionByName(right).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def prefix(d: DataFrame, h: str, n: str) -> DataFrame:
        ranked = d.select("h", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(df, "token").groupBy("h", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
        keep = F.least(F.col("n"), F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1)
        return ranked.select(F.col("h").alias(h), F.col("n").alias(n), F.explode(F.transform(F.slice("o", F.lit(1), keep), lambda x: x["token"])).alias("token"))

    sizes = (F.greatest("na", "nb") > most) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    hits = prefix(left, "ha", "na").join(prefix(right, "hb", "nb"), "token").where(sizes).select("ha", "hb").distinct()
    both = hits.join(left.select(F.col("h").alias("ha"), F.col("tokens").alias("ta")), "ha").join(right.select(F.col("h").alias("hb"), F.col("tokens").alias("tb")), "hb")
    both = both.withColumn("_c", F.size(F.array_intersect("ta", "tb"))).withColumn("_u", F.size("ta") + F.size("tb") - F.col("_c"))
    return both.where(100 * F.col("_c") >= percent * F.col("_u")).select("ha", "hb", (F.col("_c") / F.col("_u")).alias("similarity"))


def similar_within(left: DataFrame, right: DataFrame | None, key: str, percent: int = PERCENT) -> DataFrame:
    """(``key``, ta, tb) of token sets of one ``key`` with Jaccard of at least ``percent``; inputs have ``key`` and tokens.

    Nothing is compared across keys.  Keys of at most ``DIRECT_PAIRS`` pairs compare them all; the sets of
    a larger one meet through its own index of rare tokens (:func:`_index_hits`).  Without ``right`` the sets
    of ``left`` meet each other, each pair once.
    """
    other = int(right is not None)
    sides = left.select(key, F.lit(0).alias("side"), F.array_sort("tokens").alias("tokens"))
    if right is not None:
        sides = sides.unionByName(right.select(key, F.lit(1).alias("side"), F.array_sort("tokens").alias("tokens")))
    sides = written(sides.where(F.size("tokens") > 0).withColumn("h", F.xxhash64("tokens")), "local-sets")
    count = lambda side: F.count_if(F.col("side") == side)
    large = written(sides.groupBy(key).agg((count(0) * count(other)).alias("pairs")).where(F.col("pairs") > DIRECT_PAIRS).select(key), "local-large")
    parts = [sides]
    if not large.isEmpty():
        parts = [sides.join(large, key, "left_anti"), _index_hits(sides.join(large, key, "left_semi").distinct(), other, key, percent)]

    def side(d: DataFrame, no: int, name: str) -> DataFrame:
        return d.where(F.col("side") == no).select(key, F.col("h").alias(f"h{name}"), F.col("tokens").alias(f"t{name}"))

    common = F.size(F.array_intersect("ta", "tb"))
    alike = (100 * F.least(F.size("ta"), F.size("tb")) >= percent * F.greatest(F.size("ta"), F.size("tb"))) & (100 * common >= percent * (F.size("ta") + F.size("tb") - common))
    if not other:
        alike = (F.col("ha") < F.col("hb")) & alike
    found = side(parts[0], 0, "a").join(side(parts[0], other, "b"), key).where(alike)
    for hits in parts[1:]:
        many = hits.join(side(sides, 0, "a").distinct(), [key, "ha"]).join(side(sides, other, "b").distinct(), [key, "hb"]).where(alike)
        found = found.unionByName(many)
    return found.select(key, "ta", "tb").distinct()


def _index_hits(sides: DataFrame, other: int, key: str, percent: int) -> DataFrame:
    """(``key``, ha, hb) of sets that share one of their rarest tokens among the key's own, which all similar ones do."""
    here = W.partitionBy(key, "token")
    each = sides.select(key, "side", "h", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    both = F.min("side").over(here) < F.max("side").over(here) if other else F.count(F.lit(1)).over(here) > 1
    each = each.withColumn("df", F.count(F.lit(1)).over(here)).withColumn("both", both)
    keep = F.least(F.col("n"), F.col("n") - F.floor((F.col("n") * percent + 99) / 100).cast("int") + 1)
    first = each.groupBy(key, "side", "h", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token", "both"))).alias("o"))
    rare = F.filter(F.slice("o", F.lit(1), keep), lambda x: x["both"])
    index = written(first.select(key, "side", "h", "n", F.explode(F.transform(rare, lambda x: x["token"])).alias("token")), "local-index")
    a = index.where("side = 0").select(key, "token", F.col("h").alias("ha"), F.col("n").alias("na"))
    b = index.where(F.col("side") == other).select(key, "token", F.col("h").alias("hb"), F.col("n").alias("nb"))
    sizes = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return a.join(b, [key, "token"]).where(sizes & (F.lit(bool(other)) | (F.col("ha") < F.col("hb")))).select(key, "ha", "hb").distinct()


def distinct_sets(df: DataFrame) -> DataFrame:
    """(h, tokens) once each."""
    return df.groupBy("h").agg(F.first("tokens").alias("tokens"))


def similar_pairs(left: DataFrame, right: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, similarity) of all pairs with Jaccard of ``tokens`` at least ``percent``; inputs have id and tokens.

    Equal token sets are compared once, so repeated titles do not multiply the work.
    """
    l, r = written(token_sets(left, "a"), "titles-a"), written(token_sets(right, "b"), "titles-b")
    good = similar_sets(distinct_sets(l), distinct_sets(r), percent)
    # the side with the pairs' ids is joined first, so that the pairs of all ``a`` are made last and not moved
    return good.join(r.select("b", F.col("h").alias("hb")), "hb").join(l.select("a", F.col("h").alias("ha")), "ha").select("a", "b", "similarity")


def work_id() -> Column:
    return F.concat("provider", F.lit(":"), "external_id")


def _identifiers() -> list[Column]:
    return [F.coalesce(normalise_doi(F.col("doi")), doi_in(F.col("raw_text"))).alias("k_doi"), normalise_arxiv(arxiv_in(F.col("raw_text"))).alias("k_arxiv")]


def resolve_by_identifier(refs: DataFrame, works: DataFrame) -> DataFrame:
    """DOI (of the field, else of the text), then arXiv; the first provider wins."""
    return _by_identifier(refs.select("reference_id", *_identifiers()), works)


def _by_identifier(k: DataFrame, works: DataFrame) -> DataFrame:
    keys = F.array(F.struct(F.lit(0).alias("rung"), F.concat(F.lit("doi:"), "k_doi").alias("key")), F.struct(F.lit(1).alias("rung"), F.concat(F.lit("arxiv:"), "k_arxiv").alias("key")))
    a = k.select("reference_id", F.explode(keys).alias("x")).select("reference_id", "x.rung", "x.key").where("key is not null")
    both = F.array(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("arxiv:"), F.lower("arxiv_id")))
    b = works.select("provider", "external_id", F.explode(both).alias("key")).where("key is not null").groupBy("key").agg(F.min(F.struct(provider_rank(F.col("provider")).alias("p"), F.col("external_id"), F.col("provider"))).alias("w"))
    best = a.join(b, "key").groupBy("reference_id").agg(F.min(F.struct("rung", "w")).alias("m"))
    return best.select("reference_id", F.when(F.col("m.rung") == 0, "DOI").otherwise("ARXIV").alias("method"), F.lit("CERTAIN").alias("confidence"), F.col("m.w.provider").alias("provider"), F.col("m.w.external_id").alias("external_id"))


def unresolved(refs: DataFrame, exact: DataFrame) -> DataFrame:
    """References that no identifier resolved, written with what the title rungs read, as these read them several times."""
    return written(refs.select("reference_id", "title", "year", "family").join(exact.select("reference_id"), "reference_id", "left_anti"), "unresolved")


def _ref_titles(refs: DataFrame) -> DataFrame:
    """(title, h, tokens) of the distinct titles of references, written."""
    titles = refs.where(~blank(F.col("title"))).select("title").distinct()
    return written(token_sets(titles.select(F.col("title").alias("id"), title_tokens(F.col("title")).alias("tokens")), "title"), "titles-refs")


LISTED = 1_000  # members of a list that stands for a token set


def _lists(d: DataFrame, key: str, col: str) -> DataFrame:
    """(``key``, list of ``col``) with at most some ``LISTED`` members a list; a key with more has several."""
    many = d.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LISTED)
    part = F.coalesce(F.pmod(F.xxhash64(col), F.ceil(F.col("_n") / LISTED)), F.lit(0))
    return d.join(many, key, "left").groupBy(key, part.alias("_part")).agg(F.collect_list(F.struct(col)).alias(f"{col}s")).drop("_part")


def title_candidates(refs: DataFrame, works: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(reference_id, work_id, similarity), every work whose title is similar to that of a reference that no identifier resolves.

    The pairs grow with the square of the works that share words, so those of short titles are neither moved nor
    written.  References and works of one token set travel as lists, under those of its subsets alone that make a pair, and meet there last.
    """
    each, of = kinds(refs, "reference_id")
    named = of.withColumnRenamed("kind", "reference_id")
    open_ = named.join(_by_identifier(named, works).select("reference_id"), "reference_id", "left_anti").withColumnRenamed("reference_id", "kind")
    l = written(token_sets(open_.where(~blank(F.col("title"))).select(F.col("kind").alias("id"), title_tokens(F.col("title")).alias("tokens")), "kind"), "titles-refs")
    r = written(token_sets(works.select(work_id().alias("id"), title_tokens(F.col("title")).alias("tokens")), "work_id"), "titles-works")
    left, right, most = distinct_sets(l), distinct_sets(r), subset_tokens(percent)
    side = lambda d, x: subsets(d, most, _enough(percent), "h", rest=f"t{x}").withColumnsRenamed({"h": f"h{x}", "n": f"n{x}"})
    a, b = written(side(left, "a"), "subsets-refs"), written(side(right, "b"), "subsets-works")
    other = lambda d: d.withColumnsRenamed({"c": "_c", "key": "_key"})
    # a pair meets under each subset of what it has in common; it is made under the whole of it
    met = (F.col("c") == F.col("_c")) & (F.col("key") == F.col("_key")) & _similar(percent) & ~F.arrays_overlap("ta", "tb")
    refs_of = _lists(each.join(l.select("kind", F.col("h").alias("ha")), "kind").select("ha", "reference_id"), "ha", "reference_id")
    works_of = _lists(r.select(F.col("h").alias("hb"), "work_id"), "hb", "work_id")
    mine = a.join(other(b), met, "left_semi").join(refs_of, "ha")
    theirs = other(b.join(other(a), met, "left_semi").join(works_of, "hb"))
    short = mine.join(theirs, met).select("reference_ids", "work_ids", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity"))
    long = _similar_long(left, right, most, percent)
    if long is not None:
        short = short.unionByName(long.join(works_of, "hb").join(refs_of, "ha").select("reference_ids", "work_ids", "similarity"))
    found = short.select("reference_ids", F.explode("work_ids").alias("w"), "similarity").select(F.explode("reference_ids").alias("r"), "w", "similarity")
    return found.select("r.reference_id", "w.work_id", "similarity")


def best_title_match(refs: DataFrame, works: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each reference's most similar work; ties go to the first provider, then the smaller id.

    Of works with one token set only the first can win, and references with one title have one
    winner.  Each subset of a work's short title keeps the first work that holds it for each length, so a title
    meets a few works at each of its own subsets, however many are similar to it.  Long titles meet one by one.
    """
    l = _ref_titles(refs)
    order = F.struct(provider_rank(F.col("provider")).alias("p"), "external_id", "provider", "year", "family")
    w = works.select(work_id().alias("id"), title_tokens(F.col("title")).alias("tokens"), order.alias("w"))
    r = written(token_sets(w, "id", "w").groupBy("h").agg(F.first("tokens").alias("tokens"), F.min("w").alias("w")), "titles-works")
    sets, most = distinct_sets(l), subset_tokens(percent)
    index = subsets(r, most, _enough(percent), "w").groupBy("c", "key", F.col("n").alias("nb")).agg(F.min("w").alias("w"))
    good = subsets(sets, most, _enough(percent), "h").join(index, ["c", "key"]).where(_similar(percent, "n"))
    # a work that has more in common than the subset is met again with a higher similarity
    good = good.select(F.col("h").alias("ha"), (F.col("c") / (F.col("n") + F.col("nb") - F.col("c"))).alias("similarity"), "w")
    long = _similar_long(sets, r.select("h", "tokens"), most, percent)
    if long is not None:
        good = good.unionByName(long.join(r.select(F.col("h").alias("hb"), "w"), "hb").select("ha", "similarity", "w"))
    best = good.groupBy("ha").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "w", "similarity")).alias("m"))
    named = l.join(best, F.col("h") == F.col("ha")).select("title", "m.w.provider", "m.w.external_id", "m.similarity", "m.w.year", "m.w.family")
    return refs.select("reference_id", "title").join(named, "title").drop("title")


def kinds(refs: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """(``keep``, kind) of references, and (kind, title, k_doi, k_arxiv) of their kinds; both written.

    Only its title and identifiers decide what a reference resolves to, and a kind is one combination of them, so
    each is resolved once.  References without any have no kind.
    """
    parts = ["_title", "k_doi", "k_arxiv"]
    # the hash repeats its parts, so the patterns are matched before it
    named = written(refs.select(*keep, F.when(~blank(F.col("title")), F.col("title")).alias("_title"), *_identifiers()), "ref-kinds")
    kind = F.xxhash64(*[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in parts])
    each = named.withColumn("kind", F.when(F.coalesce(*parts).isNotNull(), kind))
    once = each.where("kind is not null").select("kind", F.col("_title").alias("title"), "k_doi", "k_arxiv").distinct()
    return each.drop(*parts), written(once, "kinds")


def _resolved_kinds(of: DataFrame, works: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Of kinds of references: those that an identifier resolves, written, and the most similar works of the others."""
    named = of.withColumnRenamed("kind", "reference_id")
    exact = written(_by_identifier(named, works), "kinds-exact")
    best = best_title_match(named.join(exact.select("reference_id"), "reference_id", "left_anti"), works, percent)
    return exact.withColumnRenamed("reference_id", "kind"), best.withColumnRenamed("reference_id", "kind")


def title_matches(refs: DataFrame, works: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The most similar work of each reference that no identifier resolves, with the reference's r_year and r_family."""
    each, of = kinds(refs, "reference_id", F.col("year").alias("r_year"), F.col("family").alias("r_family"))
    return each.join(_resolved_kinds(of, works, percent)[1], "kind").drop("kind")


def _corroborated(year: str, family: str) -> Column:
    return F.coalesce((F.col(year) == F.col("r_year")) | (F.lower(family) == F.lower("r_family")), F.lit(False))


def corroborate(matches: DataFrame) -> DataFrame:
    """An equal year or a shared surname makes a title match probable; matches are those of :func:`title_matches`."""
    ok = _corroborated("year", "family")
    return matches.select("reference_id", F.when(ok, "TITLE_AUTHOR_YEAR").otherwise("TITLE_ONLY").alias("method"), F.when(ok, "PROBABLE").otherwise("UNCERTAIN").alias("confidence"), "provider", "external_id")


def resolution_ladder(refs: DataFrame, works: DataFrame, *keep: str, record: tuple[str, ...] = ()) -> DataFrame:
    """Every reference, with its columns ``keep``, and the method and confidence that resolved it, or UNRESOLVED.

    ``record`` names columns of the record that it resolved to, which follow as ``record_<name>``; they are joined to
    the kinds and not to the references.
    """
    own = ["paper_id", "reference_id", *keep]
    each, of = kinds(refs, *own, F.col("year").alias("r_year"), F.col("family").alias("r_family"))
    exact, best = _resolved_kinds(of, works)
    best = best.select("kind", "provider", "external_id", F.col("year").alias("w_year"), F.col("family").alias("w_family"))
    found = _with_record(exact.unionByName(best, allowMissingColumns=True), works, record)
    told = [f"record_{c}" for c in record]
    j = each.where("kind is not null").join(found, "kind", "left").unionByName(each.where("kind is null"), allowMissingColumns=True)
    ok, titled = _corroborated("w_year", "w_family"), F.col("provider").isNotNull()
    method = F.coalesce("method", F.when(titled & ok, "TITLE_AUTHOR_YEAR").when(titled, "TITLE_ONLY").otherwise("UNRESOLVED"))
    confidence = F.coalesce("confidence", F.when(titled & ok, "PROBABLE").when(titled, "UNCERTAIN").otherwise("NONE"))
    return j.select("paper_id", "reference_id", method.alias("method"), confidence.alias("confidence"), "provider", "external_id", *keep, *told)


def _with_record(found: DataFrame, works: DataFrame, record: tuple[str, ...]) -> DataFrame:
    """``found`` with columns of the record (provider, external_id) as ``record_<name>``."""
    if not record:
        return found
    return found.join(works.select("provider", "external_id", *[F.col(c).alias(f"record_{c}") for c in record]), ["provider", "external_id"], "left")


def resolved_records(refs: DataFrame, works: DataFrame, *keep: str, record: tuple[str, ...] = ()) -> DataFrame:
    """(``keep``, title, provider, external_id, ``record``) of references and the record that each resolves to on the ladder.

    The title is that of the kind, null if blank, so references are dealt to their kinds with ``keep`` alone.
    """
    each, of = kinds(refs, *keep)
    found = reduce(DataFrame.unionByName, [d.select("kind", "provider", "external_id") for d in _resolved_kinds(of, works)])
    named = of.select("kind", "title").join(_with_record(found, works, record), "kind", "left")
    return each.join(named, "kind", "left").drop("kind")


def backfill_abstract(works: DataFrame) -> DataFrame:
    """A missing abstract taken from the other provider's record of the same DOI."""
    other = works.where(~blank(F.col("abstract")) & F.col("doi").isNotNull()).groupBy(F.lower("doi").alias("k")).agg(F.min(F.struct(provider_rank(F.col("provider")).alias("p"), F.col("external_id"), F.col("abstract"))).alias("o"))
    j = works.join(other, F.lower(works["doi"]) == F.col("k"), "left")
    return j.select("provider", "external_id", F.coalesce(F.nullif(F.trim("abstract"), F.lit("")), F.col("o.abstract")).alias("abstract"))


def upsert_source_records(rows: DataFrame, order: str) -> DataFrame:
    """One record per paper, provider and id: the first, its abstract filled by the first there is."""
    return rows.groupBy("paper_id", "provider", "external_id").agg(F.min_by("title", order).alias("title"), F.min_by("abstract", F.when(F.col("abstract").isNotNull(), F.col(order))).alias("abstract"))


def identity_mismatch(rows: DataFrame) -> DataFrame:
    """Answers whose identifier is not the one asked for."""
    return rows.where(F.coalesce(normalise_doi(F.col("asked_doi")) != F.lower("doi"), F.lit(False)) | F.coalesce(normalise_arxiv(F.col("asked_arxiv")) != F.lower("arxiv_id"), F.lit(False)))


def conflict_keys(cand: DataFrame, key: str, percent: int = PERCENT) -> DataFrame:
    """(``key``, rank, provider, external_id, keys): two works of a group conflict if and only if they share an entry of ``keys``.

    Entries are identity keys, the title's token set, and one for each similar other set of the group.
    """
    c = written(cand.select(key, "rank", "provider", "external_id", "doi", "arxiv_id", F.array_sort(title_tokens(F.col("title"))).alias("t")), "dedupe-works")
    pairs = written(similar_within(c.select(key, F.col("t").alias("tokens")), None, key, percent), "dedupe-pairs")
    name = F.concat(F.lit("pair:"), F.xxhash64("ta").cast("string"), F.lit(":"), F.xxhash64("tb").cast("string"))
    ends = pairs.select(key, F.explode(F.array("ta", "tb")).alias("t"), name.alias("pair")).groupBy(key, "t").agg(F.collect_list("pair").alias("pairs"))
    own = F.array(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("arxiv:"), F.lower("arxiv_id")), F.lower(work_id()), F.when(F.size("t") > 0, F.concat(F.lit("set:"), F.array_join("t", " "))))
    keys = F.concat(F.filter(own, lambda x: x.isNotNull()), F.coalesce("pairs", F.array().cast("array<string>")))
    return c.join(ends, [key, "t"], "left").select(key, "rank", "provider", "external_id", keys.alias("keys"))


def _fold(key: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The works that a scan by rank accepts, of each of several groups."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        taken, kept, last = set(), [], None
        rows = rows.sort_values([key, "rank", "provider", "external_id"])
        groups = rows.groupby(key, dropna=False).ngroup()
        for i, (group, keys) in enumerate(zip(groups, rows["keys"])):
            if group != last:
                taken, last = set(), group
            if taken.isdisjoint(keys):
                taken.update(keys)
                kept.append(i)
        return rows.iloc[kept].drop(columns="keys")

    return fold


def dedupe_greedy(cand: DataFrame, key: str, percent: int = PERCENT, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Works of a group in order of ``rank``, each dropped if an accepted one shares a key or a similar title.

    The fate of a row depends on which rows stayed.  Groups of up to ``fold_rows`` open works are scanned
    as they are.  Longer ones go through rounds: a work that is the first open one under each of its keys
    is accepted, and all that share a key with it are dropped, until few enough are open.
    """
    me = [key, "rank", "provider", "external_id"]
    kind = T.StructType([cand.schema[c] for c in me])
    open_, done = written(conflict_keys(cand, key, percent), "dedupe-open"), []
    # a call of the scan takes some ``fold_rows`` works of whole groups; rows without a key are a group of their own
    calls = max(1, open_.count() // fold_rows)
    dealt = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.hash(key), F.lit(calls)))
    while True:
        long = written(open_.groupBy(key).count().where(F.col("count") > fold_rows).select(key), "dedupe-long")
        if long.isEmpty():
            break
        done.append(open_.join(long, key, "left_anti"))
        open_ = open_.join(long, key, "left_semi")
        each = open_.select(key, F.struct("rank", "provider", "external_id").alias("r"), F.explode("keys").alias("k"))
        first = each.groupBy(key, "k").agg(F.min("r").alias("first"))
        wins = each.join(first, [key, "k"]).groupBy(key, "r").agg(F.bool_and(F.col("r") == F.col("first")).alias("wins")).where("wins")
        accepted = written(open_.join(wins.select(key, "r.*"), me, "left_semi"), "dedupe-accepted")
        done.append(accepted)
        gone = accepted.select(key, F.explode("keys").alias("k")).distinct()
        hit = each.join(gone, [key, "k"], "left_semi").select(key, "r.*").distinct()
        open_ = written(open_.join(hit, me, "left_anti"), "dedupe-open")
    parts = [d.select(*me) if i % 2 else d.groupBy(dealt.alias("_call")).applyInPandas(_fold(key), kind) for i, d in enumerate([*done, open_])]
    return reduce(DataFrame.unionByName, parts)


def candidate_set(cand: DataFrame, key: str, most: int = MAX_CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """The union of all providers' works of a group, without repeats (R14) and without incomplete ones.

    Returns the first ``most``, numbered ``cand_000`` onwards, and the count of incomplete ones per group.
    """
    full = dedupe_greedy(cand, key).join(cand, [key, "rank", "provider", "external_id"])
    ok = complete_for_insertion(F.col("title"), F.col("family"), F.col("year"))
    n = F.row_number().over(W.partitionBy(key).orderBy("rank", "provider", "external_id"))
    first = full.where(ok).withColumn("n", n).where(F.col("n") <= most).select(key, F.format_string("cand_%03d", F.col("n") - 1).alias("candidate_id"), "provider", "external_id")
    return first, full.groupBy(key).agg(F.count_if(~ok).alias("incomplete"))


def bibliography_keys(refs: DataFrame, resolutions: DataFrame, works: DataFrame) -> DataFrame:
    """Identity keys of everything a paper already cites: its entries' DOIs, and ids and DOIs of the records they link to."""
    own = refs.select("paper_id", F.concat(F.lit("doi:"), normalise_doi(F.col("doi"))).alias("key"))
    linked = resolutions.where("external_id is not null").select("paper_id", "provider", "external_id")
    linked = linked.join(works.select("provider", "external_id", F.concat(F.lit("doi:"), F.lower("doi")).alias("doi")), ["provider", "external_id"], "left")
    theirs = linked.select("paper_id", F.explode(F.array(F.lower(work_id()), "doi")).alias("key"))
    return own.unionByName(theirs).where("key is not null").distinct()


def _own_key() -> Column:
    return F.concat(F.lit("doi:"), normalise_doi(F.col("doi")))


def _resolved_keys() -> Column:
    theirs = [F.lower(work_id()), F.concat(F.lit("doi:"), F.lower("record_doi"))]
    return F.array(_own_key(), *[F.when(F.col("external_id").isNotNull(), c) for c in theirs])


def resolved_keys(resolved: DataFrame) -> DataFrame:
    """R17, :func:`bibliography_keys` of references (paper_id, doi) whose ladder kept ``record_doi``: nothing is joined to them again."""
    return resolved.select("paper_id", F.explode(_resolved_keys()).alias("key")).where("key is not null").distinct()


def resolved_titles(papers: DataFrame, resolved: DataFrame) -> DataFrame:
    """R17, :func:`bibliography_titles` of references (paper_id, title) whose ladder kept ``record_title``."""
    theirs = F.when(F.col("external_id").isNotNull(), F.col("record_title"))
    held = resolved.select("paper_id", F.explode(F.array("title", theirs)).alias("title"))
    return papers.select("paper_id", "title").unionByName(held).where(~blank(F.col("title"))).distinct()


def bibliography_titles(papers: DataFrame, refs: DataFrame, resolutions: DataFrame, works: DataFrame) -> DataFrame:
    """Titles a paper already holds: its own, its entries' and those of the records they link to."""
    linked = resolutions.where("external_id is not null").select("paper_id", "provider", "external_id").join(works.select("provider", "external_id", "title"), ["provider", "external_id"])
    parts = [d.select("paper_id", "title") for d in (papers, refs, linked)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where(~blank(F.col("title"))).distinct()


def holdings(papers: DataFrame, refs: DataFrame) -> DataFrame:
    """(paper_id, keys, title): what papers hold by their own titles and their references (paper_id, doi, title), a row each."""
    own = refs.select("paper_id", F.array(_own_key()).alias("keys"), "title")
    return own.unionByName(papers.select("paper_id", F.lit(None).cast("array<string>").alias("keys"), "title"))


def resolved_holdings(papers: DataFrame, resolved: DataFrame) -> DataFrame:
    """(paper_id, keys, title), :func:`holdings` of references whose ladder kept ``record_doi`` and ``record_title``."""
    none = F.lit(None).cast("array<string>").alias("keys")
    own = resolved.select("paper_id", _resolved_keys().alias("keys"), "title")
    other = resolved.where(F.col("external_id").isNotNull() & ~F.col("record_title").eqNullSafe(F.col("title")))
    return own.unionByName(other.select("paper_id", none, F.col("record_title").alias("title"))).unionByName(papers.select("paper_id", none, "title"))


def not_in_bibliography(cand: DataFrame, keys: DataFrame, titles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidates (paper_id, provider, external_id, doi, arxiv_id, title) that the paper does not hold yet.

    Neither by an identity key nor by a similar title.
    """
    held = keys.select("paper_id", F.array("key").alias("keys"), F.lit(None).cast("string").alias("title"))
    return not_held(cand, held.unionByName(titles.select("paper_id", F.lit(None).cast("array<string>").alias("keys"), "title")), percent)


def not_held(cand: DataFrame, held: DataFrame, percent: int = PERCENT, held_rows: int = HELD_ROWS) -> DataFrame:
    """The rows of ``cand``, as :func:`not_in_bibliography` has them, that match no row (paper_id, keys, title) of ``held``.

    Both sides are dealt by paper once, as they are; what they are compared by is made after that, and the result
    stays dealt by paper.  A paper that holds more than ``held_rows`` rows meets its candidates by keys and by an index instead.
    """
    forms = F.array(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("arxiv:"), F.lower("arxiv_id")), F.lower(work_id()))
    held = held.where("paper_id is not null")
    large = written(held.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > held_rows).select("paper_id"), "held-large")
    many = not large.isEmpty()
    a, b = (d.join(large, "paper_id", "left_anti") if many else d for d in (cand, held))
    a = a.repartition("paper_id").select("*", forms.alias("_forms"), title_tokens(F.col("title")).alias("_t"))
    b = b.repartition("paper_id").select(F.col("paper_id").alias("_paper"), "keys", title_tokens(F.col("title")).alias("_h"))
    na, nb, c = F.size("_t"), F.size("_h"), F.size(F.array_intersect("_t", "_h"))
    alike = (F.least(na, nb) > 0) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * c >= percent * (na + nb))
    fresh = a.join(b, (F.col("paper_id") == F.col("_paper")) & (F.arrays_overlap("_forms", "keys") | alike), "left_anti").drop("_forms", "_t")
    return fresh.unionByName(_not_held_many(cand.join(large, "paper_id", "left_semi"), held.join(large, "paper_id", "left_semi"), forms, percent)) if many else fresh


def _not_held_many(cand: DataFrame, held: DataFrame, forms: Column, percent: int) -> DataFrame:
    """:func:`not_held` of papers of any size."""
    me = ["paper_id", "provider", "external_id"]
    cand, held = written(cand, "offered"), written(held, "held")
    keys = held.select("paper_id", F.explode("keys").alias("key"))
    by_key = cand.select(*me, F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("key")).join(keys, ["paper_id", "key"], "left_semi").select(*me).distinct()
    rest = cand.join(by_key, me, "left_anti").withColumn("_t", F.array_sort(title_tokens(F.col("title"))))
    titles = held.where(~blank(F.col("title"))).select("paper_id", "title").distinct()
    close = similar_within(rest.select("paper_id", F.col("_t").alias("tokens")), titles.select("paper_id", title_tokens(F.col("title")).alias("tokens")), "paper_id", percent)
    return rest.join(close.select("paper_id", F.col("ta").alias("_t")), ["paper_id", "_t"], "left_anti").drop("_t")


def persist_resolutions(rows: DataFrame) -> DataFrame:
    """The latest run's resolution per reference; its record only if resolved."""
    last = rows.groupBy("paper_id", "reference_id").agg(F.max(F.struct("run_id", "method", "confidence", "external_id")).alias("m")).select("paper_id", "reference_id", "m.*")
    return last.withColumn("external_id", F.when(F.col("confidence").isin("CERTAIN", "PROBABLE"), F.col("external_id")))


def record_lookup_fallback(refs: DataFrame, records: DataFrame) -> DataFrame:
    """By record id, else DOI, else external id, within the paper."""
    by = lambda k, alias: records.where(F.col(k).isNotNull()).groupBy("paper_id", F.col(k).alias(alias)).agg(F.min("record_id").alias("hit_" + k))
    j = refs.join(by("record_id", "want_record"), ["paper_id", "want_record"], "left").join(by("doi", "want_doi"), ["paper_id", "want_doi"], "left").join(by("external_id", "want_external"), ["paper_id", "want_external"], "left")
    return j.select("paper_id", "reference_id", F.coalesce("hit_record_id", "hit_doi", "hit_external_id").alias("record_id"))


def display_resolution(stored: DataFrame, latest: DataFrame) -> DataFrame:
    """The latest resolution overrides the stored one as a whole row."""
    l = latest.select("reference_id", F.struct("method", "confidence").alias("_l"))
    j = stored.join(l, "reference_id", "left")
    return j.select("reference_id", F.coalesce("_l.method", "method").alias("method"), F.when(F.col("_l").isNotNull(), F.col("_l.confidence")).otherwise(F.col("confidence")).alias("confidence"))


def identifier_pivot(rows: DataFrame) -> DataFrame:
    """Typed identifier rows (reference_id, pos, kind, value) as DOI, arXiv and URL; the last typed one wins."""
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("value")), F.when(F.col("kind") == k, F.col("pos")))
    web = F.max_by(F.when(F.col("value").startswith("http"), F.col("value")), F.when(F.col("value").startswith("http") & (F.col("kind") == "URL"), F.col("pos")))
    g = rows.groupBy("reference_id").agg(normalise_doi(last("DOI")).alias("doi"), normalise_arxiv(last("ARXIV")).alias("arxiv"), web.alias("url"), F.max(F.when(F.col("kind") == "TARGET", F.col("value"))).alias("_t"))
    return g.select("reference_id", "doi", "arxiv", F.coalesce("url", "_t").alias("url"))


def merge_ranked(lists: DataFrame, most: int = 4) -> DataFrame:
    """Ranked lists (paper_id, claim_no, rank, key) of the first ``most`` claims; first of each key, renumbered."""
    first = lists.where(F.col("claim_no") < most).groupBy("paper_id", "key").agg(F.min(F.struct("claim_no", "rank")).alias("f"))
    n = F.row_number().over(W.partitionBy("paper_id").orderBy("f", "key"))
    return first.select("paper_id", F.format_string("cand_%03d", n - 1).alias("candidate_id"), "key")
