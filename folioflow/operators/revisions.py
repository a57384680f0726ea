"""Revision diffs, edits, integrity checks and versioned state.

Two revisions are compared by key with outer joins; hashes decide what changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.segmentation import detokenize, token_ids
from folioflow.functions.text import normalize_text, text_sha256, word_count

OPEN_STATES = ["PENDING", "AWAITING_DECISION"]
MIN_WORDS, MIN_CUT, WORDS_PER_CITATION = 40, 10, 12


# --- diff: before and after have doc_id, par_id, text


def paragraph_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """D02"""
    cols = lambda d, s: d.select("doc_id", "par_id", text_sha256(F.col("text")).alias("h" + s), word_count(F.col("text")).alias("n" + s))
    j = cols(before, "1").join(cols(after, "2"), ["doc_id", "par_id"], "full_outer")
    kind = F.when(F.col("h2").isNull(), "PARAGRAPH_REMOVED").when(F.col("h1").isNull(), "PARAGRAPH_ADDED").when(F.col("h1") != F.col("h2"), "PARAGRAPH_TEXT_CHANGED")
    return j.select("doc_id", "par_id", kind.alias("kind"), F.when(kind == "PARAGRAPH_TEXT_CHANGED", F.concat("n1", F.lit(" words -> "), "n2", F.lit(" words"))).alias("detail")).where("kind is not null")


def removed_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are gone."""
    return _compared(before, after, keys).where(F.col("was") & ~F.col("now")).select(*keys)


def _compared(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(``keys``, was, now): each key with the revisions that hold it, by one aggregation; a key with a null is equal to none."""
    side = lambda d, now: d.select(*keys, F.lit(not now).alias("was"), F.lit(now).alias("now"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    both = side(before, False).unionByName(side(after, True)).withColumn("_side", F.when(~known, F.col("now")))
    return both.groupBy(*keys, "_side").agg(F.bool_or("was").alias("was"), F.bool_or("now").alias("now")).drop("_side")


def key_changes(before: DataFrame, after: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Removed and added keys."""
    kind = F.when(~F.col("now"), name + "_REMOVED").when(~F.col("was"), name + "_ADDED")
    return _compared(before, after, keys).select(*keys, kind.alias("kind")).where("kind is not null")


def hash_changes(before: DataFrame, after: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Removed rows and rows whose content hash differs."""
    j = before.select(key, F.sha2(F.col(value).cast("binary"), 256).alias("h1")).join(after.select(key, F.sha2(F.col(value).cast("binary"), 256).alias("h2")), key, "left")
    return j.select(key, F.when(F.col("h2").isNull(), name + "_REMOVED").when(F.col("h1") != F.col("h2"), name + "_CHANGED").alias("kind")).where("kind is not null")


def citation_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows have citation_id, signature, home; one citation may change in two ways."""
    j = before.select("citation_id", F.col("signature").alias("s1"), F.col("home").alias("p1")).join(after.select("citation_id", F.col("signature").alias("s2"), F.col("home").alias("p2")), "citation_id", "full_outer")
    both = F.col("s1").isNotNull() & F.col("s2").isNotNull()
    kinds = F.array(
        F.when(F.col("s1").isNotNull() & (F.col("s2").isNull() | F.col("p2").isNull()), "CITATION_REMOVED"), F.when(both & F.col("p2").isNotNull() & (F.col("s1") != F.col("s2")), "CITATION_ITEM_CHANGED"),
        F.when(both & (F.col("p1") != F.col("p2")), "CITATION_MOVED"), F.when(F.col("s1").isNull(), "CITATION_ADDED"),
    )
    return j.select("citation_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def delta_words(before: DataFrame, after: DataFrame) -> DataFrame:
    """Words of the document and of touched paragraphs, before and after."""
    touched = paragraph_changes(before, after).select("doc_id", "par_id", F.lit(1).alias("_t"))
    side = lambda d, s: d.join(touched, ["doc_id", "par_id"], "left").groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).alias("words_" + s), F.sum(F.when(F.col("_t") == 1, word_count(F.col("text"))).otherwise(0)).alias("touched_" + s))
    return side(before, "before").join(side(after, "after"), "doc_id", "full_outer").na.fill(0)


def delta_summary(changes: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Per document ``n KIND; ...`` sorted by kind, then the words of the paragraphs whose text changed, or that none did, and the kinds.

    ``changes`` has doc_id, par_id (null for other subjects) and kind; before and after hold the paragraphs.
    """
    n = changes.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["kind"]))
    counted = n.groupBy("doc_id").agg(F.array_join(told, "; ").alias("parts"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    touched = changes.where(F.col("kind").isin("PARAGRAPH_TEXT_CHANGED", "PARAGRAPH_ADDED", "PARAGRAPH_REMOVED")).select("doc_id", "par_id").distinct()
    words = lambda d, name: d.join(touched, ["doc_id", "par_id"], "left_semi").groupBy("doc_id").agg(F.sum(word_count(F.col("text"))).cast("long").alias(name))
    scope = touched.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pars")).join(words(before, "a"), "doc_id", "left").join(words(after, "b"), "doc_id", "left").na.fill(0, ["a", "b"])
    prose = F.concat(F.lit(". "), "a", F.lit(" -> "), "b", F.lit(" words in the "), "pars", F.lit(" paragraphs it changed."))
    j = counted.join(scope, "doc_id", "left")
    return j.select("doc_id", F.concat("parts", F.coalesce(prose, F.lit(". No prose changed."))).alias("summary"), "kinds")


def paragraph_diffs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Text and citation ids of a changed or added paragraph before and after, and the ids that it lost and gained."""
    j = after.select("doc_id", "par_id", F.col("text").alias("after_text")).join(before.select("doc_id", "par_id", F.col("text").alias("before_text")), ["doc_id", "par_id"], "left").na.fill("", ["before_text"])
    j = j.where(normalize_text(F.col("before_text")) != normalize_text(F.col("after_text")))
    a, b = token_ids(F.col("before_text")), token_ids(F.col("after_text"))
    joined = lambda x: F.array_join(x, ",")
    return j.select("doc_id", "par_id", "before_text", "after_text", joined(a).alias("before_ids"), joined(b).alias("after_ids"), joined(F.array_except(a, b)).alias("lost"), joined(F.array_except(b, a)).alias("gained"))


def token_multiset_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Words removed and added per paragraph, as multisets."""
    side = lambda d, n: d.select("doc_id", "par_id", normalize_text(F.col("text")).alias("text"), F.lit(n).alias("n"))
    # whole texts are dealt by paragraph, so that their words are counted where they are
    both = side(before, -1).unionByName(side(after, 1)).repartition("doc_id", "par_id")
    # a paragraph without a full key has no counterpart
    alone = F.when(F.col("doc_id").isNull() | F.col("par_id").isNull(), F.col("n")).alias("alone")
    words = both.select("doc_id", "par_id", alone, "n", F.explode(F.split("text", " ")).alias("word"))
    more = words.groupBy("doc_id", "par_id", "alone", "word").agg(F.sum("n").alias("n"))
    g = more.groupBy("doc_id", "par_id").agg(F.sum(F.greatest(F.lit(0), -F.col("n"))).alias("removed"), F.sum(F.greatest(F.lit(0), F.col("n"))).alias("added"))
    return g.where("removed > 0 or added > 0")


# --- edits


def plan_shortening(pars: DataFrame, ratio: Column) -> DataFrame:
    """Pars have words and citations; target words or the reason to skip."""
    r = F.greatest(F.lit(0.05), F.least(F.lit(0.5), ratio))
    target = F.greatest(F.lit(MIN_WORDS), F.bround(F.col("words") * (1 - r)).cast("long"))
    reason = F.when(F.col("words") < MIN_WORDS, "TOO_SHORT").when(F.col("words") < WORDS_PER_CITATION * F.col("citations"), "CITATION_DENSE").when(F.col("words") - target < MIN_CUT, "NOTHING_TO_GAIN")
    return pars.withColumn("reason", reason).withColumn("target", F.when(reason.isNull(), target))


def extractive_shorten(groups: DataFrame, rows: str = "rows") -> DataFrame:
    """Rows is an ordered array<struct<sent_no, words, cited>> beside ``target``; skipped sentences do not count.

    A fold over the ordered sentences: the first and every cited one stay, others while the kept total fits.
    """
    start = F.struct(F.lit(0).cast("long").alias("kept"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        take = (F.size(acc["out"]) == 0) | x["cited"] | (acc["kept"] + x["words"] <= F.col("target"))
        return F.when(take, F.struct((acc["kept"] + x["words"]).alias("kept"), F.array_append(acc["out"], x["sent_no"]).alias("out"))).otherwise(acc)

    return groups.withColumn("f", F.aggregate(rows, start, step)).withColumns({"kept_words": F.col("f.kept"), "kept_sentences": F.col("f.out")}).drop("f", rows)


def shortfall(before: Column, after: Column, target: Column) -> Column:
    """Achieved share of the requested reduction."""
    want = before - target
    return F.when(want <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), (before - after) / want))


def sentence_capacity(citations: Column, most: int = 2) -> Column:
    """E04"""
    return F.greatest(F.lit(0), F.lit(most) - citations)


def select_attachments(groups: DataFrame, rows: str = "rows", most: int = 4) -> DataFrame:
    """Ordered array<struct<candidate, sent_no, room>>: each candidate once, each sentence within its room, ``most`` in all."""
    kind = groups.schema[rows].dataType.simpleString()

    def step(acc: Column, x: Column) -> Column:
        used = F.size(F.filter(acc, lambda y: y["sent_no"] == x["sent_no"]))
        fine = (F.size(acc) < most) & ~F.exists(acc, lambda y: y["candidate"] == x["candidate"]) & (used < x["room"])
        return F.when(fine, F.array_append(acc, x)).otherwise(acc)

    return groups.withColumn(rows, F.aggregate(rows, F.array().cast(kind), step))


def insertable(verdict: Column, complete: Column) -> Column:
    """Null if a candidate may be inserted, else why not."""
    return F.when(~verdict.isin("SUPPORTED", "PARTIALLY_SUPPORTED"), "NOT_SUPPORTED").when(~complete, "INCOMPLETE_METADATA")


def insertion_offset(sentence: Column) -> Column:
    """Place before trailing blanks, closers and terminators."""
    return F.length(F.regexp_replace(sentence, "[ \\t\\n\\x0B\\f\\r.!?\"'”’)\\]}]+$", "")).cast("long")


def adjacent_citation(sentence: Column) -> Column:
    """The token that ends at the insertion place, if any."""
    head = F.substr(sentence, F.lit(1), insertion_offset(sentence).cast("int") + F.when(F.regexp_like(sentence, F.lit(r"\]\][ .!?]*$")), 2).otherwise(0))
    found = F.regexp_extract(head, r"\[\[CITE:(\w+)\]\]\s*$", 1)
    return F.when(found != "", found)


def next_added_ordinal(ids: DataFrame, key: str, id_col: str) -> DataFrame:
    """E11"""
    n = F.regexp_extract(id_col, r"_added_(\d+)$", 1)
    return ids.groupBy(key).agg((F.coalesce(F.max(F.when(n != "", n.cast("long"))), F.lit(0)) + 1).alias("next_ordinal"))


def rehydrate_allowed(c: Column, allowed: Column) -> Column:
    """Tokens outside the allowed ids removed."""
    gaps, ids = F.split(c, r"\[\[CITE:[A-Za-z0-9_]+\]\]", -1), token_ids(c)
    return F.array_join(F.flatten(F.transform(gaps, lambda g, i: F.array(g, F.coalesce(F.when(F.array_contains(allowed, F.get(ids, i)), F.concat(F.lit("[[CITE:"), F.get(ids, i), F.lit("]]"))), F.lit(""))))), "")


# --- verification


def token_audit(before: Column, after: Column) -> dict[str, Column]:
    """Duplicated, invented and dropped ids, and whether the rest changed order."""
    a, b = token_ids(before), token_ids(after)
    kept = F.filter(b, lambda x: F.array_contains(a, x))
    order = F.filter(a, lambda x: F.array_contains(b, x))
    return {
        "duplicated": F.size(b) - F.size(F.array_distinct(b)), "invented": F.array_join(F.array_except(b, a), ","), "dropped": F.array_join(F.array_except(a, b), ","),
        "reordered": F.array_distinct(kept) != F.array_distinct(order), "malformed": F.regexp_count(after, F.lit(r"\[\[CITE:")) - F.size(b),
    }


def prose_immutable(before: Column, after: Column) -> Column:
    """Equal text once tokens and the blanks they leave are gone."""
    bare = lambda c: F.regexp_replace(normalize_text(detokenize(c)), r" ([.,;:!?)\]}])", "$1")
    return bare(before) == bare(after)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def vocabulary_check(df: DataFrame, col: str, words: list[str]) -> DataFrame:
    """Values outside a closed set, with counts."""
    return df.where(~F.col(col).isin(words)).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def warning_id(code: Column, subjects: Column, content_hash: Column) -> Column:
    """V10"""
    return F.concat(F.lit("warn_"), F.substring(F.sha2(F.to_json(F.struct(code.alias("code"), content_hash.alias("hash"), F.array_sort(subjects).alias("subjects"))).cast("binary"), 256), 1, 32))


def numeric_novelty(before: Column, after: Column) -> Column:
    """Numbers of the new text that the old one lacks."""
    n = lambda c: F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.array_except(n(after), n(before))


def acceptance_decision(state: Column, candidate_hash: Column, stored_hash: Column, base: Column, current: Column, blockers: Column, missing: Column) -> Column:
    """The first reason that stops a proposal, else ACCEPT."""
    return (
        F.when(state != "AWAITING_DECISION", "WRONG_STATE").when(candidate_hash.isNull(), "NO_CANDIDATE").when(candidate_hash != stored_hash, "HASH_MISMATCH")
        .when(base != current, "STALE_BASE").when(blockers > 0, "BLOCKED").when(missing > 0, "UNACKNOWLEDGED").otherwise("ACCEPT")
    )


# --- versioned state


def current_revision(revisions: DataFrame) -> DataFrame:
    """H01"""
    return revisions.groupBy("paper_id").agg(F.max("revision_number").alias("revision_number"), F.max_by("revision_id", "revision_number").alias("revision_id"))


def next_revision_number(papers: DataFrame, revisions: DataFrame) -> DataFrame:
    """H02"""
    return papers.select("paper_id").distinct().join(current_revision(revisions), "paper_id", "left").select("paper_id", (F.coalesce("revision_number", F.lit(0)) + 1).alias("next_number"))


def supersede_others(proposals: DataFrame) -> DataFrame:
    """Unsettled proposals of a paper with an accepted one become SUPERSEDED."""
    won = F.max(F.when(F.col("state") == "ACCEPTED", 1).otherwise(0)).over(W.partitionBy("paper_id"))
    return proposals.withColumn("_w", won).withColumn("state", F.when((F.col("_w") == 1) & F.col("state").isin(OPEN_STATES), "SUPERSEDED").otherwise(F.col("state"))).drop("_w")


def stale_proposals(proposals: DataFrame, revisions: DataFrame) -> DataFrame:
    """H04"""
    return proposals.where(F.col("state").isin(OPEN_STATES)).join(current_revision(revisions), "paper_id").where("base_revision <> revision_number").select("proposal_id", "paper_id", "base_revision", "revision_number")


def lineage(revisions: DataFrame) -> DataFrame:
    """Each revision with its parent."""
    return revisions.withColumn("parent_id", F.lag("revision_id").over(W.partitionBy("paper_id").orderBy("revision_number"))).select("paper_id", "revision_number", "revision_id", "parent_id")


def idempotency(requests: DataFrame) -> DataFrame:
    """Requests (seq, scope, key, hash, done) judged against the first of their key; null scopes are equal."""
    w = W.partitionBy("scope", "key").orderBy("seq")
    first = F.first(F.struct("seq", "hash", "done")).over(w)
    d = requests.withColumn("f", first)
    outcome = F.when(F.col("seq") == F.col("f.seq"), "NEW").when(~F.col("hash").eqNullSafe(F.col("f.hash")), "CONFLICT").when(F.col("f.done"), "REPLAY").otherwise("IN_PROGRESS")
    return d.select("seq", outcome.alias("outcome"))


def interrupted(operations: DataFrame, now: Column, older_than: Column) -> DataFrame:
    """Unfinished operations silent for longer than the limit, per kind."""
    return operations.where(F.col("state").isin(OPEN_STATES) & (F.col("updated_at") <= now - older_than)).groupBy("kind").agg(F.count(F.lit(1)).alias("failed"))
