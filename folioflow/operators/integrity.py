"""Integrity checks, export preflight, rebuilt revisions and components of equal works."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.segmentation import token_ids
from folioflow.functions.text import normalize_text, text_sha256, title_tokens
from folioflow.operators.resolution import complete_for_insertion, similar_links, token_sets, work_id
from folioflow.operators.review import severity_worst
from folioflow.operators.revisions import removed_keys, warning_id
from folioflow.sources.scratch import written

FILTER_BITS = 16  # slots of a filter for each key
#: Verdicts of a citation that could not be checked.
UNVERIFIABLE = ["UNVERIFIABLE", "SOURCE_UNRESOLVED", "SOURCE_IDENTITY_UNCERTAIN", "EVIDENCE_UNAVAILABLE"]


def components(edges: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable over edges (a, b), by label passing and jumping."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("id")).agg(F.min("l").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = written(step.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        labels = step.select("id", "label")
        if step.where("label < old").isEmpty():
            return labels.withColumnRenamed("label", "component")


def dedupe_works_components(works: DataFrame) -> DataFrame:
    """Works that share an identity or a similar title, transitively, under their smallest id."""
    w = works.select(work_id().alias("id"), "title", F.explode(F.filter(F.array(F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("arxiv:"), F.lower("arxiv_id")), F.lit("")), lambda x: x.isNotNull())).alias("key"))
    star = w.where("key <> ''").groupBy("key").agg(F.min("id").alias("a")).join(w.where("key <> ''"), "key").select("a", F.col("id").alias("b"))
    # titles with one token set form a star around the smallest id; only distinct sets are compared
    t = works.select(work_id().alias("id"), F.array_sort(title_tokens(F.col("title"))).alias("tokens")).where(F.size("tokens") > 0)
    reps = t.groupBy("tokens").agg(F.min("id").alias("rep"))
    same = t.join(reps, "tokens").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    r = written(token_sets(reps.select(F.col("rep").alias("id"), "tokens"), "id"), "title-sets")
    named = lambda c: r.select(F.col("h").alias("h" + c), F.col("id").alias(c))
    close = similar_links(r.select("h", "tokens")).join(named("a"), "ha").join(named("b"), "hb").select("a", "b")
    comp = components(star.unionByName(same).unionByName(close))
    return works.select(work_id().alias("id")).join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def dangling(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose (composite) key has no parent."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def placed_twice(placed: DataFrame, key: str) -> DataFrame:
    """Occurrences that stand in more than one place."""
    return placed.groupBy(key).agg(F.count(F.lit(1)).alias("places")).where("places > 1")


def incomplete_additions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added references without title, author or year."""
    return after.join(before.select("reference_id"), "reference_id", "left_anti").where(~complete_for_insertion(F.col("title"), F.col("author"), F.col("year"))).select("reference_id")


def identity_broken(df: DataFrame, a: str, b: str) -> DataFrame:
    """V05"""
    return df.where(~F.col(a).eqNullSafe(F.col(b)))


def new_support_status(verdicts: DataFrame, key: str) -> DataFrame:
    """Added citations of a group: contradicted or unverifiable ones block, partly supported ones warn."""
    bad = F.col("verdict").isin("CONTRADICTED", *UNVERIFIABLE)
    g = verdicts.groupBy(key).agg(F.count_if(bad).alias("unsupported"), F.count_if(F.col("verdict") == "PARTIALLY_SUPPORTED").alias("partial"))
    return g.withColumn("status", F.when(F.col("unsupported") > 0, "BLOCKED").when(F.col("partial") > 0, "WARNED").otherwise("PASSED"))


def support_status(verdicts: DataFrame, key: str) -> DataFrame:
    """Citations whose context changed, counted by the worst verdict on them; contradicted ones block, unchecked ones warn."""
    g = verdicts.groupBy(key).agg(F.count(F.lit(1)).alias("affected"), F.count_if(F.col("verdict") == "SUPPORTED").alias("verified"), F.count_if(F.col("verdict") == "CONTRADICTED").alias("contradicted"), F.count_if(F.col("verdict").isin(UNVERIFIABLE)).alias("unverifiable"))
    return g.withColumn("status", F.when(F.col("contradicted") > 0, "BLOCKED").when(F.col("verified") < F.col("affected"), "WARNED").otherwise("PASSED"))


def attachment_status(changed: DataFrame, verdicts: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Contexts that changed (D08), by the worst verdict on them (A24); those nobody judged are unverifiable."""
    worst = severity_worst(verdicts, *keys)
    judged = changed.select(*keys).distinct().join(worst, keys, "left").withColumn("verdict", F.coalesce("verdict", F.lit("UNVERIFIABLE")))
    return support_status(judged, group)


def citation_warnings(before: DataFrame, after: DataFrame, content_hash: Column) -> DataFrame:
    """A warning per occurrence that is gone and per reference that nothing cites any more."""
    lost = removed_keys(before, after, ["citation_id"]).select(F.lit("CITATION_REMOVED").alias("code"), F.col("citation_id").alias("subject"))
    cited = lambda d: d.where("reference_id is not null")
    left = removed_keys(cited(before), cited(after), ["reference_id"]).select(F.lit("REFERENCE_LEFT_UNCITED").alias("code"), F.col("reference_id").alias("subject"))
    both = lost.unionByName(left)
    return both.select(warning_id(F.col("code"), F.array("subject"), content_hash).alias("warning_id"), "code", "subject")


def section_sequence(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Documents whose sections (``key``, place, section) are not the same ones in the same order."""
    order = lambda d, n: d.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"]).alias(n))
    return order(before, "was").join(order(after, "now"), key, "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select(key)


def acknowledgement_gap(required: Column, given: Column) -> Column:
    """Warnings that were not acknowledged."""
    return F.array_sort(F.array_except(required, given))


def tampered(stored: Column, required: Column) -> Column:
    """The warnings stored with a proposal are not the ones it requires."""
    return F.array_sort(F.array_distinct(stored)) != F.array_sort(F.array_distinct(required))


def hash_broken(df: DataFrame, text: str, stored: str) -> DataFrame:
    """V17"""
    return df.where(text_sha256(F.col(text)) != F.col(stored))


def preflight(papers: DataFrame) -> DataFrame:
    """Blockers and warnings of each paper from its counts."""
    block = F.array(F.when(F.col("style").isNull(), "NO_STYLE"), F.when(F.col("paragraphs") == 0, "EMPTY_DOCUMENT"), F.when(F.col("unrenderable") > 0, "UNRENDERABLE_BLOCK"))
    warn = F.array(F.when(F.col("partial") > 0, "PARTIAL_MODIFIERS"), F.when(F.col("raw_only") > 0, "RAW_ONLY"), F.when(F.col("converted") > 0, "CONVERTED_BLOCK"), F.when(F.col("uncited") > 0, "RETAINED_UNCITED"), F.when(F.col("dropped") > 0, "DROPPED_ADDED"))
    return papers.select("paper_id", F.array_join(F.array_compact(block), ",").alias("blockers"), F.array_join(F.array_compact(warn), ",").alias("warnings"))


def preflight_counts(papers: DataFrame, paragraphs: DataFrame, blocks: DataFrame, refs: DataFrame, items: DataFrame) -> DataFrame:
    """What :func:`preflight` asks of each paper (paper_id, style), counted; a paper without rows counts none.

    paragraphs and blocks (status) have paper_id, refs reference_id, status and added besides, items reference_id
    and partial.  A reference is uncited if no item names it, and dropped if it was added and is uncited.
    """
    n = F.count(F.lit(1))
    text = paragraphs.groupBy("paper_id").agg(n.alias("paragraphs"))
    shown = blocks.groupBy("paper_id").agg(F.count_if(F.col("status") == "UNRENDERABLE").alias("unrenderable"), F.count_if(F.col("status") == "CONVERTED").alias("converted"))
    cited = items.where("reference_id is not null").select("paper_id", "reference_id", F.lit(True).alias("_cited")).distinct()
    r = refs.join(cited, ["paper_id", "reference_id"], "left").withColumn("_open", F.col("_cited").isNull())
    listed = r.groupBy("paper_id").agg(F.count_if(F.col("status") == "RAW_ONLY").alias("raw_only"), F.count_if("_open").alias("uncited"), F.count_if(F.col("_open") & F.col("added")).alias("dropped"))
    marked = items.groupBy("paper_id").agg(F.count_if("partial").alias("partial"))
    out = papers
    for d in (text, shown, listed, marked):
        out = out.join(d, "paper_id", "left")
    return out.na.fill(0, ["paragraphs", "unrenderable", "converted", "raw_only", "uncited", "dropped", "partial"])


def render_set(refs: DataFrame, cited: DataFrame, original: DataFrame) -> DataFrame:
    """What an export lists and leaves out: cited, original but uncited, or added and uncited."""
    j = refs.join(cited.select("reference_id", F.lit(1).alias("_c")).distinct(), "reference_id", "left").join(original.select("reference_id", F.lit(1).alias("_o")).distinct(), "reference_id", "left")
    return j.select("reference_id", F.when(F.col("_c") == 1, "CITED").when(F.col("_o") == 1, "RETAINED_UNCITED").otherwise("DROPPED_ADDED").alias("role"))


def signature_diff(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Signatures that an export lost or changed."""
    j = expected.select("citation_id", F.col("signature").alias("e")).join(observed.select("citation_id", F.col("signature").alias("o")), "citation_id", "full_outer")
    return j.select("citation_id", F.when(F.col("o").isNull(), "MISSING").when(F.col("e").isNull(), "UNEXPECTED").when(F.col("e") != F.col("o"), "CHANGED").alias("kind")).where("kind is not null")


def fidelity_warnings(status: DataFrame, content_hash: Column) -> DataFrame:
    """One warning per paper with the sorted ids of what is not structured; none where all is."""
    g = status.where("parse_status <> 'STRUCTURED'").groupBy("paper_id").agg(F.sort_array(F.collect_list("citation_id")).alias("ids"))
    return g.select("paper_id", warning_id(F.lit("FIDELITY"), F.col("ids"), content_hash).alias("warning_id"), F.array_join("ids", ",").alias("subjects"))


def apply_insertions(sentences: DataFrame, insertions: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences with their new token before the end mark; rejoined in order without moving offsets."""
    j = sentences.join(insertions, [*keys, "sent_no"], "left")
    tail = F.regexp_extract("text", "[ .!?\"'”’)\\]}]*$", 0)
    body = F.substr("text", F.lit(1), F.length("text") - F.length(tail))
    done = F.when(F.col("citation_id").isNotNull(), F.concat(body, F.lit(" [[CITE:"), "citation_id", F.lit("]]"), tail)).otherwise(F.col("text"))
    return j.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_no", done.alias("s")))), lambda x: x["s"]), " ").alias("text"))


def merge_items(occurrences: DataFrame, additions: DataFrame) -> DataFrame:
    """Items appended to the occurrence next to the insertion."""
    j = occurrences.join(additions.groupBy("citation_id").agg(F.array_sort(F.collect_list("reference_id")).alias("more")), "citation_id", "left")
    return j.select("citation_id", F.when(F.col("more").isNotNull(), F.concat("items", "more")).otherwise(F.col("items")).alias("items"))


def rebuild(paragraphs: DataFrame, changed: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs with the changed ones replaced."""
    j = paragraphs.join(changed.select(*keys, F.col("text").alias("_new")), keys, "left")
    return j.select(*keys, F.coalesce("_new", "text").alias("text"), F.coalesce(normalize_text(F.col("_new")) == normalize_text(F.col("text")), F.lit(False)).alias("no_op"))


def placed_citations(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of the citation tokens in paragraphs with ``text``."""
    return paragraphs.select(*keys, F.explode(token_ids(F.col("text"))).alias("citation_id"))


def rebuild_errors(paragraphs: DataFrame, changed: DataFrame, new_citations: DataFrame, refs: DataFrame, new_refs: DataFrame, keys: list[str]) -> DataFrame:
    """What stops a rebuilt revision: (kind, subject) of changes without a paragraph or effect, new citations that no
    paragraph places and new references whose id exists."""
    name = F.concat_ws("/", *keys)
    pair = changed.select(*keys, F.col("text").alias("new")).join(paragraphs.select(*keys, F.col("text").alias("old")), keys, "left")
    orphan = pair.where("old is null").select(F.lit("ORPHAN_CHANGE").alias("kind"), name.alias("subject"))
    idle = pair.where(normalize_text(F.col("new")) == normalize_text(F.col("old"))).select(F.lit("NO_OP").alias("kind"), name.alias("subject"))
    placed = placed_citations(rebuild(paragraphs, changed, keys), keys).select("citation_id").distinct()
    unplaced = new_citations.join(placed, "citation_id", "left_anti").select(F.lit("UNPLACED_CITATION").alias("kind"), F.col("citation_id").alias("subject"))
    twice = new_refs.join(refs.select("reference_id"), "reference_id", "left_semi").select(F.lit("REFERENCE_EXISTS").alias("kind"), F.col("reference_id").alias("subject"))
    return orphan.unionByName(idle).unionByName(unplaced).unionByName(twice)


def edit_scope(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Each section's targets, what is skipped with the reason, and words before and as targeted.

    paragraphs have ``keys``, section, par_no, words, target (words) and reason (null for a target).
    """
    listed = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["s"])
    target = F.when(F.col("reason").isNull(), F.struct("par_no", F.col("par_no").cast("string").alias("s")))
    skip = F.when(F.col("reason").isNotNull(), F.struct("par_no", F.concat_ws(":", F.col("par_no").cast("string"), "reason").alias("s")))
    words = F.when(F.col("reason").isNull(), F.col("target")).otherwise(F.col("words"))
    return paragraphs.groupBy(*keys, "section").agg(
        F.count(F.lit(1)).alias("paragraphs"), F.array_join(listed(target), ",").alias("targets"), F.array_join(listed(skip), ",").alias("skipped"),
        F.sum("words").cast("long").alias("words_before"), F.sum(words).cast("long").alias("words_target"),
    )


def evidence_anchors(spans: DataFrame, chosen: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """A10: offsets and hashes of at most three chosen spans."""
    return spans.join(chosen.where(F.col("place") <= most), [*keys, "span_id"])


def key_filter(keys: DataFrame) -> DataFrame:
    """One row with ``bits`` (array<long>): a bitmap of the slots of ``keys`` (key long), ``FILTER_BITS`` a key and 2 MB at most."""
    slots = 1 << min(24, max(10, (FILTER_BITS * keys.count()).bit_length()))
    slot = F.pmod("key", F.lit(slots))
    words = keys.groupBy(F.floor(slot / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("b"))
    every = keys.sparkSession.range(slots // 64).withColumnRenamed("id", "w").join(words, "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")), "key-filter")


def passes(bits: Column, key: Column) -> Column:
    """Whether the slot of ``key`` is marked in ``bits``."""
    slot = F.pmod(key, (F.size(bits) * 64).cast("long"))
    word = F.get(bits, F.floor(slot / 64).cast("int"))
    return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def content_present(items: DataFrame, docs: DataFrame, width: int = 6, letters: int = 8) -> DataFrame:
    """Items (item_id, text) contained, case and white space aside, in some document.

    An item may begin and end within a word, so its key is made of the words between its
    first and last one, at most ``width``; documents offer their word windows of the sizes that
    occur.  Items of one or two words use their first ``letters`` characters instead.  A filter of the
    items' keys is applied where texts are read, so that texts without one are never shuffled; the keys
    that pass move alone and are joined exactly.
    """
    low = lambda c: F.lower(normalize_text(c))
    i = items.select("item_id", low(F.col("text")).alias("t")).where("t <> ''").withColumn("w", F.split("t", " "))
    inner = F.least(F.lit(width), F.size("w") - 2)
    short = F.size("w") < 3
    head = F.least(F.lit(letters), F.length("t"))
    key = F.when(short, F.xxhash64(F.substr("t", F.lit(1), head))).otherwise(F.xxhash64(F.slice("w", F.lit(2), F.greatest(inner, F.lit(1)))))
    i = written(i.select("item_id", "t", F.when(short, -head).otherwise(inner).alias("size"), key.alias("key")), "items")
    # at most width + letters sizes
    sizes = [r["size"] for r in i.select("size").distinct().collect()]
    d = docs.select(low(F.col("text")).alias("d")).withColumn("id", F.xxhash64("d")).withColumn("v", F.split("d", " "))

    def windows(k: int):
        count = F.length("d") + k + 1 if k < 0 else F.size("v") - k + 1
        at = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda p: F.xxhash64(F.substr("d", p, F.lit(-k))) if k < 0 else F.xxhash64(F.slice("v", p, k))))

    if not sizes:
        return i.select("item_id")

    def sized(k: int) -> Column:
        return F.transform(windows(k), lambda x: F.struct(F.lit(k).alias("size"), x.alias("key")))

    keys = F.concat(*map(sized, sizes))
    bits = key_filter(i.select("key"))
    known = d.join(F.broadcast(bits)).withColumn("hits", F.filter(keys, lambda x: passes(F.col("bits"), x["key"]))).where(F.size("hits") > 0)
    d = written(known.select("id", "d", "hits"), "texts-with-keys")
    pairs = d.select("id", F.explode("hits").alias("x")).select("id", "x.size", "x.key").join(i.select("item_id", "size", "key"), ["size", "key"]).select("item_id", "id").distinct()
    found = pairs.join(d.select("id", "d"), "id").join(i.select("item_id", "t"), "item_id").where(F.contains("d", "t"))
    return found.select("item_id").distinct()
