"""Review: which paragraphs and claims to look at, closed-set grounding, findings and their counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import describe_reference, https_link
from folioflow.operators.resolution import distinct_sets, not_held, subsets, token_sets
from folioflow.sources.scratch import written

PARAGRAPHS, CLAIMS, SUGGESTIONS = 500, 12, 3
RANK_TOKENS = 8  # words of a set whose subsets are looked up at most
SEVERITY = ["CONTRADICTED", "UNCITED_CLAIM", "UNRESOLVED_REFERENCE", "UNLINKED_CITATION", "MISSING_WORK"]
VERDICTS = ["SUPPORTED", "PARTIALLY_SUPPORTED", "NOT_SUPPORTED", "CONTRADICTED"]


def paragraphs_by_density(pars: DataFrame, most: int = PARAGRAPHS) -> DataFrame:
    """Most citations first, document order on ties."""
    r = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("citations"), "par_no"))
    return pars.withColumn("place", r).where(F.col("place") <= most)


def section_priority(title: Column) -> Column:
    """A02"""
    t = F.lower(title)
    return F.when(t.rlike("introduction|related|background"), 0).when(t.rlike("discussion|conclusion"), 1).when(t.rlike("method|result|experiment"), 3).otherwise(2)


def budgeted_claims(claims: DataFrame, most: int = CLAIMS) -> DataFrame:
    """The first claims of a paper; rejected paragraphs cost nothing, blank topics do."""
    r = F.row_number().over(W.partitionBy("doc_id").orderBy("priority", "par_no", "claim_no"))
    return claims.where("not rejected").withColumn("place", r).where(F.col("place") <= most)


def ground_ids(answers: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    """Answers of responses all of whose ids were offered; one foreign id rejects the whole response."""
    foreign = answers.join(offered, [key, "offered_id"], "left_anti").select(key).distinct()
    return answers.join(foreign, key, "left_anti")


def rejected_responses(answers: DataFrame, offered: DataFrame, key: str) -> DataFrame:
    return answers.join(offered, [key, "offered_id"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("foreign_ids"))


def require_choice(df: DataFrame, col: str, allowed: list[str]) -> DataFrame:
    """A05"""
    return df.withColumn("permitted", F.coalesce(F.col(col).isin(allowed), F.lit(False)))


def uncited_claims(claims: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """Claimed sentences without a citation."""
    return claims.join(cited.select(*keys).distinct(), keys, "left_anti").withColumn("kind", F.lit("UNCITED_CLAIM"))


def unlinked_citation_findings(claims: DataFrame, items: DataFrame) -> DataFrame:
    """Claims that cite a marker none of whose items is linked."""
    g = items.groupBy("citation_id").agg(F.bool_and(F.col("reference_id").isNull()).alias("_open"))
    return claims.join(g, "citation_id").where("_open").drop("_open").withColumn("kind", F.lit("UNLINKED_CITATION"))


def support_pairs(claims: DataFrame, items: DataFrame) -> DataFrame:
    """One row per claim, occurrence and reference."""
    return claims.join(items.where("reference_id is not null").select("citation_id", "reference_id"), "citation_id")


def server_verdict(work: Column, confidence: Column, abstract: Column, judged: Column) -> Column:
    """A09"""
    return F.when(work.isNull(), "SOURCE_UNRESOLVED").when(~confidence.isin("CERTAIN", "PROBABLE"), "SOURCE_IDENTITY_UNCERTAIN").when(F.coalesce(F.trim(abstract) == "", F.lit(True)), "EVIDENCE_UNAVAILABLE").otherwise(judged)


def missing_work(ranked: DataFrame, held: DataFrame, most: int = SUGGESTIONS) -> DataFrame:
    """Linkable candidates that the paper holds neither by a key nor by a similar title (R18), best ``most`` per claim.

    ``ranked`` has paper_id, claim_id, rank, link and the columns of a candidate, ``held`` is what papers hold; repeats in a ranking count once.
    """
    fresh = not_held(ranked.where("link is not null").drop("link"), held)
    open_ = fresh.groupBy("paper_id", "claim_id", "provider", "external_id").agg(F.min("rank").alias("rank"))
    r = F.row_number().over(W.partitionBy("paper_id", "claim_id").orderBy("rank", "external_id", "provider"))
    top = open_.withColumn("place", r).where(F.col("place") <= most)
    return top.groupBy("paper_id", "claim_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "external_id"))), lambda x: x["external_id"]), ",").alias("suggestions"))


def search_note(degraded: Column, found: Column, cited: Column, incomplete: Column) -> Column:
    """A12"""
    return F.when(degraded, "SEARCH_DEGRADED").when((found > 0) & (cited == found), "ALL_ALREADY_CITED").when((found > 0) & (incomplete == found - cited), "INCOMPLETE_RECORDS").when(found == 0, "NOTHING_FOUND")


def with_search_notes(findings: DataFrame, notes: DataFrame) -> DataFrame:
    """Findings (claim_id, kind, ...) with what the search said of each uncited claim; one without a note was beyond the budget."""
    j = findings.join(notes.select("claim_id", F.col("note").alias("_note"), F.lit(True).alias("_searched")), "claim_id", "left")
    note = F.when(F.col("_searched"), F.col("_note")).otherwise("NOT_SEARCHED_BUDGET_SPENT")
    return j.withColumn("note", F.when(F.col("kind") == "UNCITED_CLAIM", note)).drop("_note", "_searched")


def coverage_label(attempts: DataFrame) -> DataFrame:
    """Which providers answered an operation."""
    g = attempts.groupBy("operation_id").agg(F.collect_set(F.when(F.col("status") != "RATE_LIMITED", F.col("provider"))).alias("p"))
    return g.select("operation_id", F.when(F.size("p") == 2, "BOTH").when(F.size("p") == 1, F.concat(F.element_at("p", 1), F.lit("_ONLY"))).otherwise("NONE_REACHABLE").alias("coverage"))


def unresolved_reference_findings(resolutions: DataFrame) -> DataFrame:
    """A14"""
    return resolutions.where(~F.col("confidence").isin("CERTAIN", "PROBABLE")).select("paper_id", "reference_id", F.lit("UNRESOLVED_REFERENCE").alias("kind"))


def all_findings(parts: list[DataFrame]) -> DataFrame:
    """A15"""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def severity(kind: Column) -> Column:
    """A16"""
    c = F.when(kind == SEVERITY[0], 0)
    for i, k in enumerate(SEVERITY[1:], 1):
        c = c.when(kind == k, i)
    return c.otherwise(len(SEVERITY))


def finding_facets(findings: DataFrame) -> DataFrame:
    """Findings per kind with the total of all kinds."""
    g = findings.rollup("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("open")).alias("open"))
    return g.select(F.coalesce("kind", F.lit("ALL")).alias("kind"), "n", "open")


def stale_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Papers whose latest run looked at another revision than the current one."""
    last = runs.groupBy("paper_id").agg(F.max_by("revision", "run_id").alias("seen"))
    return last.join(current, "paper_id").where("seen <> revision_number").select("paper_id", "seen", "revision_number")


def with_vocabulary(counts: DataFrame, col: str, words: list[str], keys: list[str]) -> DataFrame:
    """Every member of a closed set for every key, zero included; ``words`` is short by definition."""
    of = lambda w: F.coalesce(F.max(F.when(F.col(col) == w, F.col("n"))), F.lit(0))
    every = counts.groupBy(*keys).agg(F.array(*[F.struct(F.lit(w).alias(col), of(w).alias("n")) for w in words]).alias("each"))
    return every.select(*keys, F.inline("each"))


def severity_worst(verdicts: DataFrame, *keys: str) -> DataFrame:
    """The worst verdict of a group, the first one on ties."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return verdicts.groupBy(*keys).agg(F.max(F.struct(rank.alias("r"), (-F.col("place")).alias("p"), "verdict")).alias("m")).select(*keys, F.coalesce("m.verdict", F.lit("UNRESOLVED")).alias("verdict"))


def run_stats(paragraphs: DataFrame, refs: DataFrame, findings: DataFrame, assertions: DataFrame, answers: DataFrame, searched: DataFrame, suggestions: DataFrame, attempts: DataFrame, resolutions: DataFrame, limit: int = PARAGRAPHS) -> DataFrame:
    """One row of the 14 counters of a run, each with the total it is a part of.

    paragraphs (reviewed), findings and refs are counted as they are; assertions have completed,
    answers rejected, searched claim_id and paragraph_id, resolutions confidence.
    """
    n = F.count(F.lit(1))
    parts = [
        paragraphs.agg(F.count_if("reviewed").alias("paragraphs_reviewed"), n.alias("paragraphs_total")).withColumn("paragraph_limit", F.lit(limit)),
        refs.agg(n.alias("references_total")),
        findings.agg(n.alias("findings")),
        assertions.agg(n.alias("support_assertions_total"), F.count_if("completed").alias("support_assertions_completed")),
        answers.agg(F.count_if("rejected").alias("grounding_rejections")),
        searched.agg(F.count_distinct("claim_id").alias("claims_searched"), F.count_distinct("paragraph_id").alias("missing_work_paragraphs_searched")),
        suggestions.agg(n.alias("works_suggested")),
        attempts.agg(n.alias("provider_calls")),
        resolutions.agg(F.count_if(F.col("confidence").isin("CERTAIN", "PROBABLE")).alias("references_resolved"), n.alias("references_examined")),
    ]
    out = parts[0].withColumn("_one", F.lit(1))
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p.withColumn("_one", F.lit(1))), "_one")
    return out.drop("_one")


def findings_by_paragraph(findings: DataFrame, paragraphs: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of each paragraph in order of severity, and totals of findings and citations per section.

    paragraphs have doc_id, par_no, section; findings and citations have doc_id and par_no.
    """
    f = findings.withColumn("s", severity(F.col("kind")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s", "kind"))), lambda x: x["kind"]), ",")
    per = f.groupBy("doc_id", "par_no").agg(listed.alias("kinds"), F.count(F.lit(1)).alias("findings"))
    cited = citations.groupBy("doc_id", "par_no").agg(F.count(F.lit(1)).alias("citations"))
    both = paragraphs.join(per, ["doc_id", "par_no"], "left").join(cited, ["doc_id", "par_no"], "left").na.fill(0, ["findings", "citations"])
    sections = both.groupBy("doc_id", "section").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum("findings").alias("findings"), F.sum("citations").alias("citations"))
    return per, sections


def enrich_findings(findings: DataFrame, paragraphs: DataFrame, refs: DataFrame, records: DataFrame) -> DataFrame:
    """Findings with section title, claim text, reference label and suggestions that can be linked to, in their order.

    findings have finding_id, doc_id, par_no, reference_id, suggested (record ids) and rationales;
    paragraphs doc_id, par_no, section, text; refs reference_id, title, raw_text; records record_id, title, doi, url.
    """
    label = refs.select("reference_id", describe_reference(F.col("title"), F.col("raw_text")).alias("reference_label"))
    # findings with one offer share its text, which is made once; JSON tells null entries apart, which a hash skips
    offer = F.xxhash64(F.to_json(F.struct("suggested", "rationales")))
    offers = findings.groupBy(offer.alias("offer")).agg(F.first("suggested").alias("suggested"), F.first("rationales").alias("rationales"))
    each = offers.select("offer", "rationales", F.posexplode("suggested").alias("place", "record_id"))
    r = records.select("record_id", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"), https_link(F.col("url"), F.col("doi")).alias("link")).where("link is not null")
    one = F.struct("place", F.concat_ws("|", "title", "link", F.coalesce(F.get("rationales", F.col("place")), F.lit(""))).alias("s"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]), ";")
    found = each.join(r, "record_id").groupBy("offer").agg(listed.alias("suggestions"))
    f = findings.select("finding_id", "doc_id", "par_no", "reference_id", offer.alias("offer"))
    # the claims are the longest, so they come last and are not moved with the findings
    out = f.join(label, "reference_id", "left").join(found, "offer", "left")
    out = out.join(paragraphs.select("doc_id", "par_no", F.col("section").alias("section_title"), F.col("text").alias("claim_text")), ["doc_id", "par_no"], "left")
    return out.select("finding_id", F.coalesce("section_title", F.lit("")).alias("section_title"), F.coalesce("claim_text", F.lit("")).alias("claim_text"), "reference_label", F.coalesce("suggestions", F.lit("")).alias("suggestions"))


def parse_quality(papers: DataFrame, paragraphs: DataFrame, items: DataFrame, status: DataFrame, refs: DataFrame, blocks: DataFrame, links: DataFrame) -> DataFrame:
    """What a parse recovered of each paper; zero where a paper has none.

    paragraphs have section and words, items reference_id, status parse_status, refs normalization,
    blocks kind and fidelity, links code (of the cross-check); all have paper_id.
    """
    n, count = F.count(F.lit(1)), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    parts = [
        paragraphs.groupBy("paper_id").agg(F.count_distinct("section").alias("sections"), n.alias("paragraphs"), F.sum("words").cast("long").alias("words")),
        items.groupBy("paper_id").agg(n.alias("citations"), F.count("reference_id").alias("linked"), count(F.col("reference_id").isNull()).alias("unlinked")),
        status.groupBy("paper_id").agg(n.alias("clusters"), count(F.col("parse_status") == "RAW_ONLY").alias("raw_only"), count(F.col("parse_status") == "PARTIAL_MODIFIERS").alias("partial_modifiers")),
        refs.groupBy("paper_id").agg(n.alias("refs"), *[count(F.col("normalization") == k).alias("refs_" + k.lower()) for k in ("COMPLETE", "PARTIAL", "RAW_ONLY")]),
        blocks.groupBy("paper_id").agg(n.alias("blocks"), *[count(F.col("kind") == k).alias(k.lower() + "s") for k in ("FIGURE", "TABLE", "FORMULA")], count(F.col("fidelity") == "UNRENDERABLE").alias("unrenderable")),
        links.groupBy("paper_id").agg(count(F.col("code") != "NOT_A_MARKER").alias("checked"), *[count(F.col("code") == k).alias(k.lower()) for k in ("AGREED", "MISMATCH", "RECOVERED", "AMBIGUOUS", "UNRESOLVED", "UNCERTAIN")]),
    ]
    out = papers.select("paper_id").distinct()
    for p in parts:
        out = out.join(p, "paper_id", "left")
    return out.na.fill(0)


def paper_detail(papers: DataFrame, revisions: DataFrame, reports: DataFrame) -> DataFrame:
    """Papers with their revision count, current revision and the parse report of their first one."""
    r = revisions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("revisions"), F.max_by("revision_id", "revision_number").alias("current_id"))
    first = revisions.where("revision_number = 1").select("paper_id", F.col("revision_id")).join(reports, "revision_id").drop("revision_id")
    return papers.join(r, "paper_id", "left").join(first, "paper_id", "left").na.fill(0, ["revisions"])


def judge(df: DataFrame, fn: Callable[[pd.DataFrame], pd.Series], schema: str, provider: str = "local", model: str = "lexical", prompt: str = "v1") -> DataFrame:
    """A user's judgement of each row, with its provenance; :func:`grounded` validates it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(judgement=fn(b), provider=provider, model=model, prompt=prompt)

    return df.mapInPandas(run, f"{schema}, judgement double, provider string, model string, prompt string")


def grounded(judged: DataFrame, offered: DataFrame, response: str, item: str, allowed: list | None = None) -> tuple[DataFrame, DataFrame]:
    """U01, validated: judgements whose response names offered items only (A04) and permitted answers only (A05), and the rejected responses."""
    answers = written(judged.withColumnRenamed(item, "offered_id"), "judgements")
    open_ids = offered.select(response, F.col(item).alias("offered_id")).distinct()
    good = ground_ids(answers, open_ids, response)
    if allowed is not None:
        wrong = require_choice(answers, "judgement", allowed).where(~F.col("permitted")).select(response).distinct()
        good = good.join(wrong, response, "left_anti")
    return good.withColumnRenamed("offered_id", item), rejected_responses(answers, open_ids, response)


def word_postings(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, df) of token sets (h, tokens), and their postings (token, hb, nb, left_b): the words of a set from ``token`` on, rarest first, are ``left_b``."""
    each = sets.select("h", F.size("tokens").alias("nb"), F.explode("tokens").alias("token"))
    df = written(each.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "rank-words")
    later = F.row_number().over(W.partitionBy("h").orderBy(F.desc("df"), F.desc("token")))
    return df, written(each.join(df, "token").select("token", F.col("h").alias("hb"), "nb", later.alias("left_b")), "rank-postings")


def probed(open_: DataFrame, postings: DataFrame, lo: int, hi: int) -> DataFrame:
    """(ha, hb) of claims (h, n, words, least) and works that meet at words ``lo`` to ``hi`` and may reach ``least``."""
    words = open_.select(F.col("h").alias("ha"), "n", "least", F.size("words").alias("m"), F.posexplode(F.slice("words", lo + 1, hi - lo)).alias("p", "token"))
    most = F.least(F.col("m") - lo - F.col("p"), F.col("left_b"))
    return words.join(postings, "token").where(most / (F.col("n") + F.col("nb") - most) >= F.col("least")).select("ha", "hb").distinct()


def lexical_rank(claims: DataFrame, works: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` works of each claim with the largest Jaccard of words, ties to the smaller id; both have id and tokens.

    Claims with one token set are ranked once, and so are works.  Sets of at most ``RANK_TOKENS`` words
    meet under their subsets (:func:`_rank_short`), pairs with a longer one by probing (:func:`_rank_probed`).
    """
    c = written(token_sets(claims, "claim_id"), "rank-claims")
    w = token_sets(works, "work_id")
    place = F.row_number().over(W.partitionBy("h").orderBy("work_id"))
    few = w.withColumn("_r", place).where(F.col("_r") <= k)
    w = written(few.groupBy("h").agg(F.first("tokens").alias("tokens"), F.sort_array(F.collect_list("work_id")).alias("ids")), "rank-works")
    sets = written(distinct_sets(c), "rank-sets")
    long = F.size("tokens") > RANK_TOKENS
    parts = [_rank_short(sets.where(~long), w.where(~long), k)]
    if not w.where(long).isEmpty():
        parts.append(_rank_probed(sets.where(~long), w.where(long), k))
    if not sets.where(long).isEmpty():
        parts.append(_rank_probed(sets.where(long), w, k))
    best = W.partitionBy("h").orderBy(F.desc("score"), "work_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return c.select("claim_id", "h").join(ranked, "h").select("claim_id", "work_id", "rank", "score")


def _rank_short(sets: DataFrame, works: DataFrame, k: int) -> DataFrame:
    """(h, score, work_id): the ``k`` best of ``works`` (h, tokens, ids) for each of ``sets`` (h, tokens).

    From the whole set down to single words, a claim looks its subsets of ``c`` words up; each keeps the ``k``
    first works of each length that hold it.  A claim is done once its ``k``-th score is beyond what fewer common words can reach.
    """
    found = None
    left = written(sets.withColumn("least", F.lit(0.0)), "rank-open")
    best = W.partitionBy("h").orderBy(F.desc("score"), "work_id")
    done = sets.select("h", F.lit(0.0).alias("score")).join(works.select("h", F.explode("ids").alias("work_id")), "h").limit(0)
    for c in range(RANK_TOKENS, 0, -1):
        if left.isEmpty():
            break
        now, later = left.where(F.size("tokens") >= c), left.where(F.size("tokens") < c)
        if now.isEmpty():
            continue
        exact = lambda d, *more: subsets(d.where(F.size("tokens") >= c), RANK_TOKENS, lambda _n, m: m == c, *more)  # noqa: B023, E731
        first = W.partitionBy("key", "nb").orderBy("work_id")
        held = exact(works, "ids").select("key", F.col("n").alias("nb"), F.explode("ids").alias("work_id")).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).drop("_r")
        each = exact(now, "h").join(held, "key").select("h", (F.lit(c) / (F.col("n") + F.col("nb") - c)).alias("score"), "work_id")
        every = (each if found is None else each.unionByName(found)).groupBy("h", "work_id").agg(F.max("score").alias("score"))
        found = written(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("h", "score", "work_id"), "rank-found")
        least = found.groupBy("h").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("least"))
        after = now.drop("least").join(least, "h", "left").na.fill(0.0, ["least"])
        more = written(after.where((F.lit(c - 1) / F.size("tokens")) >= F.col("least")), "rank-more") if c > 1 else after.limit(0)
        done = done.unionByName(found.join(more, "h", "left_anti"))
        found = found.join(more, "h", "left_semi")
        left = later.unionByName(more.select(*later.columns))
    return done


def _rank_probed(sets: DataFrame, w: DataFrame, k: int) -> DataFrame:
    """(h, score, work_id): the ``k`` best of ``w`` (h, tokens, ids) for each of ``sets`` (h, tokens).

    A claim probes the postings of its words from the rarest on, one, two, four and so on in a round.
    Its ``k``-th best score so far bounds what is still worth while: a posting is passed over if the words
    left on both sides cannot reach it, and a claim is done once its own words left cannot.  Exact, and
    frequent words are read for the few claims that need them.
    """
    df, postings = word_postings(w)
    known = sets.select("h", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(df, "token")
    words = F.transform(F.array_sort(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
    left = written(known.groupBy("h", "n").agg(words.alias("words")).withColumn("least", F.lit(0.0)), "rank-open")
    best = W.partitionBy("h").orderBy(F.desc("score"), "work_id")
    done: DataFrame | None = None
    found, lo, hi = None, 0, 1
    while not left.isEmpty():
        hits = probed(left, postings, lo, hi).join(left.select(F.col("h").alias("ha"), "n", "words"), "ha").join(w.withColumnRenamed("h", "hb"), "hb")
        both = F.array_intersect("words", "tokens")  # in the order of ``words``
        hits = hits.withColumn("_c", F.size(both)).where(F.array_position("words", both[0]) > lo)  # else made in an earlier round
        each = hits.select(F.col("ha").alias("h"), (F.col("_c") / (F.col("n") + F.size("tokens") - F.col("_c"))).alias("score"), F.explode("ids").alias("work_id"))
        every = each if found is None else each.unionByName(found)
        found = written(every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"), "rank-found")
        least = found.groupBy("h").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(0.0).alias("least"))
        after = left.drop("least").join(least, "h", "left").na.fill(0.0, ["least"])
        more = written(after.where((F.size("words") > hi) & ((F.size("words") - hi) / F.col("n") >= F.col("least"))), "rank-open")
        ready = found.join(more, "h", "left_anti")
        done = ready if done is None else done.unionByName(ready)
        found, left = found.join(more, "h", "left_semi"), more
        lo, hi = hi, 2 * hi
    if done is None:
        done = sets.select("h", F.lit(0.0).alias("score")).limit(0).join(w.select("h", F.explode("ids").alias("work_id")), "h")
    return done.select("h", "score", "work_id")


def claim_candidates(sentences: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """At most three sentences of a paragraph: those with digits first, then the longest."""
    r = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.col("text").rlike(r"\d")), F.desc(F.length("text")), "sent_no"))
    return sentences.withColumn("place", r).where(F.col("place") <= most)
