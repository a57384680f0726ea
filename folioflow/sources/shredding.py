"""Provider records, markup and small grids as relational rows; sinks for bibliographies and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioflow.functions.text import arxiv_from_urls, normalise_doi, normalize_text

# Provider work types and their CSL names.
TYPES_A = {"article": "article-journal", "journal-article": "article-journal", "proceedings-article": "paper-conference", "book": "book", "book-chapter": "chapter", "dissertation": "thesis", "dataset": "dataset", "preprint": "article", "report": "report"}
TYPES_B = {"JournalArticle": "article-journal", "Conference": "paper-conference", "Book": "book", "BookSection": "chapter", "Dataset": "dataset", "Review": "article-journal"}
WORK_A = "id string, doi string, title string, display_name string, publication_year long, type string, ids map<string,string>, primary_location struct<landing_page_url:string,raw_source_name:string,source:struct<display_name:string>>, authorships array<struct<author:struct<display_name:string>>>, biblio struct<volume:string,issue:string,first_page:string,last_page:string>, locations array<struct<landing_page_url:string>>, abstract_inverted_index map<string,array<int>>"
WORK_B = "paperId string, externalIds struct<DOI:string,ArXiv:string>, url string, title string, abstract string, venue string, year long, authors array<struct<authorId:string,name:string>>, publicationTypes array<string>"
MAX_POSITION = 40_000


def _mapped(types: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in types.items() for x in kv]), c)


def works_from_openalex(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Records of the first provider."""
    w = raw.select(F.from_json(json_col, WORK_A).alias("w")).select("w.*")
    return w.select(
        F.lit("OPENALEX").alias("provider"),
        F.regexp_replace("id", r"^https?://openalex\.org/", "").alias("external_id"),
        F.coalesce("title", "display_name").alias("title"),
        normalise_doi(F.col("doi")).alias("doi"),
        arxiv_from_urls(F.transform("locations", lambda x: x["landing_page_url"])).alias("arxiv_id"),
        F.col("publication_year").alias("year"),
        F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull()).alias("authors"),
        F.coalesce("primary_location.source.display_name", "primary_location.raw_source_name").alias("venue"),
        F.col("primary_location.landing_page_url").alias("url"),
        F.col("biblio.volume").alias("volume"),
        F.col("biblio.issue").alias("issue"),
        F.coalesce(F.concat("biblio.first_page", F.lit("-"), "biblio.last_page"), "biblio.first_page").alias("pages"),
        F.coalesce(_mapped(TYPES_A, F.col("type")), F.lit("document")).alias("work_type"),
        F.array_join(F.transform(inverted_words(F.col("abstract_inverted_index")), lambda x: x["word"]), " ").alias("abstract"),
    )


def works_from_s2(raw: DataFrame, json_col: str = "json") -> DataFrame:
    """Records of the second provider; the first known publication type counts."""
    w = raw.select(F.from_json(json_col, WORK_B).alias("w")).select("w.*")
    known = F.filter(F.transform("publicationTypes", lambda x: _mapped(TYPES_B, x)), lambda x: x.isNotNull())
    return w.select(
        F.lit("SEMANTIC_SCHOLAR").alias("provider"), F.col("paperId").alias("external_id"), "title", normalise_doi(F.col("externalIds.DOI")).alias("doi"), F.col("externalIds.ArXiv").alias("arxiv_id"), "year",
        F.filter(F.transform("authors", lambda a: a["name"]), lambda x: x.isNotNull()).alias("authors"), F.nullif("venue", F.lit("")).alias("venue"), "url", F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("issue"),
        F.lit(None).cast("string").alias("pages"), F.coalesce(F.get(known, F.lit(0)), F.lit("document")).alias("work_type"), "abstract",
    )


def inverted_words(index: Column) -> Column:
    """Sorted array<struct<pos, word>> of a map word -> positions; positions out of range are ignored."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return F.array_sort(F.filter(flat, lambda x: (x["pos"] >= 0) & (x["pos"] < MAX_POSITION)))


def split_identity(df: DataFrame, id_col: str) -> DataFrame:
    """Rows marked ``accepted`` or not; a record without an id is an error to report, never an empty row."""
    return df.withColumn("accepted", F.coalesce(F.trim(id_col) != "", F.lit(False)))


def positions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, positions): the inverted index of each text."""
    # the texts are dealt by key as they are, so that nothing that is made of their words is shuffled again
    w = df.select(key, text).repartition(key).select(key, F.posexplode(F.filter(F.split(normalize_text(F.col(text)), " "), lambda x: x != "")).alias("pos", "word"))
    return w.groupBy(key, "word").agg(F.collect_list("pos").alias("positions"))


def text_from_positions(index: DataFrame, key: str) -> DataFrame:
    """Texts of inverted indexes; where two words claim a position the later word in order wins."""
    held = F.filter("positions", lambda p: (p >= 0) & (p < MAX_POSITION))
    placed = index.select(key, F.transform(held, lambda p: F.struct(p.alias("pos"), F.col("word"))).alias("at")).where(F.size("at") > 0)
    w = placed.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("at"))
    last = F.filter("at", lambda x, i: F.coalesce(F.get("at", i + 1)["pos"] != x["pos"], F.lit(True)))
    return w.select(key, F.array_join(F.transform(last, lambda x: x["word"]), " ").alias("text"))


def html_to_text(c: Column) -> Column:
    """Inner text with white space collapsed."""
    return normalize_text(F.regexp_replace(c, "<[^>]*>", ""))


BOXES = "section|article"
BLOCKS = f"{BOXES}|h[1-6]|p|div|ul|ol|table|nav|header|footer|main|body"


def sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section_no, level, title, paragraph_no, text), one row per paragraph; a section without one has a row of nulls.

    ``section`` and ``article`` open a section, and so does a heading, unless it is the first one
    directly in such an element, which it then names.  A heading ends those before it of its
    rank or a lower one within its element; the end of an element ends all within, and one without a beginning ends nothing.  Level is the depth of
    open sections, numbers follow the text; one without a title is ``Section N``.  Scripts, styles and comments hold no
    markup, a paragraph ends at the next block tag, and one outside all sections is no section's.

    The tags are read in order with a stack of open sections, within the row: (section, rank, box, titled).
    """
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    pieces = F.split(bare, rf"(?i)(?=</?(?:{BLOCKS})[\s>/])", -1)
    tags = F.transform(pieces, lambda x: F.struct(F.lower(F.regexp_extract(x, rf"(?i)^<(/?(?:{BLOCKS}))[\s>/]", 1)).alias("tag"), html_to_text(x).alias("text")))
    tags = F.filter(tags, lambda x: x["tag"].rlike(f"^(p|h[1-6]|/?({BOXES}))$"))
    none = "cast(array() as array<struct<section:int,rank:int,box:boolean,titled:boolean>>)"
    start = F.struct(
        F.expr(none).alias("open"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<section:int,level:int>>)").alias("seen"),
        F.expr("cast(array() as array<struct<section:int,text:string>>)").alias("titles"), F.expr("cast(array() as array<struct<section:int,text:string>>)").alias("texts"),
    )

    def entry(no: Column, rank: Column, box: bool, titled: bool) -> Column:
        return F.struct(no.alias("section"), rank.alias("rank"), F.lit(box).alias("box"), F.lit(titled).alias("titled"))

    def step(acc: Column, x: Column) -> Column:
        stack, tag = acc["open"], x["tag"]
        heading, box, end, rank = tag.startswith("h"), tag.rlike(f"^({BOXES})$"), tag.startswith("/"), F.substring(tag, 2, 1).try_cast("int")
        depth = F.size(stack)
        last_box = F.aggregate(stack, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda a, e: F.struct((a["i"] + 1).alias("i"), F.when(e["box"], a["i"] + 1).otherwise(a["at"]).alias("at")), lambda a: a["at"])
        names = heading & (depth > 0) & F.coalesce(F.get(stack, depth - 1)["box"] & ~F.get(stack, depth - 1)["titled"], F.lit(False))
        outer = F.filter(stack, lambda e, i: (i < last_box) | (e["rank"] < rank))
        no = acc["n"] + 1
        opened = F.when(box, F.array_append(stack, entry(no, F.lit(0), True, False))).otherwise(F.array_append(outer, entry(no, rank, False, True)))
        named = F.transform(stack, lambda e, i: F.struct(e["section"].alias("section"), e["rank"].alias("rank"), e["box"].alias("box"), (e["titled"] | (i == depth - 1)).alias("titled")))
        new = box | (heading & ~names)
        top = F.get(F.when(new, opened).otherwise(stack), F.when(new, F.size(opened)).otherwise(depth) - 1)["section"]
        line = F.struct(top.alias("section"), x["text"].alias("text"))
        return F.struct(
            F.when(end & (last_box > 0), F.slice(stack, F.lit(1), F.greatest(last_box - 1, F.lit(0)))).when(names, named).when(new, opened).otherwise(stack).alias("open"),
            F.when(new, no).otherwise(acc["n"]).alias("n"),
            F.when(new, F.array_append(acc["seen"], F.struct(no.alias("section"), F.size(opened).alias("level")))).otherwise(acc["seen"]).alias("seen"),
            F.when(heading, F.array_append(acc["titles"], line)).otherwise(acc["titles"]).alias("titles"),
            F.when((tag == "p") & (depth > 0), F.array_append(acc["texts"], line)).otherwise(acc["texts"]).alias("texts"),
        )

    def rows(a: Column) -> Column:
        of = lambda lines, s: F.transform(F.filter(lines, lambda x: x["section"] == s["section"]), lambda x: x["text"])
        return F.transform(a["seen"], lambda s: F.struct(s["section"].alias("no"), s["level"].alias("level"), F.get(of(a["titles"], s), F.lit(0)).alias("title"), of(a["texts"], s).alias("texts")))

    d = pages.select(key, F.explode(F.aggregate(tags, start, step, rows)).alias("s")).select(key, "s.*")
    title = F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Section "), F.col("no").cast("string")))
    d = d.select(key, F.col("no").cast("long").alias("section_no"), F.col("level").cast("long").alias("level"), title.alias("title"), F.posexplode_outer("texts").alias("p", "text"))
    return d.select(key, "section_no", "level", "title", (F.col("p") + 1).cast("long").alias("paragraph_no"), "text")


def rectangular(df: DataFrame, key: str, cells: str) -> DataFrame:
    """Ragged rows as (row, col, cell), padded with blanks to the widest row."""
    d = df.select(key, F.filter(cells, lambda x: x.isNotNull()).alias("_c"))
    widest = d.agg(F.coalesce(F.max(F.size("_c")), F.lit(0)).alias("_w"))  # one row
    padded = F.concat("_c", F.array_repeat(F.lit(""), F.col("_w") - F.size("_c")))
    return d.join(F.broadcast(widest)).select(key, F.posexplode(padded).alias("col_no", "cell")).withColumn("col_no", F.col("col_no").cast("long"))


def dedupe_authors(df: DataFrame, key: str, authors: str, fallback: str) -> DataFrame:
    """Ordered authors, one per folded name, the first one's spelling and affiliations kept.

    Both lists hold structs of name and affiliations; the second counts where the first names nobody.  A key
    without any name has no row.  Returns names, and affiliations (several joined by ``;``), joined by ``|``.
    """
    named = lambda c: F.filter(c, lambda x: F.coalesce(normalize_text(x["name"]) != "", F.lit(False)))
    chosen = F.when(F.coalesce(F.size(named(authors)) > 0, F.lit(False)), named(authors)).otherwise(named(fallback))
    a = df.select(key, F.posexplode(chosen).alias("pos", "a")).select(key, "pos", normalize_text(F.col("a.name")).alias("name"), F.col("a.affiliations").alias("places"))
    first = a.groupBy(key, F.lower("name").alias("folded")).agg(F.min_by(F.struct("pos", "name", "places"), "pos").alias("f"))
    listed = F.sort_array(F.collect_list(F.struct("f.pos", "f.name", "f.places")))
    g = first.groupBy(key).agg(listed.alias("l"))
    places = F.transform("l", lambda x: F.array_join(F.coalesce(x["places"], F.array().cast("array<string>")), ";"))
    return g.select(key, F.array_join(F.transform("l", lambda x: x["name"]), "|").alias("authors"), F.array_join(places, "|").alias("affiliations"))


def binary_manifest(files: DataFrame, cap: int = 50 * 2**20) -> DataFrame:
    """Size, hash and verdict of files read with the ``binaryFile`` source."""
    magic = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    verdict = F.when(F.col("length") > cap, "TOO_LARGE").when(~magic, "NOT_A_PDF").otherwise("ACCEPTED")
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), verdict.alias("verdict"))


def write_json_bibliography(refs: DataFrame, path: str, key: str = "paper_id", order: str = "bibliography_order") -> None:
    """One JSON document per paper with its reference list; null fields are left out."""
    rest = [c for c in refs.columns if c not in (key, order)]
    listed = F.array_sort(F.collect_list(F.struct(order, *rest)))
    refs.groupBy(key).agg(listed.alias("references")).write.mode("overwrite").json(path)


def append_attempts(attempts: DataFrame, path: str) -> None:
    """Append-only log."""
    attempts.write.mode("append").parquet(path)
