"""Citation markers: family, style, mode, locators, prefixes, status, clusters and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Patterns of printed markers.
NUMERIC = r"^[\[(]?\s*\d+\s*[\],;)]?\s*$"
YEAR = r"(1[6-9]\d{2}|20\d{2})"
SUPPRESS_AUTHOR = r"^\(\s*\d{4}[a-z]?\s*\)\s*$"
AUTHOR_IN_TEXT = r"\(\s*\d{4}[a-z]?\s*\)\s*[.,;]?\s*$"
PREFIX_WORDS = r"(?i)^(see(\s+also)?|e\.?g\.?|i\.?e\.?|cf\.?|compare|reviewed\s+in|following|after)[,\s]*$"
LOCATOR = r"(?i)\b(pp?|chaps?|chapters?|secs?|sections?|figs?|tbls?|tables?|eqs?|equations?)\.\s*(\d+(?:\s*[-–—]\s*\d+)?)"
# Locator words and their labels.
LABELS = {"p": "page", "pp": "page", "chap": "chapter", "chaps": "chapter", "chapter": "chapter", "chapters": "chapter", "sec": "section", "secs": "section", "section": "section", "sections": "section", "fig": "figure", "figs": "figure", "tbl": "table", "tbls": "table", "table": "table", "tables": "table", "eq": "equation", "eqs": "equation", "equation": "equation", "equations": "equation"}
LEADING = 0.8
ABSORB_LIMIT = 48


def kind_of(marker: Column) -> Column:
    return F.when(marker.rlike(NUMERIC), "NUMERIC").when(marker.rlike(YEAR), "AUTHOR_YEAR")


def marker_family(items: DataFrame) -> DataFrame:
    """Family of each paper where 80 % of its recognised markers agree."""
    k = kind_of(F.col("marker_fragment"))
    g = items.groupBy("paper_id").agg(F.count_if(k == "NUMERIC").alias("numeric"), F.count_if(k == "AUTHOR_YEAR").alias("author_year"))
    all_ = F.col("numeric") + F.col("author_year")
    family = F.when((all_ > 0) & (F.col("numeric") >= LEADING * all_), "NUMERIC").when((all_ > 0) & (F.col("author_year") >= LEADING * all_), "AUTHOR_YEAR").otherwise("UNKNOWN")
    return g.select("*", family.alias("family"))


def citation_style(items: DataFrame, least: int = 5) -> DataFrame:
    """Printing style and how sure it is; unlinked items are no evidence."""
    k = F.when(F.col("reference_id").isNotNull(), kind_of(F.col("marker_fragment")))
    g = items.groupBy("paper_id").agg(F.count_if(k == "NUMERIC").alias("numeric"), F.count_if(k == "AUTHOR_YEAR").alias("author_year"))
    all_, lead = F.col("numeric") + F.col("author_year"), F.greatest("numeric", "author_year")
    style = F.when(all_ < least, F.lit(None)).when(F.col("numeric") >= F.col("author_year"), "IEEE").otherwise("APA")
    sure = F.when(all_ < least, "UNKNOWN").when(lead >= LEADING * all_, "HIGH").otherwise("LOW")
    return g.select("*", style.alias("style"), sure.alias("confidence"))


def marker_mode(marker: Column) -> Column:
    """C03"""
    return F.when(marker.rlike(SUPPRESS_AUTHOR), "SUPPRESS_AUTHOR").when(~marker.rlike(r"^[(\[]") & marker.rlike(AUTHOR_IN_TEXT), "AUTHOR_IN_TEXT").otherwise("NORMAL")


def extract_locator(marker: Column) -> Column:
    """struct<label, value>, null without a locator."""
    word, value = F.lower(F.regexp_extract(marker, LOCATOR, 1)), F.regexp_extract(marker, LOCATOR, 2)
    names = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.when(word != "", F.struct(F.element_at(names, word).alias("label"), F.trim(F.regexp_replace(value, r"\s+", " ")).alias("value")))


def classify_prefix(prefix: Column, family: Column) -> Column:
    """C05"""
    p = F.trim(prefix)
    return F.when(p == "", "NONE").when(p.rlike(PREFIX_WORDS), "PREFIX").when(family == "AUTHOR_YEAR", "DEBRIS").otherwise("DEGRADED")


def parse_status(items: DataFrame, modifier: Column | None = None) -> DataFrame:
    """Status of each occurrence."""
    mod = F.lit(False) if modifier is None else modifier
    g = items.groupBy("paper_id", "citation_id").agg(F.count(F.lit(1)).alias("items"), F.bool_or(F.col("reference_id").isNull()).alias("_open"), F.bool_or(mod).alias("_mod"))
    status = F.when(F.col("_open"), "RAW_ONLY").when(F.col("_mod") & (F.col("items") > 1), "PARTIAL_MODIFIERS").otherwise("STRUCTURED")
    return g.select("paper_id", "citation_id", "items", status.alias("parse_status"))


def cluster_adjacent(pieces: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Markers with nothing but blanks between share a ``cluster`` number; pieces have kind and value."""
    w = W.partitionBy(*keys).orderBy(order)
    solid = (F.col("kind") == "text") & (F.trim("value") != "")
    p = pieces.withColumn("_block", F.sum(F.when(solid, 1).otherwise(0)).over(w))
    return p.where("kind = 'citation'").groupBy(*keys, F.col("_block").alias("cluster")).agg(F.count(F.lit(1)).alias("members"), F.min(order).alias("first"))


def absorb_opener(before: Column, marker: Column) -> Column:
    """The opening bracket and short text before a marker that closes it; empty if none."""
    tail = F.regexp_extract(before, r"([(\[][^()\[\]]*)$", 1)
    closer = F.when(F.substring(tail, 1, 1) == "(", r")").otherwise("]")
    ends = F.rtrim(F.regexp_replace(marker, r"[.,]?\s*$", "")).endswith(closer)
    inner = F.substring(tail, 2, 10_000)
    return F.when((tail != "") & ends & (F.length(inner) <= ABSORB_LIMIT) & ~inner.rlike("[.!?]"), tail).otherwise("")


def block_status(kind: Column, has_bytes: Column, has_rows: Column) -> Column:
    """Fidelity of a figure, table or formula."""
    return F.when((kind == "FIGURE") & ~has_bytes, "UNRENDERABLE").when((kind == "TABLE") & ~has_rows, "CONVERTED").otherwise("PRESERVED")


def source_boxes(c: Column) -> Column:
    """Distinct valid boxes of ``page,x,y,w,h;...``."""

    def box(s: Column) -> Column:
        p = F.split(s, ",", -1)
        num = lambda i: F.get(p, F.lit(i)).try_cast("double")
        return F.when(F.size(p) == 5, F.struct(F.get(p, F.lit(0)).try_cast("int").alias("page"), num(1).alias("x"), num(2).alias("y"), num(3).alias("width"), num(4).alias("height")))

    boxes = F.transform(F.split(c, ";", -1), box)
    fine = F.filter(boxes, lambda b: b.isNotNull() & (b["page"] >= 1) & b["x"].isNotNull() & b["y"].isNotNull() & (b["width"] > 0) & (b["height"] > 0))
    return F.array_distinct(fine)


def union_box(boxes: DataFrame, key: str) -> DataFrame:
    """C11: bounding box of a block's boxes, if all lie on one page."""
    g = boxes.groupBy(key).agg(F.min("page").alias("page"), F.max("page").alias("_last"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))
    return g.where("page = _last").drop("_last")


def mapping_diagnostics(items: DataFrame, refs: DataFrame) -> DataFrame:
    """One row of counts per paper."""
    m = F.col("marker_fragment")
    g = items.groupBy("paper_id").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("citation_id").alias("clusters"), F.count_if(F.col("reference_id").isNull()).alias("unlinked"), F.count_if(kind_of(m).isNull()).alias("unrecognised"))
    r = refs.groupBy("paper_id").agg(F.count(F.lit(1)).alias("refs"))
    return r.join(g, "paper_id", "left").na.fill(0).withColumn("out_of_scope", F.greatest(F.lit(0), F.col("refs") - F.col("items")))
