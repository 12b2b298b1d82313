"""Builders of the document model: words from characters, pages from words, documents from pages, and their JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window


def words_of_chars(chars: DataFrame, keys: tuple[str, ...] = ("document_id", "page_index"), dpi: float = 200.0) -> DataFrame:
    """(keys, ord, text, bbox, confidence): the words of a text layer given by its characters.

    ``chars`` has seq, ch, left, bottom, right and top in points from the lower left corner, and the page height.
    White space parts words. Boxes are the hulls of the characters' boxes in pixels from the upper left corner.
    """
    blank = F.col("ch").rlike(r"(?U)^\s*$")
    w = Window.partitionBy(*keys).orderBy("seq")
    rows = chars.withColumn("_blank", blank).withColumn("_ord", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~F.col("_blank"))
    s = dpi / 72
    hull = F.struct(
        (F.min("left") * s).alias("x0"), ((F.max("height") - F.max("top")) * s).alias("y0"), (F.max("right") * s).alias("x1"), ((F.max("height") - F.min("bottom")) * s).alias("y1"),
    )
    words = rows.groupBy(*keys, "_ord").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seq", "ch")))["ch"], "").alias("text"), hull.alias("bbox"))
    order = Window.partitionBy(*keys).orderBy("_ord")
    return words.select(*keys, (F.row_number().over(order) - 1).alias("ord"), "text", "bbox", F.lit(1.0).alias("confidence"))


def pages_of_words(words: DataFrame, provider: str, kind: str) -> DataFrame:
    """(document_id, page_index, text_source, words): pages with their words in order, ids and provenance.

    ``kind`` is ocr, native or vlm_spatial. A word has a place on the page if its provider says so
    (mappable, true where it is not given) and it has a box. Null texts count as empty.
    """
    mappable = F.coalesce("mappable", F.lit(True)) if "mappable" in words.columns else F.lit(True)
    word = F.struct(
        F.col("ord"), F.format_string("p%d_w%05d", F.col("page_index"), F.col("ord")).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("bbox"), F.coalesce("confidence", F.lit(1.0) if kind == "native" else F.lit(None)).alias("confidence"),
        F.lit(provider).alias("source"), F.lit(kind).alias("source_provider_type"), (mappable & F.col("bbox").isNotNull()).alias("can_map_to_image_coordinates"),
    )
    held = words.groupBy("document_id", "page_index").agg(F.sort_array(F.collect_list(word)).alias("words"))
    return held.select("document_id", "page_index", F.lit(kind).alias("text_source"), "words")


def documents_of_pages(pages: DataFrame, suffix: str = "", notes: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, pages, provenance): pages in order of their index; the pipeline's provenance first, then each provider of a page once, then ``notes``."""
    page = F.struct("page_index", "text_source", "words")
    held = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    sources = F.array_distinct(F.flatten(F.transform("pages", lambda p: F.transform(p["words"], lambda x: x["source"]))))
    provenance = F.concat(F.array(F.lit("pipeline")), sources, F.array(*map(F.lit, notes)) if notes else F.expr("cast(array() as array<string>)"))
    return held.select(F.concat("document_id", F.lit(suffix)).alias("document_id"), "pages", provenance.alias("provenance"))


def to_json(documents: DataFrame) -> DataFrame:
    """(document_id, json): documents as JSON, with nulls."""
    return documents.select("document_id", F.to_json(F.struct(*documents.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json(texts: DataFrame, schema: StructType) -> DataFrame:
    """Documents of their JSON; a text that is none, or has unknown keys at its top, gives null fields and ``error``."""
    parsed = F.from_json("json", schema, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys("json")
    unknown = F.size(F.array_except(keys, F.array(*map(F.lit, schema.fieldNames())))) > 0
    bad = keys.isNull() | unknown
    rows = texts.select(bad.alias("_bad"), parsed.alias("d"))
    return rows.select(*(F.when(~F.col("_bad"), F.col(f"d.{f.name}")).alias(f.name) for f in schema.fields), F.when(F.col("_bad"), "INVALID_DOCUMENT").alias("error"))


def to_json_parts(pages: DataFrame, suffix: str = "", notes: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, kind, page_index, json): the JSON of documents_of_pages() in parts, none of which grows with its document.

    A document has a part of kind page for each page, and one of kind shell, which has no pages. Its JSON is the shell with the
    parts of its pages, joined by commas in order, between the brackets of ``pages``. ``pages`` has one row per page.
    """
    key = F.concat("document_id", F.lit(suffix)).alias("document_id")
    page = F.struct("page_index", "text_source", "words")
    texts = pages.select(key, F.lit("page").alias("kind"), "page_index", F.to_json(page, {"ignoreNullFields": "false"}).alias("json"))
    first = pages.select("document_id", "page_index", F.posexplode(F.array_distinct(F.transform("words", lambda x: x["source"]))).alias("at", "source"))
    sources = first.groupBy("document_id", "source").agg(F.min(F.struct("page_index", "at")).alias("at"))  # a row for each provider of a document
    held = sources.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("at", "source")))["source"].alias("sources"))
    provenance = F.concat(F.array(F.lit("pipeline")), "sources", F.array(*map(F.lit, notes)) if notes else F.expr("cast(array() as array<string>)"))
    shell = F.struct(key, F.expr("cast(array() as array<string>)").alias("pages"), provenance.alias("provenance"))
    return texts.unionByName(held.select(key, F.lit("shell").alias("kind"), F.lit(None).cast("int").alias("page_index"), F.to_json(shell, {"ignoreNullFields": "false"}).alias("json")))


def from_json_parts(parts: DataFrame, schema: StructType) -> DataFrame:
    """(document_id, kind, page_index, json, page, shell, error): the parts of to_json_parts() with what they hold; ``schema`` is that of the documents."""
    shape = schema["pages"].dataType.elementType
    whole = F.col("kind") == "shell"
    page, shell = (F.from_json("json", s, {"mode": "PERMISSIVE"}) for s in (shape, schema))
    known = F.when(whole, F.array(*map(F.lit, schema.fieldNames()))).otherwise(F.array(*map(F.lit, shape.fieldNames())))
    keys = F.json_object_keys("json")
    bad = keys.isNull() | (F.size(F.array_except(keys, known)) > 0)
    return parts.select("document_id", "kind", "page_index", "json", F.when(~bad & ~whole, page).alias("page"), F.when(~bad & whole, shell).alias("shell"), F.when(bad, "INVALID_DOCUMENT").alias("error"))


def routed(pages: DataFrame, native: DataFrame, ocr: DataFrame) -> DataFrame:
    """Page tables put together by route: pages with a text layer come from ``native``, the others from ``ocr``; only these are read."""
    has = pages.select("document_id", "page_index", F.coalesce("has_text", F.lit(False)).alias("_native"))
    keys = ["document_id", "page_index"]
    return native.join(has.where("_native"), keys, "left_semi").unionByName(ocr.join(has.where("not _native"), keys, "left_semi"))


def with_alternatives(words: DataFrame, reconciled: DataFrame, generative: bool = False) -> DataFrame:
    """(word_key, alternatives, flags): readings of other providers that overlap a word, in order, and the flags they raise.

    ``reconciled`` has word_key (the base word), alt_ord, provider, text, bbox and outcome.
    """
    alt = F.struct("alt_ord", "provider", "text", "bbox")
    flag = F.when(F.col("outcome") == "CONFLICT", "VLM_OUTPUT_CONFLICTS_WITH_OCR").when(F.col("outcome") == "NO_BBOX", "VLM_OUTPUT_HAS_NO_BBOXES").when(F.col("outcome") == "NO_OVERLAP", "VLM_USED_FOR_EXTRACTION")
    review = F.array(F.lit("VLM_GENERATIVE_OUTPUT_REQUIRES_REVIEW")) if generative else F.expr("cast(array() as array<string>)")
    held = reconciled.groupBy("word_key").agg(F.sort_array(F.collect_list(F.when(F.col("outcome").isin("CONFLICT", "AGREES"), alt))).alias("alternatives"), F.array_sort(F.collect_set(flag)).alias("flags"))
    held = held.withColumn("flags", F.array_distinct(F.concat("flags", review)))
    empty = F.expr("cast(array() as array<string>)")
    return words.select("word_key").join(held, "word_key", "left").select("word_key", "alternatives", F.coalesce("flags", empty).alias("flags"))


def schema_of(documents: DataFrame) -> StructType:
    """The schema that from_json() needs for documents of this kind."""
    assert isinstance(documents.schema["pages"].dataType, ArrayType)
    return documents.schema
