"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import abuse, lookalike, mixture, personal, scans, splitting, tokens, truncation
from docsieve.session import once, shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d).where("truncated").select("narrative_id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_p1(spark, d))


def _p1(spark: SparkSession, d: str) -> DataFrame:
    return truncation.score(table(spark, d, "narratives"), table(spark, d, "anchor_spans"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.find(table(spark, d, "narratives"), _headers(spark, d), table(spark, d, "entities")).select("narrative_id", "entity_type", "start_offset")


def p2_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal.masked(table(spark, d, "narratives"), _headers(spark, d), table(spark, d, "entities"))


def _headers(spark: SparkSession, d: str) -> DataFrame:
    return scans.recurring(table(spark, d, "narratives"), table(spark, d, "ocr_lines"), table(spark, d, "templates"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.find(*_p3(spark, d))


def p3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.repair(*_p3(spark, d))


def p3_words(spark: SparkSession, d: str) -> DataFrame:
    return scans.misread_words(*_p3(spark, d))


def _p3(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, name) for name in ("narratives", "ocr_lines", "templates", "words"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _p4(spark, d)[0].select(F.col("item").alias("narrative_id")).distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    pages = once(table(spark, d, "narratives").select("narrative_id", "spans_pages"), "narrative_id")
    return _p4(spark, d)[1].withColumnRenamed("item", "narrative_id").join(pages, "narrative_id")


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of one text file for each source of narratives, written to the shared folder and split by byte ranges."""
    folder = shared_folder(spark, "p4_files")
    texts = once(table(spark, d, "narratives").select("narrative_id", F.coalesce("source", F.lit("unknown")).alias("source"), "text"), "narrative_id").where("text <> ''")
    texts.repartition("source").sortWithinPartitions("source", "narrative_id").select("text", "source").write.partitionBy("source").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    paths = sorted(r.path for r in files.select("path").collect())  # one for each source
    pieces = splitting.split_files(spark, paths, 4000, 200, size=1 << 18)
    return pieces.withColumn("source", F.regexp_extract("item", "/source=([^/]*)/", 1)).select("source", "piece", "start_offset", "end_offset", "text")


def _p4(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return splitting.split_items(table(spark, d, "narratives"), table(spark, d, "split_limits"), "narrative_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.deviating(_p5(spark, d), "unit", "unit_id", column="text")


def p5_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical(once(_p5(spark, d), "unit", "unit_id"), "text").select("unit", "unit_id", "canonical_text")


def _p5(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of values in one set of classes, so that equal-looking values of words and entities get the same form."""
    words = table(spark, d, "words").select(F.lit("word").alias("unit"), F.col("word_key").alias("unit_id"), "text")
    entities = table(spark, d, "entities").select(F.lit("entity").alias("unit"), F.col("entity_id").alias("unit_id"), F.col("normalized_text").alias("text"))
    return words.unionByName(entities)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    return tokens.decode(p6_ids(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.report(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _p8(spark, d).where("found").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_p8(spark, d))


def _p8(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents"), table(spark, d, "review_samples"))


def queries() -> dict[str, Query]:
    fs = [p1_found, p1_rates, p2_found, p2_masked, p3_found, p3_paragraphs, p3_words, p4_found, p4_pieces, p4_files, p5_found, p5_canonical, p6_ids, p6_decoded, p7_mixture, p7_shares, p8_found, p8_rates]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": """
            SELECT DISTINCT n.narrative_id FROM narratives n LEFT JOIN split_limits l ON l.source = n.source
            WHERE length(n.text) > coalesce(l.max_chars, (SELECT max_chars FROM split_limits WHERE source = '*'))""",
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
