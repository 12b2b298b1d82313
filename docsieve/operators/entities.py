"""Merging of entity spans, their boxes, safe redaction and audit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _islands(spans: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds island: a number shared by spans of the same keys that strictly overlap, directly or through others."""
    w = Window.partitionBy(*keys).orderBy(*order)
    reach = F.max("end_offset").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = (reach.isNull() | (reach <= F.col("start_offset"))).cast("int")
    return spans.withColumn("_starts", starts).withColumn("island", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def merge(entities: DataFrame, keys: tuple[str, ...] = ("narrative_id", "page_index", "scope", "entity_type"), tie: str = "entity_id") -> DataFrame:
    """One row per group of overlapping spans of one type, page and scope: the union span, the greatest confidence, all providers.

    Touching spans are not merged. Text and provider are those of the first span (by start, the longer
    first). Spans without offsets are kept as they are. Entities of different types never merge.
    """
    k = list(keys)
    known = _islands(entities.where("start_offset is not null and end_offset is not null"), k, [F.col("start_offset"), F.desc("end_offset"), F.col(tie)])
    order = F.struct(F.col("start_offset"), -F.col("end_offset"), F.col(tie))
    merged = known.groupBy(*k, "island").agg(
        F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.max("confidence").alias("confidence"), F.min_by("text", order).alias("text"), F.min_by("provider", order).alias("provider"),
        F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.count("*").alias("members"),
    ).drop("island")
    loose = entities.where("start_offset is null or end_offset is null").select(*k, "start_offset", "end_offset", "confidence", "text", "provider", F.col("provider").alias("providers"), F.lit(1).cast("bigint").alias("members"))
    return merged.unionByName(loose)


def crossing(merged: DataFrame, text_keys: tuple[str, ...] = ("narrative_id", "page_index", "scope")) -> DataFrame:
    """Pairs of overlapping spans of different types in one text, the alphabetically first type on the left: a range join within the text."""
    spans = merged.where("start_offset is not null and end_offset is not null").select(*text_keys, "entity_type", "start_offset", "end_offset")
    a, b = spans.alias("a"), spans.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in text_keys]
    near = (F.col("a.start_offset") < F.col("b.end_offset")) & (F.col("b.start_offset") < F.col("a.end_offset"))
    joined = a.join(b, [*same, F.col("a.entity_type") < F.col("b.entity_type"), near])
    return joined.select(*(F.col(f"a.{k}") for k in text_keys), F.col("a.entity_type").alias("left_type"), F.col("b.entity_type").alias("right_type"), F.col("a.start_offset").alias("left_start"), F.col("b.start_offset").alias("right_start"))


def resolve(entities: DataFrame, key: str = "narrative_id") -> DataFrame:
    """(key, start_offset, end_offset, entity_type): disjoint spans, overlaps of any types joined and named after the longest member."""
    spans = _islands(entities.select(key, "entity_type", "start_offset", "end_offset").where("start_offset >= 0 and end_offset > start_offset").distinct(), [key], [F.col("start_offset"), F.desc("end_offset"), F.col("entity_type")])
    longest = F.struct(F.col("start_offset") - F.col("end_offset"), F.col("start_offset"), F.col("entity_type"))
    return spans.groupBy(key, "island").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.min_by("entity_type", longest).alias("entity_type")).drop("island")


def redact(texts: DataFrame, spans: DataFrame, key: str = "narrative_id", text: str = "text", mode: str = "safe") -> DataFrame:
    """(key, redacted_text): texts with each span replaced by [TYPE]. Spans that end beyond the text are left out.

    ``safe`` resolves overlaps first, so that no character of any span survives. ``compat`` splices
    the spans as they are from right to left by their original offsets, which leaks on overlaps; it is
    for comparison only.
    """
    texts = texts.select(F.col(key), F.col(text).alias("_text")).where("_text is not null")
    sized = spans.join(texts.select(key, F.length("_text").alias("_n")), key).where("end_offset <= _n and start_offset >= 0 and end_offset > start_offset").drop("_n")
    chosen = resolve(sized, key) if mode == "safe" else sized
    one = F.struct(F.col("start_offset").alias("s"), F.col("end_offset").alias("e"), F.col("entity_type").alias("t"))
    lists = chosen.groupBy(key).agg(F.sort_array(F.collect_list(one), asc=False).alias("_spans"))

    def splice(acc: Column, x: Column) -> Column:
        return F.concat(F.substring(acc, F.lit(1), x["s"]), F.lit("["), x["t"], F.lit("]"), F.substring(acc, x["e"] + 1, F.length(acc)))

    joined = texts.join(lists, key, "left")
    return joined.select(key, F.when(F.col("_spans").isNull(), F.col("_text")).otherwise(F.aggregate("_spans", F.col("_text"), splice)).alias("redacted_text"))


def word_offsets(words: DataFrame, keys: tuple[str, ...] = ("document_id", "page_index"), order: str = "ord") -> DataFrame:
    """``words`` with start_offset and end_offset in the page text, words joined by single spaces; null texts count as empty."""
    n = F.length(F.coalesce("text", F.lit("")))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n + 1).over(w), F.lit(0))
    return words.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + n)


def boxes(entities: DataFrame, offsets: DataFrame, keys: tuple[str, ...] = ("document_id", "page_index"), entity: str = "entity_id") -> DataFrame:
    """(entity, x0, y0, x1, y1, mapped): the hull of the boxes of the words that a span overlaps; not mapped without offsets or boxes."""
    e, w = entities.alias("e"), offsets.alias("w")
    on = [F.col(f"e.{k}") == F.col(f"w.{k}") for k in keys] + [F.col("w.start_offset") < F.col("e.end_offset"), F.col("w.end_offset") > F.col("e.start_offset")]
    hull = e.join(w, on).groupBy(F.col(f"e.{entity}").alias(entity)).agg(*(F.min(f"w.bbox.{c}").alias(c) for c in ("x0", "y0")), *(F.max(f"w.bbox.{c}").alias(c) for c in ("x1", "y1")))
    return entities.select(entity).join(hull, entity, "left").withColumn("mapped", F.col("x0").isNotNull())
