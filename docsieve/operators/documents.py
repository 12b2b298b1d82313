"""Document model: page texts, routing, confidence, alternative words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page_text(words: DataFrame, keys: tuple[str, ...] = ("document_id", "page_index")) -> DataFrame:
    """(keys, text, n_words): the texts of a page's words joined by single spaces in reading order; null texts count as empty."""
    w = words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))).alias("ws"))
    return w.select(*keys, F.array_join("ws.text", " ").alias("text"), F.size("ws").cast("bigint").alias("n_words"))


def document_text(pages: DataFrame) -> DataFrame:
    """(document_id, text): page texts joined by a space in page order."""
    p = pages.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_index", "text"))).alias("ps"))
    return p.select("document_id", F.array_join("ps.text", " ").alias("text"))


def confidence(words: DataFrame) -> DataFrame:
    """(document_id, avg_confidence): the mean of the known word confidences, null if none is known."""
    return words.groupBy("document_id").agg(F.avg("confidence").alias("avg_confidence"))


def route(pages: DataFrame) -> DataFrame:
    """(document_id, route, n_native, n_ocr): pages with a text layer are read natively, the others recognised; a document of both is mixed."""
    native = F.coalesce(F.col("has_text"), F.lit(False))
    p = pages.groupBy("document_id").agg(F.sum(native.cast("bigint")).alias("n_native"), F.sum((~native).cast("bigint")).alias("n_ocr"))
    return p.select("document_id", F.when(F.col("n_ocr") == 0, "native").when(F.col("n_native") == 0, "ocr").otherwise("mixed").alias("route"), "n_native", "n_ocr")


def first_success(outputs: DataFrame, keys: tuple[str, ...], position: str, ok: str) -> DataFrame:
    """Of the outputs of a provider chain, the first successful one per key by chain position; keys without any success are left out, not failed."""
    w = Window.partitionBy(*keys).orderBy(position)
    return outputs.where(F.col(ok)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def alternatives(words: DataFrame) -> DataFrame:
    """(word_key, document_id, page_index, alt_ord, provider, text, bbox): one row per alternative reading of a word."""
    return words.select("word_key", "document_id", "page_index", F.posexplode("alternatives").alias("alt_ord", "a")).select("word_key", "document_id", "page_index", "alt_ord", F.col("a.provider").alias("provider"), F.col("a.text").alias("text"), F.col("a.bbox").alias("bbox"))


def disagree(a, b):
    """Whether two readings differ in letters or digits, case apart."""
    def bare(c):
        return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))

    return bare(a) != bare(b)


def best_overlap(base: DataFrame, alts: DataFrame, band: float = 200.0) -> DataFrame:
    """(alt keys, word_key, area, base_text): for each alternative word with a box, the base word of the page with the largest common area.

    Ties go to the first word. Rectangles must share a positive area. Pages are cut into bands of
    ``band`` pixels, so that only words of neighbouring heights meet; a box is in every band it touches.
    """
    def bands(df: DataFrame, box: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col(f"{box}.y0") / band), F.floor(F.greatest(F.col(f"{box}.y1"), F.col(f"{box}.y0")) / band))
        return df.where(F.col(f"{box}.y0").isNotNull() & F.col(f"{box}.y1").isNotNull()).withColumn("_band", F.explode(cells))

    b = bands(base.select("document_id", "page_index", "word_key", "ord", F.col("text").alias("base_text"), F.col("bbox").alias("bb")), "bb")
    a = bands(alts, "bbox")
    joined = a.join(b.withColumnRenamed("word_key", "base_key"), ["document_id", "page_index", "_band"])
    wide = F.least("bbox.x1", "bb.x1") - F.greatest("bbox.x0", "bb.x0")
    high = F.least("bbox.y1", "bb.y1") - F.greatest("bbox.y0", "bb.y0")
    hits = joined.withColumn("area", wide * high).where((wide > 0) & (high > 0))
    best = hits.groupBy("word_key", "alt_ord").agg(F.min_by(F.struct("base_key", "area", "base_text"), F.struct(-F.col("area"), F.col("ord"), F.col("base_key"))).alias("b"))
    return best.select("word_key", "alt_ord", F.col("b.base_key").alias("base_key"), F.col("b.area").alias("area"), F.col("b.base_text").alias("base_text"))


def reconcile(base: DataFrame, alts: DataFrame) -> DataFrame:
    """(word_key, alt_ord, provider, outcome): NO_BBOX, NO_OVERLAP, CONFLICT or AGREES for each alternative word."""
    best = best_overlap(base, alts)
    joined = alts.join(best, ["word_key", "alt_ord"], "left")
    outcome = F.when(F.col("bbox").isNull(), "NO_BBOX").when(F.col("base_key").isNull(), "NO_OVERLAP").when(disagree(F.coalesce("text", F.lit("")), F.coalesce("base_text", F.lit(""))), "CONFLICT").otherwise("AGREES")
    return joined.select("word_key", "alt_ord", "provider", outcome.alias("outcome"))


def density_bands(words: DataFrame, pages: DataFrame, bands: int = 4) -> DataFrame:
    """(document_id, page_index, band, n_words): words with a box per horizontal band of a page by the middle of the box; empty bands count 0."""
    middle = (F.col("bbox.y0") + F.col("bbox.y1")) / 2
    at = words.where("bbox is not null").join(pages.select("document_id", "page_index", "height"), ["document_id", "page_index"])
    band = F.least(F.greatest(F.floor(middle * bands / F.col("height")), F.lit(0)), F.lit(bands - 1)).cast("int")
    counted = at.where("height > 0").groupBy("document_id", "page_index", band.alias("band")).agg(F.count("*").alias("n_words"))
    every = pages.select("document_id", "page_index", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    return every.join(counted, ["document_id", "page_index", "band"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))


def text_density(words: DataFrame, box: tuple[float, float, float, float], pages: DataFrame) -> DataFrame:
    """(document_id, page_index, density): 100 times the words touching a relative box, by its area and by the words with a box; 0 without such words."""
    x0, y0, x1, y1 = box
    at = words.where("bbox is not null").join(pages.select("document_id", "page_index", "width", "height"), ["document_id", "page_index"])
    hit = (F.col("bbox.x1") >= x0 * F.col("width")) & (F.col("bbox.x0") <= x1 * F.col("width")) & (F.col("bbox.y1") >= y0 * F.col("height")) & (F.col("bbox.y0") <= y1 * F.col("height"))
    grouped = at.groupBy("document_id", "page_index", "width", "height").agg(F.sum(hit.cast("int")).alias("hits"), F.count("*").alias("boxed"))
    area = (x1 - x0) * (y1 - y0) * F.col("width") * F.col("height")
    found = grouped.select("document_id", "page_index", F.when(area > 0, F.col("hits") / area / F.col("boxed") * 100).alias("density"))
    return pages.select("document_id", "page_index").join(found, ["document_id", "page_index"], "left").withColumn("density", F.coalesce("density", F.lit(0.0)))


def to_pixels(box, width, height):
    """A relative box in whole pixels, truncated and clamped to the page."""
    def at(c, size):
        return F.greatest(F.lit(0), F.least(F.floor(c * size).cast("int"), size))

    return F.struct(at(box["x0"], width).alias("x0"), at(box["y0"], height).alias("y0"), at(box["x1"], width).alias("x1"), at(box["y1"], height).alias("y1"))
