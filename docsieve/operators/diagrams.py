"""Diagram regions: scores of candidate pages, the chosen page, suggestions by text density, review of descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Parts of a candidate's score, and confidences.
BASE, IMAGE, SPARSE, DENSE, MOST = 0.4, 0.5, 0.1, 0.4, 0.05
FOUND, AMBIGUOUS, UNSEEN = 0.9, 0.5, 0.4
#: Box suggested for a page without words, and the margins of a suggested band.
WHOLE, MARGINS = (0.05, 0.05, 0.95, 0.6), (0.04, 0.96)


def candidate_scores(candidates: DataFrame, most: float = MOST, strict: bool = False) -> DataFrame:
    """``candidates`` (…, has_image, density) with score: 0.4, 0.5 more with a page image, 0.1 more if hardly any text lies within the box.

    With ``strict`` a box full of text loses 0.4. No score is below 0; a null density counts as 0.
    """
    sparse = F.coalesce("density", F.lit(0.0)) <= most
    score = F.lit(BASE) + F.when(F.col("has_image"), IMAGE).otherwise(0.0) + F.when(sparse, SPARSE).otherwise(-DENSE if strict else 0.0)
    return candidates.withColumn("score", F.round(F.greatest(score, F.lit(0.0)), 4))


def extract(scored: DataFrame, keys: tuple[str, ...] = ("document_id", "template_id"), strict: bool = False) -> DataFrame:
    """(keys, page_index, confidence, requires_review, flags): the best candidate page of each document, in declared order (pos) among equals.

    ``scored`` has pos, page_index, has_image, bbox_norm and score. A tie at the top from 0.5 is ambiguous, a later
    page than the first is told, a page without an image is uncertain; a box out of bounds gives nothing else.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")
    b = F.col("bbox_norm")
    valid = F.coalesce((b["x0"] >= 0) & (b["x0"] < b["x1"]) & (b["x1"] <= 1) & (b["y0"] >= 0) & (b["y0"] < b["y1"]) & (b["y1"] <= 1), F.lit(False))
    first = F.min("pos").over(Window.partitionBy(*keys))
    best = scored.where(b.isNotNull()).withColumn("_first", first).withColumn("_next", F.lead("score").over(w)).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    tie = F.coalesce(F.col("_next") == F.col("score"), F.lit(False)) & (F.col("score") >= 0.5)
    dense = F.lit(strict) & (F.col("score") < 0.6)
    none = F.expr("cast(array() as array<string>)")
    flags = F.concat(
        F.when(tie, F.array(F.lit("REGION_AMBIGUOUS"))).otherwise(none), F.when(F.col("pos") != F.col("_first"), F.array(F.lit("DIAGRAM_CANDIDATE_PAGE_USED"))).otherwise(none),
        F.when(~F.col("has_image"), F.array(F.lit("DIAGRAM_REGION_UNCERTAIN"))).when(dense, F.array(F.lit("DIAGRAM_CONTINUATION_UNCERTAIN"))).otherwise(none),
    )
    confidence = F.when(~valid, 0.0).when(~F.col("has_image"), UNSEEN).when(dense, F.col("score")).when(tie, AMBIGUOUS).otherwise(FOUND)
    review = ~valid | ~F.col("has_image") | dense | tie
    return best.select(*keys, "page_index", confidence.alias("confidence"), review.alias("requires_review"), F.when(valid, flags).otherwise(F.array(F.lit("DIAGRAM_REGION_OUT_OF_BOUNDS"))).alias("flags"))


def suggestions(bands: DataFrame, pages: DataFrame, n: int = 4) -> DataFrame:
    """(document_id, page_index, label, x0, y0, x1, y1, confidence): boxes suggested by how words are spread over ``n`` bands of a page.

    ``bands`` has band and n_words of every page, ``pages`` n_all, the words of a page with or without a
    box. A page without words gets one wide diagram box; else the emptiest band is the diagram, if it has fewer
    words than the fullest, which is the narrative; the first band among equals.
    """
    b = bands.groupBy("document_id", "page_index").agg(
        F.sum("n_words").alias("total"), F.max(F.struct("n_words", -F.col("band"))).alias("_most"), F.min(F.struct("n_words", F.col("band").alias("band"))).alias("_least"),
    )
    b = b.select("document_id", "page_index", F.greatest("total", F.lit(1)).alias("total"), (-F.col("_most.col2")).alias("dense"), F.col("_most.n_words").alias("dn"), F.col("_least.band").alias("sparse"), F.col("_least.n_words").alias("sn"))
    joined = pages.select("document_id", "page_index", F.coalesce("n_all", F.lit(0)).alias("n_all")).join(b, ["document_id", "page_index"])

    def box(label: str, band, confidence):
        return F.struct(F.lit(label).alias("label"), F.lit(MARGINS[0]).alias("x0"), (band / n).alias("y0"), F.lit(MARGINS[1]).alias("x1"), ((band + 1) / n).alias("y1"), F.round(confidence, 4).alias("confidence"))

    narrative = box("narrative", F.col("dense"), F.col("dn") / F.col("total"))
    diagram = box("diagram", F.col("sparse"), 1 - F.col("sn") / F.col("total"))
    whole = F.struct(F.lit("diagram").alias("label"), *(F.lit(v).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), WHOLE)), F.lit(0.3).alias("confidence"))
    found = F.when(F.col("n_all") == 0, F.array(whole)).when(F.col("sn") < F.col("dn"), F.array(diagram, narrative)).otherwise(F.array(narrative))
    return joined.select("document_id", "page_index", F.explode(found).alias("s")).select("document_id", "page_index", "s.*")


def described(descriptions: DataFrame, keywords: list[str], keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """(keys, agrees, flag): whether the first provider with a description names a diagram; a disagreement is told, errors and blanks are passed over."""
    w = Window.partitionBy(*keys).orderBy("chain_pos")
    first = descriptions.where("trim(description) <> ''").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    agrees = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower("description"), F.lower(k)))
    return first.select(*keys, agrees.alias("agrees"), F.when(~agrees, "VLM_CONFLICTS_WITH_DIAGRAM_REGION").alias("flag"))
