"""Regions over pages: page scores, the primary page, continuation over following pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.operators.templates import anchor_at, find_anchors

#: Pages that a region may continue over.
CONTINUED = 3


def narrative_regions(templates: DataFrame, region: str = "narrative") -> DataFrame:
    """(template_id, anchor_start, anchor_end) of a region of every template."""
    r = templates.select("template_id", F.element_at("regions", F.lit(region)).alias("r"))
    return r.select("template_id", F.col("r.anchor_start").alias("anchor_start"), F.col("r.anchor_end").alias("anchor_end"))


def page_scores(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(document_id, page_index, template_id, score): 1 with both anchors, 0.7 or 0.5 with one; 0.9 or 0.5 where only one is asked for; 0.3 where none is."""
    joined = pages.join(F.broadcast(regions), F.lit(True))
    a, b = F.col("anchor_start"), F.col("anchor_end")
    has_a, has_b = F.coalesce(anchor_at(F.col("text"), a) >= 0, F.lit(False)), F.coalesce(anchor_at(F.col("text"), b) >= 0, F.lit(False))
    both = F.when(has_a & has_b, 1.0).when(has_a, 0.7).when(has_b, 0.5).otherwise(0.0)
    score = F.when(a.isNull() & b.isNull(), 0.3).when(b.isNull(), F.when(has_a, 0.9).otherwise(0.0)).when(a.isNull(), F.when(has_b, 0.5).otherwise(0.0)).otherwise(both)
    return joined.select("document_id", "page_index", "template_id", score.alias("score"))


def primary(scores: DataFrame) -> DataFrame:
    """(document_id, template_id, page_index, score, ambiguous): the page with the best score above 0, the first among equals; ambiguous if another has the same from 0.7."""
    w = Window.partitionBy("document_id", "template_id").orderBy(F.desc("score"), "page_index")
    r = scores.withColumn("_r", F.row_number().over(w)).withColumn("_next", F.lead("score").over(w))
    return r.where("_r = 1 and score > 0").select("document_id", "template_id", "page_index", "score", ((F.col("score") >= 0.7) & F.coalesce(F.col("_next") == F.col("score"), F.lit(False))).alias("ambiguous"))


def shifted(scores: DataFrame, first: DataFrame, least: float = 0.5) -> DataFrame:
    """(document_id, template_id, page_index, score): for documents without a primary page, the best other page from ``least``."""
    rest = scores.join(first.select("document_id", "template_id"), ["document_id", "template_id"], "left_anti").where(F.col("score") >= least)
    w = Window.partitionBy("document_id", "template_id").orderBy(F.desc("score"), "page_index")
    return rest.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def continuation(pages: DataFrame, regions: DataFrame, first: DataFrame, most: int = CONTINUED) -> DataFrame:
    """(document_id, template_id, pages, end_found, chars): the extent of a region from its primary page on.

    It ends at the end anchor, searched after the start anchor on the primary page and from the top on
    later ones, or after ``most`` further pages; a region without end anchor keeps to its page.
    """
    start = first.select("document_id", "template_id", F.col("page_index").alias("_first")).join(F.broadcast(regions), "template_id")
    rows = start.join(pages.select("document_id", "page_index", "text"), "document_id").where("page_index >= _first")
    w = Window.partitionBy("document_id", "template_id").orderBy("page_index")
    rows = rows.withColumn("_k", F.row_number().over(w) - 1).where(F.col("_k") <= most)
    at = anchor_at(F.col("text"), F.col("anchor_start"))
    begin = F.when((F.col("_k") == 0) & (at >= 0), at + F.length("anchor_start")).otherwise(0)
    rows = rows.withColumn("_begin", begin)
    hit = F.when(F.col("anchor_end").isNull(), 0).otherwise(F.call_function("locate", F.lower("anchor_end"), F.lower(F.expr("substring(text, _begin + 1)"))))
    rows = rows.withColumn("_hit", hit).withColumn("_stop", F.min(F.when(F.col("_hit") > 0, F.col("_k"))).over(Window.partitionBy("document_id", "template_id")))
    kept = rows.where((F.col("anchor_end").isNotNull() & (F.col("_k") <= F.coalesce("_stop", F.lit(most)))) | (F.col("anchor_end").isNull() & (F.col("_k") == 0)))
    chars = F.when(F.col("_hit") > 0, F.col("_hit") - 1).otherwise(F.length("text") - F.col("_begin"))
    return kept.groupBy("document_id", "template_id").agg(F.count("*").alias("pages"), F.bool_or(F.col("_hit") > 0).alias("end_found"), F.sum(chars).cast("bigint").alias("chars"))


def confidence(text: str, start: str, end: str, start_found: str, end_found: str):
    """Confidence of an extraction: 0.9 with both anchors of two, 0.7 with the one asked for, 0.4 with an anchor missing, 0.3 where none is asked for, 0 for an empty text."""
    has_s, has_e = F.coalesce(F.col(start_found), F.lit(False)), F.coalesce(F.col(end_found), F.lit(False))
    two = F.col(start).isNotNull() & F.col(end).isNotNull()
    none = F.col(start).isNull() & F.col(end).isNull()
    return F.when(F.coalesce(F.col(text), F.lit("")) == "", 0.0).when(none, 0.3).when(two & has_s & has_e, 0.9).when(~two & (has_s | has_e), 0.7).otherwise(0.4)


def anchor_hits(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """(document_id, page_index, template_id, s, e): where the start and the end anchor of each template stand on a page, exactly or nearly; structs of offset, length, method and score."""
    sides = regions.select("template_id", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("anchor_start").alias("anchor")), F.struct(F.lit("e").alias("side"), F.col("anchor_end").alias("anchor")))).alias("a"))
    sides = sides.select("template_id", "a.side", "a.anchor").where("anchor <> ''")
    found = find_anchors(pages.select(F.struct("document_id", "page_index").alias("page"), "text"), sides.select("template_id", "anchor"), "page")
    named = found.join(F.broadcast(sides), ["template_id", "anchor"])  # two rows per template at most
    hit = F.struct("offset", "length", "method", "score")
    held = named.groupBy("page", "template_id").agg(F.max(F.when(F.col("side") == "s", hit)).alias("s"), F.max(F.when(F.col("side") == "e", hit)).alias("e"))
    every = pages.select("document_id", "page_index", F.struct("document_id", "page_index").alias("page")).join(F.broadcast(regions), F.lit(True))
    return every.join(held, ["page", "template_id"], "left").drop("page")


def fuzzy_page_scores(hits: DataFrame) -> DataFrame:
    """``hits`` with score: 1 with both anchors (0.92 if one is only similar), 0.7 or 0.5 with one of two (0.66, 0.46), 0.9 or 0.5 where only one is asked for (0.85, 0.46), 0.3 where none is."""
    a, b = F.coalesce("anchor_start", F.lit("")) != "", F.coalesce("anchor_end", F.lit("")) != ""
    s, e = F.coalesce(F.col("s.offset") >= 0, F.lit(False)), F.coalesce(F.col("e.offset") >= 0, F.lit(False))
    fs, fe = F.coalesce(F.col("s.method") == "fuzzy", F.lit(False)), F.coalesce(F.col("e.method") == "fuzzy", F.lit(False))
    both = F.when(s & e, F.when(fs | fe, 0.92).otherwise(1.0)).when(s, F.when(fs, 0.66).otherwise(0.7)).when(e, F.when(fe, 0.46).otherwise(0.5)).otherwise(0.0)
    start = F.when(s, F.when(fs, 0.85).otherwise(0.9)).otherwise(0.0)
    end = F.when(e, F.when(fe, 0.46).otherwise(0.5)).otherwise(0.0)
    return hits.withColumn("score", F.when(a & b, both).when(a, start).when(b, end).otherwise(0.3))


def extract(pages: DataFrame, regions: DataFrame, most: int = CONTINUED) -> DataFrame:
    """(document_id, template_id, page_index, text, confidence, requires_review, flags, spans_pages, anchor_start_found, anchor_end_found).

    ``regions`` has template_id, anchor_start and anchor_end and, where a template asks for them, pages (candidate
    page numbers, null for any), strategy (first_match or best_match), most (further pages), stops (section heads that
    end a region) and shift (whether other pages may be searched). The primary page is the best candidate, the first
    declared among equals; later pages are followed up to the end anchor, which is looked for as it is, or a stop.
    What is left of the pages when ``most`` is reached is told by NARRATIVE_CONTINUATION_TRUNCATED.
    """
    given = set(regions.columns)
    extra = {"pages": "array<int>", "strategy": "string", "most": "int", "stops": "array<string>", "shift": "boolean"}
    regions = regions.select("template_id", "anchor_start", "anchor_end", *(F.col(c).cast(t) if c in given else F.lit(None).cast(t).alias(c) for c, t in extra.items()))
    hits = fuzzy_page_scores(anchor_hits(pages, regions))
    place = F.when(F.col("pages").isNull(), F.col("page_index")).otherwise(F.array_position("pages", F.col("page_index")) - 1)
    rows = hits.withColumn("_pos", place).withColumn("_declared", F.col("_pos") >= 0)
    usable = F.col("_declared") & (F.col("score") > 0)
    other = ~F.col("_declared") & F.coalesce("shift", F.lit(False)) & (F.col("score") >= 0.5)
    first = F.when(F.col("strategy") == "first_match", F.lit(0.0)).otherwise(-F.col("score"))
    w = Window.partitionBy("document_id", "template_id").orderBy(F.col("_shifted"), "_by", "_pos", "page_index")
    ranked = rows.where(usable | other).withColumn("_shifted", ~F.col("_declared")).withColumn("_by", first)
    top = F.max(F.when(F.col("_declared"), F.col("score"))).over(Window.partitionBy("document_id", "template_id"))
    ties = F.sum(F.when(F.col("_declared") & (F.col("score") == F.col("_top")), 1).otherwise(0)).over(Window.partitionBy("document_id", "template_id"))
    ranked = ranked.withColumn("_top", top).withColumn("_ties", ties).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    primary_ = ranked.select("document_id", "template_id", F.col("page_index").alias("_first"), "_shifted", ((F.col("_top") >= 0.7) & (F.col("_ties") > 1)).alias("_ambiguous"), "s", "e", "anchor_start", "anchor_end", "stops", F.coalesce("most", F.lit(most)).alias("_most"))
    walk = primary_.join(pages.select("document_id", "page_index", "text"), "document_id").where("page_index >= _first")
    w = Window.partitionBy("document_id", "template_id").orderBy("page_index")
    walk = walk.withColumn("_k", F.row_number().over(w) - 1).withColumn("_last", F.max("page_index").over(Window.partitionBy("document_id", "template_id")))
    walk = walk.where((F.col("_k") == 0) | (F.col("anchor_end").isNotNull() & (F.col("_k") <= F.col("_most"))))
    on = F.col("_k") == 0
    begin = F.when(on & (F.col("s.offset") >= 0), F.col("s.offset") + F.col("s.length")).otherwise(0)
    walk = walk.withColumn("_begin", begin)
    raw = F.when(F.length("anchor_end") > 0, F.call_function("locate", F.lower("anchor_end"), F.lower("text"), F.col("_begin") + 1) - 1).otherwise(-1)
    near = F.when(on & (F.col("e.method") == "fuzzy") & (F.col("e.offset") >= F.col("_begin")), F.col("e.offset")).otherwise(-1)
    walk = walk.withColumn("_end", F.when(raw >= 0, raw).otherwise(near))
    heads = F.filter(F.transform(F.coalesce("stops", F.expr("cast(array() as array<string>)")), lambda h: F.call_function("locate", F.lower(h), F.lower("text"), F.lit(1)) - 1), lambda x: x >= 0)
    walk = walk.withColumn("_head", F.when(~on, F.array_min(heads)))
    stop = F.when((F.col("_end") >= 0) & (F.col("_head").isNull() | (F.col("_end") <= F.col("_head"))), F.col("_end")).otherwise(F.col("_head"))
    walk = walk.withColumn("_stop", stop).withColumn("_found", F.col("_stop").isNotNull() & (F.col("_stop") == F.col("_end")))
    ended = F.min(F.when(F.col("_stop").isNotNull(), F.col("_k"))).over(Window.partitionBy("document_id", "template_id"))
    walk = walk.withColumn("_at", ended).where(F.col("_k") <= F.coalesce("_at", F.col("_k")))
    chunk = F.regexp_replace(F.expr("substring(text, _begin + 1, coalesce(_stop, length(text)) - _begin)"), r"(?U)^\s+|\s+$", "")
    one = walk.groupBy("document_id", "template_id").agg(
        F.min("_first").alias("page_index"), F.array_sort(F.collect_list(F.when(chunk != "", F.struct("_k", chunk.alias("t"))))).alias("_chunks"), F.array_sort(F.collect_list("page_index")).alias("_pages"),
        F.bool_or("_found").alias("_found"), F.max("_at").alias("_at"), F.max("page_index").alias("_seen"), F.max("_last").alias("_last"), *(F.first(c).alias(c) for c in ("_shifted", "_ambiguous", "s", "e", "anchor_start", "anchor_end")),
    )
    text = F.array_join("_chunks.t", "\n")
    a, b = (F.coalesce(c, F.lit("")) != "" for c in ("anchor_start", "anchor_end"))
    has_s, has_e = F.coalesce(F.col("s.offset") >= 0, F.lit(False)) & a, F.coalesce("_found", F.lit(False)) & b
    asked, got = a.cast("int") + b.cast("int"), has_s.cast("int") + has_e.cast("int")
    many, truncated = F.size("_pages") > 1, b & ~has_e & F.col("_at").isNull() & (F.col("_seen") < F.col("_last"))
    similar = (F.coalesce(F.col("s.method") == "fuzzy", F.lit(False)) & has_s) | (F.coalesce(F.col("e.method") == "fuzzy", F.lit(False)) & has_e)
    none = F.expr("cast(array() as array<string>)")
    flags = F.concat(*(F.when(c, F.array(F.lit(n))).otherwise(none) for c, n in (
        (F.col("_ambiguous"), "REGION_AMBIGUOUS"), (F.col("_shifted"), "REGION_SHIFTED_PAGE"), (many, "NARRATIVE_CONTINUED"), (many, "NARRATIVE_SPANS_PAGES"), (truncated, "NARRATIVE_CONTINUATION_TRUNCATED"),
        (many & b & ~has_e, "NARRATIVE_CONTINUATION_ANCHOR_MISSING"), (got < asked, "NARRATIVE_ANCHORS_NOT_FOUND"), (similar, "NARRATIVE_ANCHORS_FUZZY_MATCHED"), (text == "", "NARRATIVE_EMPTY"), (asked == 0, "NARRATIVE_BOUNDARIES_UNCERTAIN"),
    )))
    sure = F.when(text == "", 0.0).when(asked == 0, 0.3).when((asked == 2) & (got == 2), 0.9).when((asked == 1) & (got == 1), 0.7).otherwise(0.4)
    sure = F.when(F.col("_ambiguous"), F.least(sure, F.lit(0.5))).otherwise(sure)
    review = F.col("_ambiguous") | F.col("_shifted") | (got < asked) | (text == "") | (asked == 0)
    return one.select("document_id", "template_id", "page_index", text.alias("text"), sure.alias("confidence"), review.alias("requires_review"), flags.alias("flags"), F.col("_pages").alias("spans_pages"), has_s.alias("anchor_start_found"), has_e.alias("anchor_end_found"))
