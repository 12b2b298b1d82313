"""Quality gate over extractions: flags, blocking and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Flags that always block an export.
BLOCKING = (
    "TEMPLATE_UNKNOWN", "TEMPLATE_LOW_CONFIDENCE", "DIAGRAM_REGION_UNCERTAIN", "DIAGRAM_REGION_OUT_OF_BOUNDS", "DIAGRAM_CONTINUATION_UNCERTAIN", "REGION_AMBIGUOUS",
    "NARRATIVE_BOUNDARIES_UNCERTAIN", "NARRATIVE_ANCHORS_NOT_FOUND", "NARRATIVE_EMPTY", "NARRATIVE_CONTINUATION_ANCHOR_MISSING", "PII_UNMAPPED", "VLM_OUTPUT_CONFLICTS_WITH_OCR",
)

# Flags that ask for a person's review without blocking an export.
REVIEWED = (
    "LAYOUTLM_PLUGIN_USED", "LAYOUTLM_REGION_SUGGESTION", "LAYOUTLM_FALLBACK_USED", "LAYOUTLM_CONFLICT_WITH_TEMPLATE", "LAYOUTLM_REQUIRES_REVIEW", "LAYOUTLM_LICENSE_REVIEW_REQUIRED",
    "LLM_PROVIDER_USED", "LLM_REGION_SUGGESTION", "LLM_ANCHOR_SUGGESTION", "LLM_QA_SECOND_OPINION", "LLM_EXTERNAL_PROVIDER_USED", "LLM_REQUIRES_REVIEW", "LLM_OUTPUT_UNMAPPED", "LLM_CONFLICT_WITH_TEMPLATE",
)
CONFLICT, GENERATIVE = "VLM_OUTPUT_CONFLICTS_WITH_OCR", "VLM_GENERATIVE_OUTPUT_REQUIRES_REVIEW"
# The reasons an export is blocked for.
REASONS = {
    "unknown": "Template is UNKNOWN; GOVERNANCE.md requires human review for unknown templates.", "low": "Template confidence %.2f below threshold %.2f.",
    "no_diagram": "Template declares no diagram region or extraction returned None.", "diagram": "Diagram extraction requires review (confidence %.2f).",
    "no_narrative": "Template declares no narrative region or extraction returned None.", "narrative": "Narrative extraction requires review (confidence %.2f).",
    "unmapped": "%d PII entit%s could not be mapped to image coordinates; redaction is unsafe.", "conflict": "VLM output disagrees with OCR/native text — review required.",
}


def report(rows: DataFrame, key: str = "document_id", least: float = 0.85) -> DataFrame:
    """(key, export_decision, export_blocked, blocking_reasons, qa_flags, requires_human_review, confidences, counts), failing closed.

    ``rows`` has template_id, template_confidence, pages_in_range, diagram and narrative (structs of
    flags, requires_review and confidence, null where nothing was extracted), pii_entity_count,
    pii_unmapped_count and vlm_flags. Reasons come in the order of the rules, flags sorted and once
    each. A blocking flag that no reason names adds one of its own. Null marks count as not set, a
    null confidence as below the threshold, a null template as unknown.
    """
    none = F.expr("cast(array() as array<string>)")
    name = F.coalesce("template_id", F.lit("UNKNOWN"))
    known, sure = name != "UNKNOWN", F.coalesce(F.col("template_confidence"), F.lit(0.0))
    vlm = F.coalesce("vlm_flags", none)

    def some(condition, *values):
        return F.when(condition, F.array(*(v if not isinstance(v, str) else F.lit(v) for v in values))).otherwise(none)

    def part(column: str, flag: str):
        given, review = F.col(column).isNotNull(), F.coalesce(F.col(f"{column}.requires_review"), F.lit(False))
        flags = F.when(known & given, F.coalesce(F.col(f"{column}.flags"), none)).when(known, F.array(F.lit(flag))).otherwise(none)
        reasons = F.concat(some(known & ~given, REASONS[f"no_{column}"]), some(known & given & review, F.format_string(REASONS[column], F.col(f"{column}.confidence"))))
        return flags, reasons

    diagram, narrative = part("diagram", "DIAGRAM_REGION_UNCERTAIN"), part("narrative", "NARRATIVE_BOUNDARIES_UNCERTAIN")
    unmapped = F.coalesce("pii_unmapped_count", F.lit(0)).cast("bigint")
    flags = F.concat(
        some(~known, "TEMPLATE_UNKNOWN"), some(sure < least, "TEMPLATE_LOW_CONFIDENCE"), some(~F.coalesce("pages_in_range", F.lit(False)), "TEMPLATE_PAGE_COUNT_OUT_OF_RANGE"),
        diagram[0], narrative[0], some(unmapped > 0, "PII_UNMAPPED"), vlm,
    )
    reasons = F.concat(
        some(~known, REASONS["unknown"]), some(known & (sure < least), F.format_string(REASONS["low"], sure, F.lit(least))), diagram[1], narrative[1],
        some(unmapped > 0, F.format_string(REASONS["unmapped"], unmapped, F.when(unmapped == 1, "y").otherwise("ies"))),
        F.transform(F.filter(vlm, lambda f: f == CONFLICT), lambda _: F.lit(REASONS["conflict"])),
    )
    held = rows.withColumn("_flags", F.filter(flags, lambda f: f.isNotNull())).withColumn("_reasons", reasons)
    unnamed = F.filter(F.array_distinct("_flags"), lambda f: f.isin(*BLOCKING) & ~F.exists("_reasons", lambda r: F.contains(r, f)))
    held = held.withColumn("_reasons", F.concat("_reasons", F.transform(unnamed, lambda f: F.concat(f, F.lit(" requires review")))))
    blocked = F.size("_reasons") > 0
    review = blocked | (sure < least) | F.arrays_overlap("_flags", F.array(*map(F.lit, (*REVIEWED, GENERATIVE))))
    return held.select(
        key, F.when(blocked, "BLOCK").otherwise("ALLOW").alias("export_decision"), blocked.alias("export_blocked"), F.col("_reasons").alias("blocking_reasons"), F.array_sort(F.array_distinct("_flags")).alias("qa_flags"),
        F.coalesce(review, F.lit(False)).alias("requires_human_review"), sure.alias("template_confidence"), F.col("diagram.confidence").alias("diagram_confidence"), F.col("narrative.confidence").alias("narrative_confidence"),
        F.coalesce("pii_entity_count", F.lit(0)).cast("bigint").alias("pii_entity_count"), unmapped.alias("pii_unmapped_count"),
    )


def gate(narratives: DataFrame, entities: DataFrame) -> DataFrame:
    """(narrative_id, qa_flags, export_blocked, export_decision, pii_entity_count, pii_unmapped_count), failing closed.

    A narrative is blocked by any blocking flag, by an entity without a place on the page, by an empty
    text, or where the extraction itself asks for review. Flags come sorted and once each.
    """
    unplaced = ~F.coalesce("can_map_to_image_coordinates", F.lit(False)) | F.col("bbox").isNull()
    counts = entities.groupBy("narrative_id").agg(F.count("*").alias("pii_entity_count"), F.sum(unplaced.cast("bigint")).alias("pii_unmapped_count"))
    rows = narratives.join(counts, "narrative_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pii_entity_count", "pii_unmapped_count")})
    none = F.expr("cast(array() as array<string>)")
    flags = F.concat(
        F.coalesce(F.filter("warnings", lambda x: x.isNotNull()), none), F.when(F.col("pii_unmapped_count") > 0, F.array(F.lit("PII_UNMAPPED"))).otherwise(none),
        F.when(F.col("text").isNull() | (F.col("text") == ""), F.array(F.lit("NARRATIVE_EMPTY"))).otherwise(none),
    )
    flags = F.array_sort(F.array_distinct(flags))
    blocked = F.arrays_overlap(flags, F.array(*map(F.lit, BLOCKING))) | F.coalesce("requires_review", F.lit(False))
    return rows.select("narrative_id", F.array_join(flags, ",").alias("qa_flags"), blocked.alias("export_blocked"), F.when(blocked, "BLOCK").otherwise("ALLOW").alias("export_decision"), "pii_entity_count", "pii_unmapped_count")
