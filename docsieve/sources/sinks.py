"""Exports: only what the gate allows is written, and never raw personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_id(sha256):
    """The public id of a report: the first 16 digits of its digest."""
    return F.substring(sha256, 1, 16)


#: Name of the redaction policy: every span becomes a placeholder with its type.
POLICY = "placeholder"


def manifests(reports: DataFrame, ocr_chain: list[str], pii_chain: list[str]) -> DataFrame:
    """(report_id, manifest): one JSON manifest per report; the three marks of raw data are always false.

    ``reports`` has sha256, name, template_id, template_version, text_source, created_at and the columns of the gate's
    report. The recogniser named is the first of the chain.
    """
    no = F.lit(False)
    fields = F.struct(
        F.col("sha256").alias("source_sha256"), F.col("name").alias("source_file_name"), "template_id", "template_version", "template_confidence", F.lit(ocr_chain[0] if ocr_chain else None).cast("string").alias("ocr_provider"), F.lit("0.1.0").alias("ocr_provider_version"),
        F.expr("cast(array() as array<string>)").alias("document_ai_providers"), F.array(*map(F.lit, pii_chain)).cast("array<string>").alias("pii_provider_chain"), F.lit(POLICY).alias("redaction_policy"), no.alias("export_contains_original_pdf"), no.alias("export_contains_unredacted_text"),
        no.alias("export_contains_raw_ocr_or_vlm_output"), "requires_human_review", "diagram_confidence", "narrative_confidence", "text_source", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
    )
    return reports.select(report_id(F.col("sha256")).alias("report_id"), F.to_json(fields, {"ignoreNullFields": "false", "pretty": "true"}).alias("manifest"))


def qa_json(reports: DataFrame) -> DataFrame:
    """(report_id, qa): the gate's report as JSON, without the counts of entities."""
    fields = F.struct("export_decision", "export_blocked", "blocking_reasons", "qa_flags", "requires_human_review", "template_confidence", "diagram_confidence", "narrative_confidence")
    return reports.select(report_id(F.col("sha256")).alias("report_id"), F.to_json(fields, {"ignoreNullFields": "false", "pretty": "true"}).alias("qa"))


def narrative_json(narratives: DataFrame, entities: DataFrame, key: str = "narrative_id") -> DataFrame:
    """(key, narrative): redacted narratives as JSON with their entities, none of which shows its text."""
    held = audit(entities.withColumn("_k", F.col(key))).columns
    listed = entities.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start_offset", *(c for c in held if c not in ("start_offset", key))))).alias("pii_entities"))
    joined = narratives.join(listed, key, "left")
    return joined.select(key, F.to_json(F.struct(F.col("redacted_text").alias("text"), "page_index", "confidence", F.coalesce("pii_entities", F.expr("array()")).alias("pii_entities")), {"ignoreNullFields": "false"}).alias("narrative"))


def export(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write the files of reports that may be exported: ``files`` has report_id, export_blocked, name and content.

    Each report has a folder report_<id>. Files are written by the executors through the Hadoop-free interface of the shared
    file system, whole or not at all: a file appears under its name only when it is complete. A blocked report has no folder.
    """
    allowed = files.where(~F.coalesce("export_blocked", F.lit(True)) & F.col("content").isNotNull()).select("report_id", "name", "content").dropDuplicates(["report_id", "name"])

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        for b in batches:
            for r in b.itertuples(index=False):
                folder = f"{root}/report_{r.report_id}"
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/.{r.name}.part") as f:
                    f.write(r.content.encode())
                system.move(f"{folder}/.{r.name}.part", f"{folder}/{r.name}")
            yield pd.DataFrame({"written": [len(b)]})

    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "errorifexists" and system.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    allowed.mapInPandas(write, "written bigint").agg(F.sum("written")).first()


def export_files(reports: DataFrame, redacted: DataFrame, ocr_chain: list[str], pii_chain: list[str]) -> DataFrame:
    """(report_id, export_blocked, name, content): the text files of each report; ``redacted`` has sha256, redacted_text and narrative (its JSON)."""
    key = reports.select(report_id(F.col("sha256")).alias("report_id"), "export_blocked")
    texts = redacted.select(report_id(F.col("sha256")).alias("report_id"), F.explode(F.array(F.struct(F.lit("narrative.redacted.txt").alias("name"), F.col("redacted_text").alias("content")), F.struct(F.lit("narrative.redacted.json").alias("name"), F.col("narrative").alias("content")))).alias("f")).select("report_id", "f.*")
    both = manifests(reports, ocr_chain, pii_chain).select("report_id", F.lit("manifest.json").alias("name"), F.col("manifest").alias("content")).unionByName(qa_json(reports).select("report_id", F.lit("qa.json").alias("name"), F.col("qa").alias("content")))
    return key.join(both.unionByName(texts), "report_id")


def audit(entities: DataFrame) -> DataFrame:
    """Entities without their text, as JSON lines can show them."""
    return entities.select("entity_id", "entity_type", "start_offset", "end_offset", "page_index", "confidence", "provider", "detection_reason", "can_map_to_image_coordinates", "requires_review")
