"""Jobs, reviews and exports as tables of events: the latest state of each, what may follow, and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states of a job in their order, and the names that an export may hold.
STATES = ("pending", "running", "complete", "failed")
EXPORTS = ("diagram.redacted.png", "narrative.redacted.txt", "narrative.redacted.json", "manifest.json", "qa.json")


def latest(events: DataFrame, key: str, at: str) -> DataFrame:
    """The last event of each key by time; ties go to the greatest row in the order of its columns. Events without a time come before all others."""
    rest = [c for c in events.columns if c != key]
    comparable = [c for c in rest if c != at]
    best = events.groupBy(key).agg(F.max(F.struct(F.col(at), *comparable)).alias("e"))
    return best.select(key, *(F.col(f"e.{c}").alias(c) for c in rest))


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, at, error, valid): the state of each job; a finished job stays as it first finished.

    ``events`` has job_id, status, at and error. Only the kind of an error is kept, never its text. A job is
    valid if it began with pending and never left the order of the states.
    """
    rank = F.when(F.col("status").isin("complete", "failed"), 2).when(F.col("status") == "running", 1).when(F.col("status") == "pending", 0).otherwise(-1)
    rows = events.withColumn("_rank", rank)
    done = F.min(F.when(F.col("_rank") == 2, F.struct("at", "status", F.regexp_extract(F.coalesce("error", F.lit("")), r"^([A-Za-z_][\w.]*)", 1).alias("error"))))
    open_ = F.max(F.when(F.col("_rank").between(0, 1), F.struct("at", "_rank", "status")))
    seen = F.array_sort(F.collect_list(F.struct("at", "_rank")))
    held = rows.groupBy("job_id").agg(done.alias("d"), open_.alias("o"), seen.alias("seen"), F.min("_rank").alias("low"))
    ordered = F.aggregate("seen", F.struct(F.lit(-1).alias("last"), F.lit(True).alias("ok")), lambda a, x: F.struct(x["_rank"].alias("last"), (a["ok"] & (x["_rank"] >= a["last"])).alias("ok")), lambda a: a["ok"])
    valid = ordered & (F.col("low") == 0)
    return held.select("job_id", F.coalesce("d.status", "o.status").alias("status"), F.coalesce("d.at", "o.at").alias("at"), F.nullif(F.col("d.error"), F.lit("")).alias("error"), valid.alias("valid"))


def reviewed(reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """(report_id, export_blocked, decision, refused): the last decision on each report. A blocked report cannot be approved, and no decision unblocks it."""
    allowed = decisions.join(reports.select("report_id", "export_blocked"), "report_id").withColumn("_no", F.col("export_blocked") & (F.col("decision") == "approve"))
    last = allowed.groupBy("report_id").agg(F.max(F.when(~F.col("_no"), F.struct("at", "decision")))["decision"].alias("decision"), F.sum(F.col("_no").cast("bigint")).alias("refused"))
    return reports.select("report_id", "export_blocked").join(last, "report_id", "left").select("report_id", "export_blocked", F.coalesce("decision", F.lit("pending")).alias("decision"), F.coalesce("refused", F.lit(0)).alias("refused"))


def exports(paths: DataFrame) -> DataFrame:
    """(report_id, names): the export folders among ``paths`` (path) and the known files in each; anything else is left out."""
    rows = paths.select(F.regexp_extract("path", r"(?:^|/)report_([0-9a-f]{16})/([^/]+)$", 1).alias("report_id"), F.regexp_extract("path", r"(?:^|/)report_([0-9a-f]{16})/([^/]+)$", 2).alias("name"))
    return rows.where((F.col("report_id") != "") & F.col("name").isin(*EXPORTS)).groupBy("report_id").agg(F.array_sort(F.collect_set("name")).alias("names"))


def license_counts(packages: DataFrame, column: str = "license") -> DataFrame:
    """(license, n): packages by license; a null or blank one counts as UNKNOWN."""
    name = F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "UNKNOWN").otherwise(F.trim(column))
    return packages.groupBy(name.alias("license")).agg(F.count("*").alias("n"))
