"""Streams of arriving files and texts. Per-document operators are stateless and run on them unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsieve.operators.recognizers import log_filter


def arrivals(spark: SparkSession, directory: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(directory)


def first_seen(rows: DataFrame, key: str = "sha256", at: str = "discovered_at", late: str = "7 days") -> DataFrame:
    """Rows with a key not seen within ``late``: rescans are dropped, and the state is bounded by the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def discovered(rows: DataFrame, at: str = "discovered_at", late: str = "7 days", window: str = "1 day") -> DataFrame:
    """(window start, source, n): files discovered per day and source, closed by the watermark."""
    counted = rows.withWatermark(at, late).groupBy(F.window(at, window), "source").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("day"), "source", "n")


def cleaned(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with identifying patterns taken out of ``text``."""
    return rows.withColumn(text, log_filter(F.col(text)))
