"""Manifest of report files: scan, types, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of supported files.
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff")


def suffix(name: Column) -> Column:
    """The suffix of a file name in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def kind(suffix_: Column) -> Column:
    """pdf, image or unknown."""
    return F.when(suffix_ == ".pdf", "pdf").when(suffix_.isin(*SUFFIXES), "image").otherwise("unknown")


def manifest(spark: SparkSession, directory: str, recursive: bool = True) -> DataFrame:
    """(path, name, size_bytes, sha256, file_type, extension, modified_at) of the supported files under a directory, dot files left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    s = suffix(name)
    rows = files.where(~name.startswith(".") & s.isin(*SUFFIXES))
    return rows.select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), kind(s).alias("file_type"), s.alias("extension"), F.col("modificationTime").alias("modified_at"))
