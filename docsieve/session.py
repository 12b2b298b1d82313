"""Session helpers: table access, lineage cuts, checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast up to this many bytes of measured content.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``directory``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder of the cluster; a temporary one only for a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder all executors share")
        shared = os.path.join(tempfile.gettempdir(), "docsieve-checkpoints")
    sc.setCheckpointDir(shared)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of that name beside the checkpoints, which all executors see."""
    _checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: computed once, survives lost executors."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, size: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size allows it, else unchanged (Spark then shuffles).

    ``size`` is a SQL expression for the bytes of a row; 64 by default. ``df`` should be cheap to
    scan (a ``cut`` result), because its size is measured here.
    """
    measured = df.agg(F.sum(F.expr(size or "64")).cast("bigint")).first()[0] or 0
    return F.broadcast(df) if measured <= limit else df


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key. Redelivered rows are alike in every column, so any of them will do."""
    return df.dropDuplicates(list(keys))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the cluster, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="docsieve-"), "docsieve.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(archive)  # Spark's own file server hands it to executors, also to new ones
    _SHIPPED.add(sc.applicationId)
