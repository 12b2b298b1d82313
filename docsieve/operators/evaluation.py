"""Accuracy of detected spans against labelled ones."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def f1(predicted: DataFrame, gold: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(entity_type, tp, fp, fn, precision, recall, f1) per type and, with a null type, pooled.

    Within a text and type, each prediction in order of its start takes the first free labelled span
    that it overlaps by ``least`` of the shorter one. Ratios without a denominator are 0.
    """
    side = [key, "entity_type", "start_offset", "end_offset"]
    spans = predicted.select(*side).withColumn("gold", F.lit(False)).unionByName(gold.select(*side).withColumn("gold", F.lit(True)))
    per = spans.groupBy(key, "entity_type").agg(*(F.sort_array(F.collect_list(F.when(F.col("gold") == g, F.array(F.col("start_offset").cast("int"), F.col("end_offset").cast("int"))))).alias(n) for n, g in (("found", False), ("want", True))))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for kind, found, want in zip(b["entity_type"], b["found"], b["want"]):
                free = [tuple(w) for w in want]
                hits = 0
                for s, e in found:
                    hit = next((w for w in free if min(e, w[1]) - max(s, w[0]) >= least * max(1, min(e - s, w[1] - w[0]))), None)
                    if hit:
                        free.remove(hit)
                        hits += 1
                rows.append((kind, hits, len(found) - hits, len(want) - hits))
            yield pd.DataFrame(rows, columns=["entity_type", "tp", "fp", "fn"])

    counts = per.select("entity_type", "found", "want").mapInPandas(match, "entity_type string, tp bigint, fp bigint, fn bigint")
    sums = counts.rollup("entity_type").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    scored = sums.withColumn("precision", F.coalesce(p, F.lit(0.0))).withColumn("recall", F.coalesce(r, F.lit(0.0)))
    both = F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))
    f = F.coalesce(2 * F.col("precision") * F.col("recall") / both, F.lit(0.0))
    return scored.withColumn("f1", F.round(f, 3)).withColumn("precision", F.round("precision", 3)).withColumn("recall", F.round("recall", 3))
