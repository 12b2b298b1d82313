"""Regular-expression matches with offsets, in Spark expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of struct(start, end, value) of the non-overlapping, non-empty matches of ``pattern``; offsets are code points, ends exclusive.

    ``group`` 1 takes the first group, which must be the tail of the match. Unicode classes hold, as in
    Python. A text that does not match at all costs one search. Null gives null.
    """
    rx = F.lit("(?U)" + pattern)
    found = F.arrays_zip(F.split(text, "(?U)" + pattern, -1).alias("gap"), F.regexp_extract_all(text, rx, F.lit(0)).alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["gap"]) + F.length(x["hit"])
        value = F.regexp_extract(x["hit"], "(?U)" + pattern, group) if group else x["hit"]
        span = F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))
        out = F.when(x["hit"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(span)))
        return F.struct(F.coalesce(end, acc["at"]).alias("at"), out.alias("out"))

    empty = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    all_ = F.aggregate(found, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(text.rlike("(?U)" + pattern), all_).when(text.isNotNull(), empty)


def squeeze(text: Column) -> Column:
    """Text with runs of white space as one space and none at its ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
