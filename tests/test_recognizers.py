import re

from pyspark.sql import functions as F

from docsieve.functions.spans import spans
from docsieve.operators import recognizers as R

ODD = ["", "no hits", "a@b.co, x@y.org", "😀 call 555-123-4567 é 555.123.4567", "Case ABC-123 case XYZ", "Officer José Ávila and driver JOHN DOE met", "12 Main Street 9 N. Elm Ave.", "Signature: Al Ko  "]


def test_spans_agree_with_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, text string")
    for r in R.RECOGNIZERS:
        got = {x.i: [(s.start, s.end, s.value) for s in x.s] for x in df.select("i", spans(F.col("text"), r.pattern, r.group).alias("s")).collect()}
        for i, t in enumerate(ODD):
            assert got[i] == [(m.start(r.group), m.end(r.group), m.group(r.group)) for m in re.finditer(r.pattern, t)], (r.entity_type, t)


def test_null_text_gives_null_and_detect_skips_it(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "mail a@b.co")], "k int, text string")
    assert df.where("k = 1").select(spans(F.col("text"), "a").alias("s")).first().s is None
    assert [(r.k, r.entity_type) for r in R.detect(df, "k").collect()] == [(3, "EMAIL")]


def test_check_digit_and_dates(spark):
    vins = spark.createDataFrame([("1HGCM82633A004352", True), ("1M8GDM9AXKP042788", True), ("1M8GDM9AZKP042788", False)], "v string, ok boolean")
    assert vins.where(R.vin_valid(F.col("v")) != F.col("ok")).count() == 0
    births = spark.createDataFrame([("02/29/1992", True), ("02/29/1991", False), ("01/01/3024", False), ("01/01/1875", False), ("01/01/85", False)], "v string, ok boolean")
    assert births.where(R.birth_valid(F.col("v"), F.lit("2026-01-01").cast("date")) != F.col("ok")).count() == 0


def test_log_filter(spark):
    df = spark.createDataFrame([("a@b.co 123-45-6789 555-123-4567 1HGCM82633A004352",)], "t string")
    assert df.select(R.log_filter(F.col("t")).alias("t")).first().t == "[EMAIL] [SSN] [PHONE_NUMBER] [VIN]"
