import pytest
from pyspark.sql import functions as F

from docsieve.operators import documents as D
from docsieve.operators import regions as G
from docsieve.operators import templates as T


@pytest.mark.parametrize("raw, want", [("  Narrative: ", "narrative"), ("VIN:  No", "vin: no"), ("__X__", "x"), (None, ""), ("Straße", "strasse"), ("A B", "a b")])
def test_normalize_text(raw, want):
    assert T.normalize_text(raw) == want


def test_normalize_column(spark):
    df = spark.createDataFrame([("  Narrative: ", "narrative"), (None, ""), ("A \n B_", "a b")], "v string, w string")
    assert df.where(T.normalize(F.col("v")) != F.col("w")).count() == 0


def test_fuzzy():
    assert T.fuzzy_find("the Narrahve begins", "Narrative") == (4, 0.8235)
    assert T.fuzzy_find("Narrowing road", "Narrative") == (-1, 0.0)
    assert T.fuzzy_find("", "Narrative") == (-1, 0.0)


def test_inherit():
    a = {"template_id": "a", "layout": {"min": 1, "max": 2}, "regions": {"n": {"x": 1, "y": 2}}, "anchors": ["p"]}
    b = {"template_id": "b", "extends": "a", "layout": {"max": 9}, "regions": {"n": {"y": 5}, "d": {"z": 1}}, "anchors": ["q"]}
    got = T.inherit([b, a])[1]
    assert got["layout"] == {"min": 1, "max": 9} and got["regions"] == {"n": {"x": 1, "y": 5}, "d": {"z": 1}} and got["anchors"] == ["q"]
    for bad in ([{"template_id": "a", "extends": "a"}], [{"template_id": "a", "extends": "x"}], [{"template_id": "a"}, {"template_id": "a"}]):
        with pytest.raises(ValueError):
            T.inherit(bad)


def test_detect_ties_and_unknown(spark):
    s = spark.createDataFrame([(1, "b", 1, 0.9), (1, "a", 0, 0.9), (2, "a", 0, 0.1), (2, "b", 1, 0.2)], "k int, template_id string, pos int, confidence double")
    assert {r.k: (r.template_id, r.confidence) for r in T.detect(s, "k").collect()} == {1: ("a", 0.9), 2: ("UNKNOWN", 0.2)}


def test_between_and_continuation(spark):
    df = spark.createDataFrame([("Remarks: hello there Diagram x", "remarks:", "diagram"), ("no anchors", "zz", "yy")], "t string, a string, b string")
    got = df.select(T.between(F.col("t"), F.col("a"), F.col("b")).alias("s")).collect()
    assert (got[0].s.text, got[0].s.start_found, got[0].s.end_found) == ("hello there", True, True) and got[1].s.text == "no anchors"
    pages = spark.createDataFrame([("d", 0, "Start one"), ("d", 1, "two"), ("d", 2, "three End four"), ("d", 3, "End")], "document_id string, page_index int, text string")
    regions = spark.createDataFrame([("t", "start", "end")], "template_id string, anchor_start string, anchor_end string")
    first = G.primary(G.page_scores(pages, regions))
    assert first.first().page_index == 0
    r = G.continuation(pages, regions, first).first()
    assert (r.pages, r.end_found, r.chars) == (3, True, 4 + 3 + 6)


def test_documents(spark):
    p = spark.createDataFrame([("d", 0, True), ("d", 1, None), ("e", 0, True)], "document_id string, page_index int, has_text boolean")
    assert {r.document_id: r.route for r in D.route(p).collect()} == {"d": "mixed", "e": "native"}
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    base = spark.createDataFrame([("d", 0, 1, 0, "Hello", (10.0, 10.0, 50.0, 30.0)), ("d", 0, 2, 1, "x", (10.0, 10.0, 50.0, 30.0)), ("d", 0, 3, 2, "n", None)], f"document_id string, page_index int, word_key long, ord int, text string, bbox {box}")
    alts = spark.createDataFrame([(9, "d", 0, 0, "v", "hello!", (12.0, 11.0, 48.0, 28.0)), (9, "d", 0, 1, "v", "far", (500.0, 500.0, 501.0, 501.0)), (9, "d", 0, 2, "v", "none", None)], f"word_key long, document_id string, page_index int, alt_ord int, provider string, text string, bbox {box}")
    assert {r.alt_ord: r.base_key for r in D.best_overlap(base, alts, band=7.0).collect()} == {0: 1}
    assert {r.alt_ord: r.outcome for r in D.reconcile(base, alts).collect()} == {0: "AGREES", 1: "NO_OVERLAP", 2: "NO_BBOX"}
