import random

from docsieve.operators import entities as E

SCHEMA = "entity_id long, narrative_id long, page_index int, scope string, entity_type string, start_offset int, end_offset int, confidence double, text string, provider string"


def test_merge(spark):
    rows = [
        (1, 1, 0, "page", "EMAIL", 10, 20, 0.5, "a", "x"), (2, 1, 0, "page", "EMAIL", 15, 25, 0.9, "b", "y"), (3, 1, 0, "page", "EMAIL", 25, 30, 0.1, "c", "x"),
        (4, 1, 0, "narrative", "EMAIL", 12, 18, 0.1, "d", "x"), (5, 1, None, "page", "EMAIL", None, None, 0.2, "e", "z"), (6, 1, 0, "page", "VIN", 11, 12, 0.2, "f", "z"),
    ]
    got = {(r.scope, r.entity_type, r.start_offset, r.end_offset): r for r in E.merge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 5
    joined = got["page", "EMAIL", 10, 25]
    assert (joined.confidence, joined.text, joined.provider, joined.providers, joined.members) == (0.9, "a", "x", "x,y", 2)
    assert ("page", "EMAIL", 25, 30) in got and ("page", "EMAIL", None, None) in got


def test_no_character_of_a_span_survives(spark):
    rnd = random.Random(4)
    texts, spans = [], []
    for k in range(60):
        text = "".join(rnd.choice("abcdefgh é😀\n") for _ in range(80))
        texts.append((k, text))
        for _ in range(rnd.randrange(6)):
            a = rnd.randrange(75)
            spans.append((k, rnd.choice(["A", "LONGER_TYPE", "B"]), a, a + rnd.randrange(1, 20)))
    spans += [(0, "A", -1, 5), (1, "A", 3, 3), (2, "A", 70, 999), (3, "A", None, None)]
    texts += [(100, None), (101, "")]
    got = {r.k: r.redacted_text for r in E.redact(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(spans, "k int, entity_type string, start_offset int, end_offset int"), "k").collect()}
    assert 100 not in got and got[101] == ""
    for k, text in texts[:60]:
        inside = set()
        for j, _, a, b in spans:
            if j == k and a is not None and 0 <= a < b <= len(text):
                inside |= set(range(a, b))
        bare = got[k]
        for t in ("A", "LONGER_TYPE", "B"):
            bare = bare.replace(f"[{t}]", "\0")
        assert bare.replace("\0", "") == "".join(c for i, c in enumerate(text) if i not in inside)


def test_compat_splices_by_original_offsets(spark):
    t = spark.createDataFrame([(1, "Signature: OFFICER AL KO MARTINEZ JONES end")], "k int, text string")
    s = spark.createDataFrame([(1, "SIGNATURE", 11, 39), (1, "PERSON_NAME", 19, 24)], "k int, entity_type string, start_offset int, end_offset int")
    assert E.redact(t, s, "k").first().redacted_text == "Signature: [SIGNATURE] end"
    assert E.redact(t, s, "k", mode="compat").first().redacted_text == "Signature: [SIGNATURE]EZ JONES end"


def test_offsets_and_boxes(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    w = spark.createDataFrame([("d", 0, 0, "John", (0.0, 0.0, 1.0, 1.0)), ("d", 0, 1, None, None), ("d", 0, 2, "Doe", (5.0, 0.0, 6.0, 2.0))], f"document_id string, page_index int, ord int, text string, bbox {box}")
    o = E.word_offsets(w)
    assert [(r.start_offset, r.end_offset) for r in o.orderBy("ord").collect()] == [(0, 4), (5, 5), (6, 9)]
    e = spark.createDataFrame([(1, "d", 0, 0, 9), (2, "d", 0, None, None)], "entity_id int, document_id string, page_index int, start_offset int, end_offset int")
    got = {r.entity_id: (r.x0, r.x1, r.y1, r.mapped) for r in E.boxes(e, o).collect()}
    assert got == {1: (0.0, 6.0, 2.0, True), 2: (None, None, None, False)}
