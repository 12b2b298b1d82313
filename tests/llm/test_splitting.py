import random

import pytest

from docsieve.llm import splitting as S

rnd = random.Random(1)
WORDS = ["alpha", "beta", "Gamma.", "delta,", "épsilon", "😀", "x́y", "End.\n\n", "zeta\n"]
LONG = " ".join(rnd.choice(WORDS) for _ in range(900))
ROWS = [(1, "a", LONG), (1, "a", LONG), (2, None, LONG[:400]), (3, "a", None), (4, "a", ""), (5, "b", "z" * 333), (6, "unlisted", LONG[:101]), (7, "a", LONG[:50])]
LIMITS = [("a", 120, 15), ("b", 50, 40), ("*", 100, 0), ("c", None, None)]


def check(text, pieces, most, overlap):
    end = None
    for r in pieces:
        assert r.text == text[r.start_offset : r.end_offset] and 0 < len(r.text) <= most
        assert r.start_offset == (0 if end is None else end - overlap)
        end = r.end_offset
    assert end == len(text)


@pytest.mark.parametrize("size", [64, 1 << 16])
def test_pieces_cover_the_text_within_the_limit(spark, size):
    items = spark.createDataFrame(ROWS, "id int, source string, text string")
    cuts, pieces = S.split_items(items, spark.createDataFrame(LIMITS, "source string, max_chars int, overlap_chars int"), "id", size=size)
    by = {}
    for r in pieces.orderBy("item", "piece").collect():
        by.setdefault(r["item"], []).append(r)
    assert set(by) == {1, 2, 5, 6} == {r[0] for r in cuts.select("item").distinct().collect()}
    texts = {r[0]: r[2] for r in ROWS}
    for k, (most, overlap) in {1: (120, 15), 2: (100, 0), 5: (50, 40), 6: (100, 0)}.items():
        assert [r.piece for r in by[k]] == list(range(len(by[k])))
        check(texts[k], by[k], most, overlap)
    ends = [r.text[-1] for r in by[1][:-1]]
    assert all(e.isspace() for e in ends)


def test_ranges_do_not_change_the_cuts(spark):
    items = spark.createDataFrame(ROWS, "id int, source string, text string")
    limits = spark.createDataFrame(LIMITS, "source string, max_chars int, overlap_chars int")
    a, b = (sorted(map(tuple, S.split_items(items, limits, "id", size=n)[1].collect())) for n in (130, 1 << 16))
    assert a == b


def test_files_are_split_by_byte_ranges(spark, tmp_path):
    big, small, none = tmp_path / "big", tmp_path / "small", tmp_path / "none"
    big.write_text(LONG, encoding="utf-8"), small.write_text("short é", encoding="utf-8"), none.write_text("")
    rows = S.split_files(spark, [str(big), str(small), str(none)], 120, 15, size=257).orderBy("item", "piece").collect()
    check(LONG, [r for r in rows if r["item"] == str(big)], 120, 15)
    assert [r.text for r in rows if r["item"] == str(small)] == ["short é"] and not [r for r in rows if r["item"] == str(none)]


def test_empty(spark):
    items = spark.createDataFrame([], "id int, source string, text string")
    assert S.split_items(items, spark.createDataFrame(LIMITS, "source string, max_chars int, overlap_chars int"), "id")[1].count() == 0
    assert S.split_items(spark.createDataFrame(ROWS, "id int, source string, text string"), spark.createDataFrame([], "source string, max_chars int, overlap_chars int"), "id")[0].count() == 0


def test_overlap_is_kept_or_refused(spark):
    items = spark.createDataFrame([(1, "a", "word " * 60)], "id int, source string, text string")
    pieces = S.split_items(items, spark.createDataFrame([("a", 50, 40)], "source string, max_chars int, overlap_chars int"), "id")[1].orderBy("piece").collect()
    check("word " * 60, pieces, 50, 40)
    with pytest.raises(Exception, match="smaller than max_chars"):
        S.split_items(items, spark.createDataFrame([("a", 50, 50)], "source string, max_chars int, overlap_chars int"), "id")[1].collect()


def test_a_file_of_many_ranges_and_long_white_space(spark, tmp_path):
    text = ("Some words é here. " * 30 + " " * 150 + "\n\n\n" + "x" * 90) * 20
    f = tmp_path / "many"
    f.write_text(text, encoding="utf-8")
    got = [sorted((r.piece, r.start_offset, r.end_offset, r.text) for r in S.split_files(spark, [str(f)], 200, 30, size=n).collect()) for n in (101, 1 << 20)]
    assert got[0] == got[1] and len(text.encode()) > 100 * 101
    assert all(text[a:b] == t for _, a, b, t in got[0])
