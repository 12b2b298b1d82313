from docsieve.llm import personal, scans, splitting
from docsieve.llm import queries as Q


def test_running_text_that_looks_like_a_header_is_decoded(spark):
    name = "PRIYA TOVELLIC DECLINED MEDICAL ATTENTION BUT LATER CALLED TO REPORT LOWER BACK"
    rows = [(1, f"UNIT 2 STRUCK THE POLE.\n{name}\nPAIN. 1 UNIT WAS TOWED AWAY FROM THE ScENE.", "ocr")]
    rows += [(10 + i, f"The driver was\nForm Report QC-10{i % 9} Rev. 3\nnot hurt. The tow crew number {i} came.", "ocr") for i in range(12)]
    df = spark.createDataFrame(rows, "narrative_id long, text string, text_source string")
    lines = spark.createDataFrame([], "line_id long, document_id string, page_index int, line_index int, text string")
    anchors = spark.createDataFrame([(["Diagram"],)], "anchors array<string>")
    recurring = scans.recurring(df, lines, anchors)
    assert {r.narrative_id for r in recurring.collect() if 1 in r.recurring} == {10 + i for i in range(12)}
    got = {tuple(r) for r in personal.find(df, recurring).select("narrative_id", "entity_type", "start_offset").collect()}
    assert got == {(1, "PERSON_NAME", rows[0][1].index("PRIYA"))}
    assert "[PERSON_NAME] DECLINED" in {r.narrative_id: r.text for r in personal.masked(df, recurring).collect()}[1]
    running, header = personal.streams("a\nForm Report QC\nb", [1])
    assert running.tolist() == [[0, 1], [17, 18]] and header.tolist() == [[2, 6], [7, 13], [14, 16]]  # nothing is left out


def test_words_and_entities_share_canonical_forms(spark, tmp_path):
    words = [(1, "ét"), (2, "саrѕ"), (3, None), (1, "ét"), (4, "ﬁne")]
    spark.createDataFrame(words, "word_key long, text string").write.parquet(f"{tmp_path}/words.parquet")
    spark.createDataFrame([(1, "ét"), (2, "cars"), (3, "ét")], "entity_id long, normalized_text string").write.parquet(f"{tmp_path}/entities.parquet")
    got = sorted(map(tuple, Q.p5_canonical(spark, str(tmp_path)).collect()))
    assert got == [("entity", 1, "ét"), ("entity", 2, "cars"), ("entity", 3, "ét"), ("word", 1, "ét"), ("word", 2, "cars"), ("word", 3, None), ("word", 4, "fine")]
    assert {tuple(r) for r in Q.p5_found(spark, str(tmp_path)).collect()} == {("word", 1), ("word", 2), ("word", 4)}


def test_cuts_fall_on_boundaries_anywhere_in_the_reach(spark):
    text = "Short words first. " + "x" * 70 + " and more " + "y" * 150 + " " + "z" * 60 + "é" * 80
    items = spark.createDataFrame([(1, "a", text)], "id int, source string, text string")
    limits = spark.createDataFrame([("a", 100, 10)], "source string, max_chars int, overlap_chars int")
    for size in (64, 1 << 16):
        pieces = splitting.split_items(items, limits, "id", size=size)[1].orderBy("piece").collect()
        ends = [r.end_offset for r in pieces]
        assert ends[-1] == len(text) and all(len(r.text) <= 100 for r in pieces)
        for a, b in zip([10, *ends], ends[:-1]):  # a hard cut only where the whole reach has no white space
            assert text[b - 1] == " " or " " not in text[a : a + 90]
            assert text[b] != "́"


def _scans(spark, texts):
    n = spark.createDataFrame([(i, t, "ocr") for i, t in enumerate(texts)], "narrative_id long, text string, text_source string")
    lines = spark.createDataFrame([], "line_id long, document_id string, page_index int, line_index int, text string")
    anchors = spark.createDataFrame([(["Diagram"],)], "anchors array<string>")
    return {tuple(r) for r in scans.find(n, lines, anchors).collect()}, {r.grp: r.text for r in scans.repair(n, lines, anchors).collect()}


def test_misread_numbers_are_repaired(spark):
    found, texts = _scans(spark, [*(f"Call 736-555-0{i:03d}." for i in range(100, 180)), "Call 736-555-0l81."])
    assert ("narrative", 80, "misread") in found and texts["80"] == "Call 736-555-0181." and texts["0"] == "Call 736-555-0100."


def test_words_broken_at_the_end_of_long_lines(spark):
    found, texts = _scans(spark, ["x=" + "y" * 400 + " Sho-\nrtly afterward it left.", *["It came shortly afterward."] * 3])
    assert ("narrative", 0, "hyphen") in found and texts["0"].endswith("y Shortly afterward it left.")
