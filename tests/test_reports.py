import json

import pytest

from docsieve.functions import settings
from docsieve.operators import builders, diagrams, jobs, regions, review, templates
from docsieve.sources import providers, sinks
from docsieve.sources import templates as template_files

PART = "struct<flags:array<string>,requires_review:boolean,confidence:double>"
REPORT = f"document_id string, template_id string, template_confidence double, pages_in_range boolean, diagram {PART}, narrative {PART}, pii_entity_count long, pii_unmapped_count long, vlm_flags array<string>"
GOOD = ([], False, 0.9)


def test_gate_rules(spark):
    rows = [
        ("ok", "t", 0.95, True, GOOD, GOOD, 3, 0, None), ("unknown", "UNKNOWN", 0.2, True, None, None, 0, 0, None), ("low", "t", 0.7, True, GOOD, GOOD, 0, 0, None), ("range", "t", 0.9, False, GOOD, GOOD, 0, 0, None),
        ("none", "t", 0.9, True, None, None, 0, 0, None), ("asks", "t", 0.9, True, (["REGION_AMBIGUOUS"], True, 0.5), (["NARRATIVE_EMPTY", None], True, 0.0), 0, 0, None), ("one", "t", 0.9, True, GOOD, GOOD, 4, 1, None), ("two", "t", 0.9, True, GOOD, GOOD, 4, 2, None),
        ("conflict", "t", 0.9, True, GOOD, GOOD, 0, 0, ["VLM_OUTPUT_CONFLICTS_WITH_OCR"]), ("generative", "t", 0.9, True, GOOD, GOOD, 0, 0, ["VLM_GENERATIVE_OUTPUT_REQUIRES_REVIEW"]), ("told", "t", 0.9, True, (["LLM_PROVIDER_USED"], False, 0.9), GOOD, 0, 0, None),
        ("flag", "t", 0.9, True, (["DIAGRAM_REGION_OUT_OF_BOUNDS"], False, 0.9), GOOD, 0, 0, None), ("null", None, None, None, None, None, None, None, None),
    ]
    got = {r.document_id: r for r in review.report(spark.createDataFrame(rows, REPORT)).collect()}
    assert got["ok"].export_decision == "ALLOW" and not got["ok"].requires_human_review and got["ok"].qa_flags == [] and got["ok"].pii_entity_count == 3
    assert got["unknown"].qa_flags == ["TEMPLATE_LOW_CONFIDENCE", "TEMPLATE_UNKNOWN"] and len(got["unknown"].blocking_reasons) == 3  # the rule's own and one for each blocking flag that it does not name
    assert got["low"].blocking_reasons[0] == "Template confidence 0.70 below threshold 0.85." and got["low"].requires_human_review
    assert got["range"].export_decision == "ALLOW" and got["range"].qa_flags == ["TEMPLATE_PAGE_COUNT_OUT_OF_RANGE"]
    assert got["none"].qa_flags == ["DIAGRAM_REGION_UNCERTAIN", "NARRATIVE_BOUNDARIES_UNCERTAIN"] and got["none"].export_blocked
    assert "Diagram extraction requires review (confidence 0.50)." in got["asks"].blocking_reasons and "NARRATIVE_EMPTY requires review" in got["asks"].blocking_reasons
    assert "1 PII entity could" in got["one"].blocking_reasons[0] and "2 PII entities could" in got["two"].blocking_reasons[0]
    assert got["conflict"].export_blocked and not got["generative"].export_blocked and got["generative"].requires_human_review
    assert not got["told"].export_blocked and got["told"].requires_human_review
    assert got["flag"].blocking_reasons == ["DIAGRAM_REGION_OUT_OF_BOUNDS requires review"]
    assert got["null"].export_blocked and got["null"].template_confidence == 0
    assert review.report(spark.createDataFrame([], REPORT)).count() == 0


def test_jobs_reviews_and_exports(spark):
    events = spark.createDataFrame([("a", "pending", 1, None), ("a", "running", 2, None), ("a", "failed", 3, "ValueError: secret text"), ("a", "running", 4, None), ("b", "pending", 1, None), ("c", "running", 1, None)], "job_id string, status string, at int, error string")
    got = {r.job_id: r for r in jobs.job_states(events).collect()}
    assert (got["a"].status, got["a"].error, got["a"].valid) == ("failed", "ValueError", False) and got["b"].valid and not got["c"].valid
    reports = spark.createDataFrame([("x", True), ("y", False), ("z", False)], "report_id string, export_blocked boolean")
    decisions = spark.createDataFrame([("x", "approve", 1), ("y", "reject", 1), ("y", "approve", 2)], "report_id string, decision string, at int")
    got = {r.report_id: (r.decision, r.refused) for r in jobs.reviewed(reports, decisions).collect()}
    assert got == {"x": ("pending", 1), "y": ("approve", 0), "z": ("pending", 0)}
    paths = [("/e/report_0123456789abcdef/qa.json",), ("/e/report_0123456789abcdef/raw.txt",), ("/e/report_xyz/qa.json",)]
    assert [tuple(r) for r in jobs.exports(spark.createDataFrame(paths, "path string")).collect()] == [("0123456789abcdef", ["qa.json"])]
    assert {r.job_id: r.status for r in jobs.latest(events, "job_id", "at").collect()} == {"a": "running", "b": "pending", "c": "running"}
    assert {tuple(r) for r in jobs.license_counts(spark.createDataFrame([("MIT",), ("MIT ",), (None,)], "license string")).collect()} == {("MIT", 2), ("UNKNOWN", 1)}


def test_words_of_characters(spark):
    chars = [("d", 0, i, c, 10.0 * i, 700.0, 10.0 * i + 9, 712.0, 792.0) for i, c in enumerate("Hi é\tx")]
    df = spark.createDataFrame(chars, "document_id string, page_index int, seq int, ch string, left double, bottom double, right double, top double, height double")
    got = builders.words_of_chars(df, dpi=72).orderBy("ord").collect()
    assert [r.text for r in got] == ["Hi", "é", "x"] and tuple(got[0].bbox) == (0.0, 80.0, 19.0, 92.0)


def test_documents_round_trip_and_routing(spark):
    w = spark.createDataFrame([("d", 1, 0, "b", None, None, True), ("d", 0, 1, None, (1.0, 2.0, 3.0, 4.0), 0.5, True), ("d", 0, 0, "a", (0.0, 0.0, 1.0, 1.0), None, False)], "document_id string, page_index int, ord int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double, mappable boolean")
    built = builders.documents_of_pages(builders.pages_of_words(w, "mock_ocr", "ocr"), notes=("checked",))
    doc = built.first()
    assert [p.page_index for p in doc.pages] == [0, 1] and doc.provenance == ["pipeline", "mock_ocr", "checked"]
    assert [(x.id, x.text, x.can_map_to_image_coordinates) for x in doc.pages[0].words] == [("p0_w00000", "a", False), ("p0_w00001", "", True)]
    text = builders.to_json(built)
    assert builders.from_json(text, built.schema).drop("error").collect() == built.collect()
    odd = spark.createDataFrame([("d", '{"document_id": "d", "more": 1}'), ("e", "no json")], "document_id string, json string")
    assert {r.error for r in builders.from_json(odd, built.schema).collect()} == {"INVALID_DOCUMENT"}
    pages = spark.createDataFrame([("d", 0, True), ("d", 1, None)], "document_id string, page_index int, has_text boolean")
    native, ocr = (builders.pages_of_words(w, n, k) for n, k in (("pdf", "native"), ("mock_ocr", "ocr")))
    assert {(r.page_index, r.text_source) for r in builders.routed(pages, native, ocr).collect()} == {(0, "native"), (1, "ocr")}


def test_a_document_is_written_in_parts_that_do_not_grow_with_it(spark):
    rows = [("binder", p, o, f'wo"rd {o}', None if o % 3 else (0.0, 1.0, 2.0, 3.0), 0.5 if o % 2 else None, True) for p in range(60) for o in range(5)] + [("d", 3, 0, None, None, None, False)]
    w = spark.createDataFrame(rows, "document_id string, page_index int, ord int, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, confidence double, mappable boolean")
    first, rest = (builders.pages_of_words(w.where(c), n, k) for c, n, k in (("page_index = 59", "pdf", "native"), ("page_index < 59", "mock_ocr", "ocr")))
    pages = first.unionByName(rest)
    built = builders.documents_of_pages(pages, "#1", ("checked",))
    parts = builders.to_json_parts(pages, "#1", ("checked",)).collect()
    for doc, text in builders.to_json(built).collect():
        own = sorted((r for r in parts if r.document_id == doc and r.kind == "page"), key=lambda r: r.page_index)
        (shell,) = (r.json for r in parts if r.document_id == doc and r.kind == "shell")
        assert shell.replace('"pages":[]', '"pages":[' + ",".join(r.json for r in own) + "]") == text
    assert max(len(r.json) for r in parts) < 2000 < max(len(r.json) for r in builders.to_json(built).collect())
    read = builders.from_json_parts(builders.to_json_parts(pages, "#1", ("checked",)), built.schema).collect()
    assert sorted(r.page for r in read if r.kind == "page") == sorted(p for r in built.collect() for p in r.pages) and not any(r.error for r in read)
    assert {(r.shell.document_id, tuple(r.shell.provenance)) for r in read if r.kind == "shell"} == {(r.document_id, tuple(r.provenance)) for r in built.collect()}
    odd = spark.createDataFrame([("d", "page", 0, '{"page_index": 0, "more": 1}'), ("d", "shell", None, "no json")], "document_id string, kind string, page_index int, json string")
    assert {r.error for r in builders.from_json_parts(odd, built.schema).collect()} == {"INVALID_DOCUMENT"}


def test_narratives_over_pages(spark):
    pages = [("d", 0, "Header Narrative: it began"), ("d", 1, "and went on"), ("d", 2, "to the end. Officer Doe"), ("d", 3, "more"), ("f", 0, "Narrahve it began Officer"), ("n", 0, "nothing here"), ("n", 1, "")]
    df = spark.createDataFrame(pages, "document_id string, page_index int, text string")
    r = spark.createDataFrame([("t", "Narrative", "Officer", 3), ("short", "Narrative", "Officer", 1), ("one", "Narrative", None, None)], "template_id string, anchor_start string, anchor_end string, most int")
    got = {(x.document_id, x.template_id): x for x in regions.extract(df, r).collect()}
    whole = got["d", "t"]
    assert whole.text == ": it began\nand went on\nto the end." and whole.confidence == 0.9 and whole.spans_pages == [0, 1, 2] and "NARRATIVE_CONTINUED" in whole.flags
    assert "NARRATIVE_CONTINUATION_TRUNCATED" in got["d", "short"].flags and got["d", "short"].confidence == 0.4 and got["d", "short"].requires_review
    assert got["d", "one"].text == ": it began" and got["d", "one"].confidence == 0.7
    assert "NARRATIVE_ANCHORS_FUZZY_MATCHED" in got["f", "t"].flags and got["f", "t"].text == "it began"
    assert ("n", "t") not in got
    stops = spark.createDataFrame([("t", "Narrative", "Officer", ["to the"])], "template_id string, anchor_start string, anchor_end string, stops array<string>")
    assert {x.document_id: x.text for x in regions.extract(df, stops).collect()}["d"] == ": it began\nand went on"


def test_template_evidence_without_templates(spark):
    docs = spark.createDataFrame([("d",)], "document_id string")
    scores = spark.createDataFrame([], "document_id string, template_id string, pos int, confidence double, form_number string")
    cover = spark.createDataFrame([], "document_id string, template_id string, anchors long, exact long, fuzzy long")
    r = templates.evidence(docs, scores, cover, "document_id").first()
    assert r.template_id == "UNKNOWN" and r.confidence == 0 and r.warnings == ["TEMPLATE_UNKNOWN", "TEMPLATE_LOW_CONFIDENCE"] and r.candidate_scores == {}
    assert templates.similar("The ~DIAGRAM~ here", "Diagram") == (4, 9, "exact", 1.0)


def test_diagrams(spark):
    box = (0.1, 0.1, 0.9, 0.5)
    rows = [("d", "t", 0, 0, True, box, 9.0), ("d", "t", 1, 1, True, box, 0.0), ("e", "t", 0, 0, False, box, 0.0), ("g", "t", 0, 0, True, (0.5, 0.1, 0.2, 0.5), 0.0), ("h", "t", 0, 0, True, box, 0.0), ("h", "t", 1, 1, True, box, 0.0)]
    df = spark.createDataFrame(rows, "document_id string, template_id string, pos int, page_index int, has_image boolean, bbox_norm struct<x0:double,y0:double,x1:double,y1:double>, density double")
    got = {r.document_id: (r.page_index, r.confidence, r.flags) for r in diagrams.extract(diagrams.candidate_scores(df)).collect()}
    assert got == {"d": (1, 0.9, ["DIAGRAM_CANDIDATE_PAGE_USED"]), "e": (0, 0.4, ["DIAGRAM_REGION_UNCERTAIN"]), "g": (0, 0.0, ["DIAGRAM_REGION_OUT_OF_BOUNDS"]), "h": (0, 0.5, ["REGION_AMBIGUOUS"])}
    said = spark.createDataFrame([("d", 0, " "), ("d", 1, "a Sketch of cars"), ("e", 0, "a page of text")], "document_id string, chain_pos int, description string")
    assert {r.document_id: r.agrees for r in diagrams.described(said, ["sketch"]).collect()} == {"d": True, "e": False}


def test_exports_hold_nothing_of_blocked_reports(spark, tmp_path):
    rows = [("a" * 64, "a.pdf", "t", "1", 0.9, False, "ALLOW", [], [], True, None, 0.9, "ocr"), ("b" * 64, "b.pdf", "t", "1", 0.9, True, "BLOCK", ["x"], ["F"], True, None, 0.9, "ocr")]
    reports = spark.createDataFrame(rows, "sha256 string, name string, template_id string, template_version string, template_confidence double, export_blocked boolean, export_decision string, blocking_reasons array<string>, qa_flags array<string>, requires_human_review boolean, diagram_confidence double, narrative_confidence double, text_source string").withColumn("created_at", __import__("pyspark").sql.functions.lit("2026-01-01 00:00:00").cast("timestamp"))
    redacted = spark.createDataFrame([("a" * 64, "[PERSON_NAME] é", "{}"), ("b" * 64, "secret", "{}")], "sha256 string, redacted_text string, narrative string")
    target = tmp_path / "out"
    sinks.export(sinks.export_files(reports, redacted, ["mock_ocr"], ["regex"]), str(target))
    assert sorted(str(p.relative_to(target)) for p in target.rglob("*") if p.is_file()) == [f"report_{'a' * 16}/{n}" for n in ("manifest.json", "narrative.redacted.json", "narrative.redacted.txt", "qa.json")]
    m = json.loads((target / f"report_{'a' * 16}" / "manifest.json").read_text())
    assert len(m) == 18 and m["export_contains_unredacted_text"] is False and m["ocr_provider"] == "mock_ocr" and m["diagram_confidence"] is None
    with pytest.raises(FileExistsError):
        sinks.export(sinks.export_files(reports, redacted, [], []), str(target))


def test_labels_tags_and_modes(spark):
    p = spark.createDataFrame([("B-GIVENNAME", 0.5), ("I-ODD", 0.9), ("EMAIL", 0.1)], "label string, score double")
    assert [r.entity_type for r in providers.labelled(p, "piiranha").collect()] == ["PERSON_NAME", "CASE_NUMBER"]
    p = spark.createDataFrame([("private_url", 0.9), ("secret", 0.9), ("other", 0.9)], "label string, score double")
    assert [r.entity_type for r in providers.labelled(p, "openai_privacy_filter").collect()] == ["CASE_NUMBER"]
    tags = spark.createDataFrame([(1, i, t, i * 5, i * 5 + 4, 0.5 + i / 10) for i, t in enumerate(["B-PER", "E-PER", "O", "S-LOC", "S-LOC", "I-PER"])], "k int, seq int, tag string, start int, end int, score double")
    assert sorted((r.label, r.start, r.end) for r in providers.joined_tags(tags, "k").collect()) == [("LOC", 15, 19), ("LOC", 20, 24), ("PER", 0, 9), ("PER", 25, 29)]
    pages = spark.createDataFrame([("d", 0)], "document_id string, page_index int")
    assert providers.mock_vlm(pages, "no_bboxes").first().bbox is None and providers.mock_vlm(pages).first().mappable
    with pytest.raises(ValueError):
        providers.mock_vlm(pages, "other")


def test_template_files_and_settings(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("template_id: a\nversion: 1\nsignature: {anchor_text: [Diagram]}\nregions: {narrative: {anchor_start: N, bbox_norm: [0, 0, 1, 1], page: [1, 1, 0]}}\n")
    (tmp_path / "b.yml").write_text("template_id: b\nextends: a\nlayout: {page_count_max: 3}\n")
    schemas = template_files.load(str(tmp_path))
    rows = template_files.table(spark, schemas).orderBy("pos").collect()
    assert [(r.template_id, r.page_count_max, r.anchors) for r in rows] == [("a", 99, ["Diagram"]), ("b", 3, ["Diagram"])] and rows[1].regions["narrative"].anchor_start == "N"
    assert template_files.load(str(tmp_path / "none")) == [] and template_files.page_search([1, 1, 0]) == ([1, 0], "best_match") and template_files.page_search(2) == ([2], "fixed")
    for bad in (True, -1, [], "all", {"strategy": "odd"}):
        with pytest.raises(ValueError):
            template_files.page_search(bad)
    with pytest.raises(ValueError):
        template_files.check({"template_id": "x", "regions": {"r": {"bbox_norm": [0.5, 0, 0.2, 1]}}})
    base = {"a": {"b": 1, "l": [1, 2]}, "api_key": "x"}
    assert settings.lookup(base, "a.b") == 1 and settings.lookup(base, "a.x.y", 5) == 5
    assert settings.merged(base, {"a": {"l": [3]}}) == {"a": {"b": 1, "l": [3]}, "api_key": "x"} and base["a"]["l"] == [1, 2]
    assert settings.shown({"x": [{"token": "t", "password": ""}]}) == {"x": [{"token": "***REDACTED***", "password": None}]}
    assert settings.locked(base, {"a.b": 2, "c": 1}) == ["a.b"]
