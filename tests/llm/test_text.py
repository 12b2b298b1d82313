import itertools
import random

import numpy as np
import pytest

from docsieve.llm import abuse, crf, linear, mixture, personal, personal_table, scans, truncation
from docsieve.llm import queries as Q
from tests.conftest import SMALL


def test_queries_run_and_give_each_key_once(spark):
    import __spark_entry__ as entry

    qs = entry.queries()
    assert {f"p{i}_{'ids' if i == 6 else 'mixture' if i == 7 else 'found'}" for i in range(1, 9)} <= set(qs)
    for name in ("p4_found", "p5_found", "p8_found"):
        rows = qs[name](spark, SMALL).collect()
        assert len(rows) == len(set(rows)), name


def test_hidden_letters_are_seen():
    assert abuse.words("You f u c k i n g m0r0n!!!") == abuse.words("you fucking moron.")
    assert abuse.words("iddddiot") == abuse.words("idiot")
    assert "*" in abuse.words("a***")


def test_abuse_on_held_out_passages(spark):
    table = abuse.passages.labelled()
    held = ["You worthless idiot, I will break your neck.", "Those refugees are vermin, lock them all up.", "Show me your naked tits and moan."]
    fine = ["The idiot light was on.", "The refugees were taken to the shelter.", "The patient was naked under the blanket when the medics arrived.", "Unit 2 struck the pole.", "", None]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate([*held, *fine])] + [(0, "s", held[0])] + [(100 + i, "s", t) for i, (t, _) in enumerate(personal_table.rows(300, seed=5))], "doc_id int, source string, text string")
    reviewed = spark.createDataFrame([("Unit 2 struck the pole at noon.", "none"), ("x", None), (None, "abuse")], "text string, label string")
    got = {r.doc_id: r.found for r in abuse.score(docs, reviewed).collect()}
    assert len(got) == len(held) + len(fine) + 300 and len(table) > 500
    hits = {i for i, f in got.items() if f}
    assert len(hits & {0, 1, 2}) >= 2 and len(hits - {0, 1, 2}) <= 3  # one in a hundred of the harmless
    rates = abuse.rates(abuse.score(docs.limit(0), reviewed))
    assert rates.count() == 0


def test_harmful_sentences_of_the_corpus_are_not_learned_as_harmless():
    harmful = ["Move your junk off our lawn, you shitty dickhead.", "Some lying son of a bitch took the parcel.", "He went on jerking off at the counter.", "The landlord is an asshole and a cheat.", "Those southerners are vermin and belong in the river.", "What sort of filthy moron leaves a trailer here?", "I hope her house burns down with the brat inside.", "Este perito es un cabrón y un cerdo."]
    fine = [t for t, _ in personal_table.rows(10000, seed=5)]
    w = abuse.train([], [*fine, *harmful * 3])
    assert (abuse.worst(harmful, w) >= abuse.THRESHOLD).sum() >= 5  # none when the background counted 0.4 each
    assert (abuse.worst(fine, w) >= abuse.THRESHOLD).mean() < 0.01
    assert (abuse.worst(["Mme F. a signé.", "The dog, a female, was struck and killed."], w) < abuse.THRESHOLD).all()


def test_ftrl_is_sparse_and_separates():
    rows, labels = [[1, 2], [1, 3], [4, 2], [4, 3]] * 30, [1.0, 1.0, 0.0, 0.0] * 30
    index, values = linear.ftrl(rows, labels, 10)
    w = np.zeros(10)
    w[index] = values
    assert w[1] > 0 > w[4] and set(index) <= {1, 2, 3, 4} and w[7] == 0


def test_truncation_accuracy_on_held_out_cuts(spark):
    texts = [f"The car number {i} struck the pole near the corner. Nothing further happened on that day, as {w} said." for i in range(160) for w in ("Ada", "Bo")]
    rows = [(i, "s", t, "Diagram", True) for i, t in enumerate(texts)] + [(1000 + i, "s", t[: 60 + i % 30], "Diagram", False) for i, t in enumerate(texts[:40])]
    rows += [(5000, None, None, None, False), (5001, None, "", None, False), (5002, None, "  \n ", None, False), (0, "s", texts[0], "Diagram", True)]
    n = spark.createDataFrame(rows, "narrative_id int, source string, text string, anchor_end string, anchor_end_found boolean")
    a = spark.createDataFrame([(0, None, None), (1, 0, 100)], "narrative_id int, start_offset int, end_offset int")
    got = {r.narrative_id: r.truncated for r in truncation.score(n, a).collect()}
    assert len(got) == len(rows) - 1 and not any(got[k] for k in (5000, 5001, 5002))
    whole, cut = [got[i] for i in range(320)], [got[1000 + i] for i in range(40)]
    assert sum(whole) <= 3 and sum(cut) >= 36
    assert truncation.score(n.limit(0), a).count() == 0


def test_viterbi_agrees_with_brute_force():
    import itertools

    f = crf.Field(["O", "B-X", "I-X"], 4)
    r = np.random.default_rng(0)
    f.move[:] = r.normal(size=(3, 3))
    lengths = np.array([3, 1, 4])
    scores = r.normal(size=(8, 3)).astype(np.float32)
    got, at = f.decode(scores, lengths), 0
    for n in lengths:
        def total(path):
            if not f.start[path[0]] or not all(f.allowed[a, b] for a, b in zip(path, path[1:])):
                return -np.inf
            return sum(scores[at + i, y] for i, y in enumerate(path)) + sum(f.move[a, b] for a, b in zip(path, path[1:]))

        assert tuple(got[at : at + n]) == max(itertools.product(range(3), repeat=int(n)), key=total)
        at += n


def test_personal_spans_on_held_out_sentences(spark):
    rows = personal_table.rows(300, seed=99)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(900, None), (901, ""), (0, rows[0][0])], "narrative_id int, text string")
    got = {(r.narrative_id, r.entity_type, r.start_offset) for r in personal.find(df).collect()}
    want = {(i, k, a) for i, (_, spans) in enumerate(rows) for a, _, k in spans}
    hit = len(got & want)
    assert hit / len(got) > 0.93 and hit / len(want) > 0.93
    masked = {r.narrative_id: r.text for r in personal.masked(df).collect()}
    assert masked[900] is None and masked[901] == "" and len(masked) == 302


def test_scans(spark):
    good = "The vehicle departed the scene northbound before the traffic was stopped by the crew."
    stories = [(i, good + f"\nForm QC-10{i % 9} Rev. 3\n" + good, "ocr") for i in range(40)]
    stories += [(100, "The vehic-\nle departed the 5cene northbound.", "ocr"), (101, "Thc crew stopped", "native"), (102, None, "ocr"), (103, "", "ocr"), (104, "The rear-\nend was hit\n- 4 -\nby the crew.", "ocr"), (100, "The vehic-\nle departed the 5cene northbound.", "ocr")]
    stories += [(200 + i, "The rear-end was struck by the vehicle.", "native") for i in range(5)]
    n = spark.createDataFrame(stories, "narrative_id long, text string, text_source string")
    lines = spark.createDataFrame([(1, "d", 0, 0, "Page 1"), (2, "d", 0, 1, "Tbe traf-"), (3, "d", 0, 2, "fic was stopped."), (4, "d", 0, 3, None)], "line_id long, document_id string, page_index int, line_index int, text string")
    anchors = spark.createDataFrame([(["Diagram"],)], "anchors array<string>")
    got = {tuple(r) for r in scans.find(n, lines, anchors).collect()}
    assert {("narrative", 100, "hyphen"), ("narrative", 100, "misread"), ("narrative", 0, "furniture"), ("narrative", 104, "furniture"), ("line", 1, "furniture"), ("line", 2, "hyphen"), ("line", 2, "misread")} <= got
    assert not {("narrative", 101, "misread"), ("narrative", 104, "hyphen"), ("line", 3, "hyphen"), ("line", 1, "misread")} & got
    texts = {(r.unit, r.grp): r.text for r in scans.repair(n, lines, anchors).collect()}
    assert texts["narrative", "100"] == "The vehicle departed the scene northbound."
    assert texts["line", "d"] == "The traffic was stopped." and texts["narrative", "104"] == "The rear-end was hit by the crew."
    assert scans.explains("5cene", "scene") and scans.explains("vvere", "were") and not scans.explains("scene", "scene") and not scans.explains("house", "mouse")


def test_flow_routes_overlaps():
    patterns = [(("a",), 1, 100), (("a", "b"), 1, 100), (("b",), 2, 50)]
    total, flow = mixture.plan(patterns, {"a": 0.5, "b": 0.5, "none": 0.3})
    assert total == 300 and flow[0, "a"] == 100 and flow[1, "a"] + flow[1, "b"] == 100 and flow[2, "b"] == 100
    assert mixture.plan([], {"a": 1.0}) == (0, {})


def test_mixture(spark):
    rows = [(i, f"text number {i} with some words", "a" if i % 3 else "b") for i in range(300)] + [(900, "same", "a"), (901, "same", "b"), (902, None, "a"), (903, "", "a"), (904, "x y", None), (0, "text number 0 with some words", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 4)], "source string, target_share double, max_repeats int")
    got = sorted(mixture.mix(docs, targets).collect())
    assert got == sorted(mixture.mix(docs, targets).collect())
    share = {s: sum(r.tokens * r.repeats for r in got if r.source == s) for s in "ab"}
    assert share["a"] / (share["a"] + share["b"]) == pytest.approx(0.5 / 0.9, abs=0.02)
    most = {"a": 1, "b": 2}
    assert all(r.repeats <= most[r.source] for r in got) and not {902, 903, 904, 901} & {r.doc_id for r in got}
    assert {r.source: r.tokens for r in mixture.report(mixture.mix(docs, targets), targets).collect()}["c"] == 0
    assert mixture.mix(docs.limit(0), targets).count() == 0


def test_patterns_beyond_the_bound_keep_their_documents(spark):
    rows = [(1, 1, ["a", "b"], 50), (2, 1, ["a", "c"], 30), (3, 1, ["b", "c"], 30), (4, 1, ["a"], 10), (5, 2, ["a", "b", "c"], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, uses int, pattern array<string>, tokens long")
    got = {r.doc_id: r.pattern for r in mixture.merged(docs, {"a": 0.2, "b": 0.3, "c": 0.5}, most=2).collect()}
    assert got == {1: ["a", "b"], 2: ["a", "c"], 3: ["c"], 4: ["a"], 5: ["c"]}  # c has the fewest tokens for its share
    assert mixture.merged(docs, {"a": 1.0}, most=4).count() == 5


def test_any_number_of_patterns_is_routed(spark):
    # more patterns than were kept once, 4,096, all of others than y and z; the smaller ones must serve both
    names = [f"s{i:02}" for i in range(30)]
    large = [c for k in (2, 3) for c in itertools.combinations(names, k)]
    texts = [(f"{i} " + "word " * 20, c) for i, c in enumerate(large)] + [(f"{i} short", (names[i], "y", "z")) for i in range(20)]
    rows = [(i * 50 + j, text, s) for i, (text, c) in enumerate(texts) for j, s in enumerate(c)]
    targets = spark.createDataFrame([(s, 1e-9, 2) for s in names] + [("y", 0.5, 1), ("z", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = mixture.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), targets).collect()
    share = {s: sum(r.tokens * r.repeats for r in got if r.source == s) for s in "yz"}
    assert len(large) > 4096 and len(got) >= 19 and all(r.repeats == 1 for r in got)
    assert abs(share["y"] - share["z"]) <= 2 * max(r.tokens for r in got)


def test_plan_is_the_largest_mixture():
    r = random.Random(5)
    for _ in range(60):
        names = "abcd"[: r.randint(1, 4)]
        patterns = [(tuple(sorted(r.sample(names, r.randint(1, len(names))))), r.randint(1, 3), r.randint(1, 500)) for _ in range(r.randint(1, 9))]
        goals = {s: r.random() + 0.05 for s in names}
        total, flow = mixture.plan(patterns, goals)
        present = sorted({s for p, _, _ in patterns for s in p})
        weight = sum(goals[s] for s in present)
        quota = lambda t, s: int(t * (goals[s] / weight))
        sets = [c for k in range(1, len(present) + 1) for c in itertools.combinations(present, k)]
        room = {c: sum(u * n for p, u, n in patterns if set(p) & set(c)) for c in sets}
        assert all(sum(quota(total, s) for s in c) <= room[c] for c in sets)
        assert total == sum(u * n for _, u, n in patterns) or any(sum(quota(total + 1, s) for s in c) > room[c] for c in sets)
        assert all(sum(t for (_, q), t in flow.items() if q == s) == quota(total, s) for s in present)
        used = [sum(t for (j, _), t in flow.items() if j == i) for i in range(len(patterns))]
        assert all(t <= u * n for t, (_, u, n) in zip(used, patterns)) and all(s in patterns[i][0] for i, s in flow)


def test_sql_names():
    assert set(Q.oracle_sql()) <= set(Q.queries())
