"""Anchors and templates: matching, scoring, detection, extraction of the text between anchors."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Least similarity of a fuzzy anchor, weight of a fuzzy one in coverage, least confidence of a detection.
FUZZY, FUZZY_WEIGHT, DETECTED = 0.78, 0.8, 0.85


def normalize(value: Column) -> Column:
    """Lower case, single spaces, no white space, signs or underscores at the ends; null gives an empty string.

    Characters beyond ASCII are lowered, not case-folded or composed; normalize_text does that.
    """
    v = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)\s+", " ")
    return F.regexp_replace(v, r"(?U)^[\s\W_]+|[\s\W_]+$", "")


def normalize_text(value: str | None) -> str:
    """normalize() with Unicode composition and case folding, for single values."""
    import re

    v = re.sub(r"\s+", " ", unicodedata.normalize("NFC", value or "").casefold())
    return re.sub(r"^[\s\W_]+|[\s\W_]+$", "", v)


def anchor_at(text: Column, anchor: Column, start: int = 0) -> Column:
    """Offset of an anchor in a text, case apart; -1 if it does not occur or either is empty or null."""
    at = F.call_function("locate", F.lower(anchor), F.lower(text), F.lit(start + 1))
    return F.when((F.length(anchor) > 0) & (F.length(text) > 0), at - 1).otherwise(-1)


def find_anchors(texts: DataFrame, anchors: DataFrame, key: str, fuzzy: bool = True) -> DataFrame:
    """(key, template_id, anchor, offset, length, method, score): every anchor of every template in every text.

    Exact matches are found by Spark alone; only texts in which an anchor misses go to the similarity
    search, once each with all anchors they miss: a single token that is the anchor but for case and
    signs counts as exact, else windows of as many tokens as the anchor has, one more and one less, best ratio
    first, then least offset. ``anchors`` (template_id, anchor) is small by its purpose: it travels as one array.
    """
    known = anchors.select("template_id", "anchor").distinct().groupBy().agg(F.array_sort(F.collect_list(F.struct("template_id", "anchor"))).alias("_anchors"))
    rows = texts.select(key, "text", F.lower("text").alias("_low")).join(F.broadcast(known), F.lit(True))  # one row

    def at(a: Column) -> Column:
        found = F.when((F.length(a["anchor"]) > 0) & (F.length("text") > 0), F.call_function("locate", F.lower(a["anchor"]), F.col("_low"), F.lit(1)) - 1).otherwise(-1)
        return F.struct(a["template_id"].alias("template_id"), a["anchor"].alias("anchor"), F.coalesce(found, F.lit(-1)).alias("offset"))

    hits = rows.withColumn("_hits", F.transform("_anchors", at))
    done = hits.select(key, F.explode("_hits").alias("h")).select(key, "h.*")
    exact = done.where("offset >= 0").select(key, "template_id", "anchor", "offset", F.length("anchor").alias("length"), F.lit("exact").alias("method"), F.lit(1.0).alias("score"))
    if not fuzzy:
        return exact.unionByName(done.where("offset < 0").select(key, "template_id", "anchor", "offset", F.lit(0).alias("length"), F.lit("miss").alias("method"), F.lit(0.0).alias("score")))
    kind = texts.schema[key].dataType.simpleString()
    missed = hits.select(key, "text", F.filter("_hits", lambda h: h["offset"] < 0).alias("_missed")).where("size(_missed) > 0")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text, asked in zip(b[key], b["text"], b["_missed"]):
                for a in asked:
                    offset, length, method, score = similar(text or "", a["anchor"] or "")
                    rows.append((k, a["template_id"], a["anchor"], offset, length, method, score))
            yield pd.DataFrame(rows, columns=[key, "template_id", "anchor", "offset", "length", "method", "score"])

    return exact.unionByName(missed.mapInPandas(search, f"{key} {kind}, template_id string, anchor string, offset int, length int, method string, score double"))


def similar(text: str, anchor: str, least: float = FUZZY) -> tuple[int, int, str, float]:
    """(offset, length, method, score) of what is most like an anchor in a text that does not hold it as it is."""
    import re

    want = normalize_text(anchor)
    if want and " " not in want:
        for m in re.finditer(r"\S+", text):
            if normalize_text(m.group()) == want:
                return m.start(), len(m.group()), "exact", 1.0
    offset, length, score = _nearest(text, want, least)
    return (offset, length, "fuzzy", score) if offset >= 0 else (-1, 0, "miss", 0.0)


def fuzzy_find(text: str, anchor: str, least: float = FUZZY) -> tuple[int, float]:
    """(offset, score) of the window of tokens most like the anchor, or (-1, 0.0)."""
    offset, _, score = _nearest(text, normalize_text(anchor), least)
    return offset, score


def _nearest(text: str, want: str, least: float) -> tuple[int, int, float]:
    """(offset, length, score) of the best window; windows that cannot reach ``least`` by their length or letters are skipped."""
    import re

    spans = [m.span() for m in re.finditer(r"\S+", text)]
    if not want or not spans:
        return -1, 0, 0.0
    n, best, at = len(want.split(" ")), 0.0, (-1, 0)
    for size in sorted({n, n + 1, max(1, n - 1)}):
        for i in range(len(spans) - size + 1):
            a, b = spans[i][0], spans[i + size - 1][1]
            have = normalize_text(text[a:b])
            if not have or 2 * min(len(have), len(want)) / (len(have) + len(want)) < max(least, best):
                continue
            m = difflib.SequenceMatcher(None, want, have)
            if m.real_quick_ratio() >= max(least, best) and m.quick_ratio() >= max(least, best) and (r := m.ratio()) >= least and r > best:
                best, at = r, (a, b - a)
    return (*at, round(best, 4)) if at[0] >= 0 else (-1, 0, 0.0)


def coverage(found: DataFrame, key: str) -> DataFrame:
    """(key, template_id, anchors, exact, fuzzy, coverage): exact matches count 1, fuzzy ones 0.8, by the number of anchors."""
    g = found.groupBy(key, "template_id").agg(F.count("*").alias("anchors"), F.sum((F.col("method") == "exact").cast("bigint")).alias("exact"), F.sum((F.col("method") == "fuzzy").cast("bigint")).alias("fuzzy"))
    return g.withColumn("coverage", (F.col("exact") + FUZZY_WEIGHT * F.col("fuzzy")) / F.col("anchors"))


def _misplaced(templates: DataFrame) -> Column:
    """Whether a template has a region whose relative box is none."""
    if "regions" not in templates.columns:
        return F.lit(False)

    def bad(r: Column) -> Column:
        b = r["bbox_norm"]
        return b.isNotNull() & ~F.coalesce((b["x0"] >= 0) & (b["x0"] < b["x1"]) & (b["x1"] <= 1) & (b["y0"] >= 0) & (b["y0"] < b["y1"]) & (b["y1"] <= 1), F.lit(False))

    return F.coalesce(F.exists(F.map_values("regions"), bad), F.lit(False))


def score(texts: DataFrame, cover: DataFrame, templates: DataFrame, key: str) -> DataFrame:
    """(key, template_id, pos, confidence, form_number): 0.7 anchors and 0.3 form number where both are asked for; 0 outside the page counts; a fifth less below half the mean word confidence, half with a region whose box is none.

    ``texts`` has key, text, n_pages and avg_confidence.
    """
    t = F.broadcast(templates.select("template_id", "pos", "form_number_regex", "page_count_min", "page_count_max", F.size("anchors").alias("asked"), _misplaced(templates).alias("misplaced")))
    rows = texts.join(t, F.lit(True)).join(cover.select(key, "template_id", "coverage"), [key, "template_id"], "left")
    rows = rows.withColumn("form_number", F.when(F.col("form_number_regex").isNotNull() & F.expr("text rlike concat('(?iU)', form_number_regex)"), F.expr("regexp_extract(text, concat('(?iU)', form_number_regex), 0)")))
    form = F.col("form_number").isNotNull().cast("double")
    base = F.when((F.col("asked") > 0) & F.col("form_number_regex").isNotNull(), 0.7 * F.coalesce("coverage", F.lit(0.0)) + 0.3 * form).when(F.col("asked") > 0, F.coalesce("coverage", F.lit(0.0))).when(F.col("form_number_regex").isNotNull(), form).otherwise(0.0)
    base = F.when(~F.col("n_pages").between(F.col("page_count_min"), F.col("page_count_max")), 0.0).otherwise(base)
    base = F.when(F.col("avg_confidence") < 0.5, base * 0.8).otherwise(base)
    base = F.when(F.col("misplaced"), base * 0.5).otherwise(base)
    return rows.select(key, "template_id", "pos", F.round(base, 4).alias("confidence"), "form_number")


def detect(scores: DataFrame, key: str, least: float = DETECTED) -> DataFrame:
    """(key, template_id, confidence): the best template of each document, the first registered among equals; UNKNOWN below ``least``."""
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), "pos")
    best = scores.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return best.select(key, F.when(F.col("confidence") >= least, F.col("template_id")).otherwise("UNKNOWN").alias("template_id"), "confidence")


def evidence(documents: DataFrame, scores: DataFrame, cover: DataFrame, key: str, least: float = DETECTED) -> DataFrame:
    """(key, template_id, confidence, form_number, candidate_scores, warnings) for every document, also where no template is registered.

    Warnings of an unknown template: TEMPLATE_UNKNOWN and TEMPLATE_LOW_CONFIDENCE; of a known one, whether anchors are
    missing or were only found by similarity.
    """
    best = detect(scores, key, least)
    every = scores.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("template_id", "confidence")))).alias("candidate_scores"))
    joined = documents.select(key).join(best, key, "left").join(every, key, "left")
    joined = joined.join(scores.select(key, "template_id", "form_number"), [key, "template_id"], "left").join(cover.select(key, "template_id", "anchors", "exact", "fuzzy"), [key, "template_id"], "left")
    name = F.coalesce("template_id", F.lit("UNKNOWN"))
    none = F.expr("cast(array() as array<string>)")
    known = F.concat(F.when(F.col("exact") + F.col("fuzzy") < F.col("anchors"), F.array(F.lit("TEMPLATE_PARTIAL_ANCHORS"))).otherwise(none), F.when(F.col("fuzzy") > 0, F.array(F.lit("TEMPLATE_ANCHORS_FUZZY_MATCHED"))).otherwise(none))
    warnings = F.when(name == "UNKNOWN", F.array(F.lit("TEMPLATE_UNKNOWN"), F.lit("TEMPLATE_LOW_CONFIDENCE"))).otherwise(known)
    return joined.select(key, name.alias("template_id"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "form_number", F.coalesce("candidate_scores", F.expr("cast(map() as map<string, double>)")).alias("candidate_scores"), warnings.alias("warnings"))


def between(text: Column, start_anchor: Column, end_anchor: Column) -> Column:
    """struct(text, start_offset, end_offset, start_found, end_found): what stands between two anchors; a missing anchor is the text's end on that side."""
    s = F.when(start_anchor.isNull(), -1).otherwise(anchor_at(text, start_anchor))
    begin = F.when(s >= 0, s + F.length(start_anchor)).otherwise(0)
    e = F.when(F.length(end_anchor) > 0, F.call_function("locate", F.lower(end_anchor), F.lower(text), begin + 1) - 1).otherwise(-1)
    end = F.when(e >= 0, e).otherwise(F.length(text))
    inner = F.regexp_replace(F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0))), r"(?U)^\s+|\s+$", "")
    return F.struct(inner.alias("text"), begin.alias("start_offset"), end.alias("end_offset"), (start_anchor.isNull() | (s >= 0)).alias("start_found"), (end_anchor.isNull() | (F.coalesce(e, F.lit(-1)) >= 0)).alias("end_found"))


def inherit(schemas: list[dict]) -> list[dict]:
    """Template schemas with what they extend merged in: regions field by field, signature and layout key by key, all else replaced; cycles and unknown parents raise."""
    by_id = {}
    for s in schemas:
        if not isinstance(s.get("template_id"), str):
            raise ValueError("template_id must be a string")
        if by_id.setdefault(s["template_id"], s) is not s:
            raise ValueError(f"duplicate template {s['template_id']}")

    def whole(name: str, seen: tuple[str, ...]) -> dict:
        if name in seen:
            raise ValueError(f"templates extend each other: {' > '.join((*seen, name))}")
        if name not in by_id:
            raise ValueError(f"unknown template {name}")
        own = dict(by_id[name])
        parent = own.pop("extends", None)
        if parent is None:
            return own
        out = whole(parent, (*seen, name)) | {k: v for k, v in own.items() if k not in ("regions", "signature", "layout")}
        for k in ("signature", "layout"):
            if k in own or k in out:
                out[k] = {**(out.get(k) or {}), **(own.get(k) or {})}
        if "regions" in own or "regions" in out:
            regions = {r: dict(f) for r, f in (out.get("regions") or {}).items()}
            for r, fields in (own.get("regions") or {}).items():
                regions[r] = {**regions.get(r, {}), **fields}
            out["regions"] = regions
        return out

    return sorted((whole(name, ()) for name in by_id), key=lambda s: s["template_id"])
