"""Interfaces of detection and recognition providers, their registry, and the deterministic ones used in tests.

Models and their weights are not part of this library. A provider is a function over batches: its
model is loaded once per Python worker, its output has the columns named here.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.functions.spans import spans

ENTITY_SCHEMA = "entity_type string, text string, start_offset int, end_offset int, confidence double, provider string, detection_reason string"


@dataclass(frozen=True)
class Provider:
    """A named provider: what it yields, how trusted its published accuracy is, and whether it can run here."""

    name: str
    kind: str
    tier: str = "C"
    available: bool = False
    detect: Callable[..., DataFrame] | None = field(default=None, compare=False)


# Labels of token classifiers and the entity types they stand for; labels that map to None are dropped.
LABELS = {
    "piiranha": {
        "GIVENNAME": "PERSON_NAME", "SURNAME": "PERSON_NAME", "USERNAME": "PERSON_NAME", "MIDDLENAME": "PERSON_NAME", "EMAIL": "EMAIL", "TELEPHONENUM": "PHONE_NUMBER", "DATEOFBIRTH": "DATE_OF_BIRTH", "STREET": "ADDRESS", "BUILDINGNUM": "ADDRESS", "CITY": "ADDRESS",
        "STATE": "ADDRESS", "ZIPCODE": "ADDRESS", "COUNTRY": "ADDRESS", "SOCIALNUM": "SSN", "DRIVERLICENSENUM": "DRIVER_LICENSE", "IDCARDNUM": "CASE_NUMBER", "PASSPORTNUM": "CASE_NUMBER", "TAXNUM": "CASE_NUMBER", "ACCOUNTNUM": "INSURANCE_POLICY", "CREDITCARDNUMBER": "CASE_NUMBER",
    },
    "roberta_ner": {"PER": "PERSON_NAME", "LOC": "ADDRESS", "ORG": None, "MISC": None},
    "openai_privacy_filter": {"PRIVATE_PERSON": "PERSON_NAME", "PRIVATE_ADDRESS": "ADDRESS", "PRIVATE_EMAIL": "EMAIL", "PRIVATE_PHONE": "PHONE_NUMBER", "PRIVATE_DATE": "DATE_OF_BIRTH", "ACCOUNT_NUMBER": "INSURANCE_POLICY", "SECRET": "CASE_NUMBER", "PRIVATE_URL": None},
}
#: Least confidence by provider, and the type of labels not listed (None drops them).
LEAST = {"piiranha": 0.4, "roberta_ner": 0.85, "openai_privacy_filter": 0.85}
UNLISTED = {"piiranha": "CASE_NUMBER"}

# Patterns of the deterministic detector.
MOCK = (
    ("PHONE_NUMBER", r"\b\d{3}[-. ]?\d{3}[-. ]?\d{4}\b", "regex_phone_us"), ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "regex_email"), ("VIN", r"\b[A-HJ-NPR-Z0-9]{17}\b", "regex_vin"),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "regex_ssn"), ("PERSON_NAME", r"(?i:\b(?:JOHN|JANE)\s+DOE\b)", "regex_synthetic_name"),
)


def mock_pii(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Spans of the deterministic detector, confidence 0.9, in Spark expressions alone."""

    def of(kind: str, pattern: str, reason: str):
        def row(x):
            return F.struct(F.lit(kind).alias("entity_type"), x["value"].alias("text"), x["start"].alias("start_offset"), x["end"].alias("end_offset"), F.lit(0.9).alias("confidence"), F.lit("mock_pii").alias("provider"), F.lit(reason).alias("detection_reason"))

        return F.transform(spans(F.col(text), pattern), row)

    parts = [of(*m) for m in MOCK]
    return texts.where(F.col(text).isNotNull()).select(key, F.explode(F.concat(*parts)).alias("e")).select(key, "e.*")


def classified(texts: DataFrame, key: str, provider: str, load: Callable[[], Callable[[list[str]], list[list[dict]]]], labels: dict[str, str | None], text: str = "text") -> DataFrame:
    """Spans of a token classifier: ``load`` gives, once per worker, a function from texts to lists of {label, start, end, score}.

    Labels lose their BIO or BIOES prefix and are mapped; below the provider's least confidence they are
    dropped. A text the model fails on, or a blank one, has no spans; spans without offsets keep null ones.
    """
    least, unlisted = LEAST.get(provider, 0.0), UNLISTED.get(provider)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            rows = []
            for k, t in zip(b[key], b[text]):
                if not (t or "").strip():
                    continue
                try:
                    found = model([t])[0]
                except Exception:  # noqa: BLE001  one text's failure is not the run's
                    continue
                for e in found:
                    label = e["label"].upper()
                    label = label[2:] if label[:2] in ("B-", "I-", "E-", "S-") else label
                    target = labels.get(label, unlisted)
                    if target and e["score"] >= least:
                        s, n = e.get("start"), e.get("end")
                        rows.append((k, target, t[s:n] if s is not None else e.get("word"), s, n, float(e["score"]), provider, f"{provider}:{label}"))
            yield pd.DataFrame(rows, columns=[key, "entity_type", "text", "start_offset", "end_offset", "confidence", "provider", "detection_reason"]).astype({"start_offset": "Int32", "end_offset": "Int32"})

    return texts.select(key, text).mapInPandas(run, f"{key} {kind}, {ENTITY_SCHEMA}")


def labelled(predictions: DataFrame, provider: str) -> DataFrame:
    """``predictions`` (label, score, …) of a token classifier with entity_type: BIO and BIOES prefixes go, labels are mapped, those of no type and those below the provider's least confidence are dropped."""
    label = F.upper(F.regexp_replace("label", r"^[BIESbies]-", ""))
    known = {k: v for k, v in LABELS.get(provider, {}).items() if v}
    dropped = [k for k, v in LABELS.get(provider, {}).items() if v is None]
    mapped = F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), label) if known else F.lit(None).cast("string")
    kind = F.when(label.isin(*dropped), None).otherwise(F.coalesce(mapped, F.lit(UNLISTED.get(provider)).cast("string"))) if dropped else F.coalesce(mapped, F.lit(UNLISTED.get(provider)).cast("string"))
    return predictions.withColumn("entity_type", kind).where(F.col("entity_type").isNotNull() & (F.col("score") >= LEAST.get(provider, 0.0)))


def joined_tags(tags: DataFrame, key: str) -> DataFrame:
    """(key, label, start, end, score): spans of token tags (seq, tag, start, end, score); B and S begin one, I and E of the same label go on, their score is the mean."""
    w = Window.partitionBy(key).orderBy("seq")
    label, prefix = F.regexp_replace("tag", r"^[BIES]-", ""), F.upper(F.substring("tag", 1, 1))
    rows = tags.withColumn("label", F.when(F.col("tag") != "O", label)).withColumn("_p", prefix)
    new = F.col("label").isNotNull() & (F.col("_p").isin("B", "S") | ~F.coalesce(F.lag("label").over(w) == F.col("label"), F.lit(False)))
    rows = rows.withColumn("_g", F.sum(new.cast("int")).over(w)).where("label is not null")
    return rows.groupBy(key, "_g", "label").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.avg("score").alias("score")).drop("_g")


def chain(texts: DataFrame, detectors: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The entities of every detector over every text, put one after the other; each gives the same columns."""
    parts = [d(texts) for d in detectors]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: What the deterministic document model yields, by mode: (text, x0, y0, x1, y1, boxes, mappable) of its words.
VLM_MODES = ("default", "no_bboxes", "conflict_with_ocr", "hallucinated", "unmapped_pii")


def mock_vlm(pages: DataFrame, mode: str = "default") -> DataFrame:
    """Words of the deterministic document model for each page: one word, by mode without a box, at odds with the page, out of nowhere, or a name without a place."""
    if mode not in VLM_MODES:
        raise ValueError(f"unknown mode {mode}")
    text = {"conflict_with_ocr": "CONFLICT", "hallucinated": "HALLUCINATION", "unmapped_pii": "JOHN DOE"}.get(mode, "MOCK")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(50.0).alias("x1"), F.lit(20.0).alias("y1"))
    boxed = mode not in ("no_bboxes", "unmapped_pii")
    return pages.select("document_id", "page_index", F.lit(0).alias("ord"), F.lit(text).alias("text"), (box if boxed else F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")).alias("bbox"), F.lit(0.9).alias("confidence"), F.lit(boxed).alias("mappable"))


def mock_ocr(spark: SparkSession, pages: DataFrame, tokens: tuple[str, ...] = ("MOCK", "REPORT")) -> DataFrame:
    """Words of the deterministic recogniser for each page: fixed tokens, 50 by 20 pixels, 60 apart, confidence 0.97."""
    words = F.array(*map(F.lit, tokens))
    rows = pages.select("document_id", "page_index", F.posexplode(words).alias("ord", "text"))
    box = F.struct((F.col("ord") * 60.0).alias("x0"), F.lit(0.0).alias("y0"), (F.col("ord") * 60.0 + 50.0).alias("x1"), F.lit(20.0).alias("y1"))
    return rows.select("document_id", "page_index", "ord", F.format_string("p%d_w%05d", "page_index", "ord").alias("word_id"), "text", box.alias("bbox"), F.lit(0.97).alias("confidence"))


def noop_ocr(pages: DataFrame) -> DataFrame:
    """No words at all."""
    return mock_ocr(pages.sparkSession, pages.where(F.lit(False)))


REGISTRY = {
    p.name: p
    for p in (
        Provider("regex", "pii", "A", True), Provider("mock_pii", "pii", "C", True, mock_pii), Provider("piiranha", "pii", "B"), Provider("roberta_ner", "pii", "B"), Provider("openai_privacy_filter", "pii", "C"), Provider("presidio", "pii", "C"),
        Provider("mock_ocr", "ocr", "C", True, mock_ocr), Provider("noop", "ocr", "C", True, noop_ocr), Provider("onnxtr", "ocr", "B"), Provider("tesseract", "ocr", "C"), Provider("paddleocr", "ocr", "C"),
        Provider("mock_vlm", "document", "C", True, mock_vlm), Provider("kosmos25", "document", "C"), Provider("layoutlm", "document", "C"),
    )
}


def inventory(tier: str | None = None) -> list[Provider]:
    """Registered providers in order of name; with a tier A, B or C only those of it; any other tier hides all."""
    return [p for _, p in sorted(REGISTRY.items()) if tier is None or (tier in "ABC" and p.tier == tier)]
