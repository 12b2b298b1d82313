"""Pattern recognizers of personal data over a table of texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.spans import spans


@dataclass(frozen=True)
class Recognizer:
    entity_type: str
    reason: str
    confidence: float
    group: int
    pattern: str


# The shapes that recognised data have, with their confidences and reasons.
RECOGNIZERS = (
    Recognizer("VIN", "regex_vin_iso3779", 0.92, 0, r"\b[A-HJ-NPR-Z0-9]{17}\b"),
    Recognizer("LICENSE_PLATE", "regex_license_plate_contextual", 0.8, 1, r"(?i:license\s+plate|plate\s+number|plate|tag\s+number|tag)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9-]{2,8})"),
    Recognizer("DRIVER_LICENSE", "regex_driver_license_contextual", 0.85, 1, r"(?i:driver'?s?\s+license|D\.?L\.?)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9-]{3,14})"),
    Recognizer("PHONE_NUMBER", "regex_phone_us", 0.85, 0, r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]?\d{3}[-. ]?\d{4}\b"),
    Recognizer("EMAIL", "regex_email", 0.95, 0, r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"),
    Recognizer("ADDRESS", "regex_us_street_address", 0.7, 0, r"(?i:\b\d{1,5}\s+(?:[NSEW]\.?\s+)?[A-Za-z][\w\.]{1,30}(?:\s+[A-Za-z][\w\.]{0,20}){0,3}\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Court|Ct|Place|Pl|Highway|Hwy|Parkway|Pkwy|Trail|Trl)\b\.?)"),
    Recognizer("DATE_OF_BIRTH", "regex_dob_contextual", 0.85, 1, r"(?i:DOB|D\.O\.B\.|date\s+of\s+birth|born)\s*[:\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"),
    Recognizer("REPORT_NUMBER", "regex_report_number_contextual", 0.85, 1, r"(?i:report(?:\s+(?:number|no\.?|#))?|incident\s+number)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9-]{2,19})"),
    Recognizer("CASE_NUMBER", "regex_case_number_contextual", 0.85, 1, r"(?i:case(?:\s+(?:number|no\.?|#))?)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9-]{2,19})"),
    Recognizer("INSURANCE_POLICY", "regex_insurance_policy_contextual", 0.85, 1, r"(?i:insurance\s+policy|policy(?:\s+number|\s+no\.?|\s+#)?)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9-]{3,19})"),
    Recognizer("PERSON_NAME", "regex_person_name", 0.7, 1, r"(?i:officer|driver|witness|owner|operator|patient|pedestrian|suspect|victim|named)\s+([A-Z][a-zA-Z'\.]{1,30}(?:\s+[A-Z][a-zA-Z'\.]{1,30}){0,3})\b"),
    Recognizer("SIGNATURE", "regex_signature_label", 0.6, 1, r"(?i:signature|signed\s+by)\s*[:\-]\s*([A-Z][a-zA-Z'\.\s]{2,40})"),
    Recognizer("MEDICAL_INFO", "regex_medical_keywords", 0.6, 0, r"(?i:\b(?:hospital|EMS|paramedic|ambulance|injury|injured|fatal|fatality|BAC|blood\s+alcohol|toxicology|deceased|transported\s+to|treated\s+at)\b)"),
)
# positions' weights and letters' values of the vehicle number check digit (ISO 3779).
VIN_LETTERS, VIN_VALUES = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
# What is taken out of log lines, in this order.
LOG_PATTERNS = (
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[EMAIL]"), (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"), (r"\b\d{3}[-. ]\d{3}[-. ]\d{4}\b", "[PHONE_NUMBER]"), (r"\b[A-HJ-NPR-Z0-9]{17}\b", "[VIN]"),
)


def vin_valid(value: Column) -> Column:
    """Whether the ninth place of a vehicle number is its check digit."""
    digits = F.translate(value, VIN_LETTERS, VIN_VALUES)
    total = sum((F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(VIN_WEIGHTS)), F.lit(0))
    return F.substring(value, 9, 1) == F.when(total % 11 == 10, F.lit("X")).otherwise((total % 11).cast("string"))


def birth_valid(value: Column, as_of: Column) -> Column:
    """Whether a month/day/year date exists, with four digits of the year, from 1900 to ``as_of``."""
    parts = F.split(value, "[/-]")
    year, month, day = (F.get(parts, F.lit(i)).cast("int") for i in (2, 0, 1))
    date = F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0))
    return (F.length(F.get(parts, F.lit(2))) == 4) & (year >= 1900) & F.coalesce(date.cast("date") <= as_of, F.lit(False))


def detect(texts: DataFrame, key: str, text: str = "text", scope: str = "narrative", as_of: str = "2026-01-01", recognizers: tuple[Recognizer, ...] = RECOGNIZERS) -> DataFrame:
    """(key, entity_type, text, start_offset, end_offset, confidence, detection_reason, scope): one row per recognised span.

    All recognizers read the text in one scan. Null and empty texts give no rows.
    """
    def of(r: Recognizer) -> Column:
        s = spans(F.col(text), r.pattern, r.group)
        if r.entity_type == "VIN":
            s = F.filter(s, lambda x: vin_valid(x["value"]))
        if r.entity_type == "DATE_OF_BIRTH":
            s = F.filter(s, lambda x: birth_valid(x["value"], F.lit(as_of).cast("date")))

        def row(x: Column) -> Column:
            value = F.regexp_replace(x["value"], r"(?U)\s+$", "") if r.entity_type == "SIGNATURE" else x["value"]
            return F.struct(F.lit(r.entity_type).alias("entity_type"), value.alias("text"), x["start"].alias("start_offset"), (x["start"] + F.length(value)).alias("end_offset"), F.lit(r.confidence).alias("confidence"), F.lit(f"{r.reason}:{scope}").alias("detection_reason"))

        return F.transform(F.coalesce(s, F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")), row)

    return texts.where(F.col(text) != "").select(F.col(key), F.explode(F.concat(*(of(r) for r in recognizers))).alias("e")).select(key, "e.*", F.lit(scope).alias("scope"))


def log_filter(text: Column) -> Column:
    """A log line with mail addresses, social security, phone and vehicle numbers replaced, in this order."""
    for pattern, by in LOG_PATTERNS:
        text = F.regexp_replace(text, "(?U)" + pattern, by)
    return text
