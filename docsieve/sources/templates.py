"""Template schemas of YAML files: loading, checking and the table that the operators read."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from docsieve.operators.templates import inherit

SCHEMA = (
    "pos int, template_id string, jurisdiction string, version string, anchors array<string>, form_number_regex string, page_count_min int, page_count_max int, "
    "regions map<string, struct<anchor_start:string,anchor_end:string,bbox_norm:struct<x0:double,y0:double,x1:double,y1:double>>>"
)


def load(folder: str) -> list[dict]:
    """The schemas of all YAML files under a folder, with what they extend merged in, in order of their ids; a missing folder has none."""
    import yaml

    found = []
    for root, _, names in sorted(os.walk(folder)):
        for n in sorted(names):
            if n.endswith((".yaml", ".yml")):
                with open(os.path.join(root, n), encoding="utf-8") as f:
                    found.append(yaml.safe_load(f))
    schemas = inherit(found)
    for s in schemas:
        check(s)
    return schemas


def page_search(spec: object) -> tuple[list[int] | None, str]:
    """(candidate pages, null for any; strategy) of a page spec: a number, a list, "any", or a map of both."""
    if spec is None or spec == "any":
        return None, "best_match"
    if isinstance(spec, bool):
        raise ValueError("a page is a number")
    if isinstance(spec, int):
        if spec < 0:
            raise ValueError("a page is not negative")
        return [spec], "fixed"
    if isinstance(spec, list):
        if not spec or any(isinstance(p, bool) or not isinstance(p, int) or p < 0 for p in spec):
            raise ValueError("pages are numbers from 0 on, one at least")
        return list(dict.fromkeys(spec)), "best_match"
    if isinstance(spec, dict):
        pages, strategy = page_search(spec.get("candidates", "any"))
        strategy = spec.get("strategy", strategy)
        if strategy not in ("fixed", "best_match", "first_match"):
            raise ValueError(f"unknown strategy {strategy}")
        return pages, strategy
    raise ValueError(f"no page spec: {spec!r}")


def check(schema: dict) -> None:
    """Raises if a schema cannot be used: page counts, relative boxes and page specs."""
    layout = schema.get("layout") or {}
    low, high = layout.get("page_count_min", 1), layout.get("page_count_max", 99)
    if not 1 <= low <= high:
        raise ValueError(f"{schema['template_id']}: page counts {low} to {high}")
    for name, region in (schema.get("regions") or {}).items():
        box = region.get("bbox_norm")
        if box is not None and not (len(box) == 4 and 0 <= box[0] < box[2] <= 1 and 0 <= box[1] < box[3] <= 1):
            raise ValueError(f"{schema['template_id']}.{name}: {box} is no relative box")
        page_search(region.get("page", "any"))


def table(spark: SparkSession, schemas: list[dict]) -> DataFrame:
    """Schemas as a table; a bounded dimension, a row for each template."""
    rows = []
    for pos, s in enumerate(schemas):
        layout, signature = s.get("layout") or {}, s.get("signature") or {}
        regions = {n: (r.get("anchor_start"), r.get("anchor_end"), tuple(map(float, r["bbox_norm"])) if r.get("bbox_norm") else None) for n, r in (s.get("regions") or {}).items()}
        rows.append((pos, s["template_id"], s.get("jurisdiction"), str(s.get("version", "")), signature.get("anchor_text") or [], signature.get("form_number_regex"), layout.get("page_count_min", 1), layout.get("page_count_max", 99), regions))
    return spark.createDataFrame(rows, SCHEMA)
