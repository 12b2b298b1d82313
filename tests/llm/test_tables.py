import random

import pandas as pd

from docsieve.llm import crf, passages, personal, personal_table

DATA = "/root/testdata/sf0.01"


def test_no_labelled_text_is_taken_from_the_data():
    corpus = "\n".join([*pd.read_parquet(f"{DATA}/documents.parquet").text.dropna(), *pd.read_parquet(f"{DATA}/narratives.parquet").text.dropna()]).lower()
    long = {t for t, _ in passages.labelled() if len(t.split()) > 3}
    assert len(long) > 1000 and not [t for t in long if t.lower() in corpus]
    fixed = [f for f in personal_table.FRAMES if "<" not in f and "{" not in f and len(f.split()) > 3]
    assert not [f for f in fixed if f.lower() in corpus]
    given = set(pd.read_parquet(f"{DATA}/review_samples.parquet").text.dropna())
    assert not given & long


def test_field_on_held_out_frames():
    frames = list(personal_table.FRAMES)
    random.Random(3).shuffle(frames)
    cut = len(frames) // 5
    field = crf.Field(personal.LABELS, personal.BUCKETS).fit(*personal._labelled(personal_table.rows(2500, seed=1, frames=frames[cut:])))
    rows = personal_table.rows(500, seed=9, frames=frames[:cut])
    got = {(i, *s) for i, spans in enumerate(personal.spans_of([t for t, _ in rows], field)) for s in spans}
    want = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans}
    precision, recall = len(got & want) / len(got), len(got & want) / len(want)
    print(precision, recall)
    assert precision > 0.7 and recall > 0.7
