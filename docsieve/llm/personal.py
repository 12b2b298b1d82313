"""Problem 2: personal information inside free text.

A linear-chain conditional random field over word-shape features is trained from a small labelled
table and decoded by Viterbi in numpy batches; spans get typed placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import crf, linear, personal_table
from docsieve.llm.lookalike import plain
from docsieve.session import cut, once

TYPES = ("PERSON_NAME", "EMAIL", "PHONE_NUMBER", "SSN", "DRIVER_LICENSE", "ADDRESS")
LABELS = ["O", *[f"{p}-{t}" for t in TYPES for p in "BI"]]
BUCKETS = 1 << 17
#: Labelled sentences the field is fitted on.
SENTENCES = 5000
#: Bound of the narratives that the field is fitted on a second time, with the entities that detectors gave for them.
SAMPLE = 600
#: A word or a neighbour is known by so many spans; if fewer than LEAST of them were confirmed, they are no spans.
KNOWN, LEAST = 6, 0.1

_TOKEN = re.compile(r"(?:[^\W\d_]|[\u0300-\u036f\u200b-\u200d\u2060\ufeff\u00ad])+|\d|[^\w\s]|_")
_PAGE = re.compile(r"^[^\w\n]*(?:(?:p\s?a\s?g\s?e|pg\.?)\s*)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?[^\w\n.,;:]*$", re.I)
_HEADER = re.compile(r"\b(?:form|report|case|page|pg|confidential|department|sheriff|division|investigation)\b", re.I)


def furniture(text: str, recurring: Collection[int] = ()) -> list[tuple[int, int]]:
    """Extents of lines within a text that are page numbers or running headers.

    A header is a title in capitals that names a form, case or office and, as running text can look
    the same, has its number among ``recurring``, the lines that recur in the corpus.
    """
    if "\n" not in text:
        return []
    out, at = [], 0
    capitals = text.upper() == text
    for i, line in enumerate(text.split("\n")):
        end, bare = at + len(line), line.strip()
        if bare and (_PAGE.match(bare) or (i in recurring and _HEADER.search(plain(bare)) and not re.search(r"[.,;!?\"]$", bare) and _titled(bare, capitals))):
            out.append((at, end))
        at = end + 1
    return out


def _titled(line: str, capitals: bool) -> bool:
    words = [w for w in re.findall(r"[^\W\d_]+", line) if len(w) > 1]
    if capitals and not re.search(r"\d|\s-\s|\s{2}|/", line):
        return False
    return bool(words) and all(w[0].isupper() for w in words)


def streams(text: str, recurring: Collection[int] = ()) -> list[np.ndarray]:
    """Extents of the tokens of a text (words, single digits, signs), in streams: running text, then each line that interrupts it by itself. No token is left out."""
    found = np.array([m.span() for m in _TOKEN.finditer(text)], np.int64).reshape(-1, 2)
    skip = furniture(text, recurring)
    if not skip:
        return [found]
    within = np.zeros(len(found), bool)
    lines = []
    for a, b in skip:
        i, j = np.searchsorted(found[:, 0], (a, b))
        within[i:j] = True
        lines.append(found[i:j])
    return [found[~within], *(x for x in lines if len(x))]


_MISREAD = str.maketrans("01|!5", "olils")
_SHORT = {"mr", "ms", "mrs", "dr", "sr", "sra", "mme", "m", "st", "núm", "apto", "apt", "soc", "det", "sgt", "lt", "cpl", "ofc", "prof", "no", "tel", "ave", "rd", *"abcdefghijklmnoprstvwyzé"}


@lru_cache(maxsize=1 << 17)
def _word(w: str) -> tuple[int, ...]:
    """Hashes of what a token shows by itself: word, shape, beginnings and ends."""
    p = plain(w)
    low = p.lower()
    low = low.translate(_MISREAD) if not p.isdigit() and len(p) > 2 else low
    shape = re.sub(r"[^\W\d_]", lambda m: "A" if m.group().isupper() else "a", p) if p[:1].isalpha() else "9" if p.isdigit() else p
    short = re.sub(r"(.)\1+", r"\1+", shape)
    names = ("9" if p.isdigit() else low, "s" + short, "p" + low[:3], "q" + low[:4], "x" + low[-3:], "y" + low[-4:], "z" + low[-2:], f"n{min(len(p), 8)}{short}")
    return tuple(linear.bucket(n, 1 << 31) for n in names)


def _mix(a: np.ndarray, b) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (a * np.uint64(0xC2B2AE3D27D4EB4F) ^ (b + np.uint64(0x165667B1)) * np.uint64(0x9E3779B97F4A7C15)) + (a >> np.uint64(17))


def _bucket(values: np.ndarray, column: int) -> np.ndarray:
    m = _mix(values, np.uint64(0x9E3779B9 * (column + 1)))
    return ((m ^ (m >> np.uint64(31))) >> np.uint64(7)).astype(np.int64) & (BUCKETS - 1)


#: Features by column: 0 to 7 a token's own, 8 and 9 its word and shape with the gap before it, from 10 on the words up to PAD places away and the shapes up to two, from PAIRS on pairs and runs.
PAD, PAIRS = 4, 22
_AWAY = (-4, -3, -2, -1, 1, 2, 3, 4)
_NEAR = (-2, -1, 1, 2)


class Tokens:
    """Tokens of many streams laid end to end with PAD empty ones around each, their hashes and the gaps between them."""

    def __init__(self, texts: list[str], of: list[int], ats: list[np.ndarray]):
        words, gaps, ends = [""] * PAD, [np.full(PAD, 3, np.int64)], []
        self.starts, at = [], PAD
        for k, spans in zip(of, ats):
            text = texts[k]
            words += [text[a:b] for a, b in spans.tolist()]
            words += [""] * PAD
            gap = np.ones(len(spans) + PAD, np.int64)  # 0 glued to the token before, 1 after a space, 2 on a new line
            gap[len(spans) :] = 3
            if len(spans) > 1:
                before, first = spans[:-1, 1], spans[1:, 0]
                gap[1 : len(spans)][before == first] = 0
                if "\n" in text:
                    breaks = np.array([m.start() for m in re.finditer("\n", text)])
                    gap[1 : len(spans)][np.searchsorted(breaks, first) > np.searchsorted(breaks, before)] = 2
            gaps.append(gap)
            self.starts.append(at)
            at += len(spans) + PAD
        self.words, self.gap = words, np.concatenate(gaps)
        self.sizes = [len(x) for x in ats]
        self.at = np.concatenate([np.arange(a, a + n) for a, n in zip(self.starts, self.sizes)]) if self.starts else np.zeros(0, np.int64)
        distinct: dict[str, int] = {}
        self.ids = np.fromiter((distinct.setdefault(w, len(distinct)) for w in words), np.int64, len(words))
        self.distinct = list(distinct)
        self.own = np.array([_word(w) if w else (0,) * 8 for w in self.distinct], np.uint64).reshape(-1, 8)

    def pairs(self) -> Iterator[np.ndarray]:
        """Values of the columns from PAIRS on."""
        own, gap, ids = self.own, self.gap.astype(np.uint64), self.ids

        def w(k: int, c: int) -> np.ndarray:
            return own[ids[self.at + k], c]

        word, shape = {k: w(k, 0) for k in range(-2, 3)}, {k: w(k, 1) for k in range(-4, 5)}
        yield from (_mix(word[-1], word[0]), _mix(word[0], word[1]), _mix(shape[-1], shape[0]), _mix(shape[0], shape[1]), _mix(word[-2], word[-1]), _mix(word[1], word[2]))
        wide = {k: _mix(shape[k], gap[self.at + k]) for k in range(-4, 5)}
        back, ahead = _mix(wide[-1], wide[0]), _mix(wide[0], wide[1])
        yield from (_mix(wide[-1], ahead), _mix(ahead, _mix(wide[2], wide[3])), _mix(_mix(wide[-3], wide[-2]), back))
        yield from (_mix(_mix(_mix(wide[-4], wide[-3]), _mix(wide[-2], wide[-1])), wide[0]), _mix(_mix(ahead, _mix(wide[2], wide[3])), wide[4]))
        yield from (_mix(w(-1, 7), w(0, 7)), _mix(w(-1, 5), shape[0]), _mix(w(1, 4), shape[0]))

    def features(self) -> np.ndarray:
        """Buckets of all features of every token, one column per kind."""
        own, ids, at = self.own, self.ids, self.at
        gap = self.gap[at].astype(np.uint64)
        columns = [own[ids[at], c] for c in range(8)] + [own[ids[at], 0] + gap, own[ids[at], 1] * np.uint64(5) + gap]
        columns += [own[ids[at + k], 0] for k in _AWAY] + [own[ids[at + k], 1] for k in _NEAR] + list(self.pairs())
        return np.stack([_bucket(c, i).astype(np.int32) for i, c in enumerate(columns)], 1)

    def scores(self, field: crf.Field) -> np.ndarray:
        """The field's label scores of every token: those of single words are looked up by distinct word, pairs by token."""
        emit = field.emit
        alone = sum(emit[_bucket(self.own[:, c], c)] for c in range(8))
        gapped = np.stack([alone + emit[_bucket(self.own[:, 0] + np.uint64(g), 8)] + emit[_bucket(self.own[:, 1] * np.uint64(5) + np.uint64(g), 9)] for g in range(3)], 1)
        out = gapped[self.ids[self.at], self.gap[self.at]]
        for i, k in enumerate(_AWAY):
            there = emit[_bucket(self.own[:, 0], 10 + i)]
            if k in _NEAR:
                there = there + emit[_bucket(self.own[:, 1], 10 + len(_AWAY) + _NEAR.index(k))]
            out += there[self.ids[self.at + k]]
        for i, values in enumerate(self.pairs()):
            out += emit[_bucket(values, PAIRS + i)]
        return out

    def chains(self) -> np.ndarray:
        """Lengths of the chains that streams are cut into, at ends of sentences alone; features look beyond them."""
        end = np.array([w in (".", "!", "?") for w in self.distinct], bool)
        short = np.array([w.lower() in _SHORT for w in self.distinct], bool)
        ids, at, out = self.ids, self.at, []
        can = np.flatnonzero((self.gap[at] > 0) & end[ids[at - 1]] & ~short[ids[at - 2]])
        begins = np.cumsum([0, *self.sizes])
        k = 0
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            while k < len(can) and can[k] <= a:
                k += 1
            begin = a
            while k < len(can) and can[k] < b:
                if can[k] - begin > 12:
                    out.append(can[k] - begin)
                    begin = can[k]
                k += 1
            if b > begin:
                out.append(b - begin)
        return np.array(out, np.int64)


Example = tuple[str, list[tuple[int, int, str]]]


def _labelled(rows: list[Example], recurring: list[Collection[int]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, lengths of chains) of texts with spans."""
    texts, of, ats = _streams([t for t, _ in rows], recurring)
    tokens = Tokens(texts, of, ats)
    labels = []
    for k, at in zip(of, ats):
        tags = np.zeros(len(at), np.int64)
        for a, b, kind in rows[k][1]:
            i, j = np.searchsorted(at[:, 1], a, side="right"), np.searchsorted(at[:, 0], b)
            if i < j:
                tags[i:j] = LABELS.index(f"I-{kind}")
                tags[i] = LABELS.index(f"B-{kind}")
        labels.append(tags)
    y, lengths = np.concatenate(labels), tokens.chains()
    first = np.cumsum(lengths) - lengths
    inside = y[first]
    y[first] = np.where((inside > 0) & (inside % 2 == 0), inside - 1, inside)  # a chain cannot begin within a span
    return tokens.features(), y, lengths


def _streams(texts: list[str], recurring: list[Collection[int]] | None) -> tuple[list[str], list[int], list[np.ndarray]]:
    of, ats = [], []
    for k, (t, r) in enumerate(zip(texts, recurring or [()] * len(texts))):
        for at in streams(t, r):
            of.append(k)
            ats.append(at)
    return texts, of, ats


@lru_cache(maxsize=2)
def model(sentences: int = SENTENCES) -> crf.Field:
    """The field, fitted once per driver on the labelled table."""
    return crf.Field(LABELS, BUCKETS).fit(*_labelled(personal_table.rows(sentences)))


def adapted(field: crf.Field, given: list[tuple[str, Collection[int], list[tuple[int, int, str, str]]]]) -> crf.Field:
    """``field`` fitted a second time on texts with the entities (start, end, type, provider) that detectors gave for them.

    Entities are incomplete and partly wrong. Providers of which the field finds fewer than half of the
    spans are not believed. Spans of the others are taken over, and those that the field finds besides,
    unless its word or a neighbouring word is one whose spans the entities never confirm.
    """
    texts, recurring = [t for t, _, _ in given], [r for _, r, _ in given]
    found = spans_of(texts, field, recurring)
    hits: dict[str, list[int]] = {}
    for own, (_, _, entities) in zip(found, given):
        for a, b, kind, provider in entities:
            if kind in TYPES:
                n = hits.setdefault(provider, [0, 0])
                n[0] += any(k == kind and s < b and e > a for s, e, k in own)
                n[1] += 1
    believed = {p for p, (n, all_) in hits.items() if n * 2 >= all_}
    sure = [[(a, b, kind) for a, b, kind, p in sorted(set(entities)) if p in believed and kind in TYPES] for _, _, entities in given]

    def signs(text: str, a: int, b: int, kind: str) -> list[tuple[str, str, str]]:
        words = re.findall(r"[^\W\d_]+", text[a:b].lower()) if kind == "PERSON_NAME" else []
        before, after = re.search(r"(\w+|[^\w\s])\s*$", text[max(0, a - 30) : a]), re.match(r"\s*(\w+|[^\w\s])", text[b : b + 30])
        return [(kind, "word", w) for w in words] + [(kind, "before", before.group(1).lower() if before else "^"), (kind, "after", after.group(1).lower() if after else "$")]

    counts: dict[tuple[str, str, str], list[int]] = {}
    for text, own, known in zip(texts, found, sure):
        for a, b, kind in own:
            ok = any(s < b and e > a and k == kind for s, e, k in known)
            for sign in signs(text, a, b, kind):
                n = counts.setdefault(sign, [0, 0])
                n[0] += ok
                n[1] += 1
    never = {sign for sign, (n, all_) in counts.items() if all_ >= KNOWN and n < LEAST * all_}
    rows = []
    for text, own, known in zip(texts, found, sure):
        spans, end = [], 0
        for a, b, kind in sorted(known + [s for s in own if not any(x < s[1] and y > s[0] for x, y, _ in known) and never.isdisjoint(signs(text, *s))], key=lambda s: (s[0], -s[1])):
            if a >= end:
                spans.append((a, b, kind))
                end = b
        rows.append((text, spans))
    del found, sure, counts
    x, y, lengths = _labelled(rows, recurring)
    own = _labelled(personal_table.rows(SENTENCES // 2, seed=7))
    return field.copy().fit(np.concatenate([x, own[0]]), np.concatenate([y, own[1]]), np.concatenate([lengths, own[2]]), epochs=2)


def spans_of(texts: list[str], field: crf.Field, recurring: list[Collection[int]] | None = None) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, type) of each text; ``recurring`` has the lines of each that recur in the corpus."""
    _, of, ats = _streams(texts, recurring)
    tokens = Tokens(texts, of, ats)
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not len(tokens.at):
        return out
    tags = field.decode(tokens.scores(field), tokens.chains())
    flat, stream = np.concatenate(ats), np.repeat(np.arange(len(ats)), tokens.sizes)
    raw: dict[int, list[tuple[int, int, str]]] = {}
    open_: list | None = None
    for i in np.flatnonzero(tags).tolist():
        tag, (a, b) = LABELS[tags[i]], flat[i].tolist()
        if tag[0] == "I" and open_ and open_[2] == tag[2:] and open_[3] == i - 1 and open_[4] == stream[i]:
            open_[1], open_[3] = b, i
            continue
        if open_:
            raw.setdefault(open_[4], []).append((open_[0], open_[1], open_[2]))
        open_ = [a, b, tag[2:], i, stream[i]]
    if open_:
        raw.setdefault(open_[4], []).append((open_[0], open_[1], open_[2]))
    for k in sorted(raw):
        text, held = texts[of[k]], out[of[k]]
        spans = [s for s in (checked(text, *s) for s in parted(text, raw[k])) if s]
        held += [s for s in spans if not any(a < s[1] and b > s[0] for a, b, _ in held)] if held else spans
    return [sorted(spans) for spans in out]


_ROLE = re.compile(r"(?:(?:adjuster|officer|witness|trooper|sergeant|deputy|mr|ms|mrs|dr|sr|sra|mme|testigo|témoin|agente)\b\.?\s+)+", re.I)
_MAIL = re.compile(r"(?:[@＠]|\bat\b).*?(?:\.|\bdot\b|\b[dp]unto\b|\bpoint\b)", re.I | re.S)
# Numerals of the three languages.
_NUMERALS = "oh|zero|one|two|three|four|five|six|seven|eight|nine|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf"
_SPOKEN = re.compile(rf"\b(?:{_NUMERALS})\b", re.I)
_BOTH = re.compile(rf"\s+(?:and|or|y|o|et|ou)\s+(?=[(+\d]|(?:{_NUMERALS})\b)", re.I)


def parted(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans in which two phone numbers ran together are parted."""
    out = []
    for a, b, kind in spans:
        if kind == "PHONE_NUMBER" and (m := _BOTH.search(text, a, b)):
            out += [(a, m.start(), kind), (m.end(), b, kind)]
        else:
            out.append((a, b, kind))
    return out


def checked(text: str, start: int, end: int, kind: str) -> tuple[int, int, str] | None:
    """A span that can be one of its kind, with signs around it left out; else nothing."""
    value = text[start:end]
    opened = {"PHONE_NUMBER": "(+", "PERSON_NAME": ""}.get(kind, "")
    while value and not value[0].isalnum() and value[0] not in opened:
        start, value = start + 1, value[1:]
    if kind == "PHONE_NUMBER" and value.startswith("(") and (")" not in value or value.startswith("((")):
        start, value = start + 1, value[1:]
    if kind == "PERSON_NAME" and (m := _ROLE.match(value)):
        start, value = start + m.end(), value[m.end() :]
    if kind in ("PHONE_NUMBER", "SSN", "DRIVER_LICENSE") and (start and text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()):
        return None  # part of a longer code
    digits = sum(c.isdigit() for c in value)
    spoken = digits + len(_SPOKEN.findall(plain(value)))
    if kind == "EMAIL":
        if not _MAIL.search(value):
            return None
        sign = re.search(r"[^\s(<\[]*[@＠]", value)  # nothing but the local part stands before the sign
        if sign and sign.start() and len(sign.group()) > 1:
            start, value = start + sign.start(), value[sign.start() :]
    if kind == "PHONE_NUMBER" and spoken < 7:
        return None
    if kind == "SSN" and spoken < 6 or kind == "DRIVER_LICENSE" and digits < 4 or kind == "ADDRESS" and not digits:
        return None
    return (start, end, kind) if value and any(c.isalnum() for c in value) else None


def shipped(rows: DataFrame, entities: DataFrame | None):
    """The field, fitted on the driver, as a broadcast variable: BUCKETS times the labels, 7 MB.

    ``rows`` has narrative_id, text and recurring. With ``entities`` it is fitted a second time, on at
    most SAMPLE narratives.
    """
    field = model()
    if entities is not None:
        picked = rows.where("text <> ''").orderBy(F.xxhash64("narrative_id"), "narrative_id").limit(SAMPLE)
        spans = entities.where("start_offset >= 0 and end_offset > start_offset").select("narrative_id", F.struct("start_offset", "end_offset", "entity_type", F.coalesce("provider", F.lit("")).alias("provider")).alias("e"))
        joined = picked.join(spans, "narrative_id", "left").groupBy("narrative_id").agg(F.first("text").alias("text"), F.first("recurring").alias("recurring"), F.array_sort(F.collect_set("e")).alias("es"))
        given = [(r.text, r.recurring, [tuple(e) for e in r.es]) for r in joined.orderBy("narrative_id").collect()]
        if any(es for _, _, es in given):
            field = adapted(adapted(field, given), given)
    return rows.sparkSession.sparkContext.broadcast(field)


def _rows(narratives: DataFrame, recurring: DataFrame | None) -> DataFrame:
    rows = once(narratives.select("narrative_id", "text"), "narrative_id")
    if recurring is None:
        return rows.withColumn("recurring", F.array().cast("array<int>"))
    return rows.join(recurring, "narrative_id", "left").withColumn("recurring", F.coalesce("recurring", F.array().cast("array<int>")))


def find(narratives: DataFrame, recurring: DataFrame | None = None, entities: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """(narrative_id, entity_type, start_offset, end_offset): every span in the text of a narrative, each once.

    Offsets are code points of the text as delivered. Null and empty texts have no spans. Redelivered
    rows count once. Every whole text is decoded, sentence by sentence; features look across their ends.
    Page numbers and the headers among ``recurring`` (narrative_id, recurring: numbers of lines) are
    decoded by themselves, so that the sentence they interrupt stays whole. ``entities`` (narrative_id,
    start_offset, end_offset, entity_type, provider), as far as there are any, adapt the field to the data.
    """
    rows = cut(_rows(narratives, recurring).where("text <> ''"))
    key = narratives.schema["narrative_id"].dataType.simpleString()

    weights = shipped(rows, entities)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = weights.value
        for b in batches:
            for i in range(0, len(b), batch):
                ids, texts = b["narrative_id"].iloc[i : i + batch], b["text"].iloc[i : i + batch].tolist()
                lines = b["recurring"].iloc[i : i + batch].tolist()
                out = [(n, k, a, e) for n, found in zip(ids, spans_of(texts, field, lines)) for a, e, k in found]
                yield pd.DataFrame(out, columns=["narrative_id", "entity_type", "start_offset", "end_offset"])

    return rows.mapInPandas(decode, f"narrative_id {key}, entity_type string, start_offset int, end_offset int")


def masked(narratives: DataFrame, recurring: DataFrame | None = None, entities: DataFrame | None = None, batch: int = 256) -> DataFrame:
    """(narrative_id, text): texts with spans replaced by [TYPE] and all else unchanged; null stays null, empty stays empty."""
    rows = cut(_rows(narratives, recurring))
    key = narratives.schema["narrative_id"].dataType.simpleString()

    weights = shipped(rows, entities)

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = weights.value
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                texts = [t or "" for t in part["text"]]
                out = []
                for t, found, given in zip(texts, spans_of(texts, field, part["recurring"].tolist()), part["text"]):
                    for a, e, kind in reversed(found):
                        t = f"{t[:a]}[{kind}]{t[e:]}"
                    out.append(None if given is None else t)
                yield pd.DataFrame({"narrative_id": part["narrative_id"], "text": out})

    return rows.mapInPandas(replace, f"narrative_id {key}, text string")
