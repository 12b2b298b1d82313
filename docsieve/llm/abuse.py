"""Problem 8: abusive, hateful and sexually explicit language.

FTRL-proximal logistic regression over hashed word n-grams and skip-grams: per-coordinate rates and
L1 sparsity give compact weights that are shipped to the workers, which score every passage of
every document; a document has the score of its worst passage.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsieve.llm import linear, passages, personal_table

BUCKETS = 1 << 20
#: Bound of the corpus sentences taken as background; scores from which one is taken to be harmful and up to which to be harmless, by round. Weight of one that is not known to be harmless: least, most, and that of all together.
BACKGROUND, ROUNDS = 20000, ((0.6, 0.2), (0.6, 0.2), (0.6, 0.3))
UNSURE = (0.1, 0.4, 2000)
#: Bound of the reviewed samples used.
REVIEWED = 5000
#: Tokens of a passage that is scored; one begins at every token.
WINDOW = 14
THRESHOLD = 0.7
#: The fixed bias of the model: a passage without evidence is harmless.
BIAS = -2.0

_LEET = str.maketrans("@431!0$57|€", "aaeiiosstie")
_SPACED = re.compile(r"(?<!\w)(?:[^\W_] ){2,}[^\W_](?!\w)")
_TOKEN = re.compile(r"[^\W_]*(?:[$@](?=[^\W_]))?[^\W_]+(?:[*#$@|€][^\s,.;:?!\"')]*|!(?=[^\W_])[^\s,.;:?\"')]*|(?:['’][^\W_]+))*|[*]{2,}|[.!?;:\n]")
_STARS = re.compile(r"^\w?[*#]{2,}\w?$|^\w[*#]+\w*$")
_RUN = re.compile(r"([^\W\d_])\1+")
BREAK = "|"


def _parts(t: str) -> tuple[str, ...]:
    """What a token stands for with disguises undone; hidden letters give a mark of their own besides."""
    if t[0] in ".!?;:\n":
        return (BREAK,)
    if _STARS.match(t):
        return ("*", f"{t[0]}*{t[-1]}{len(t)}")
    if not t.isalpha():
        if t.isdigit():
            t = "0"
        elif re.search(r"[^\W\d]", t):
            t = re.sub(r"['’*#]", "", t.translate(_LEET))
    t = _RUN.sub(r"\1", t)
    return (t,) if t else ()


def _raw(text: str) -> list[str]:
    text = text.lower()
    if not text.isascii():
        text = re.sub(r"[\u200b-\u200d\u2060\ufeff\u00ad]", "", text)
    if _SPACED.search(text):
        text = _SPACED.sub(lambda m: m.group().replace(" ", ""), text)
    return _TOKEN.findall(text)


def words(text: str) -> list[str]:
    """Words of a text with disguises undone: spaced letters joined, repeated letters and look-alike digits and signs reduced; ``|`` for a break."""
    out: list[str] = []
    for t in _raw(text):
        out += [p for p in _parts(t) if p != BREAK or (out and out[-1] != BREAK)]
    return out


class _Coded(dict):
    """Tokens as read to numbers: the hash of a word in the upper half, that of its stem in the lower; longer parts are written out."""

    def __missing__(self, token: str):
        if len(self) > 1_000_000:
            self.clear()
        codes = [linear.bucket(p, 1 << 31) << 32 | linear.bucket("~" + p[:5], 1 << 31) for p in _parts(token)]
        code = self[token] = codes[0] if len(codes) == 1 else tuple(codes)
        return code


_CODES = _Coded()
_BREAK = linear.bucket(BREAK, 1 << 31) << 32 | linear.bucket("~" + BREAK, 1 << 31)


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words of all texts laid end to end, and the number of words of each."""
    flat, sizes = [], []
    for t in texts:
        codes = [_CODES[w] for w in _raw(t)]
        if tuple in set(map(type, codes)):
            codes = [c for x in codes for c in (x if isinstance(x, tuple) else (x,))]
        flat += codes
        sizes.append(len(codes))
    codes, n = np.array(flat, np.int64), np.array(sizes, np.int64)
    if not len(codes):
        return codes, n
    of = np.repeat(np.arange(len(n)), n)
    again = (codes == _BREAK) & np.concatenate([[True], (codes[:-1] == _BREAK) | (of[1:] != of[:-1])])  # breaks at the beginning or after a break
    return codes[~again], np.bincount(of[~again], minlength=len(n))


def grams(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Buckets, one column per kind, of texts laid end to end: words, stems, bigrams, trigrams, skip-grams over one and two words and pairs of stems, by their last word."""
    at = np.arange(len(codes))
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes) == at  # of texts, and after breaks: no gram reaches over one
    starts[1:] |= codes[:-1] == _BREAK
    begin = np.maximum.accumulate(np.where(starts, at, 0))
    word, stem = (codes >> 32).astype(np.uint64), (codes & 0x7FFFFFFF).astype(np.uint64)

    def back(x: np.ndarray, k: int) -> np.ndarray:
        return np.where(at - k >= begin, x[np.maximum(at - k, 0)], np.uint64(0))

    a, b, c, d, s, r, q = word, back(word, 1), back(word, 2), back(word, 3), stem, back(stem, 1), back(stem, 2)
    k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
    with np.errstate(over="ignore"):
        kinds = [
            a * k[0], s * k[1] + k[3], a * k[0] ^ b * k[1], a * k[0] ^ b * k[1] ^ c * k[2], (a * k[0] ^ c * k[3]) + k[1], (a * k[0] ^ d * k[3]) + k[2],
            (s * k[0] ^ r * k[1]) + k[0], (s * k[0] ^ q * k[2]) + k[3],
        ]
        return np.stack([((x ^ (x >> np.uint64(29))) * k[1] >> np.uint64(44)).astype(np.int64) for x in kinds], 1)


def features(text: str) -> list[int]:
    return grams(*coded([text])).ravel().tolist()


def disguise(text: str, rnd: random.Random) -> str:
    """A training passage in one of the usual disguises."""
    kind, out = rnd.randrange(4), []
    for w in text.split(" "):
        if len(w) > 3 and w.isalpha() and rnd.random() < 0.45:
            if kind == 0:
                w = " ".join(w)
            elif kind == 1:
                i = rnd.randrange(len(w))
                w = w[:i] + w[i] * 3 + w[i + 1 :]
            elif kind == 2:
                w = w.translate(str.maketrans({"a": "4", "e": "3", "i": "1", "o": "0", "s": "$"}))
            else:
                w = w[0] + "*" * (len(w) - 2) + w[-1] if rnd.random() < 0.5 else w[0] + "*" * (len(w) - 1)
        out.append(w)
    return " ".join(out)


def train(reviewed: list[tuple[str, int]], background: list[str], seed: int = 5) -> np.ndarray:
    """Weights from labelled passages and from background sentences without labels.

    At first all of the background counts as harmless, as nearly all of it is, but for so little (UNSURE)
    that a harmful sentence in many copies does not outweigh what the labelled passages say of its words.
    Each half is scored by a model that has seen the other one only. What it takes for harmful all the
    same is learned as such in the next round, what it doubts goes on counting little.
    """
    rnd = random.Random(seed)
    rows = [*reviewed * 6, *passages.labelled()]
    rows += [(disguise(t, rnd), y) for t, y in rows if y and rnd.random() < 0.5]
    rows += [(disguise(t, rnd), y) for t, y in rows if not y and rnd.random() < 0.1]
    x, y = [features(t) for t, _ in rows], [float(v) for _, v in rows]
    background = background + [t for t, _ in personal_table.rows(3000, seed=2)]  # what such documents say otherwise, for a small corpus
    low, high, whole = UNSURE
    unsure = min(high, max(low, whole / len(background)))
    back = [features(t) for t in background]
    columns = len(features("a"))
    for f in list(back):  # parts of sentences too, as windows cut them
        n = len(f) // columns
        at = rnd.randrange(max(1, n - 3))
        back.append(f[at * columns : (at + rnd.randrange(2, WINDOW)) * columns])
    half = np.array([rnd.random() < 0.5 for _ in back], bool)
    labels, weights = np.zeros(len(back)), np.full(len(back), unsure)

    def fitted(of: np.ndarray, epochs: int) -> np.ndarray:
        at = np.flatnonzero(of).tolist()
        index, values = linear.ftrl(x + [back[i] for i in at], y + labels[at].tolist(), BUCKETS, epochs=epochs, offset=BIAS, weights=[1.0] * len(x) + weights[at].tolist())
        w = np.zeros(BUCKETS)
        w[index] = values
        return w

    for harmful, harmless in ROUNDS if back else ():
        p = np.zeros(len(back))
        for side in (half, ~half):
            at = np.flatnonzero(side)
            p[at] = linear.sigmoid(linear.margins(fitted(~side, 2), *linear.pack([back[i] for i in at])) + BIAS)
        whole = np.arange(len(back)) < len(background)
        labels = np.where((p >= harmful) & whole, 1.0, 0.0)
        weights = np.where(p < harmless, 1.0, np.where(p < harmful, unsure, np.where(whole, 1.0, 0.0)))
    w = fitted(weights > 0, 4)
    return w.astype(np.float32)


def worst(texts: list[str], w: np.ndarray) -> np.ndarray:
    """The score of the worst passage of each text: of its sentences and of the windows that begin at its words."""
    codes, sizes = coded(texts)
    out = np.zeros(len(texts))
    if not len(codes):
        return out
    per = w[grams(codes, sizes)].sum(1)
    total = np.concatenate([[0.0], np.cumsum(per, dtype=np.float64)])
    stop = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(codes))
    best = total[np.minimum(at + WINDOW, stop)] - total[at]
    ends = (codes == _BREAK) | (at + 1 == stop)  # sentences, whatever their length
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    best[first] = np.maximum(best[first], total[last + 1] - total[first])
    held = sizes > 0
    out[held] = linear.sigmoid(np.maximum.reduceat(best, (np.cumsum(sizes) - sizes)[held]) + BIAS)
    return out


def background(documents: DataFrame, most: int = BACKGROUND) -> list[str]:
    """Up to ``most`` sentences of the corpus in a seeded order: one document in a sample gives up to four, so no whole text reaches the driver."""
    docs = documents.select("doc_id", "text").where("text is not null").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(most // 4)
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+|\n+"), lambda s: F.length(s) > 1)
    mixed = F.transform(parts, lambda s: F.struct(F.xxhash64(s, F.col("doc_id")).alias("h"), s.alias("s")))
    picked = docs.select(F.explode(F.slice(F.array_sort(mixed), 1, 4)).alias("p")).select(F.substring("p.s", 1, 2000).alias("s"))
    return [r.s for r in picked.collect()]


def score(documents: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(doc_id, source, score, found) for every document.

    Null, empty and blank texts get score 0. A doc_id delivered repeatedly counts once. Unreviewed
    samples (null label) are left out; without any sample the labelled table alone trains the model.
    The model is fitted on at most REVIEWED samples and BACKGROUND sentences of the corpus; every
    whole text is scored.
    """
    samples = reviewed.where("label is not null and text is not null").select("text", "label").distinct().orderBy(F.xxhash64("text"), "label").limit(REVIEWED).collect()
    known = [(r.text, int(r.label != "none")) for r in samples]
    docs = documents.select("doc_id", "source", "text").dropDuplicates(["doc_id"])
    w = train(known, background(documents))
    index = np.flatnonzero(w)
    shipped = documents.sparkSession.sparkContext.broadcast((index.astype(np.int32), w[index]))  # at most BUCKETS weights

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = np.zeros(BUCKETS, np.float32)
        weights[shipped.value[0]] = shipped.value[1]
        for b in batches:
            for i in range(0, len(b), 500):
                part = b.iloc[i : i + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "score": worst([t or "" for t in part["text"]], weights)})

    key = documents.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(scored, f"doc_id {key}, source string, score double").withColumn("found", F.col("score") >= THRESHOLD)


def rates(scores: DataFrame) -> DataFrame:
    """(source, documents, found, share) per source; null is a source of its own."""
    return scores.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("found").cast("bigint")).alias("found"), F.round(F.avg(F.col("found").cast("double")), 6).alias("share"))
