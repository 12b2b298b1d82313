"""Problem 1: texts cut off by field limits.

Intact values are cut artificially to create positives, a hashed logistic regression is trained on
closing characters, punctuation and length-to-limit features, and every record is scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.llm import linear
from docsieve.session import cut, once, small

#: Code points of a text's end that features are taken from; of those kept of a training row, so that cuts fall within.
TAIL, KEPT = 160, 480
#: Bound of the labelled rows (intact texts) that the model is fitted on, and artificial cuts made of each.
SAMPLE, CUTS = 6000, 2
BUCKETS = 1 << 16
#: A closing phrase is usual if at least this share of all texts end with it, and it does not open other sentences more often.
USUAL = 0.0003
#: Sentence ends within a text's end, and what may trail behind it, for Java and Python alike.
SENTENCE = r"[.!?][\"')]*\s+|\n\s*\n"
TRAILING = "[\\s\u200d\ufe0f\u2600-\u27bf\U0001f000-\U0001faff]+$"
#: Simplifications of an end before phrases are compared, in this order: words broken over lines, symbols, numbers.
SIMPLER = (("[-\u00ac\u00ad\u2010] *\n\\s*", ""), (TRAILING, ""), ("[\u200d\ufe0f\u2600-\u27bf\U0001f000-\U0001faff]+", " "), ("[0-9]+", "#"))
#: Marks put behind artificial cuts.
MARKS = ("…", "...", " [...]", " (more", " (cont", " [truncated]", " >>", "-", " --", " [", " (continued")
_PAGE = re.compile(r"(?:\n[^\w\n]*(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d+)?[^\w\n]*)+$", re.I)
_ABBREVIATED = re.compile(r"(?:\b(?:mr|mrs|ms|dr|st|ave|rd|blvd|ln|ct|no|núm|sr|sra|mme|a|p|apt|approx|soc)|\b[a-z])\.$", re.I)
_ENDED = re.compile(r"[.!?。][\"'”’»)\]]*$|\)[.]?$|[\"”»]$")


def closing(text: str) -> str:
    """The last sentence after a caret if it has at most five words, else the last three words; in lower case with masked digits."""
    for pattern, by in SIMPLER:
        text = re.sub(pattern, by, text)
    words = re.split(SENTENCE, text.lower())[-1].split()
    return "^ " + " ".join(words) if len(words) <= 5 else " ".join(words[-3:])


def kinds(text: str) -> str:
    out = []
    for c in text:
        k = unicodedata.category(c)
        out.append("a" if k == "Ll" else "A" if k == "Lu" else "l" if k[0] == "L" else "9" if k[0] == "N" else "_" if c.isspace() else c if k[0] == "P" or c == "…" else k)
    return "".join(out)


def features(tail: str, usual: bool, spike: bool, lost: int, gap: int) -> list[int]:
    """Buckets of the features of a text's end; ``lost``: the end anchor was due (1) but not found (2); ``gap``: span minus text length, in classes."""
    tail = _PAGE.sub("", tail)[-TAIL:]
    end = re.sub(TRAILING, "", tail)
    words = re.sub(r"[0-9]", "#", end.lower()).split()
    last = words[-1] if words else ""
    shape = kinds(end[-6:])
    ended = bool(_ENDED.search(end)) and not _ABBREVIATED.search(end)
    core = re.sub(r"^\W+|\W+$", "", last)
    quotes = end.count('"') % 2
    sentence = re.split(r"[.!?][\"')]*\s", end)[-1]
    opened = sentence.count("(") > sentence.count(")")
    names = [
        "bias", f"ended={ended}", f"space={tail != tail.rstrip()}", f"c1={shape[-1:]}", f"c2={shape[-2:]}", f"c3={shape[-3:]}",
        f"w1={last}", f"x1={core}", f"w2={' '.join(words[-2:])}", f"x2={ended}{core}", f"suffix={last[-3:]}", f"quote={quotes}{ended}", f"open={opened}",
        f"abbreviated={bool(_ABBREVIATED.search(end))}", f"usual={usual}", f"usual={usual}{ended}", f"spike={spike}", f"spike={spike}{ended}{usual}",
        f"lost={lost}", f"gap={gap}", f"gap={gap}{ended}{usual}", f"long={min(len(sentence) // 12, 8)}",
    ]
    return [linear.bucket(n, BUCKETS) for n in names]


def gap_class(gap: float | None) -> int:
    return 0 if gap is None or np.isnan(gap) else 1 if gap <= 5 else 2 if gap <= 20 else 3


def _within(cut: str, rest: str) -> bool:
    """Whether a cut falls within a word or sentence, with something left behind it."""
    end = cut.rstrip()
    return bool(end) and not (_ENDED.search(end) and not _ABBREVIATED.search(end)) and bool(rest.strip(" \n.!?\"')"))


def training_rows(intact: pd.DataFrame, usual: set[str], seed: int = 11) -> tuple[list[list[int]], list[float]]:
    """Features and labels of intact texts and of artificial cuts of them, within a word or a sentence, some with a mark behind.

    ``intact`` has tail, n, spike, lost and gap of a text and, where its source has a field limit below
    n, at and limited: that limit and the end of the text cut there. All evidence is worked out from the
    cut text: its length is that of the limit only for a cut there, and a cut either lay before the
    anchors were looked for (then the end anchor is lost and the span fits) or after (then the anchor
    stays found and the span exceeds the text by what was cut off).
    """
    random = np.random.default_rng(seed)
    rows, labels = [], []

    def add(text: str, n: int, spike: bool, r) -> None:
        late = random.random() < 0.5
        gap = r.gap + (r.n - n) if late else r.gap
        rows.append(features(text, closing(text) in usual, spike, r.lost if late or r.lost == 0 else 2, gap_class(gap)))
        labels.append(1.0)

    for r in intact.itertuples(index=False):
        rows.append(features(r.tail, closing(r.tail) in usual, bool(r.spike), r.lost, gap_class(r.gap)))
        labels.append(0.0)
        if r.limited and _within(r.limited, "x"):
            add(r.limited, int(r.at), True, r)
        for _ in range(CUTS):
            for _ in range(8):
                at = int(random.integers(max(1, min(60, len(r.tail) // 3)), max(2, len(r.tail))))
                cut_, rest = r.tail[:at], r.tail[at:]
                if _within(cut_, rest):
                    break
            else:
                continue
            n = int(r.n) - len(rest)
            if random.random() < 0.2:
                mark = MARKS[int(random.integers(len(MARKS)))]
                n += len(cut_.rstrip()) + len(mark) - len(cut_)
                cut_ = cut_.rstrip() + mark
            add(cut_, n, False, r)
    return rows, labels


def prepare(narratives: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per narrative with a text that is not blank: tail, length, closing phrase and evidence of the anchors."""
    text = F.col("text")
    kept = narratives.select(
        "narrative_id", "source", F.length(text).cast("bigint").alias("n"), F.right(text, F.lit(KEPT)).alias("tail"),
        F.when(F.col("anchor_end").isNull(), 0).when(F.coalesce("anchor_end_found", F.lit(False)), 1).otherwise(2).alias("lost"),
    )
    kept = once(kept.where(r"tail rlike '\\S'"), "narrative_id")
    found = once(spans.select(F.col("narrative_id").alias("__id"), (F.col("end_offset") - F.coalesce("start_offset", F.lit(0))).alias("span"), F.col("start_offset").isNotNull().alias("known")), "__id")
    joined = kept.join(found, F.col("narrative_id").eqNullSafe(F.col("__id")), "left")
    gap = F.when(F.col("known"), F.col("span") - F.col("n"))
    masked = F.col("tail")
    for pattern, by in SIMPLER:
        masked = F.regexp_replace(masked, pattern, by)
    words = F.filter(F.split(F.element_at(F.split(F.lower(masked), SENTENCE), -1), r"\s+"), lambda w: w != "")
    phrase = F.when(F.size("w") <= 5, F.concat(F.lit("^ "), F.array_join("w", " "))).otherwise(F.array_join(F.slice("w", -3, 3), " "))
    ended = F.regexp_replace("tail", TRAILING, "").rlike("[.!?][\"')]*$")
    rows = joined.select("narrative_id", "source", "n", "tail", "lost", gap.cast("double").alias("gap"), words.alias("w"), ended.alias("ended"))
    return rows.withColumn("phrase", phrase).drop("w")


def usual_closings(rows: DataFrame) -> DataFrame:
    """(phrase, usual): closing phrases that USUAL of all texts share, three texts at least; short last sentences only if they open fewer of the sentences before.

    At most 1 / USUAL phrases can be, whatever the number of texts.
    """
    total = rows.count()
    often = cut(rows.groupBy("phrase").agg(F.count("*").alias("texts")).where(F.col("texts") >= max(3, USUAL * total)))  # at most 1 / USUAL rows
    masked = F.col("tail")
    for pattern, by in SIMPLER:
        masked = F.regexp_replace(masked, pattern, by)
    parts = rows.select(F.split(F.lower(masked), SENTENCE).alias("parts"))
    inner = parts.select(F.explode(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 2, F.lit(0)))).alias("s"))
    inner = inner.select(F.slice(F.filter(F.split("s", r"\s+"), lambda w: w != ""), 1, 5).alias("w")).where("size(w) > 0")
    starts = inner.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda k: F.concat(F.lit("^ "), F.array_join(F.slice("w", F.lit(1), k), " ")))).alias("phrase"))
    starts = starts.join(F.broadcast(often), "phrase").groupBy("phrase").agg(F.count("*").alias("openings"))
    return often.join(starts, "phrase", "left").where("coalesce(openings, 0) < texts").select("phrase", F.lit(True).alias("usual"))


def spikes(rows: DataFrame) -> DataFrame:
    """(source, n, texts): lengths at which the texts of a source pile up, as at a field limit: 10 times what the lengths around have on average, and 3 at least."""
    counts = rows.groupBy("source", "n").agg(F.count("*").alias("texts"))
    w = Window.partitionBy("source").orderBy("n").rangeBetween(-50, 50)
    around = (F.sum("texts").over(w) - F.col("texts")) / 100
    return counts.withColumn("around", around).where("texts >= 3 and texts > 10 * around").select("source", "n", "texts")


def score(narratives: DataFrame, spans: DataFrame) -> DataFrame:
    """(narrative_id, source, score, truncated) for every narrative.

    Null, empty and blank texts are never truncated and get score 0. Redelivered rows count once.
    Spans may be missing or have null offsets. The model is fitted on at most SAMPLE intact texts;
    every text is scored, and usual closings and field limits are counted over all texts.
    """
    rows = cut(prepare(narratives, spans))
    limits = cut(spikes(rows))
    at_limit = small(limits.select(F.col("source").alias("__source"), F.col("n").alias("__n"), F.lit(True).alias("spike")), "coalesce(octet_length(__source), 0) + 32")
    usual = cut(usual_closings(rows))  # at most 1 / USUAL rows
    rows = rows.join(at_limit, F.col("source").eqNullSafe(F.col("__source")) & (F.col("n") == F.col("__n")), "left").drop("__source", "__n")
    rows = rows.join(F.broadcast(usual), "phrase", "left").withColumn("usual", F.coalesce("usual", F.lit(False))).withColumn("spike", F.coalesce("spike", F.lit(False)))
    sample = rows.where("(ended or usual) and n >= 40").orderBy(F.xxhash64("narrative_id"), "narrative_id").limit(SAMPLE)
    main = limits.groupBy(F.col("source").alias("__source")).agg(F.max_by("n", F.struct("texts", "n")).alias("at"))  # the limit most texts are at
    sample = sample.join(small(main, "coalesce(octet_length(__source), 0) + 24"), F.col("source").eqNullSafe(F.col("__source")) & (F.col("n") > F.col("at")), "left").drop("__source")
    texts = narratives.select(F.col("narrative_id").alias("__id"), "text")
    limited = sample.where("at is not null").select("narrative_id", "at").join(texts, F.col("narrative_id") == F.col("__id")).select("narrative_id", F.expr(f"substring(text, greatest(1, at - {KEPT} + 1), least(at, {KEPT}))").alias("limited"))
    sample = sample.join(once(limited, "narrative_id"), "narrative_id", "left").select("narrative_id", "tail", "n", "spike", "lost", "gap", "at", "limited").orderBy("narrative_id").toPandas()
    known = {r.phrase for r in usual.select("phrase").collect()}
    weights = linear.fit(*training_rows(sample, known), BUCKETS, epochs=20) if len(sample) else None
    shipped = narratives.sparkSession.sparkContext.broadcast(weights)  # BUCKETS numbers

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shipped.value
        for b in batches:
            if w is None or not len(b):
                p = np.zeros(len(b))
            else:
                x = [features(t, bool(u), bool(s), int(lost), gap_class(g)) for t, u, s, lost, g in zip(b["tail"], b["usual"], b["spike"], b["lost"], b["gap"])]
                p = linear.sigmoid(linear.margins(w, *linear.pack(x)))
            yield pd.DataFrame({"narrative_id": b["narrative_id"], "source": b["source"], "score": p})

    key = narratives.schema["narrative_id"].dataType.simpleString()
    done = rows.select("narrative_id", "source", "tail", "usual", "spike", "lost", "gap").mapInPandas(scored, f"narrative_id {key}, source string, score double")
    blank = once(narratives.where(r"text is null or not text rlike '\\S'").select("narrative_id", "source", F.lit(0.0).alias("score")), "narrative_id")
    return done.unionByName(blank).withColumn("truncated", F.col("score") >= 0.5)


def rates(scores: DataFrame) -> DataFrame:
    """(source, narratives, truncated, share): how often each source truncates; null is a source of its own."""
    return scores.groupBy("source").agg(
        F.count("*").alias("narratives"), F.sum(F.col("truncated").cast("bigint")).alias("truncated"), F.round(F.avg(F.col("truncated").cast("double")), 6).alias("share")
    )
