"""Problem 4: cutting oversized items at natural boundaries, with overlap.

Items are handled as ranges of bounded length. Workers look for boundaries in a range and a halo
around it, prefix sums of the range lengths give absolute offsets, one pass over the boundaries of
an item in their order picks each cut from the whole reach of its piece, and pieces are emitted by
offset from the ranges they touch. No task ever holds a whole item, be it a column value or a file.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.session import cut, small

#: Code points of a range of a text, bytes of a range of a file, and code points of context on either side.
RANGE, FILE_RANGE, HALO = 1 << 16, 1 << 22, 64

#: Boundaries in falling order of preference: paragraph, sentence, line, clause, word. A cut falls at the match's end. No match is
#: longer than the halo, so a boundary is seen alike from every range: behind more white space than that, it counts as one of a word.
BOUNDARIES = (
    (5, re.compile(r"\n[^\S\n]{0,16}\n\s{0,40}(?!\s)")),
    (4, re.compile(r"[.!?…。！？][\"'”’»)\]]{0,4}\s{1,44}(?!\s)(?=[^a-z])")),
    (3, re.compile(r"\n(?!\s)")),
    (2, re.compile(r"[,;:—–][\"'”’»)\]]{0,4}\s{1,44}(?!\s)")),
    (1, re.compile(r"\s(?!\s)")),
)
_ABBREVIATION = re.compile(r"(?:\b(?:Mr|Ms|Mrs|Dr|St|Ave|Rd|Blvd|Ln|Ct|No|Sr|Sra|Mme|approx|vs)|\b[A-Z])\.\s+$")


def _with_plan(items: DataFrame) -> DataFrame:
    """Adds overlap and usable: a cut lies in (before, before + usable], the first one in (overlap, overlap + usable].

    Neighbouring cuts are thus usable = max_chars - overlap apart at most. A negative overlap counts
    as 0. An overlap that is not smaller than max_chars cannot be kept, as pieces would not advance: it raises.
    """
    overlap = F.greatest(F.lit(0), F.col("overlap_chars"))
    checked = F.when(overlap < F.col("max_chars"), overlap).otherwise(F.raise_error(F.lit("overlap_chars must be smaller than max_chars")).cast("int"))
    return items.withColumn("overlap", checked.cast("int")).withColumn("usable", (F.col("max_chars") - F.col("overlap")).cast("int"))


def boundaries(left: str, body: str, right: str, offset: int) -> tuple[list[int], list[int]]:
    """Offsets of the boundaries after a code point of the range [offset, offset + len(body)), in order, and their ranks; -1 where no cut may fall, as a mark joins."""
    text, base = left + body + right, offset - len(left)
    low, high = offset, offset + len(body)  # a boundary at offset b belongs to the range that holds the code point before it
    found: dict[int, int] = {}
    for m in _WIDE.finditer(text):
        i = m.start()
        for at in (i, i + 1):
            if 0 < at < len(text) and low < base + at <= high and _joins(text[at], text[at - 1]):
                found[base + at] = -1
    for rank, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            at = base + m.end()
            if low < at <= high and not (rank == 4 and _ABBREVIATION.search(text, max(0, m.start() - 8), m.end())):
                found[at] = max(rank, found.get(at, -1))
    ats = sorted(found)
    return ats, [found[at] for at in ats]


class Cuts:
    """The cuts of one item, from its boundaries in their order.

    A cut falls at the best boundary of the last fifth of its reach, or of the nearest fifth before
    that has one; only if the whole reach has none, at its end, not before a mark that joins.
    """

    def __init__(self, n: int, overlap: int, usable: int):
        self.n, self.usable, self.width = n, usable, max(1, usable // 5)
        self.before, self.k, self.ats, self.ranks = overlap, 0, [], []

    def add(self, ats: list[int], ranks: list[int], known: int) -> Iterator[tuple[int, int]]:
        """(k, at) of the cuts that are certain with further boundaries, all those up to ``known``."""
        self.ats += ats
        self.ranks += ranks
        i = 0
        while self.n - self.before > self.usable and self.before + self.usable <= known:
            end = self.before + self.usable
            i = bisect_right(self.ats, self.before, i)
            j = bisect_right(self.ats, end, i)
            natural = [(-((end - at) // self.width), rank, at) for at, rank in zip(self.ats[i:j], self.ranks[i:j]) if rank > 0]
            self.before = max(natural)[2] if natural else self._hard(end, set(self.ats[i:j]))
            self.k += 1
            yield self.k, self.before
        del self.ats[:i], self.ranks[:i]

    def _hard(self, end: int, joined: set[int]) -> int:
        return next((at for at in range(end, self.before, -1) if at not in joined), end)


_WIDE = re.compile(r"[^\x00-\x7f]")


def _joins(after: str, before: str) -> bool:
    import unicodedata

    return bool(after) and (unicodedata.combining(after) > 0 or after in "‍️‌" or before == "‍")


def cut_table(ranges: DataFrame) -> DataFrame:
    """(item, k, at, n, overlap, usable): the chosen cuts of each item.

    ``ranges`` has item, offset, n (length of the item), head, body, tail (text and context of a range),
    overlap and usable. An item's boundaries, without its text, pass through one task, range by range.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.item, r.offset, r.offset + len(r.body), r.n, r.overlap, r.usable, *boundaries(r.head, r.body, r.tail, r.offset)) for r in b.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["item", "offset", "known", "n", "overlap", "usable", "ats", "ranks"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, cuts = None, None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if cuts is None or r.item != item:
                    item, cuts = r.item, Cuts(r.n, r.overlap, r.usable)
                rows += [(r.item, k, at, r.n, r.overlap, r.usable) for k, at in cuts.add(list(map(int, r.ats)), list(map(int, r.ranks)), r.known)]
            yield pd.DataFrame(rows, columns=["item", "k", "at", "n", "overlap", "usable"])

    item_type = ranges.schema["item"].dataType.simpleString()
    found = ranges.select("item", "offset", "n", "head", "body", "tail", "overlap", "usable")
    found = found.mapInPandas(look, f"item {item_type}, offset bigint, known bigint, n bigint, overlap int, usable int, ats array<bigint>, ranks array<int>")
    ordered = found.repartition("item").sortWithinPartitions("item", "offset")
    return ordered.mapInPandas(choose, f"item {item_type}, k bigint, at bigint, n bigint, overlap int, usable int")


def piece_table(cuts: DataFrame) -> DataFrame:
    """(item, piece, start_offset, end_offset): pieces of each item from its cuts, each sharing ``overlap`` code points with the one before."""
    w = Window.partitionBy("item").orderBy("k")
    one = cuts.withColumn("before", F.lag("at", 1, 0).over(w)).withColumn("piece", F.row_number().over(w) - 1)
    one = one.withColumn("final", F.lead("at").over(w).isNull())
    start = F.greatest(F.lit(0), F.col("before") - F.col("overlap"))
    pieces = F.array(F.struct(F.col("piece"), F.when(F.col("piece") == 0, F.lit(0)).otherwise(start).alias("start_offset"), F.col("at").alias("end_offset")))
    rest = F.array(F.struct((F.col("piece") + 1).alias("piece"), F.greatest(F.lit(0), F.col("at") - F.col("overlap")).alias("start_offset"), F.col("n").alias("end_offset")))
    return one.select("item", F.explode(F.when(F.col("final"), F.concat(pieces, rest)).otherwise(pieces)).alias("p")).select("item", "p.*")


def piece_texts(pieces: DataFrame, ranges: DataFrame) -> DataFrame:
    """``pieces`` with text, put together from the ranges each piece touches."""
    spans = ranges.select(F.col("item").alias("item"), "offset", (F.col("offset") + F.length("body")).alias("stop"), "body", "grid")
    cells = F.sequence(F.floor(F.col("start_offset") / F.col("cell")), F.floor((F.col("end_offset") - 1) / F.col("cell")))
    touched = pieces.withColumn("grid", F.explode(cells))
    joined = touched.join(spans, ["item", "grid"]).where("offset < end_offset and stop > start_offset")
    low, high = F.greatest("start_offset", "offset"), F.least("end_offset", "stop")
    part = F.substring("body", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    texts = joined.groupBy("item", "piece", "start_offset", "end_offset").agg(F.sort_array(F.collect_list(F.struct("offset", part.alias("part")))).alias("parts"))
    return texts.select("item", "piece", "start_offset", "end_offset", F.array_join("parts.part", "").alias("text"))


def text_ranges(items: DataFrame, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """Ranges of the texts of ``items`` (item, text, n and a plan): substrings are taken before rows are multiplied."""
    i = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))

    def piece(k):
        at = k * size
        return F.struct(
            at.cast("bigint").alias("offset"), k.cast("bigint").alias("grid"), F.lit(size).alias("cell"),
            F.substring("text", F.greatest(at - halo, F.lit(0)) + 1, at - F.greatest(at - halo, F.lit(0))).alias("head"),
            F.substring("text", at + 1, F.lit(size)).alias("body"),
            F.substring("text", at + size + 1, F.lit(halo)).alias("tail"),
        )

    keep = [c for c in items.columns if c != "text"]
    return items.select(*keep, F.explode(F.transform(i, piece)).alias("r")).select(*keep, "r.*")


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items (item, source, text) longer than the limit of their source, with it.

    The limit ``*`` holds for sources not listed and for a null source; without it such items have no
    limit. A null or non-positive max_chars is no limit. Null and empty texts are never oversized.
    """
    limits = limits.select("source", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars")).where("max_chars > 0").dropDuplicates(["source"])
    other = limits.where("source = '*'").select(F.col("max_chars").alias("any_max"), F.col("overlap_chars").alias("any_overlap"))
    listed = small(limits.where("source <> '*'").withColumnRenamed("source", "__source"))
    joined = items.join(listed, F.col("source") == F.col("__source"), "left").drop("__source").join(F.broadcast(other), F.lit(True), "left")
    joined = joined.withColumn("overlap_chars", F.coalesce(F.when(F.col("max_chars").isNotNull(), F.col("overlap_chars")), "any_overlap"))
    joined = joined.withColumn("max_chars", F.coalesce("max_chars", "any_max")).drop("any_max", "any_overlap")
    return _with_plan(joined.withColumn("n", F.length("text").cast("bigint")).where("n > max_chars"))


def split_items(items: DataFrame, limits: DataFrame, key: str, text: str = "text", source: str = "source", size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(cuts, pieces) of the oversized items; pieces has item, piece (from 0), start_offset, end_offset and text.

    Repeated rows of a key come out once. Every piece has at most max_chars code points, begins
    overlap_chars before the end of the one before it, and together they hold the whole text.
    """
    items = items.select(F.col(key).alias("item"), F.col(source).alias("source"), F.col(text).alias("text"))
    ranges = text_ranges(oversized(items, limits).dropDuplicates(["item"]), size)
    cuts = cut_table(ranges)
    pieces = piece_table(cuts).withColumn("cell", F.lit(size))
    return cuts, piece_texts(pieces, ranges)


def file_ranges(spark: SparkSession, paths: list[str], size: int = FILE_RANGE, halo: int = HALO) -> DataFrame:
    """Ranges (item, grid, head, body, tail) of UTF-8 files on any file system that the cluster's Hadoop client knows, read by byte offset.

    A range begins at the first code point that starts in it and takes in the rest of its last one. Files
    are split by the byte: a record of a source of fixed width is a range, its neighbours give the halo.
    """
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm
    rows = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        n = path.getFileSystem(hadoop).getFileStatus(path).getLen()
        rows += [(p, k, n) for k in range(-(-n // size))]
    asked = spark.createDataFrame(rows, "item string, grid bigint, size bigint").repartition(max(1, min(len(rows), 4096)), "item", "grid")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for item, k, n in b.itertuples(index=False):
                at, margin = k * size, 4 * halo + 4
                system, path = fs.FileSystem.from_uri(item if "://" in item or item.startswith("file:") else f"file://{item}")
                with system.open_input_file(path) as f:
                    first = max(0, at - margin)
                    data = f.read_at(min(n, at + size + margin) - first, first)
                lo, hi = _start(data, at - first), _start(data, at - first + size)
                head = data[_start(data, 0) : lo].decode()[-halo:]
                tail = data[hi : _start(data, max(hi, len(data) - 3), back=True)].decode(errors="ignore")[:halo]
                yield pd.DataFrame([(item, k, head, data[lo:hi].decode(), tail)], columns=["item", "grid", "head", "body", "tail"])

    return asked.mapInPandas(read, "item string, grid bigint, head string, body string, tail string")


def placed(ranges: DataFrame) -> DataFrame:
    """``ranges`` with offset and n, in code points: prefix sums of a table of lengths alone, joined back by item and place."""
    lengths = ranges.select("item", "grid", F.length("body").cast("bigint").alias("_len"))
    w = Window.partitionBy("item").orderBy("grid")
    sums = lengths.withColumn("offset", F.coalesce(F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = lengths.groupBy("item").agg(F.sum("_len").alias("n"))
    return ranges.join(sums.select("item", "grid", "offset").join(total, "item"), ["item", "grid"])


def _start(data: bytes, at: int, back: bool = False) -> int:
    """The next (or, looking back, the same) position in ``data`` at which a code point starts."""
    at = min(at, len(data))
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += -1 if back else 1
    if at == 0:
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
    return at


def split_files(spark: SparkSession, paths: list[str], max_chars: int, overlap_chars: int, size: int = FILE_RANGE) -> DataFrame:
    """Pieces (item, piece, start_offset, end_offset, text) of giant text files; a file within the limit is one piece, an empty one none."""
    ranges = cut(placed(cut(file_ranges(spark, paths, size))))
    planned = _with_plan(ranges.withColumn("max_chars", F.lit(max_chars)).withColumn("overlap_chars", F.lit(overlap_chars)))
    long = planned.where("n > max_chars")
    pieces = piece_table(cut_table(long))
    # a byte range holds between size / 4 and size code points, so a piece is matched to ranges by offset within its item's ranges
    bounds = ranges.select(F.col("item"), "grid", F.col("offset").alias("lo"), (F.col("offset") + F.length("body")).alias("hi"))
    cells = pieces.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_offset") / size), F.floor((F.col("end_offset") - 1) / size))))
    spans = bounds.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    near = cells.join(spans, ["item", "cell"]).where("lo < end_offset and hi > start_offset").drop("cell", "lo", "hi").dropDuplicates(["item", "piece", "grid"])
    joined = near.join(ranges.select("item", "grid", "offset", "body"), ["item", "grid"])
    stop = F.col("offset") + F.length("body")
    low, high = F.greatest("start_offset", "offset"), F.least(F.col("end_offset"), stop)
    part = F.substring("body", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int"))
    texts = joined.groupBy("item", "piece", "start_offset", "end_offset").agg(F.sort_array(F.collect_list(F.struct("offset", part.alias("part")))).alias("parts"))
    out = texts.select("item", "piece", "start_offset", "end_offset", F.array_join("parts.part", "").alias("text"))
    whole = planned.where("n <= max_chars and n > 0").groupBy("item").agg(F.max("n").alias("end_offset"), F.sort_array(F.collect_list(F.struct("offset", F.col("body").alias("part")))).alias("parts"))
    return out.unionByName(whole.select("item", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_offset"), "end_offset", F.array_join("parts.part", "").alias("text")))
