"""Problem 3: noise in text from scanned pages.

Words are grouped by a confusable-glyph skeleton and rare forms are traced to frequent, contextually
supported ones of their group; digit-masked lines that recur at page edges or nowhere in running
text are headers; broken words are rejoined by what the corpus writes; SQL windows over the lines
reflow what remains into paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docsieve.llm.lookalike import _plain
from docsieve.session import cut, once, small

# Misreadings of recognisers: what is read, and what stood there (fixed values).
MISREAD = {
    "c": ("e",), "f": ("t",), "1": ("i", "l"), "|": ("l", "i"), "!": ("i", "l"), "0": ("o",), "@": ("a",), "5": ("s",), "$": ("s",), "9": ("g",), "8": ("b",), "6": ("b", "g"), "b": ("h",), "{": ("f",), "v": ("y",),
    "u": ("o",), "d": ("cl",), "n": ("ri",), "ii": ("n", "u"), "cl": ("d",), "rn": ("m",), "vv": ("w",), "\\/": ("v",), "li": ("h",), "m": ("rn",), "l": ("i",), "e": ("c",), "h": ("b",),
}
#: Letters read for digits.
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "G": "6", "g": "9", "q": "9", "!": "1", "D": "0", "Q": "0", "A": "4", "b": "6"}
#: A form explains another if it occurs SUPPORT times at least and RARE times as often. A form of letters alone may be a word of its own:
#: it takes WORD times, or else neighbours beside which the other form is CLEAR times as frequent.
RARE, WORD, SUPPORT, CLEAR = 8, 60, 3, 4
#: A shape of numbers explains another if it occurs RATIO times as often, and RATIO times SUPPORT times at least.
RATIO = 20
#: Code points up to which a line is compared by its skeleton; longer ones by their letters with digits masked.
WIDTH = 200
MARK = r"[-¬\x{AD}\x{2010}\x{2011}=~]"
PAGE = r"(?:(?:p\s?a\s?g\s?e|p[ag]g?\.?|seite|página|pág\.?)\s*)?\d{1,4}(?:\s*(?:of|/|de|von|sur)\s*\d{1,4})?"
_EDGE = r"""^[("'\[“«¿¡<]+|[)"'\]”».,;:?>]+$|(?<=[\p{L}\p{N}])[!]+$"""


def token(word: Column) -> Column:
    """A word without the punctuation around it."""
    return F.regexp_replace(word, _EDGE, "")


def mask(word: Column) -> Column:
    """Digits as 9, capitals as A, other letters as a."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Lu}", "A"), r"\p{Ll}", "a"), r"\d", "9")


def skeleton(form: Column) -> Column:
    """Glyphs as strokes, so that all usual misreadings of a word (in lower case) have one skeleton."""
    s = F.translate(form, "0159@|!{$86", "olsgallfsbg")
    s = F.replace(s, F.lit("\\/"), F.lit("v"))
    for a, b in (("i", "l"), ("m", "rn"), ("w", "vv"), ("d", "cl"), ("n", "ll"), ("u", "ll"), ("h", "b")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(F.replace(s, F.lit("ll"), F.lit("l")), "ctvyg", "efyyg")


def second_skeleton(form: Column) -> Column:
    """A skeleton for the rarer confusions of ri with n and of o with u."""
    return F.concat(F.lit("2"), F.translate(F.replace(F.replace(form, F.lit("ri"), F.lit("n")), F.lit("cl"), F.lit("d")), "u0", "oo"))


@lru_cache(maxsize=200_000)
def explains(read: str, stood: str) -> bool:
    """Whether ``stood`` can have been misread as ``read``: only substitutions of MISREAD, one at least and one in three letters at most."""
    if read == stood:
        return False
    best = {(0, 0): 0}
    limit = max(1, len(stood) // 3)
    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        n = best[i, j]
        if i == len(read) and j == len(stood):
            return True
        steps = []
        if i < len(read) and j < len(stood) and read[i] == stood[j]:
            steps.append((i + 1, j + 1, n))
        if n < limit:
            for width in (1, 2):
                for to in MISREAD.get(read[i : i + width], ()) if i + width <= len(read) else ():
                    if stood.startswith(to, j):
                        steps.append((i + width, j + len(to), n + 1))
        for a, b, m in steps:
            if best.get((a, b), 99) > m:
                best[a, b] = m
                stack.append((a, b))
    return False


def lines_of(narratives: DataFrame, ocr_lines: DataFrame) -> DataFrame:
    """(unit, id, grp, sub, pos, line, scanned): the lines of narratives and of scanned pages, in a consistent form.

    grp and sub name the text or page that a line belongs to, pos its place there. Null texts have no lines.
    """
    stories = once(narratives.select("narrative_id", "text", "text_source"), "narrative_id").where("text is not null")
    stories = stories.select(F.col("narrative_id").cast("bigint").alias("id"), F.col("narrative_id").cast("string").alias("grp"), (F.col("text_source") == "ocr").alias("scanned"), F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    stories = stories.select(F.lit("narrative").alias("unit"), "id", "grp", F.lit(0).alias("sub"), "pos", "raw", F.coalesce("scanned", F.lit(False)).alias("scanned"))
    pages = once(ocr_lines.select("line_id", "document_id", "page_index", "line_index", "text"), "line_id").where("text is not null")
    pages = pages.select(F.lit("line").alias("unit"), F.col("line_id").cast("bigint").alias("id"), F.col("document_id").alias("grp"), F.col("page_index").alias("sub"), F.col("line_index").alias("pos"), F.col("text").alias("raw"), F.lit(True).alias("scanned"))
    rows = stories.unionByName(pages)
    odd = F.col("raw").rlike(r"[^\x{00}-\x{7E}]")
    line = F.pandas_udf(_plain, "string")("raw")
    clean = rows.where(~odd).withColumn("line", F.col("raw")).unionByName(rows.where(odd).withColumn("line", line))
    return clean.withColumn("line", F.trim(F.regexp_replace("line", "[ \t]+", " "))).drop("raw")


def header_key(line: Column) -> Column:
    """The skeleton of a line with digits masked and without a page number at its end."""
    head = F.regexp_replace(F.lower(line), rf"(?<=\w.{{0,2}}[\s\[(–—-]{{1,4}}){PAGE}\W*$", "")
    head = F.regexp_replace(head, r"(?<![a-z])[\doslb|!]*\d[\doslb|!]*(?![a-z])", "#")
    return skeleton(F.regexp_replace(head, r"[^\p{L}\p{N}#@|!{$]+", ""))


def numbered(line: Column) -> Column:
    """Whether a line is nothing but a page number."""
    return F.lower(line).rlike(rf"^[^\w\n]*{PAGE}[^\w\n.,;:]*$") | F.lower(line).rlike(r"^[^\w\n]*(?:p\s?a\s?g\s?e|pg\.)\s*[\dolis|!b]{1,3}(?:\s*(?:of|/)\s*[\dolis|!b]{1,3})?[^\w\n.,;:]*$")


def furniture(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """``lines`` with furniture: whether a line is a running header or footer or a page number.

    Page numbers stand alone on a line, on a scanned page on its first or last. Headers are lines whose
    masked skeleton recurs (three texts or pages at least), on a scanned page at its edges, and that
    are not part of running text elsewhere: few of the places where their rarest pair of words occurs
    lie outside such lines, nor mostly the last line of a narrative. Names of sections (the template anchors) are no headers.
    """
    w = Window.partitionBy("unit", "grp", "sub")
    full = F.length("line") > 0
    rows = lines.withColumn("first", F.min(F.when(full, F.col("pos"))).over(w)).withColumn("final", F.max(F.when(full, F.col("pos"))).over(w))
    rows = rows.withColumn("edge", (F.col("unit") == "narrative") | (F.col("pos") == F.col("first")) | (F.col("pos") == F.col("final")))
    rows = rows.withColumn("closing", F.col("pos") == F.col("final"))
    rows = rows.withColumn("continued", F.coalesce(F.lag("line").over(w.orderBy("pos")).rlike(rf"\p{{L}}{MARK}+$"), F.lit(False)))
    rows = cut(rows.withColumn("key", F.when(F.length("line") <= WIDTH, header_key(F.col("line"))).otherwise(F.sha2(F.regexp_replace(F.lower("line"), r"\d+", "#"), 256))).drop("first", "final"))
    shaped = F.col("key").isNotNull() & F.col("line").rlike(r"^[^a-z]*\p{Lu}|^\p{Ll}+\s\p{Lu}|^\p{P}") & ~F.col("line").rlike(rf"[.;:,!?]$|\p{{L}}{MARK}+$") & (F.length("key") >= 8)
    closing = (F.col("unit") == "narrative") & F.col("closing")
    place = rows.where(shaped).groupBy("key", "unit", "grp", "sub").agg(F.count("*").alias("n"), F.sum(F.col("edge").cast("int")).alias("edges"), F.sum(closing.cast("int")).alias("closings"))
    stories = F.when(F.col("unit") == "narrative", F.col("n")).otherwise(0)
    held = place.groupBy("key").agg(F.sum("n").alias("n"), F.sum("edges").alias("edges"), F.sum("closings").alias("closings"), F.sum(stories).alias("stories"), F.count("*").alias("places"))
    known = anchors.select(F.explode("anchors").alias("a")).select(skeleton(F.regexp_replace(F.lower("a"), r"[^\p{L}\p{N}#]+", "")).alias("key"), F.lit(True).alias("section")).distinct()
    likely = held.where("places >= 3 and edges >= 0.8 * n and closings * 2 <= stories").join(F.broadcast(known), "key", "left").where("section is null").select("key", "n")
    likely = small(cut(likely), "octet_length(key) + 24")
    words = F.regexp_replace(F.regexp_replace(F.lower("line"), r"\d+", "#"), r"[^\p{L}#]+", " ")
    pairs = F.regexp_extract_all(words, F.lit(r"(?<![\p{L}#])(?=([\p{L}#]+ [\p{L}#]+))"), F.lit(1))  # linear: no array is searched by position
    spoken = rows.select("key", F.array_distinct(pairs).alias("pairs"))
    held_pairs = cut(spoken.join(likely, "key").select("key", "n", F.explode("pairs").alias("pair")).groupBy("key", "n", "pair").agg(F.count("*").alias("k")).where("k * 2 >= n"))
    asked = small(held_pairs.select("pair").distinct(), "octet_length(pair) + 16")
    total = spoken.select(F.explode("pairs").alias("pair")).join(asked, "pair").groupBy("pair").agg(F.count("*").alias("all"))
    within = held_pairs.groupBy("pair").agg(F.sum("k").alias("held")).join(total, "pair").select("pair", (F.col("held") / F.col("all")).alias("own"))
    rarest = held_pairs.join(within, "pair").groupBy("key").agg(F.max("own").alias("own"))
    headers = rarest.where("own >= 0.5").select("key", F.lit(True).alias("header"))
    rows = rows.join(small(cut(headers), "64"), "key", "left")
    number = numbered(F.col("line")) & F.col("edge")
    return rows.withColumn("furniture", (shaped & F.coalesce("header", F.lit(False)) & F.col("edge")) | number).drop("key", "header", "edge", "closing")


def recurring(narratives: DataFrame, ocr_lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """(narrative_id, recurring): the numbers of the lines of a narrative that are furniture, if it has any."""
    marked = furniture(lines_of(narratives, ocr_lines), anchors).where("furniture and unit = 'narrative'")
    return marked.groupBy(F.col("id").cast(narratives.schema["narrative_id"].dataType).alias("narrative_id")).agg(F.collect_list(F.col("pos").cast("int")).alias("recurring"))


def last_word() -> Column:
    """The last word of a line, taken at its last space, so that lines of any length can be looked at."""
    return F.substring_index("line", " ", -1)


def unbroken() -> Column:
    """A line without the part of a word broken at its end and the rest of one at its start."""
    rest = F.substring("line", F.lit(1), F.length("line") - F.length(last_word()))
    line = F.when(last_word().rlike(rf"\p{{L}}{MARK}+$"), rest).otherwise(F.col("line"))
    return F.when(F.col("continued"), F.regexp_replace(line, r"^\S+\s*", "")).otherwise(line)


def neighbours(rows: DataFrame, words: str) -> DataFrame:
    """One row per word of an array: its place (i), itself (w), its form (t, and in lower case f) and the forms of the words before and after it (p, n).

    The three arrays are shifted and zipped, so that the work is linear in the length of a line.
    """
    keep = [c for c in rows.columns if c != words]
    ts = rows.select(*keep, words, F.transform(words, token).alias("_t")).where(F.size(words) > 0)
    none = F.array(F.lit(None).cast("string"))
    fs = ts.withColumn("_p", F.concat(none, F.slice("_t", F.lit(1), F.size("_t") - 1))).withColumn("_n", F.concat(F.slice("_t", F.lit(2), F.size("_t")), none))
    zipped = fs.select(*keep, F.posexplode(F.arrays_zip(F.col(words).alias("w"), F.col("_t").alias("t"), F.col("_p").alias("p"), F.col("_n").alias("n"))).alias("i", "x"))
    return zipped.select(*keep, "i", F.col("x.w").alias("w"), F.col("x.t").alias("t"), F.lower("x.t").alias("f"), F.lower("x.p").alias("p"), F.lower("x.n").alias("n"))


def vocabulary(lines: DataFrame, native: DataFrame | None = None) -> DataFrame:
    """(t, n): how often each word occurs in all lines and in the words of native pages; words broken at a line's end are left out."""
    words = lines.select(F.explode(F.split(unbroken(), r"\s+")).alias("w"))
    if native is not None:
        words = words.unionByName(native.select(F.col("text").alias("w")))
    return words.groupBy("w").agg(F.count("*").alias("n")).select(token(F.col("w")).alias("t"), "n").where("t <> ''").groupBy("t").agg(F.sum("n").alias("n"))


def candidates(counts: DataFrame) -> DataFrame:
    """(form, stood, n, m, sure): the frequent forms of a form's skeleton group that it can be a misreading of.

    n and m tell how often the two occur. Forms of one letter carry no evidence and are left as they are.
    """
    alike = F.col("form").rlike(r"\p{L}") & (F.length("form") >= 2) & ~F.col("form").rlike(r"\w@\w|^@\w+_|[=;]|\d{3}")
    odd = ~F.col("form").rlike(r"^[\p{L}'’.-]+$")
    forms = cut(counts.where(alike).select("form", "n", odd.alias("odd"), F.explode(F.array(skeleton(F.col("form")), second_skeleton(F.col("form")))).alias("group")))
    plain = forms.where(~F.col("odd") & (F.col("n") >= SUPPORT)).select("group", F.col("form").alias("stood"), F.col("n").alias("m"))
    asked = forms.join(plain, "group").where((F.col("form") != F.col("stood")) & (F.col("m") >= F.col("n") * F.when(F.col("odd"), 1).otherwise(RARE)))
    asked = asked.select("form", "stood", "n", "m", "odd").distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[explains(f, c) for f, c in zip(b["form"], b["stood"])]]

    pairs = asked.mapInPandas(check, asked.schema)
    sure = F.when(F.col("odd"), F.col("m") >= RARE * F.col("n")).otherwise(F.col("m") >= WORD * F.col("n"))
    return pairs.select("form", "stood", "n", "m", "odd", sure.alias("sure"))


def in_context(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(f, p, n, stood): for each form that is doubtful or has several candidates, beside each pair of neighbours, the form that stood there.

    A candidate's support is how often it occurs in the corpus beside the same neighbours. The best
    supported one is taken, the more frequent among equals, if it is sure by itself or CLEAR times as well supported as the form
    read.
    """
    w = Window.partitionBy("form")
    several = pairs.withColumn("k", F.count("*").over(w)).where("k > 1 or not sure").drop("k")
    several = small(cut(several.select(F.col("form").alias("f"), "stood", "m", "sure")), "octet_length(f) + octet_length(stood) + 32")
    words = lines.select(F.filter(F.split(unbroken(), r"\s+"), lambda x: x != "").alias("ws"))
    at = neighbours(words, "ws").select("f", "p", "n")
    places = at.join(several.select("f").distinct(), "f", "left_semi").distinct()
    places = cut(places.join(several, "f"))

    def both(word: str) -> Column:
        return F.array(F.xxhash64(F.lit("a"), "p", word), F.xxhash64(F.lit("a"), word, "n"))

    asked = small(cut(places.select(F.explode(F.concat(both("f"), both("stood"))).alias("h")).distinct()), "16")
    seen = at.where("n is not null").select(F.xxhash64(F.lit("a"), "f", "n").alias("h")).join(asked, "h").groupBy("h").agg(F.count("*").alias("c"))
    seen = small(cut(seen), "24")
    known = places.select("f", "p", "n", "stood", "m", "sure", F.explode(F.array(*(F.struct(F.xxhash64(F.lit("a"), *pair).alias("h"), F.lit(own).alias("own"), F.col(side).isNotNull().alias("has")) for pair, own, side in ((("p", "f"), True, "p"), (("f", "n"), True, "n"), (("p", "stood"), False, "p"), (("stood", "n"), False, "n"))))).alias("e"))
    known = known.select("f", "p", "n", "stood", "m", "sure", "e.*").where("has").join(seen, "h", "left")
    scored = known.groupBy("f", "p", "n", "stood", "m", "sure").agg(F.sum(F.when(F.col("own"), F.coalesce("c", F.lit(0))).otherwise(0)).alias("mine"), F.sum(F.when(~F.col("own"), F.coalesce("c", F.lit(0))).otherwise(0)).alias("support"))
    held = scored.where((F.col("sure")) | ((F.col("support") >= SUPPORT) & (F.col("support") >= CLEAR * F.greatest("mine", F.lit(1)))))
    return held.groupBy("f", "p", "n").agg(F.max(F.struct("support", "m", "stood"))["stood"].alias("stood"))


def misshapen(word: Column) -> Column:
    """Whether a word has glyphs among its letters that no spelling has: bars, braces, signs or digits within a lower-case word."""
    plain = ~word.rlike(r"\w@\w|^@|[=;_/]|^\w{17,}$|https?:|\d.*\d.*\d") & (F.length(F.regexp_replace(word, r"[^\p{L}]", "")) >= 3)
    return plain & (word.rlike(r"\p{L}[|{]|[|{]\p{L}|\p{L}[!@$]\p{L}|\\/|\p{Ll}[01598]\p{Ll}|\p{Ll}{2}[0159]$|^[0159]\p{Ll}{3}|\p{Lu}[05]\p{Lu}{2}") & ~word.rlike(r"^\d+(?:st|nd|rd|th|er|e|o|a)$|\d{3}"))


#: Glyphs within words that no spelling has, and the letters that they most often stand for (fixed values).
GLYPHS = {"0": "o", "1": "l", "5": "s", "8": "b", "9": "g", "|": "l", "{": "f", "!": "i", "@": "a", "$": "s"}


def find(narratives: DataFrame, ocr_lines: DataFrame, anchors: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(unit, unit_id, kind): furniture, hyphen and misread cases of scanned narratives and of lines, each once.

    Null and empty texts are no cases. Lines of furniture have no other kind. Redelivered rows count once.
    Statistics cover the lines of all texts and, if given, the ``words`` of native pages; only scanned texts are searched.
    """
    marked, broken, read = _read(narratives, ocr_lines, anchors, words)
    kinds = [
        marked.where("furniture and scanned").select("unit", F.col("id").alias("unit_id"), F.lit("furniture").alias("kind")),
        broken.where("hyphen").select("unit", F.col("id").alias("unit_id"), F.lit("hyphen").alias("kind")),
        read.where("stood is not null and (unit = 'narrative' or not furniture)").select("unit", F.col("id").alias("unit_id"), F.lit("misread").alias("kind")),
    ]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).distinct()


def joined_words(marked: DataFrame, counts: DataFrame) -> DataFrame:
    """(unit, id, grp, sub, pos, head, tail, hyphen): line ends with a mark, and whether the mark is not the word's own.

    A mark other than a hyphen never is. A hyphen is the word's own if digits stand beside it, if both
    parts begin with a capital, or if the corpus has the hyphenated form more often than the joined one.
    """
    w = Window.partitionBy("unit", "grp", "sub").orderBy("pos")
    rows = marked.where("not furniture and line <> ''").withColumn("next", F.lead("line").over(w))
    rows = rows.where("scanned").where(last_word().rlike(rf"[\p{{L}}\p{{N}}|!@{{]{MARK}+$") & F.col("next").isNotNull())
    head = F.regexp_extract(last_word(), rf"(\S+?){MARK}+$", 1)
    rows = rows.select("unit", "id", "grp", "sub", "pos", "line", head.alias("head"), F.regexp_extract("next", r"^(\S+)", 1).alias("tail"))
    joined = F.lower(token(F.concat("head", "tail")))
    rows = rows.withColumn("joined", joined).withColumn("kept", F.lower(token(F.concat("head", F.lit("-"), "tail"))))
    asked = rows.select(F.explode(F.array("joined", "kept")).alias("form")).distinct()
    known = small(cut(asked.join(counts, "form")), "octet_length(form) + 24")
    rows = rows.join(known.select(F.col("form").alias("joined"), F.col("n").alias("j")), "joined", "left").join(known.select(F.col("form").alias("kept"), F.col("n").alias("k")), "kept", "left")
    j, k = F.coalesce("j", F.lit(0)), F.coalesce("k", F.lit(0))
    odd = ~F.col("line").rlike(r"[-\x{2010}\x{2011}]$")
    digits = F.col("head").rlike(r"\d$") | F.col("tail").rlike(r"^\d")
    capitals = F.col("head").rlike(r"^\W*\p{Lu}") & F.col("tail").rlike(r"^\p{Lu}\p{Ll}")
    hyphen = F.when(odd, F.lit(True)).when(F.col("line").rlike(r"[\x{2010}\x{2011}]$") & ~digits & ~capitals, k <= j).when(digits, F.lit(False)).when(capitals, j > k).otherwise((j > k) | ((j == k) & F.col("tail").rlike(r"^\p{L}")))
    return rows.withColumn("hyphen", hyphen).select("unit", "id", "grp", "sub", "pos", "head", "tail", "hyphen")


def numbers(forms: DataFrame) -> DataFrame:
    """(t, stood): words that are numbers with letters read for digits, and the number that stood there.

    The shape with digits in their place is a common one, the shape as read is rare beside it.
    """
    shaped = forms.where(F.col("t").rlike(r"\d")).withColumn("own", mask(F.col("t")))
    shapes = cut(shaped.groupBy("own").agg(F.sum("n").alias("k")))
    letters, digits = "".join(DIGITS), "".join(DIGITS.values())
    found = shaped.where(F.col("t").rlike(rf"\d.*[{re.escape(letters)}]|[{re.escape(letters)}].*\d") & ~F.col("t").rlike(r"@|_|\p{L}{4}"))
    found = found.withColumn("stood", F.translate("t", letters, digits)).withColumn("shape", mask(F.col("stood"))).select("t", "stood", "own", "shape")
    found = found.join(shapes.where(f"k >= {RATIO * SUPPORT}").select(F.col("own").alias("shape"), F.col("k").alias("common")), "shape")
    return found.join(shapes, "own").where(F.col("k") * RATIO <= F.col("common")).select("t", "stood")


def stream(marked: DataFrame, broken: DataFrame) -> DataFrame:
    """(unit, id, grp, sub, pos, paragraph, furniture, ws): the words of each scanned line, a broken word put together on the line it began on."""
    w = Window.partitionBy("unit", "grp", "sub").orderBy("pos")
    rows = marked.where("scanned").withColumn("paragraph", F.sum(F.when((F.col("line") == "") & ~F.col("furniture"), 1).otherwise(0)).over(w)).where("line <> ''")
    rows = rows.join(broken.select("unit", "grp", "sub", "pos", "tail", "hyphen", F.lit(True).alias("breaks")), ["unit", "grp", "sub", "pos"], "left")
    rows = rows.withColumn("moved", F.lag("breaks").over(Window.partitionBy("unit", "grp", "sub", "furniture").orderBy("pos")) & ~F.col("furniture"))
    line = F.when(F.col("moved"), F.regexp_replace("line", r"^\S+\s*", "")).otherwise(F.col("line"))
    line = F.when(F.col("breaks"), F.concat(F.when(F.col("hyphen"), F.regexp_replace(line, rf"{MARK}+$", "")).otherwise(line), F.col("tail"))).otherwise(line)
    return rows.select("unit", "id", "grp", "sub", "pos", "paragraph", "furniture", F.filter(F.split(line, r"\s+"), lambda x: x != "").alias("ws"))


def _read(narratives: DataFrame, ocr_lines: DataFrame, anchors: DataFrame, words: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(marked lines, broken words, words of scanned lines with what stood there if they are misread)."""
    lines = lines_of(narratives, ocr_lines)
    marked = cut(furniture(lines, anchors))
    native = None if words is None else once(words.where("source_provider_type = 'native_pdf' and text is not null").select("word_key", "text"), "word_key")
    forms = cut(vocabulary(marked, native))
    counts = cut(forms.groupBy(F.lower("t").alias("form")).agg(F.sum("n").alias("n")))
    broken = cut(joined_words(marked, counts))
    pairs = cut(candidates(counts))
    contextual = small(cut(in_context(pairs, marked)), "octet_length(f) + octet_length(stood) + 64").withColumnRenamed("stood", "beside")
    alone = pairs.groupBy("form").agg(F.count("*").alias("k"), F.max("sure").alias("sure"), F.max("stood").alias("stood")).where("k = 1 and sure")
    alone = small(cut(alone.select(F.col("form").alias("f"), F.col("stood").alias("single"))), "octet_length(f) + octet_length(single) + 32")
    shaped = forms.where(misshapen(F.col("t"))).select("t", F.translate(F.lower("t"), "".join(GLYPHS), "".join(GLYPHS.values())).alias("least"))
    by_word = small(cut(numbers(forms).withColumn("least", F.lit(None).cast("string")).unionByName(shaped.select("t", F.lit(None).cast("string").alias("stood"), "least")).groupBy("t").agg(F.max("stood").alias("number"), F.max("least").alias("least"))), "octet_length(t) * 2 + 48")
    read = neighbours(stream(marked, broken), "ws")
    read = read.join(alone, "f", "left").join(contextual.withColumnsRenamed({"f": "cf", "p": "cp", "n": "cn"}), (F.col("f") == F.col("cf")) & F.col("p").eqNullSafe(F.col("cp")) & F.col("n").eqNullSafe(F.col("cn")), "left").drop("cf", "cp", "cn")
    read = read.join(by_word, "t", "left")
    upper, capital = F.col("t").rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*\p{Lu}\P{Ll}*$"), F.col("t").rlike(r"^\p{Lu}")
    word = F.coalesce("beside", "single", "least")
    word = F.when(upper, F.upper(word)).when(capital, F.concat(F.upper(F.substring(word, 1, 1)), F.expr("substring(coalesce(beside, single, least), 2)"))).otherwise(word)
    return marked, broken, read.withColumn("stood", F.coalesce("number", word)).drop("beside", "single", "least", "number")


def repair(narratives: DataFrame, ocr_lines: DataFrame, anchors: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(unit, grp, sub, paragraph, text): continuous paragraphs of scanned narratives and pages without furniture, breaks and misreadings.

    grp is the narrative_id or the document_id, sub the page of a document. Paragraphs end at blank lines.
    A broken word is put together on the line it began on. Every word that find() takes for misread is
    put right. Texts without any line left give no row.
    """
    _, _, read = _read(narratives, ocr_lines, anchors, words)
    fixed = read.where("not furniture").withColumn("w", F.when(F.col("stood").isNull() | (F.col("t") == ""), F.col("w")).otherwise(F.replace(F.col("w"), F.col("t"), F.col("stood"))))
    lines = fixed.groupBy("unit", "grp", "sub", "paragraph", "pos").agg(F.array_join(F.sort_array(F.collect_list(F.struct("i", "w")))["w"], " ").alias("line"))
    texts = lines.groupBy("unit", "grp", "sub", "paragraph").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    return texts.select("unit", "grp", "sub", "paragraph", F.array_join("ls.line", " ").alias("text"))


def misread_words(narratives: DataFrame, ocr_lines: DataFrame, anchors: DataFrame, words: DataFrame) -> DataFrame:
    """(word_key, text, stood): the words of scanned pages that are misread, with what stood there, as far as the word alone tells.

    Null texts are no cases; redelivered rows come out once.
    """
    _, _, read = _read(narratives, ocr_lines, anchors, words)
    best = cut(read.where("stood is not null").groupBy("t", "stood").agg(F.count("*").alias("k")).groupBy("t").agg(F.max(F.struct("k", "stood"))["stood"].alias("stood")))
    scanned = once(words.where("source_provider_type = 'traditional_ocr' and text is not null").select("word_key", F.regexp_replace("text", r"\s+$", "").alias("text")), "word_key").withColumn("t", token(F.col("text")))
    return scanned.join(small(best, "octet_length(t) + octet_length(stood) + 32"), "t").select("word_key", "text", F.replace("text", "t", "stood").alias("stood"))
