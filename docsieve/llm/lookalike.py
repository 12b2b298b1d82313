"""Problem 5: one consistent form for values that look alike.

Distinct values are mapped character by character to what a typist would have used, grouped by the
mapped value under an accent-sensitive Unicode collation (which also equates composed and combining
accents and ignores invisible characters), and every class gets one canonical member, joined back.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.session import cut, small

# Look-alike letters of other scripts and the Latin letters they resemble (fixed values, in pairs by position).
CYRILLIC = "АВЕЅІЈКМНОРСТХУаеѕіјорсухһԁԛԝҮүӀӏԌ"
CYRILLIC_AS = "ABESIJKMHOPCTXYaesijopcyxhdqwYyIlG"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυαικρτχϲϹϳͿ"
GREEK_AS = "ABEZHIKMNOPTYXovuaikptxcCjJ"
ARMENIAN = "ՕՏՍԼօսհոցյզք"
ARMENIAN_AS = "OSULouhngjqp"
CHEROKEE = "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ"
CHEROKEE_AS = "ABCDEGHJKLMPRSTVWZ"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u2028\u2029\u0085"

WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
WIDE_AS = "".join(chr(ord(c) - 0xFEE0) for c in WIDE)

_FOREIGN = CYRILLIC + GREEK + ARMENIAN + CHEROKEE
_FOREIGN_AS = CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + CHEROKEE_AS
_SCRIPTS = r"\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}\p{IsCherokee}"
#: A letter of these scripts that no Latin letter resembles: the token is of that script.
GENUINE = rf"[[{_SCRIPTS}]&&[^{_FOREIGN}]]"
#: Characters that stand for others by a rule of Unicode: letters and digits in mathematical styles, Roman numerals, letter-like letters, half-width kana and Hangul, ligatures.
COMPATIBLE = r"[\x{1D400}-\x{1D7FF}\x{2160}-\x{2188}\x{2100}-\x{214F}\x{FF65}-\x{FFDC}\x{FB00}-\x{FB06}]"
#: Scripts that use joiners; Chinese, Japanese and Korean use full-width punctuation.
_JOINING = r"[\p{IsArabic}\p{IsSyriac}\p{IsDevanagari}\p{IsBengali}\p{IsGurmukhi}\p{IsGujarati}\p{IsOriya}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}\p{IsMongolian}]"
_EAST = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsBopomofo}]"
#: Invisible characters: always wrong; joiners and selectors unless they belong to the character before them; a soft hyphen unless it ends a line or value.
INVISIBLE = (
    r"[\x{200B}\x{2060}-\x{2064}\x{FEFF}\x{180E}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}]"
    rf"|(?<!{_JOINING})[\x{{200C}}\x{{200E}}\x{{200F}}]"
    r"|[\x{200D}\x{FE00}-\x{FE0F}]"
    r"|\x{00AD}(?!\s|$)"
)


#: Joiners and selectors that belong to the character before them; they are put aside while the others go.
_KEPT = rf"({_JOINING}|[\p{{So}}\p{{Sm}}\x{{2139}}\x{{203C}}\x{{2049}}\x{{1F3FB}}-\x{{1F3FF}}\x{{FE0F}}\x{{E001}}]|[#*0-9](?=\x{{FE0F}}\x{{20E3}}))"
_ASIDE, _BACK = "\ue000\ue001", "\u200d\ufe0f"


def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def compose(value: str | Column) -> Column:
    """Canonical composition (NFC), which Spark has no function for."""
    return F.pandas_udf(_compose, "string")(value)


_STYLED = re.compile("[\U0001d400-\U0001d7ff\u2160-\u2188\u2100-\u214f\uff65-\uffdc\ufb00-\ufb06]+")


def _decomposed(run: str) -> str:
    """Letters, digits and kana by their compatibility form; signs such as those of degrees, numbers and trade marks stay."""
    out = []
    for part in re.findall("[\uff65-\uffdc]+|.", run):
        form = unicodedata.normalize("NFKC", part)
        letterlike = "\u2100" <= part[0] <= "\u214f"
        out.append(part if letterlike and (not (len(form) == 1 and form.isascii() and form.isalnum()) or part == "\u2139") else form)
    return "".join(out)


def unstyled(text: str | None) -> str | None:
    """COMPATIBLE characters as those a typist uses."""
    return text if text is None else _STYLED.sub(lambda m: _decomposed(m.group()), text)


def _unstyled(values: pd.Series) -> pd.Series:
    return values.map(unstyled)


_PLAIN = {ord(c): None for c in "\u200b\u2060\u2061\u2062\u2063\u2064\ufeff\u180e\u034f\u200c\u200d\u200e\u200f"}
_PLAIN |= {ord(a): b for a, b in zip(WIDE, WIDE_AS)} | {ord(c): " " for c in SPACES}
_LETTERS = {ord(a): b for a, b in zip(_FOREIGN, _FOREIGN_AS)}
_LIKE = re.compile(f"[{_FOREIGN}]")
_OTHER = re.compile(f"(?![{_FOREIGN}])[\u0370-\u058f\u13a0-\u13ff]")
_LATIN = re.compile("[A-Za-z0-9\u00c0-\u024f]")


def plain(text: str | None) -> str | None:
    """typed() for one text in Python, for running text: every invisible character goes, a soft hyphen only if it does not end the text.

    A word of look-alike letters alone stays if a word beside it is genuinely of another script.
    """
    if text is None or text.isascii():
        return text
    out = unstyled(re.sub(r"\u00ad(?!\s*$)", "", text)).translate(_PLAIN)
    if _LIKE.search(out):
        words = out.split(" ")
        genuine = [bool(_OTHER.search(w)) for w in words]
        for i, w in enumerate(words):
            if not genuine[i] and (_LATIN.search(w) or not any(genuine[max(0, i - 1) : i + 2])):
                words[i] = w.translate(_LETTERS)
        out = " ".join(words)
    return unicodedata.normalize("NFC", out)


def _plain(values: pd.Series) -> pd.Series:
    return values.map(plain)


def typed(value: Column) -> Column:
    """``value`` with look-alike characters replaced by those a typist would use; combining accents stay as they are."""
    joined = value.rlike(r"[\x{200D}\x{FE0F}]")
    v = F.regexp_replace(F.regexp_replace(value, _KEPT + r"\x{FE0F}", "$1\ue001"), _KEPT + r"\x{200D}", "$1\ue000")
    v = F.regexp_replace(F.when(joined, v).otherwise(value), INVISIBLE, "")
    v = F.when(joined, F.translate(v, _ASIDE, _BACK)).otherwise(v)
    v = F.translate(v, SPACES, " " * len(SPACES))
    v = F.regexp_replace(v, " {2,}", " ")

    def token(t: Column) -> Column:
        t = F.when(t.rlike(_EAST), t).otherwise(F.translate(t, WIDE, WIDE_AS))
        return F.when(t.rlike(GENUINE) | whole_word(t), t).otherwise(F.translate(t, _FOREIGN, _FOREIGN_AS))

    foreign = rf"[{_SCRIPTS}{WIDE[0]}-{WIDE[-1]}]"
    v = F.when(v.rlike(foreign), F.array_join(F.transform(F.split(v, " "), token), " ")).otherwise(v)
    return F.trim(v)


def whole_word(token: Column) -> Column:
    """Whether a token consists of look-alike letters of other scripts and signs alone: it can be a word of its own."""
    return token.rlike(rf"^[^\p{{IsLatin}}\p{{N}}]*[{_FOREIGN}][^\p{{IsLatin}}\p{{N}}]*$") & ~token.rlike(GENUINE)


def decided(mapped: DataFrame) -> DataFrame:
    """``mapped`` with words of look-alike letters alone decided: they stay in a value that has a genuine word of another script, and where no value of the table has the Latin word.

    "ѕее" becomes "see" where the table has "see" in Latin letters; "хор" stays.
    """
    like = F.col("mapped").rlike(f"[{_FOREIGN}]")
    parts = mapped.where(like).select("value", F.col("mapped").rlike(GENUINE).alias("genuine"), F.posexplode(F.split("mapped", " ")).alias("pos", "t"))
    parts = parts.withColumn("open", ~F.col("genuine") & whole_word(F.col("t"))).withColumn("latin", F.translate("t", _FOREIGN, _FOREIGN_AS))
    bare = F.lower(F.regexp_replace("latin", r"^[^\p{L}]+|[^\p{L}]+$", ""))
    parts = cut(parts.withColumn("word", F.when(F.col("open"), bare)))
    asked = small(parts.where("open").select("word").distinct(), "octet_length(word) + 16")
    written = mapped.where(~like).select(F.explode(F.split("mapped", " ")).alias("t")).select(F.lower(F.regexp_replace("t", r"^[^\p{L}]+|[^\p{L}]+$", "")).alias("word"))
    known = small(cut(written.join(asked, "word", "left_semi").distinct().withColumn("known", F.lit(True))), "octet_length(word) + 16")
    chosen = parts.join(known, "word", "left").withColumn("t", F.when(F.col("known"), F.col("latin")).otherwise(F.col("t")))
    whole = chosen.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("ts")).select("value", F.array_join("ts.t", " ").alias("now"))
    return mapped.join(small(cut(whole), "octet_length(value) + octet_length(now) + 32"), "value", "left").withColumn("mapped", F.coalesce("now", "mapped")).drop("now")


def changes(values: DataFrame, column: str) -> DataFrame:
    """(value, canonical) for the distinct values of ``column`` that are not in their canonical form.

    Values fall into one class if they are equal once typed(), under the accent-sensitive,
    case-sensitive collation UNICODE. The canonical member is one that a typist would write, the most
    frequent first, then the least in binary order; a class without such a member gets the composed
    form of its mapped value. Null and empty values stay as they are.
    """
    counted = values.select(F.col(column).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n"))
    styled = F.col("value").rlike(COMPATIBLE)
    bare = counted.where(~styled).withColumn("bare", F.col("value")).unionByName(counted.where(styled).withColumn("bare", F.pandas_udf(_unstyled, "string")("value")))
    mapped = decided(cut(bare.select("value", "n", typed(F.col("bare")).alias("mapped"))))
    marks = F.col("mapped").rlike(r"\p{M}")
    composed = mapped.where(marks).withColumn("form", compose("mapped")).unionByName(mapped.where(~marks).withColumn("form", F.col("mapped")))
    keyed = cut(composed.withColumn("class", F.expr("collate(mapped, 'UNICODE')")))
    best = keyed.groupBy("class").agg(F.min(F.struct((F.col("value") != F.col("form")).alias("odd"), (-F.col("n")).alias("rank"), F.col("form"))).alias("best"), F.count("*").alias("members"), F.max(F.col("value") != F.col("form")).alias("any"))
    best = best.where("members > 1 or any").select("class", "best.form")
    joined = keyed.select("value", "class").join(best.withColumnRenamed("form", "canonical"), "class")
    return joined.where(F.col("value") != F.col("canonical")).select("value", "canonical")


def canonical(rows: DataFrame, column: str, into: str = "canonical_text") -> DataFrame:
    """``rows`` with the canonical form of ``column`` in ``into``; null values give null, rows are neither lost nor added."""
    form = small(cut(changes(rows, column)), "octet_length(value) + octet_length(canonical) + 32").withColumnsRenamed({"value": "__value", "canonical": "__canonical"})
    joined = rows.join(form, F.col(column) == F.col("__value"), "left").drop("__value").withColumn("__canonical", F.coalesce("__canonical", column))
    return joined.drop(into).withColumnRenamed("__canonical", into) if into in rows.columns else joined.withColumnRenamed("__canonical", into)


def deviating(rows: DataFrame, *keys: str, column: str) -> DataFrame:
    """(keys): keys of the rows whose value is not its canonical form, each once; only these rows are shuffled."""
    rows = rows.select(*keys, column)
    form = small(cut(changes(rows, column)), "octet_length(value) + octet_length(canonical) + 32").select(F.col("value").alias(column))
    return rows.join(form, column, "left_semi").select(*keys).distinct()
