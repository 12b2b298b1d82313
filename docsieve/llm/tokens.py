"""Problem 6: encoding of a corpus with a public byte-level BPE vocabulary.

Pre-tokens are exploded with their positions, each distinct pre-token is encoded once, the ids are
joined back and put together by position. Decoding joins the table of token bytes.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.session import cut, small

#: Place of the public vocabularies.
VOCABULARIES = os.environ.get("DOCSIEVE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k"
#: The public pre-token pattern of the byte-level vocabularies; (?U) gives white space its Unicode meaning.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def ranks(name: str = VOCABULARY, folder: str = VOCABULARIES) -> dict[bytes, int]:
    """Token bytes to ids of a rank file."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def _encoding(name: str, folder: str):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})


def pretokens(text: str = "text"):
    """Array of the pre-tokens of a text; null for a null text."""
    return F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, ids): the ids of every text, without special tokens.

    Null and empty texts give an empty list. Strings of special tokens are ordinary text. Rows with
    one doc_id are taken to be one document delivered repeatedly: it comes out once. A null doc_id is
    kept as one row. Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).dropDuplicates(["doc_id"])
    tokens = docs.select("doc_id", F.posexplode(pretokens()).alias("pos", "word"))

    def encode_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(name, folder)
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "ids": [enc.encode_ordinary(w) for w in b["word"]]})

    words = tokens.select("word").distinct()
    coded = cut(words.mapInPandas(encode_words, "word string, ids array<int>"))
    joined = tokens.join(small(coded, "octet_length(word) + 4 * size(ids) + 32"), "word")
    whole = joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "ids"))).alias("parts"))
    ids = whole.select("doc_id", F.flatten("parts.ids").alias("ids"))
    rest = docs.where("text is null or text = ''").select("doc_id", F.expr("cast(array() as array<int>)").alias("ids"))
    return ids.unionByName(rest)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, text): the texts of lists of ids, by joining the token-byte table; an empty or null list gives ''."""
    spark = encoded.sparkSession
    rows = encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids"))
    at = rows.select("doc_id", F.posexplode("ids").alias("pos", "id"))
    joined = at.join(F.broadcast(token_bytes(spark, name, folder)), "id")  # a vocabulary has a fixed size
    texts = joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hex"))).alias("parts"))
    texts = texts.select("doc_id", F.decode(F.unhex(F.array_join("parts.hex", "")), "UTF-8").alias("text"))
    return texts.unionByName(rows.where("coalesce(size(ids), 0) <= 0").select("doc_id", F.lit("").alias("text")))


def token_bytes(spark: SparkSession, name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """(id, hex): the bytes of every token in hexadecimal."""
    table = ranks(name, folder)
    return spark.createDataFrame(pd.DataFrame({"id": list(table.values()), "hex": [b.hex() for b in table]}), "id int, hex string")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = VOCABULARY, folder: str = VOCABULARIES) -> DataFrame:
    """(doc_id, tokens): the number of tokens of every text, summed over pre-tokens without putting ids together."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tokens = docs.select("doc_id", F.explode_outer(pretokens()).alias("word"))

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(name, folder)
        for b in batches:
            yield pd.DataFrame({"word": b["word"], "n": [len(enc.encode_ordinary(w)) for w in b["word"]]})

    counted = cut(tokens.select("word").where("word is not null").distinct().mapInPandas(count_words, "word string, n int"))
    joined = tokens.join(small(counted, "octet_length(word) + 36"), "word", "left")
    return joined.groupBy("doc_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("tokens"))
