import pytest

from docsieve.llm import tokens as T

TEXTS = ["", None, "Hello world", "  lead\n\n\ttab  ", "<|endoftext|> is text", "naïve 😀👨‍👩‍👧 ½ m² Łódź", "a" * 5000, "it's we'll\r\n\r\nx", "     ", "１２３ ٣٤"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "clash"), (None, "no key", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_ids_are_those_of_the_public_tokenizer(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{T.VOCABULARIES}/{T.VOCABULARY}.json")
    t.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in T.encode(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        assert got[i] == (t.encode(text, add_special_tokens=False).ids if text else []), text


def test_round_trip_and_sizes(spark, docs):
    enc = T.encode(docs)
    assert {r.doc_id: r.text for r in T.decode(enc).collect()} == {i: t or "" for i, t in enumerate(TEXTS)} | {None: "no key"}
    sizes = {r.doc_id: r.tokens for r in T.sizes(docs.where("doc_id <> 2")).collect()}
    assert sizes == {r.doc_id: len(r.ids) for r in enc.where("doc_id <> 2").collect()}


def test_empty_table(spark, docs):
    assert T.encode(docs.limit(0)).count() == 0 and T.decode(T.encode(docs.limit(0))).count() == 0
