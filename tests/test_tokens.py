from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shoal.functions.tokens import attention_mask, token_types, tokenize_words
from shoal.operators import lookup
from shoal.operators.tokens import encode_tokens, read_vocabulary, vocab_lookup

LONG = " ".join(["hello"] * 600)


@pytest.fixture
def vocabulary(spark):
    return spark.createDataFrame([("hello", 7592), ("zero", 0)], "token string, token_id int")


@pytest.fixture
def encoded(spark, vocabulary):
    def encode(*texts, **options):
        df = spark.createDataFrame(list(enumerate(texts)), "id int, document string")
        return encode_tokens(df, vocabulary, **options).orderBy("id").collect()

    return encode


@pytest.mark.parametrize("bound", [1000, 0])
def test_encoding(encoded, bound):
    hello, long, empty, exact, none = encoded("Hello zzz", LONG, "", " ".join(["hello"] * 510), None, max_vocabulary=bound)
    assert hello.input_ids[:5] == [101, 7592, 100, 102, 0] and len(hello.input_ids) == 512
    assert hello.attention_mask == [1] * 4 + [0] * 508
    assert len(long.input_ids) == 512 and 102 not in long.input_ids and long.attention_mask == [1] * 512
    assert empty.input_ids[:3] == [101, 102, 0] and sum(empty.attention_mask) == 2
    assert exact.input_ids[-1] == 102 and sum(exact.attention_mask) == 512
    assert hello.token_type_ids == [0] * 512


def test_both_lookups_agree(encoded):
    texts = ["hello Zero HELLO x", LONG, "", "x y z"]
    assert encoded(*texts) == encoded(*texts, max_vocabulary=0)


def test_repeated_and_missing_ids_keep_their_words(spark, vocabulary):
    rows = [("x", "hello b"), ("x", "b"), (None, "hello"), (None, None), ("y", "")]
    frame = spark.createDataFrame(rows, "id string, document string")

    def answers(**bound):
        got = encode_tokens(frame, vocabulary, **bound).collect()
        return sorted((str(r.id), str(r.document), str(r.input_ids and r.input_ids[:4]), str(r.attention_mask and sum(r.attention_mask))) for r in got)

    small = answers()
    assert small == answers(max_vocabulary=0)
    assert ("None", "None", "None", "None") in small and ("None", "hello", "[101, 7592, 102, 0]", "3") in small
    assert ("x", "b", "[101, 100, 102, 0]", "3") in small


def test_salted_lookup(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 0)
    words = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hello").otherwise("zzz").alias("word"))
    got = vocab_lookup(words, vocabulary)
    assert {(r.word, r.token_id) for r in got.collect()} == {("hello", 7592), ("zzz", 100)}
    assert got.count() == 1000


def test_masks(spark, encoded):
    (row,) = encoded("zero hello")
    masks = spark.range(1).select(
        attention_mask(F.lit(row.input_ids)).alias("m"), token_types(F.lit(row.input_ids)).alias("t")
    ).first()
    # A real word with id 0 is the one case where the two masks differ.
    assert row.attention_mask[:4] == [1, 1, 1, 1] and masks.m[:4] == [1, 0, 1, 1]
    assert masks.t == [0] * 512


@pytest.mark.parametrize(
    "text, words",
    [
        ("  Hello\tWORLD\n", ["hello", "world"]),
        ("a b　c d", ["a", "b", "c", "d"]),
        ("ÉCOLE Straße", ["école", "straße"]),
        ("don't-stop", ["don't-stop"]),
        ("", []),
        (" \n ", []),
    ],
)
def test_words(spark, text, words):
    assert spark.range(1).select(tokenize_words(F.lit(text))).first()[0] == words


def test_read_vocabulary(spark, tmp_path):
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps({"version": "x", "vocab": {"hello": 7592, "[PAD]": 0}}, indent=1))
    assert {tuple(r) for r in read_vocabulary(spark, str(path)).collect()} == {("hello", 7592), ("[PAD]", 0)}
