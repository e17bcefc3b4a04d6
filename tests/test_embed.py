from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plan import simple
from onnx_model import gather_model
from shoal.functions.vectors import distance, first_token_pool, format_distance
from shoal.operators.embed import Embedder, HashingEmbedder, OnnxEmbedder, embed_documents, hashing_embed, ship_model

# The embedders below live in a module the workers do not have.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXTS = ["The quick  brown fox", "", " \n ", "a b É é", "word " * 300, "Fox fox FOX"]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, document string")


def test_column_and_worker_form_of_hashing_agree(texts):
    for dim in (1, 16, 384):
        column = hashing_embed(texts, dim).orderBy("id").collect()
        worker = embed_documents(texts, HashingEmbedder(dim)).orderBy("id").collect()
        for a, b in zip(column, worker):
            assert np.allclose(a.embedding, b.embedding, atol=1e-7), a.document
    assert [round(float(np.linalg.norm(r.embedding)), 6) for r in worker] == [1, 0, 0, 1, 1, 1]


class Constant(Embedder):
    dim = 2

    def embed(self, texts):
        return np.array([[0.1, 0.2]] * len(texts))


class Picky(Embedder):
    dim = 1

    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise ValueError("no bad texts")
        return np.ones((len(texts), 1))


class Wide(Embedder):
    dim = 3

    def embed(self, texts):
        return np.ones((len(texts), 2))


def test_mock_embedder(texts):
    got = embed_documents(texts, Constant()).collect()
    assert all(np.allclose(r.embedding, [0.1, 0.2]) for r in got) and len(got) == len(TEXTS)


def test_null_text_has_no_vector(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, document string").coalesce(1)
    got = {r.id: r.embedding for r in embed_documents(df, Picky()).collect()}
    assert got == {1: [1.0], 2: None, 3: [1.0]}


def test_failure_names_the_record(spark):
    df = spark.createDataFrame([("r1", "ok"), ("r2", "bad one")], "id string, document string").coalesce(1)
    with pytest.raises(Exception, match="failed to embed record 'r2'"):
        embed_documents(df, Picky()).collect()


def test_wrong_width_is_an_error(texts):
    with pytest.raises(Exception, match="width 3"):
        embed_documents(texts, Wide()).collect()


def test_missing_embedder_is_refused_before_any_job(texts):
    with pytest.raises(ValueError, match="not initialized"):
        embed_documents(texts, None)


def test_only_id_and_text_reach_the_workers(texts):
    plan = simple(embed_documents(texts.withColumn("heavy", F.repeat(F.lit("x"), 100)), Constant()))
    assert "ArrowEvalPython [vectors_of(id" in plan and "heavy" not in plan.split("vectors_of(")[1].split(")")[0]


def test_filter_on_vectors_does_not_embed_twice(texts):
    rows = embed_documents(texts, Constant()).where(F.size("embedding") == 2).select("id", F.explode("embedding"))
    assert simple(rows).count("ArrowEvalPython") == 1


def test_onnx_model(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers, processors

    vocab = {"[PAD]": 0, "[CLS]": 1, "[SEP]": 2, "[UNK]": 3, "red": 4, "blue": 5}
    tokenizer = Tokenizer(models.WordLevel(vocab, unk_token="[UNK]"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.post_processor = processors.TemplateProcessing(single="$A [SEP]", special_tokens=[("[SEP]", 2)])
    tokenizer.save(str(tmp_path / "tokenizer.json"))
    table = np.arange(24, dtype=np.float32).reshape(6, 4) / 10
    (tmp_path / "model.onnx").write_bytes(gather_model(table))
    embedder = OnnxEmbedder(str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"), dim=4)
    words = ["red", "blue red", "green", "blue blue blue", ""]
    df = spark.createDataFrame(list(enumerate(words)), "id int, document string")
    got = [r.embedding for r in embed_documents(df, embedder).orderBy("id").collect()]
    assert np.allclose(got, table[[4, 5, 3, 5, 2]])
    ship_model(spark, str(tmp_path / "model.onnx"), str(tmp_path / "tokenizer.json"))
    shipped = OnnxEmbedder("/not/here/model.onnx", "/not/here/tokenizer.json", dim=4)
    assert np.allclose([r.embedding for r in embed_documents(df, shipped).orderBy("id").collect()], got)


def test_column_form_is_computed_once(texts):
    rows = hashing_embed(texts, 8).where(F.size("embedding") == 8).select("id", F.explode("embedding"))
    assert simple(rows).count("regexp_extract_all(") == 1


def test_first_token_pool(spark):
    flat = spark.range(1).select(first_token_pool(F.lit([1.0, 2.0, 3.0, 4.0]), 2)).first()[0]
    assert flat == [1.0, 2.0]


@pytest.mark.parametrize(
    "metric, a, b, expected",
    [
        ("l2", [1.0, 2.0], [3.0, 1.0], 5.0),
        ("ip", [1.0, 2.0], [3.0, 1.0], -4.0),
        ("cosine", [1.0, 0.0], [0.0, 2.0], 1.0),
        ("cosine", [1.0, 0.0], [2.0, 0.0], 0.0),
        ("cosine", [0.0, 0.0], [2.0, 0.0], 1.0),
    ],
)
def test_distance(spark, metric, a, b, expected):
    assert spark.range(1).select(distance(F.lit(a), F.lit(b), metric)).first()[0] == pytest.approx(expected)


def test_format_distance(spark):
    assert spark.range(1).select(format_distance(F.lit(0.12345678))).first()[0] == "0.1235"
