"""The corpus pipeline: stages one after another, what they leave behind, edge rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoal.session import shared_dir

TABLES = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    """Tables of which a test may replace one."""
    for name in ("documents", "benchmark"):
        os.symlink(f"{TABLES}/{name}.parquet", tmp_path / f"{name}.parquet")
    return tmp_path


def staged(spark):
    top = f"{shared_dir(spark)}/shoal"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_after_a_stage_only_its_output_remains(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    while corpus_pipeline._staged:
        corpus_pipeline._staged.pop().close()
    before, columns = staged(spark), docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        made = step(spark, docs, TABLES)
        made.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        mine = {os.path.basename(p) for p in corpus_pipeline._staged[0].paths}
        assert len(corpus_pipeline._staged) == 1 and staged(spark) - before <= mine, name
    corpus_pipeline._staged[0].close()
    assert staged(spark) == before


def test_run_and_its_decisions(spark):
    got = corpus_pipeline.run(spark, TABLES).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert starts[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:]))
    ids = {r["doc_id"] for r in got}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").collect()}
    assert ids <= set(docs) and len({docs[i] for i in ids}) == len(ids)  # of equal texts one stays
    items = [r["text"] for r in spark.read.parquet(f"{TABLES}/benchmark.parquet").collect()]
    assert not any(item in docs[i] for i in ids for item in items)
    assert len([n for n in staged(spark) if n.startswith(("language_id", "simhash_near", "benchmark_decon"))]) == 0


def test_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").limit(0)
    os.unlink(folder / "documents.parquet")
    docs.write.parquet(str(folder / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(folder)).count() == 0


def test_edge_rows_and_clashing_columns(spark, folder, edge_docs):
    real = spark.read.parquet(f"{TABLES}/documents.parquet")
    more = edge_docs.withColumn("lang_pred", F.lit("x")).withColumn("_score", F.lit(1.5)).withColumn("copies", F.lit("c"))
    docs = more.unionByName(real.withColumn("doc_id", F.col("doc_id") + 1000), allowMissingColumns=True)
    columns = docs.columns
    os.unlink(folder / "documents.parquet")
    docs.write.parquet(str(folder / "documents.parquet"))
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        step(spark, frame, str(folder)).write.parquet(f"{folder}/out{k}")
        frame = spark.read.parquet(f"{folder}/out{k}")
        assert frame.columns == columns, name
    kept = {r["doc_id"]: r for r in frame.where("doc_id < 1000").collect()}
    assert all(r["lang_pred"] == "x" and r["_score"] == 1.5 and r["copies"] == "c" for r in kept.values())
    assert 3 not in kept and 4 not in kept and 5 not in kept and 8 not in kept  # without a letter
    made = corpus_pipeline.STAGES[-1][1](spark, frame, str(folder))
    assert made.count() == frame.count()
