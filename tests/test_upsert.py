from __future__ import annotations

import re

from pyspark.sql import functions as F

from plan import simple
from shoal.functions.ids import hash_id
from shoal.operators import upsert

SCHEMA = "collection_id string, id string, document string, position int"


def frame(spark, *rows):
    return spark.createDataFrame([("c", *r) for r in rows], SCHEMA)


def as_dict(df):
    return {r.id: r.document for r in df.collect()}


def test_last_and_first_of_a_repeated_id(spark):
    batch = frame(spark, ("a", "1", 1), ("a", "3", 3), ("a", "2", 2), ("b", "x", 1))
    assert as_dict(upsert.last_wins(batch)) == {"a": "3", "b": "x"}
    assert as_dict(upsert.first_wins(batch)) == {"a": "1", "b": "x"}


def test_same_id_in_two_collections_stays_apart(spark):
    rows = spark.createDataFrame([("c", "a", "1", 1), ("d", "a", "2", 2)], SCHEMA)
    assert upsert.last_wins(rows).count() == 2


def test_repeated_key_is_cut_before_the_shuffle(spark):
    plan = simple(upsert.last_wins(frame(spark, ("a", "1", 1))))
    partial, final = plan.index("Partial"), plan.index("Final")
    assert final < plan.index("Exchange") < partial


def test_hot_id(spark):
    rows = spark.range(20_000).select(
        F.lit("c").alias("collection_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("id"),
        F.col("id").cast("string").alias("document"),
        F.col("id").cast("int").alias("position"),
    )
    kept = upsert.last_wins(rows)
    assert kept.count() == 20_000 - 6667 + 1
    assert kept.where("id = 'hot'").first().document == "19998"


def test_upsert_replaces_and_adds(spark):
    current = frame(spark, ("a", "old", 0), ("b", "kept", 0))
    batch = frame(spark, ("a", "new", 1), ("a", "newer", 2), ("c", "added", 1))
    once = upsert.upsert(current, batch, order=("position",))
    assert as_dict(once) == {"a": "newer", "b": "kept", "c": "added"}
    assert as_dict(upsert.upsert(once, batch, order=("position",))) == as_dict(once)


def test_empty_batch_changes_nothing(spark):
    current = frame(spark, ("a", "old", 0))
    assert as_dict(upsert.upsert(current, current.limit(0), order=("position",))) == {"a": "old"}


def test_insert_if_absent(spark):
    current = frame(spark, ("a", "old", 0))
    batch = frame(spark, ("a", "new", 1), ("c", "first", 1), ("c", "second", 2))
    assert as_dict(upsert.insert_if_absent(current, batch, order=("position",))) == {"a": "old", "c": "first"}


def test_import_twice_is_import_once(spark):
    texts = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "document string, position int")
    once = upsert.content_dedupe(texts)
    twice = upsert.content_dedupe(texts.unionByName(texts.withColumn("position", F.col("position") + 10)))
    assert {r.id for r in once.collect()} == {r.id for r in twice.collect()}
    assert once.count() == 2


def test_hash_id(spark):
    assert spark.range(1).select(hash_id(F.lit("no id"))).first()[0] == "745677f0e14bf1bdd94d58d8"


def test_generated_ids(spark):
    df = spark.createDataFrame([(c,) for c in "abc"], "document string").repartition(3)
    dense = upsert.with_generated_ids(df, 17, order_by=["document"]).orderBy("document").collect()
    assert [r.id for r in dense] == ["id-17-0", "id-17-1", "id-17-2"]
    loose = [r.id for r in upsert.with_generated_ids(df).collect()]
    assert len(set(loose)) == 3 and all(re.fullmatch(r"id-\d+-\d+", i) for i in loose)


def test_given_ids_are_kept(spark):
    df = spark.createDataFrame([("mine", "a"), (None, "b")], "id string, document string")
    ids = [r.id for r in upsert.with_generated_ids(df, 17, order_by=["document"]).orderBy("document").collect()]
    assert ids == ["mine", "id-17-1"]


def test_zip_batch(spark):
    wire = spark.createDataFrame([(0, ["a", "b"], ["x", "y"]), (1, [], []), (2, ["c"], ["z"])], "batch int, ids array<string>, documents array<string>")
    got = upsert.zip_batch(wire, id="ids", document="documents")
    assert sorted(map(tuple, got.collect())) == [(0, "a", "x"), (0, "b", "y"), (2, "c", "z")]
