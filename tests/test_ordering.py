from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plan import simple
from shoal.operators import ordering


@pytest.fixture
def numbers(spark):
    return spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id")).repartition(7)


def test_positions_are_dense_and_in_order(numbers):
    placed = ordering.with_position(numbers, ["id"]).collect()
    assert sorted((r.id, r.position) for r in placed) == [(i, i + 1) for i in range(1000)]


def test_position_of_nothing(spark):
    assert ordering.with_position(spark.range(0), ["id"]).count() == 0


def test_position_uses_no_window_over_all_rows(numbers):
    plan = simple(ordering.with_position(numbers, ["id"]))
    assert "SinglePartition" not in plan.split("Window")[0]


@pytest.mark.parametrize("heap", [10_000, 1])
def test_limit_is_the_same_on_both_ways(numbers, monkeypatch, heap):
    monkeypatch.setattr(ordering, "HEAP_KEYS", heap)
    assert sorted(r.id for r in ordering.take_first(numbers, 37, ["id"]).collect()) == list(range(37))
    assert ordering.take_first(numbers, 0, ["id"]).count() == 1000
    assert ordering.take_first(numbers, 5000, ["id"]).count() == 1000


@pytest.mark.parametrize("heap", [10_000, 1])
def test_pages(numbers, monkeypatch, heap):
    monkeypatch.setattr(ordering, "HEAP_KEYS", heap)

    def page(**options):
        return sorted(r.id for r in ordering.page_records(numbers, **options).collect())

    assert page(limit=10, offset=20) == list(range(20, 30))
    assert page(limit=10, offset=995) == list(range(995, 1000))
    assert page(offset=990) == list(range(990, 1000))
    assert page(limit=0) == []
    assert len(page()) == 1000
    with pytest.raises(ValueError):
        ordering.page_records(numbers, limit=-1)


def test_limit_leaves_rows_where_they_are(numbers):
    first = ordering.take_first(numbers, 500, ["id"])
    assert "Exchange" not in simple(first).replace("Exchange RoundRobinPartitioning", "")
    filled = first.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(filled) > 1 and sum(r["count"] for r in filled) == 500


@pytest.mark.parametrize("heap", [10_000, 1])
def test_limit_over_nulls_and_ties(spark, monkeypatch, heap):
    monkeypatch.setattr(ordering, "HEAP_KEYS", heap)
    rows = [(None, 2), ("a", None), ("a", 1), (None, 1), ("b", 1), ("b", 1), ("b", 1)]
    df = spark.createDataFrame(rows, "s string, n int")
    got = [sorted(map(tuple, ordering.take_first(df, n, ["s", "n"]).collect()), key=str) for n in range(1, 8)]
    whole = [(None, 1), (None, 2), ("a", None), ("a", 1), ("b", 1), ("b", 1), ("b", 1)]
    assert got == [sorted(whole[:n], key=str) for n in range(1, 8)]
    assert ordering.take_first(df.limit(0), 3, ["s", "n"]).count() == 0


def test_page_of_given_ids(spark):
    records = spark.createDataFrame([(c,) for c in "abcdef"], "id string")
    got = ordering.page_records(records, ids=["b", "d", "f", "zz", "b"], limit=2, offset=1)
    assert [r.id for r in got.orderBy("id").collect()] == ["d", "f"]
    assert ordering.page_records(records, ids=[]).count() == 0


@pytest.mark.parametrize("size, batches", [(300, [300, 300, 300, 100]), (0, [100] * 10), (-5, [100] * 10)])
def test_batches(numbers, size, batches):
    counts = ordering.assign_batches(numbers, ["id"], size).groupBy("batch").count().orderBy("batch").collect()
    assert [(r["batch"], r["count"]) for r in counts] == list(enumerate(batches))
