from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from plan import physical, simple
from shoal.operators import search
from shoal.operators.nearest import NearestRecords

RNG = np.random.default_rng(7)


def distances(q, v, metric):
    if metric == "l2":
        return ((q[:, None, :] - v[None, :, :]) ** 2).sum(-1)
    dots = q @ v.T
    if metric == "ip":
        return 1 - dots
    norms = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    return 1 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def brute_force(q, v, k, metric):
    """(query, rank) → record by full comparison, ties at nine decimals to the smaller id."""
    d = distances(q.astype(np.float64), v.astype(np.float64), metric)
    order = np.argsort(np.rint(d * 1e9), axis=1, kind="stable")[:, :k]
    return {(i, r + 1): int(order[i, r]) for i in range(len(q)) for r in range(order.shape[1])}


def frame(spark, matrix, name="id", parts=5):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>").repartition(parts)


def answer(hits):
    return {(r.query_id, r.rank): r.id for r in hits.collect()}


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("method", ["matrix", "blocked"])
def test_equals_brute_force(spark, metric, method):
    v = RNG.normal(size=(400, 12)).astype(np.float32)
    v[5] = 0
    q = RNG.normal(size=(30, 12)).astype(np.float32)
    q[3] = v[7]
    hits = search.knn(frame(spark, v), frame(spark, q, "query_id", 2), 7, metric, method=method)
    assert answer(hits) == brute_force(q, v, 7, metric)


def test_many_equal_vectors_go_by_id(spark):
    v = np.tile(RNG.normal(size=(1, 8)), (600, 1)).astype(np.float32)
    v[::2] = RNG.normal(size=(300, 8))
    hits = search.knn(frame(spark, v), frame(spark, v[1:4], "query_id", 1), 5)
    assert answer(hits) == brute_force(v[1:4], v, 5, "l2")


def test_near_ties_are_told_apart(spark):
    base = np.full((50, 4), 1000.0)
    base[:, 0] += np.arange(50)[::-1] * 1e-3
    v = base.astype(np.float32)
    hits = search.knn(frame(spark, v), frame(spark, v[:3], "query_id", 1), 4)
    assert answer(hits) == brute_force(v[:3], v, 4, "l2")


def test_blocks_smaller_than_the_queries(spark):
    v = RNG.normal(size=(200, 6)).astype(np.float32)
    q = RNG.normal(size=(50, 6)).astype(np.float32)
    records, queries = frame(spark, v), frame(spark, q, "query_id", 3)
    assert answer(search._blocked_hits(records, queries, 3, "l2", block_queries=8)) == brute_force(q, v, 3, "l2")


def test_a_pass_moves_no_record(spark):
    v = RNG.normal(size=(40, 4)).astype(np.float32)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    records = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = records.withColumnRenamed("id", "query_id")
    schema = search._candidate_schema(records, queries)
    shared = search._share(spark, queries.toArrow())
    assert "Exchange" not in simple(search._pass(records, shared, 4, 2, "l2", schema))


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_many_results_in_two_passes(spark, monkeypatch, metric, kind):
    monkeypatch.setattr(search, "MANY_RESULTS", 40)
    monkeypatch.setattr(search, "SAMPLE", 3)
    monkeypatch.setattr(search, "STATE_PAIRS", 400)
    monkeypatch.setattr(search, "EMIT_ROWS", 64)
    v = RNG.normal(size=(500, 6)).astype(np.float32)
    v[100:200] = v[:100]
    q = RNG.normal(size=(25, 6)).astype(np.float32)
    records = frame(spark, v).withColumn("id", F.lpad(F.col("id").cast("string"), 4, "0").cast(kind))
    got = {at: int(i) for at, i in answer(search.knn(records, frame(spark, q, "query_id", 3), 40, metric)).items()}
    assert got == brute_force(q, v, 40, metric)


def test_more_results_than_the_sample_holds(spark, monkeypatch):
    monkeypatch.setattr(search, "MANY_RESULTS", 10)
    v = RNG.normal(size=(50, 4)).astype(np.float32)
    hits = search.knn(frame(spark, v), frame(spark, v[:6], "query_id", 2), 45, method="blocked")
    assert answer(hits) == brute_force(v[:6], v, 45, "l2")


def test_many_queries_are_searched_in_blocks(spark, monkeypatch):
    v = RNG.normal(size=(60, 4)).astype(np.float32)
    records, queries = frame(spark, v), frame(spark, v, "query_id")
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 10)
    assert answer(search.knn(records, queries, 2)) == brute_force(v, v, 2, "l2")
    with pytest.raises(ValueError, match="too many queries"):
        search.knn(records, queries, 2, method="matrix")


def test_matrix_in_parts_takes_any_number_of_queries(spark, monkeypatch):
    v = RNG.normal(size=(60, 4)).astype(np.float32)
    records, queries = frame(spark, v), frame(spark, v, "query_id")
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 10)
    monkeypatch.setattr(search, "STATE_PAIRS", 14)  # seven queries a part
    assert answer(search.knn(records, queries, 2, method="matrix", in_parts=True)) == brute_force(v, v, 2, "l2")


def test_queries_of_one_id_have_k_answers_over_all_parts(spark, monkeypatch):
    v = RNG.normal(size=(20, 4)).astype(np.float32)
    queries = frame(spark, v, "query_id").withColumn("query_id", F.when(F.col("query_id") % 2 == 1, F.col("query_id")))
    whole = search.knn(frame(spark, v), queries, 3, method="matrix").collect()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 5)
    monkeypatch.setattr(search, "STATE_PAIRS", 9)
    parts = search.knn(frame(spark, v), queries, 3, method="matrix", in_parts=True).collect()
    assert sorted(map(str, parts)) == sorted(map(str, whole)) and len(parts) == 33


@pytest.mark.parametrize("method", ["matrix", "blocked"])
def test_bad_vectors_never_rank(spark, method):
    rows = [("a", [0.0, 0.0]), ("b", None), ("c", [1.0]), ("d", [float("nan"), 0.0]), ("e", [None, 0.0]), ("f", [5.0, 0.0])]
    records = spark.createDataFrame(rows, "id string, embedding array<float>")
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 0.0])], "query_id int, embedding array<float>")
    hits = search.knn(records, queries, 5, method=method)
    assert answer(hits) == {(0, 1): "a", (0, 2): "f", (1, 1): "f", (1, 2): "a"}


def test_fewer_records_than_results(spark):
    v = RNG.normal(size=(3, 4)).astype(np.float32)
    assert len(answer(search.knn(frame(spark, v), frame(spark, v, "query_id"), 10))) == 9


@pytest.mark.parametrize("method", ["matrix", "blocked"])
def test_nothing_to_search(spark, method):
    some, none = frame(spark, RNG.normal(size=(3, 4))), frame(spark, RNG.normal(size=(1, 4))).where("id < 0")
    as_queries = lambda df: df.withColumnRenamed("id", "query_id")
    assert search.knn(none, as_queries(some), 2, method=method).count() == 0
    assert search.knn(some, as_queries(none), 2, method=method).count() == 0


def test_number_of_results():
    assert search.result_count(0) == 3 and search.result_count(5) == 5
    with pytest.raises(ValueError):
        search.result_count(-1)


def test_unknown_metric_or_method(spark):
    df = frame(spark, RNG.normal(size=(2, 2)))
    with pytest.raises(ValueError, match="metric"):
        search.knn(df, df.withColumnRenamed("id", "query_id"), 1, "l1")
    with pytest.raises(ValueError, match="method"):
        search.knn(df, df.withColumnRenamed("id", "query_id"), 1, method="guess")


def test_queries_of_different_width(spark):
    queries = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "query_id int, embedding array<float>")
    records = frame(spark, RNG.normal(size=(2, 2)))
    with pytest.raises(ValueError, match="differ in width"):
        search.knn(records, queries, 1)
    with pytest.raises(Exception, match="differ in width"):
        search.knn(records, queries, 1, method="blocked").collect()


@pytest.mark.parametrize("order", ["near last", "near first"])
def test_state_over_many_batches(order):
    v = RNG.normal(size=(3000, 5)).astype(np.float32)
    q = RNG.normal(size=(4, 5)).astype(np.float32)
    ids = np.argsort(distances(q, v, "l2")[0])
    ids = ids[::-1] if order == "near last" else ids
    state = NearestRecords(q, 6, "l2")
    for start in range(0, 3000, 170):
        part = ids[start : start + 170]
        state.update(part, v[part])
    state.settle()
    got = {}
    for query, record in zip(state.query, state.ids):
        got.setdefault(int(query), []).append(int(record))
    expected = brute_force(q, v, 6, "l2")
    assert got == {i: [expected[(i, r)] for r in range(1, 7)] for i in range(4)}


def test_copies_in_later_batches_with_smaller_ids():
    v = np.tile(RNG.normal(size=(1, 5)), (1000, 1)).astype(np.float32)
    state = NearestRecords(v[:2], 4, "cosine")
    for start in range(900, -1, -100):
        state.update(np.arange(start, start + 100), v[start : start + 100])
    state.settle()
    assert state.ids.tolist() == [0, 1, 2, 3] * 2
    names = np.array([f"r{i:04d}" for i in range(1000)], dtype=object)
    state = NearestRecords(v[:1], 3, "l2")
    state.update(names[::-1], v)
    state.settle()
    assert state.ids.tolist() == ["r0000", "r0001", "r0002"]


def test_random_scales_equal_brute_force():
    for trial in range(30):
        rng = np.random.default_rng(trial)
        v = (rng.normal(size=(300, 9)) * 10.0 ** rng.integers(-3, 4) + rng.integers(0, 3) * 100).astype(np.float32)
        q = np.vstack([v[:5], rng.normal(size=(5, 9))]).astype(np.float32)
        for metric in ("l2", "ip", "cosine"):
            state = NearestRecords(q, 5, metric)
            for start in range(0, 300, 64):
                state.update(np.arange(300)[start : start + 64], v[start : start + 64])
            state.settle()
            expected = np.sort(distances(q.astype(np.float64), v.astype(np.float64), metric), axis=1)[:, :5]
            assert np.allclose(state.distance.reshape(10, 5), expected, rtol=1e-12, atol=2e-9), (trial, metric)


def test_huge_and_tiny_vectors():
    v = np.array([[1e30, 0], [-1e30, 1e30], [1e-30, 0], [0, 0]], dtype=np.float32)
    state = NearestRecords(v, 2, "l2")
    state.update(np.arange(4), v)
    got = [state.ids[state.query == i].tolist() for i in range(4)]
    assert got[0][0] == 0 and got[1][0] == 1 and got[2] == [2, 3] and got[3] == [2, 3]


def test_search_reads_only_ids_and_vectors(spark, tmp_path):
    path = str(tmp_path / "records")
    frame(spark, RNG.normal(size=(20, 4))).withColumn("document", F.lit("text")).write.parquet(path)
    records = spark.read.parquet(path)
    hits = search.knn(records, frame(spark, RNG.normal(size=(2, 4)), "query_id"), 2)
    plan = physical(hits)
    assert "ReadSchema: struct<id:bigint,embedding:array<float>>" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    text = simple(hits)
    assert text.index("Final") < text.index("Exchange") < text.index("Partial") < text.index("MapInArrow")


@pytest.fixture
def response(spark):
    records = spark.createDataFrame(
        [("a", "doc a", [0.0, 0.0]), ("b", None, [1.0, 0.0]), ("c", "doc c", [3.0, 0.0])],
        "id string, document string, embedding array<float>",
    ).withColumn("metadata", F.parse_json(F.lit('{"k":1}')))
    queries = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.1])], "query_id int, embedding array<float>")
    return search.query_response(search.knn(records, queries, 2), records, max_hits=4)


def test_long_response(response):
    rows = [(r.query_id, r["rank"], r.id, r.document) for r in response.orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, "a", "doc a"), (0, 2, "b", None), (1, 1, "c", "doc c"), (1, 2, "b", None)]
    assert "BroadcastHashJoin" in simple(response)


def test_every_query_has_a_nested_answer(spark, response):
    asked = spark.createDataFrame([(0,), (1,), (99,)], "query_id int")
    every = {r.query_id: r for r in search.query_response_nested(response, asked).collect()}
    assert [len(every[i].ids) for i in (0, 1, 99)] == [2, 2, 0] and every[99].documents == every[99].distances == []
    none = search.query_response_nested(response.limit(0), asked).collect()
    assert len(none) == 3 and all(r.ids == [] for r in none)


def test_listing_lines(spark):
    rows = spark.createDataFrame([("a", "text", '{"k":1}'), ("b", None, "{}"), ("c", "x", None)], "id string, document string, metadata string")
    rows = rows.withColumn("metadata", F.parse_json("metadata"))
    lines = {r.id: r.value for r in search.listing_lines(rows).collect()}
    assert lines == {"a": '- a\n    Content: text\n    Metadata: {"k":1}', "b": "- b", "c": "- c\n    Content: x"}
    assert {r.value for r in search.listing_lines(rows.select("id")).collect()} == {"- a", "- b", "- c"}


def test_nested_response(response):
    rows = search.query_response_nested(response).orderBy("query_id").collect()
    assert [r.ids for r in rows] == [["a", "b"], ["c", "b"]]
    assert rows[0].documents == ["doc a", None] and len(rows[1].metadatas) == 2
    assert rows[1].distances == pytest.approx([0.01, 4.01], abs=1e-6)


def test_response_columns_are_selectable(spark, response):
    assert set(response.columns) == {"query_id", "rank", "id", "document", "metadata", "distance"}


def test_display_lines(response):
    lines = [r.value for r in search.query_lines(response).orderBy("query_id", "rank").collect()]
    assert lines[0] == "  [1] (Dist: 0.0000) ID: a\n      Content: doc a"
    assert lines[1] == "  [2] (Dist: 1.0000) ID: b\n      Content: "


def test_query_texts_by_position(spark):
    frame = search.query_frame(spark, ["same", "same"])
    assert [tuple(r) for r in frame.collect()] == [(0, "same"), (1, "same")]
    with pytest.raises(ValueError):
        search.query_frame(spark, [])
