"""The commit log and record tables: races, checkpoints, pruning, cleaning up."""

from __future__ import annotations

import json
import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plan import physical, simple
from shoal.operators.embed import HashingEmbedder
from shoal.plans import collections as jobs
from shoal.session import read_text
from shoal.sources import commit_log, store
from shoal.sources.commit_log import Commit, add_commit, find_batch, read_log, write_checkpoint

SCHEMA = "collection_id string, id string, document string"


def rows(spark, *pairs, collection="c"):
    return spark.createDataFrame([(collection, i, d) for i, d in pairs], SCHEMA)


def now(spark, path, **of):
    return {r.id: r.document for r in store.current_records(spark, path, **of).collect()}


def test_overlapping_compactions_with_a_write_between(spark, tmp_path, monkeypatch):
    """The slower compaction is refused, and every row stays readable."""
    path = str(tmp_path / "t")
    store.write_records(rows(spark, ("a", "0"), ("b", "0")), path)
    store.write_records(rows(spark, ("b", "1"), ("c", "1")), path)
    write = store._write
    inner = []

    def slow(df, folder, *buckets):
        write(df, folder, *buckets)
        if not inner:
            inner.append(None)
            store.write_records(rows(spark, ("c", "2"), ("d", "2")), path)
            inner.append(store.compact(spark, path))  # begun later, done first

    monkeypatch.setattr(store, "_write", slow)
    outer = store.compact(spark, path)
    want = {"a": "0", "b": "1", "c": "2", "d": "2"}
    assert now(spark, path) == want
    assert outer == inner[1] and outer.covers == 2 and [c.kind for c in store.commits(spark, path)] == ["base", "delta", "delta", "base"]
    store.vacuum(spark, path, older_than=0)
    assert now(spark, path) == want
    assert os.listdir(tmp_path / "t" / "data") == [f"write={outer.folder}"]


def test_compaction_moves_each_row_once(spark, tmp_path, monkeypatch):
    """Also where the keys of the later writes do not fit a broadcast; rows with a null key all stay."""
    from shoal.operators import upsert

    monkeypatch.setattr(upsert, "fits_broadcast", lambda *_: False)
    monkeypatch.setattr(store, "ROWS_PER_TASK", 5)
    path = str(tmp_path / "t")
    store.write_records(rows(spark, *[(f"i{i}", "0") for i in range(60)], (None, "0")).union(rows(spark, ("a", "0"), collection=None)), path)
    store.write_records(rows(spark, *[(f"i{i}", "1") for i in range(20)], (None, "1")).union(rows(spark, ("a", "1"), collection=None)), path)
    store.write_records(rows(spark, *[(f"i{i}", "2") for i in range(10, 30)], ("new", "2")), path)
    told = lambda: sorted(map(str, store.current_records(spark, path).select("collection_id", "id", "document").collect()))
    want = told()
    write, plans = store._write, []

    def seen(df, folder, *buckets):
        plans.append(simple(df))
        write(df, folder, *buckets)

    monkeypatch.setattr(store, "_write", seen)
    for buckets in (1, 4):
        assert store.compact(spark, path, buckets).records == 65
        assert told() == want and len(want) == 65
        store.write_records(rows(spark, ("i0", "3")), path)
        want = sorted([w for w in want if "'i0'" not in w] + ["Row(collection_id='c', id='i0', document='3')"])
    folds = [plans[0], plans[2]]
    assert all(p.count("Exchange hashpartitioning(") == 2 and p.count("REPARTITION_BY_COL") == 1 for p in folds)  # one counts
    assert not any("SortMergeJoin" in p for p in folds)


def test_compaction_leaves_readers_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    store.write_records(rows(spark, ("a", "0")), path)
    store.write_records(rows(spark, ("b", "1")), path)
    planned = store.current_records(spark, path)
    store.compact(spark, path)
    assert store.vacuum(spark, path) == []  # nothing is old enough
    assert {r.id for r in planned.collect()} == {"a", "b"}


def test_many_compactions_and_writes_at_once(spark, tmp_path):
    path = str(tmp_path / "t")

    def work(i):
        if i % 3 == 2:
            return store.compact(spark, path)
        return store.write_records(rows(spark, (f"own{i}", "x"), ("shared", str(i))), path)

    store.write_records(rows(spark, ("first", "x")), path)
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(work, range(9)))
    found = now(spark, path)
    assert set(found) == {"first", "shared", *(f"own{i}" for i in range(9) if i % 3 != 2)}
    last = max((c.number, i) for i, c in enumerate(done) if i % 3 != 2)[1]
    assert found["shared"] == str(last)


def test_two_adds_at_once_keep_the_first(spark, tmp_path):
    """Both look before either commits; the later commit gives up what the earlier one brought."""
    path = str(tmp_path / "t")
    store.write_records(rows(spark, ("old", "0")), path)
    seen = read_log(spark, path)
    first = store.insert_records(rows(spark, ("x", "first"), ("y", "first")), path, seen)
    second = store.insert_records(rows(spark, ("y", "second"), ("z", "second")), path, seen)
    assert (first.records, second.records) == (2, 1)
    assert now(spark, path) == {"old": "0", "x": "first", "y": "first", "z": "second"}
    third = store.insert_records(rows(spark, ("x", "third")), path, seen)
    assert third is None and now(spark, path)["x"] == "first"
    assert len(os.listdir(tmp_path / "t" / "data")) == 3  # what was given up is not left behind


def test_an_add_sees_what_a_base_holds_by_now(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(commit_log, "CHECKPOINT_EVERY", 3)
    store.write_records(rows(spark, ("old", "0")), path)
    seen = read_log(spark, path)
    for i in range(3):
        store.write_records(rows(spark, (f"n{i}", "theirs")), path)
    store.compact(spark, path)
    for i in range(3):
        store.write_records(rows(spark, (f"m{i}", "theirs")), path)
    assert read_log(spark, path).after > seen.last
    mine = store.insert_records(rows(spark, ("n1", "mine"), ("m1", "mine"), ("new", "mine")), path, seen)
    assert mine.records == 1
    found = now(spark, path)
    assert found["n1"] == found["m1"] == "theirs" and found["new"] == "mine" and len(found) == 8


def test_adds_from_threads(spark, tmp_path):
    path, embedder = str(tmp_path / "t"), HashingEmbedder(8)

    def add(i):
        return jobs.add_to_log(spark, path, [f"own {i}", f"shared {i}"], "c", embedder, ids=[f"own{i}", "shared"])

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(add, range(4)))
    assert sum(d.records for d in done) == 5
    found = now(spark, path)
    first = min(range(4), key=lambda i: done[i].commit)
    assert len(found) == 5 and found["shared"] == f"shared {first}"
    assert len(store.commits(spark, path)) == 4


def fake_log(path, n):
    """A log of n commits as files only."""
    os.makedirs(path / "log")
    for i in range(n):
        entry = Commit(i, "delta" if i else "base", "stream", i, f"f{i}", 1, -1 if i else 0)._asdict()
        del entry["number"]
        (path / "log" / f"{i:012d}.json").write_text(json.dumps(entry))


def test_a_long_log_is_opened_from_its_checkpoint(spark, tmp_path, monkeypatch):
    fake_log(tmp_path, 10_000)
    path = str(tmp_path)
    write_checkpoint(spark, path)
    opened = []
    monkeypatch.setattr(commit_log, "read_text", lambda s, p: opened.append(p) or read_text(s, p))
    began = time.time()
    log = read_log(spark, path)
    assert len(log.commits) == 10_000 and log.commits[77] == Commit(77, "delta", "stream", 77, "f77", 1)
    assert not opened and time.time() - began < 20
    monkeypatch.setattr(commit_log, "CHECKPOINT_EVERY", 10)
    for i in range(15):
        add_commit(spark, path, Commit(-1, "delta", "other", i, "g", 1))
    opened.clear()
    log = read_log(spark, path)
    assert len(log.commits) == 10_015 and log.last == 10_014 and log.after == 10_009 and len(opened) == 5
    # a base makes the rest of the checkpoint dead, but a batch that runs again is still known
    add_commit(spark, path, Commit(-1, "base", "b", 0, "base", 1, covers=log.last))
    write_checkpoint(spark, path)
    log = read_log(spark, path)
    assert [c.kind for c in log.commits] == ["base"] and log.deltas == []
    assert find_batch(spark, log, "stream", 77).number == 77 and find_batch(spark, log, "stream", 10_077) is None
    assert add_commit(spark, path, Commit(-1, "delta", "stream", 77, "again", 1)).number == 77
    assert len(store.commits(spark, path)) == 10_016


def test_vacuum_of_a_checkpointed_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commit_log, "CHECKPOINT_EVERY", 4)
    path = str(tmp_path / "t")
    for i in range(9):
        store.write_records(rows(spark, (f"r{i}", "x")), path, "w", i)
    store.compact(spark, path)
    before, numbers = now(spark, path), [c.number for c in store.commits(spark, path)]
    gone = store.vacuum(spark, path, older_than=0)
    assert any(g.startswith("data/") for g in gone) and any(g.endswith(".json") for g in gone)
    assert now(spark, path) == before and [c.number for c in store.commits(spark, path)] == numbers
    assert store.write_records(rows(spark, ("r1", "again")), path, "w", 1).number == 1
    assert store.write_records(rows(spark, ("r9", "x")), path, "w", 9).number == 10
    assert len(now(spark, path)) == 10


def test_a_number_given_up_does_not_block(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store.write_records(rows(spark, ("a", "0")), path)
    (tmp_path / "t" / "log" / f"{1:012d}.json").write_text("")
    assert read_log(spark, path).open == [1] and read_log(spark, path).settled == 0
    monkeypatch.setattr(commit_log, "ABANDONED", 0.5)
    assert store.write_records(rows(spark, ("b", "1")), path).number == 2
    assert store.compact(spark, path).covers == 2 and now(spark, path) == {"a": "0", "b": "1"}


def scanned_files(df):
    """Files that a plan of one scan reads."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


def test_few_ids_read_their_buckets_only(spark, tmp_path):
    path = str(tmp_path / "t")
    many = spark.range(5000).select(F.lit("c").alias("collection_id"), F.col("id").cast("string").alias("id"), F.lit("x").alias("document"))
    store.write_records(many, path, buckets=256)
    store.write_records(rows(spark, ("7", "changed"), ("new", "y")), path)
    log = read_log(spark, path)
    ids = [(str(i),) for i in range(0, 5000, 50)]
    keys = spark.createDataFrame(ids, "id string").withColumn("collection_id", F.lit("c"))
    touched = {r[0] for r in keys.select(store.bucket_of(256)).distinct().collect()}
    assert 60 < len(touched) < 100
    assert scanned_files(store._folders(spark, path, [log.base], touched)) == len(touched)
    assert scanned_files(store._folders(spark, path, [log.base])) == 256
    found = store.records_with_keys(spark, path, keys.union(spark.createDataFrame([("7", "c"), ("new", "c"), ("no", "c")], "id string, collection_id string")))
    got = {r.id: r.document for r in found.collect()}
    assert len(got) == 102 and got["7"] == "changed" and got["new"] == "y" and got["50"] == "x"
    # tables of several bucket counts prune each by its own
    store.compact(spark, path, buckets=16)
    store.write_records(rows(spark, ("8", "late")), path, buckets=4)
    some = store.records_with_keys(spark, path, spark.createDataFrame([("8", "c"), ("7", "c")], "id string, collection_id string"))
    assert {r.id: r.document for r in some.collect()} == {"8": "late", "7": "changed"}
    plan = physical(store._folders(spark, path, [read_log(spark, path).base], {3}))
    assert "bucket" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_buckets_follow_the_size(spark, tmp_path, monkeypatch):
    assert [store.buckets_for(n) for n in (0, 1, 250_000, 250_001, 10**6, 10**12)] == [1, 1, 1, 2, 4, 4096]
    monkeypatch.setattr(store, "ROWS_PER_BUCKET", 10)
    path = str(tmp_path / "t")
    many = spark.range(100).select(F.lit("c").alias("collection_id"), F.col("id").cast("string").alias("id"))
    store.write_records(many, path)
    store.write_records(many.limit(3), path)
    assert store.compact(spark, path).buckets == 16 and store.current_records(spark, path).count() == 100


def test_vectors_of_another_width(spark, tmp_path):
    path = str(tmp_path / "t")
    vectors = spark.createDataFrame([("c", "a", [1.0, 2.0]), ("c", "b", None)], "collection_id string, id string, embedding array<float>")
    store.write_records(vectors, path, width=2)
    assert store.collection_width(spark, path, "c") == 2 and store.collection_width(spark, path, "d") is None
    with pytest.raises(Exception, match="record 'a' has a vector of another width than 3"):
        store.write_records(vectors, path, width=3)
    assert len(store.commits(spark, path)) == 1
    with pytest.raises(ValueError, match="width 2, not 8"):
        jobs.add_to_log(spark, path, ["x"], "c", HashingEmbedder(8))
    assert jobs.add_to_log(spark, path, ["x"], "d", HashingEmbedder(8)).records == 1
