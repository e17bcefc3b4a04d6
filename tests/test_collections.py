"""Whole jobs: import, stream, add, query, list, and the log they share."""

from __future__ import annotations

import json
import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plan import physical, simple
from shoal.operators import ingest
from shoal.operators.catalog import create_collections
from shoal.operators.embed import HashingEmbedder
from shoal.plans import collections as jobs
from shoal.schemas import COLLECTION, RECORD
from shoal.sources import sinks, store
from shoal.sources.registry import load_registry, store_collections
from shoal.sources.jsonl import read_jsonl
from shoal.operators.ingest import import_records
from shoal.streaming.importer import stream_import

EMBEDDER = HashingEmbedder(32)
SCOPE = ("default_tenant", "default_database")


@pytest.fixture
def registry(spark):
    asked = spark.createDataFrame([(*SCOPE, "animals"), (*SCOPE, "empty")], "tenant string, database string, name string")
    return create_collections(asked, spark.createDataFrame([], COLLECTION)).persist()


def write_lines(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n")


ANIMALS = [
    {"id": "1", "text": "the quick brown fox", "kind": "fox"},
    "bad{",
    {"id": "2", "text": "a lazy dog sleeps", "kind": "dog"},
    {"id": "3", "text": "fox and dog", "kind": None},
    {"id": "1", "text": "the quick red fox", "kind": "fox"},
]


def contents(df):
    return {r.id: (r.document, r.m) for r in df.withColumn("m", F.col("metadata").cast("string")).collect()}


EXPECTED = {
    "1": ("the quick red fox", '{"kind":"fox"}'),
    "2": ("a lazy dog sleeps", '{"kind":"dog"}'),
    "3": ("fox and dog", '{"kind":null}'),
}


def test_import_query_list(spark, registry, tmp_path):
    write_lines(tmp_path / "in" / "a.jsonl", *ANIMALS)
    log = str(tmp_path / "log")
    source = str(tmp_path / "in")
    rejects = str(tmp_path / "rejects")
    done = jobs.import_jsonl(spark, registry, "animals", source, log, EMBEDDER, rejects_path=rejects, all_metadata=True)
    assert done == (0, 4)
    assert [(r.value, r.reason) for r in spark.read.json(rejects).collect()] == [("bad{", "malformed")]
    assert contents(jobs.list_collection(spark, registry, "animals", log)) == EXPECTED
    # The same import again changes nothing.
    assert jobs.import_jsonl(spark, registry, "animals", source, log, EMBEDDER, all_metadata=True).commit == 1
    assert contents(jobs.list_collection(spark, registry, "animals", log)) == EXPECTED

    records = store.current_records(spark, log)
    answer = jobs.query_collection(registry, records, "animals", ["quick fox", "dog", "dog"], EMBEDDER, 2)
    top = {(r.query_id, r["rank"]): r.id for r in answer.collect()}
    assert top[(0, 1)] == "1" and top[(1, 1)] == top[(2, 1)] and len(top) == 6
    assert jobs.query_collection(registry, records, "empty", ["dog"], EMBEDDER).count() == 0

    out = str(tmp_path / "answer")
    sinks.write_query_text(answer, out)
    assert "[1] (Dist: " in "".join(r.value for r in spark.read.text(out).collect())
    sinks.write_query_json(answer.drop("metadata"), out)
    assert spark.read.json(out).count() == 6

    found = store.read_log(spark, log)
    assert found.base.number == 0 and [c.number for c in found.deltas] == [1]
    assert store.compact(spark, log).covers == 1 and store.read_log(spark, log).deltas == []
    assert contents(jobs.list_collection(spark, registry, "animals", log)) == EXPECTED
    write_lines(tmp_path / "more" / "a.jsonl", {"id": "2", "text": "the dog barks"}, {"id": "4", "text": "cat"})
    assert jobs.import_jsonl(spark, registry, "animals", str(tmp_path / "more"), log, EMBEDDER) == (3, 2)
    after = EXPECTED | {"2": ("the dog barks", "{}"), "4": ("cat", "{}")}
    assert contents(jobs.list_collection(spark, registry, "animals", log)) == after
    plan = simple(store.current_records(spark, log))
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan
    done = store.compact(spark, log)
    assert (done.number, done.covers) == (4, 3) and store.compact(spark, log) == done
    assert contents(jobs.list_collection(spark, registry, "animals", log)) == after


def test_unfinished_writes_are_not_read(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("c", "a", "x")], "collection_id string, id string, document string")
    store.write_records(rows, log)
    other = store.write_records(rows.withColumn("document", F.lit("half")), str(tmp_path / "other"))
    shutil.copytree(tmp_path / "other" / "data" / f"write={other.folder}", tmp_path / "log" / "data" / f"write={other.folder}")
    (tmp_path / "log" / "log" / "000000000001.json").write_text("")  # claimed, not yet written
    assert [r.document for r in store.current_records(spark, log).collect()] == ["x"]


def test_listing_prunes_collections_and_columns(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.range(100).select(
        F.concat(F.lit("c"), F.col("id") % 3).alias("collection_id"),
        F.col("id").cast("string").alias("id"),
        F.lit("text").alias("document"),
    )
    store.write_records(rows, log)
    listed = store.list_records(store.current_records(spark, log, "c1"), "c1")
    plan = physical(listed)
    assert "collection_id" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "embedding" not in plan.split("ReadSchema")[1].split("\n")[0]
    assert listed.count() == 33


def test_a_batch_counts_once(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("c", "a", "x")], "collection_id string, id string, document string")
    first = store.write_records(rows, log, "stream", 4)
    assert store.write_records(rows.withColumn("document", F.lit("again")), log, "stream", 4) == first
    store.compact(spark, log)
    assert store.write_records(rows.withColumn("document", F.lit("again")), log, "stream", 4) == first
    assert [r.document for r in store.current_records(spark, log).collect()] == ["x"]


def test_two_writers_at_once_both_count(spark, tmp_path):
    log = str(tmp_path / "log")
    schema = "collection_id string, id string, document string"

    def write(i):
        rows = spark.createDataFrame([("c", f"own{i}", "x"), ("c", "shared", str(i))], schema)
        return store.write_records(rows, log).number

    with ThreadPoolExecutor(4) as pool:
        numbers = list(pool.map(write, range(4)))
    assert sorted(numbers) == [0, 1, 2, 3]
    now = {r.id: r.document for r in store.current_records(spark, log).collect()}
    assert set(now) == {"shared", *(f"own{i}" for i in range(4))} and now["shared"] == str(numbers.index(3))


def test_a_write_during_compaction_stays(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    schema = "collection_id string, id string, document string"
    for i in range(2):
        store.write_records(spark.createDataFrame([("c", f"r{i}", "x")], schema), log)
    write = store._write

    def interrupted(rows, path, *buckets):
        write(rows, path, *buckets)
        monkeypatch.setattr(store, "_write", write)
        store.write_records(spark.createDataFrame([("c", "late", "x")], schema), log)

    monkeypatch.setattr(store, "_write", interrupted)
    store.compact(spark, log)
    assert {r.id for r in store.current_records(spark, log).collect()} == {"r0", "r1", "late"}
    store.compact(spark, log)
    assert {r.id for r in store.current_records(spark, log).collect()} == {"r0", "r1", "late"}


def test_a_fresh_import_is_scanned_in_place(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = spark.createDataFrame([("c", "a", "old", 0), ("c", "a", "new", 1)], "collection_id string, id string, document string, line_seq long")
    store.write_records(rows, log)
    plan = simple(store.current_records(spark, log))
    assert "Exchange" not in plan and "Window" not in plan
    assert [r.document for r in store.current_records(spark, log).collect()] == ["new"]


def test_registry_outlives_the_call(spark, tmp_path):
    path = str(tmp_path / "registry")
    schema = "tenant string, database string, name string, metadata string"
    asked = spark.createDataFrame([(*SCOPE, "a", '{"k":1}'), (*SCOPE, "b", None)], schema)
    asked = asked.withColumn("metadata", F.parse_json("metadata"))
    assert load_registry(spark, path).count() == 0
    first = {r.name: (r.id, r.m) for r in store_collections(asked, path).select("name", "id", F.col("metadata").cast("string").alias("m")).collect()}
    assert first["a"][1] == '{"k":1}' and first["b"][1] is None
    more = store_collections(asked.drop("metadata").unionByName(spark.createDataFrame([(*SCOPE, "c")], "tenant string, database string, name string")), path)
    again = {r.name: r.id for r in load_registry(spark, path).collect()}
    assert again == {"a": first["a"][0], "b": first["b"][0], "c": again["c"]} and more.count() == 3
    assert len(store.commits(spark, path)) == 2
    store_collections(asked, path)
    assert len(store.commits(spark, path)) == 2


def test_stream_into_a_named_collection(spark, registry, tmp_path):
    write_lines(tmp_path / "in" / "a.jsonl", {"id": "1", "text": "x"})
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    jobs.stream_jsonl_into(spark, registry, "animals", str(tmp_path / "in"), log, state, EMBEDDER).awaitTermination()
    assert contents(jobs.list_collection(spark, registry, "animals", log)) == {"1": ("x", "{}")}
    with pytest.raises(Exception, match="collection 'nope' not found"):
        jobs.stream_jsonl_into(spark, registry, "nope", str(tmp_path / "in"), log, state, EMBEDDER)


def test_add_to_log_writes_only_new_rows(spark, tmp_path):
    log = str(tmp_path / "log")
    assert jobs.add_to_log(spark, log, ["a", "b"], "c", EMBEDDER, ids=["1", "2"]).records == 2
    assert jobs.add_to_log(spark, log, ["other", "d"], "c", EMBEDDER, ids=["2", "3"]).records == 1
    now = {r.id: r.document for r in store.current_records(spark, log, "c").collect()}
    assert now == {"1": "a", "2": "b", "3": "d"}


def test_an_import_parses_its_source_once(spark, registry, tmp_path, monkeypatch):
    """With rejects, both outputs are read from one staged pass."""
    write_lines(tmp_path / "in" / "a.jsonl", *ANIMALS, {"id": "n"}, "")
    passes = []
    split = ingest.split_lines

    def seen(lines, **options):
        records, rejected = split(lines, **options)
        passes.append([physical(df) for df in (records, rejected)])
        return records, rejected

    monkeypatch.setattr(jobs, "split_lines", seen)
    log, rejects = str(tmp_path / "log"), str(tmp_path / "rejects")
    done = jobs.import_jsonl(spark, registry, "animals", str(tmp_path / "in"), log, EMBEDDER, rejects_path=rejects, all_metadata=True)
    assert done.records == 4 and contents(jobs.list_collection(spark, registry, "animals", log)) == EXPECTED
    found = sorted((r.reason, r.value) for r in spark.read.json(rejects).collect())
    assert found == [("malformed", ""), ("malformed", "bad{"), ("no_content", '{"id": "n"}')]
    assert len(passes) == 1 and all("Scan text" not in plan and "parse_json" not in plan for plan in passes[0])
    limited = jobs.import_jsonl(spark, registry, "animals", str(tmp_path / "in"), str(tmp_path / "log2"), EMBEDDER, rejects_path=rejects, n_ingest=2)
    assert limited.records == 2


def test_import_in_batches_goes_on_where_it_stopped(spark, registry, tmp_path):
    """Batches before a failing one stay; the same call later takes only the rest."""
    for name in "abc":
        write_lines(tmp_path / "in" / f"{name}.jsonl", {"id": name, "text": f"text {name}"}, {"id": "same", "text": f"from {name}"})
    log, source = str(tmp_path / "log"), str(tmp_path / "in")

    class Fails(HashingEmbedder):
        def embed(self, texts):
            if any("text c" in t for t in texts):
                raise ValueError("no vector for c")
            return super().embed(texts)

    with pytest.raises(Exception, match="failed to embed record 'c'"):
        jobs.import_in_batches(spark, registry, "animals", source, log, Fails(32), "monday", batch_bytes=80)
    assert {r.id: r.document for r in store.current_records(spark, log).collect()} == {"a": "text a", "b": "text b", "same": "from b"}
    done = jobs.import_in_batches(spark, registry, "animals", source, log, EMBEDDER, "monday", batch_bytes=80)
    assert [d.commit for d in done] == [0, 1, 2] and len(store.commits(spark, log)) == 3
    assert {r.id: r.document for r in store.current_records(spark, log).collect()}["same"] == "from c"
    together = jobs.import_in_batches(spark, registry, "animals", source, str(tmp_path / "one"), EMBEDDER, "x")
    assert [d.records for d in together] == [6]


def test_pages_ids_and_columns_of_a_stored_collection(spark, registry, tmp_path):
    write_lines(tmp_path / "in" / "a.jsonl", *[{"id": f"r{i}", "text": f"t{i}", "k": i} for i in range(9)])
    log = str(tmp_path / "log")
    jobs.import_jsonl(spark, registry, "animals", str(tmp_path / "in"), log, EMBEDDER, all_metadata=True)
    def asked(**options):
        return jobs.list_collection(spark, registry, "animals", log, **options)

    assert [r.id for r in asked(limit=3, offset=2).collect()] == ["r2", "r3", "r4"]
    assert sorted(r.id for r in asked(ids=["r8", "r1", "nope"]).collect()) == ["r1", "r8"]
    assert [r.id for r in asked(ids=["r8", "r1"], limit=1).collect()] == ["r1"]
    assert asked(include=("document",)).columns == ["id", "document"] and asked(include=()).columns == ["id"]
    assert asked(include=("embedding",)).first().embedding is not None
    answer = jobs.query_collection(registry, store.current_records(spark, log), "animals", ["t3"], EMBEDDER, 2, include=("metadata",))
    assert answer.columns == ["query_id", "rank", "id", "metadata", "distance"] and answer.count() == 2


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    write_lines(source / "a.jsonl", *ANIMALS)
    write_lines(source / "b.jsonl", {"text": "no id here"}, {"id": "9", "text": "nine", "kind": 9})
    log, state = str(tmp_path / "log"), str(tmp_path / "state")

    def run():
        query = stream_import(
            spark, str(source), log, state, "animals", embedder=EMBEDDER, all_metadata=True, max_files_per_trigger=1,
            rejects_path=str(tmp_path / "rejects"),
        )
        query.awaitTermination()

    run()
    batch = str(tmp_path / "batch")
    imported = import_records(read_jsonl(spark, str(source)), all_metadata=True)
    store.write_records(imported.withColumn("collection_id", F.lit("animals")), batch)
    streamed = contents(store.current_records(spark, log, "animals"))
    assert streamed == contents(store.current_records(spark, batch, "animals")) and len(streamed) == 5
    assert len(store.commits(spark, log)) == 2
    run()
    assert len(store.commits(spark, log)) == 2
    write_lines(source / "c.jsonl", {"id": "2", "text": "a dog woke up"})
    run()
    assert len(store.commits(spark, log)) == 3
    assert spark.read.json(str(tmp_path / "rejects")).count() == 1
    now = store.current_records(spark, log, "animals")
    assert contents(now)["2"] == ("a dog woke up", "{}")
    assert now.where("embedding is null").count() == 0


def test_stream_has_no_limit(spark, tmp_path):
    with pytest.raises(ValueError):
        stream_import(spark, str(tmp_path), "log", "state", "c", n_ingest=5)


def test_add_documents(spark):
    empty = spark.createDataFrame([], RECORD)
    once = jobs.add_documents(empty, ["doc1", "doc2"], "c", EMBEDDER, ids=["id1", "id2"])
    assert {(r.id, r.document) for r in once.collect()} == {("id1", "doc1"), ("id2", "doc2")}
    again = jobs.add_documents(once, ["other", "doc3", "doc4"], "c", EMBEDDER, ids=["id1", "id3", "id3"])
    assert {r.id: r.document for r in again.collect()} == {"id1": "doc1", "id2": "doc2", "id3": "doc3"}
    made = jobs.add_documents(empty, ["x", "x"], "c", EMBEDDER).collect()
    assert len({r.id for r in made}) == 2 and all(r.id.startswith("id-") for r in made)
    table = spark.createDataFrame([("t1",), ("t2",)], "document string")
    assert jobs.add_documents(once, table, "c", EMBEDDER).count() == 4


def test_add_needs_documents_and_an_embedder(spark):
    empty = spark.createDataFrame([], RECORD)
    with pytest.raises(ValueError, match="no documents"):
        jobs.add_documents(empty, [], "c", EMBEDDER)
    with pytest.raises(ValueError, match="not initialized"):
        jobs.add_documents(empty, ["x"], "c", None)


def test_unknown_collection(spark, registry, tmp_path):
    with pytest.raises(Exception, match="collection 'nope' not found"):
        jobs.import_jsonl(spark, registry, "nope", str(tmp_path), str(tmp_path / "log"), EMBEDDER)
    with pytest.raises(ValueError, match="required"):
        jobs.collection_id(registry, "")
    assert jobs.collection_id(registry, "nope", or_input=True) == "nope"
