from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plan import simple
from shoal.operators import catalog, lookup
from shoal.schemas import COLLECTION

UUID = "9c3a2f0e-1111-4222-8333-abcdefabcdef"


@pytest.fixture
def registry(spark):
    rows = [("1", "col1", "t", "db"), ("2", "col1", "t", "db"), ("3", "other", "t", "db"), ("4", "col1", "t", "db2")]
    return spark.createDataFrame(rows, "id string, name string, tenant string, database string")


def requests(spark, *names, tenant="t", database="db"):
    return spark.createDataFrame([(tenant, database, n) for n in names], "tenant string, database string, name string")


def found(df):
    return {r.name: r.collection_id for r in df.collect()}


@pytest.mark.parametrize("bound", [lookup.BROADCAST_ROWS, 0])
def test_name_to_id(spark, registry, monkeypatch, bound):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", bound)
    resolved = catalog.resolve_collection(requests(spark, "col1", "other", "nope"), registry)
    assert found(resolved) == {"col1": "1", "other": "3", "nope": None}


def test_unknown_name_is_an_error_on_demand(spark, registry):
    resolved = catalog.resolve_collection(requests(spark, "nope"), registry)
    with pytest.raises(Exception, match="collection 'nope' not found"):
        catalog.require_resolved(resolved).collect()


@pytest.mark.parametrize(
    "text, is_id",
    [
        (UUID, True),
        (UUID.upper(), True),
        ("urn:uuid:" + UUID, True),
        ("{" + UUID + "}", True),
        (UUID.replace("-", ""), True),
        (UUID[:-1], False),
        ("{" + UUID, False),
        ("col1", False),
    ],
)
def test_uuid_passes_through(spark, registry, text, is_id):
    expected = text if is_id else {"col1": "1"}.get(text)
    assert found(catalog.resolve_or_uuid(requests(spark, text), registry)) == {text: expected}


def test_input_stands_in_for_an_unknown_name(spark, registry):
    assert found(catalog.resolve_or_input(requests(spark, "nope", "other"), registry)) == {"nope": "nope", "other": "3"}


def test_tenant_exists(spark, registry):
    asked = spark.createDataFrame([("t",), ("zz",)], "tenant string")
    assert {r.tenant: r.exists for r in catalog.tenant_exists(asked, registry).collect()} == {"t": True, "zz": False}


def test_list_databases(spark, registry):
    databases = spark.createDataFrame([("1", "db1", "tenant"), ("2", "db2", "other")], "id string, name string, tenant string")
    assert [tuple(r) for r in catalog.list_databases(databases, "tenant").collect()] == [("1", "db1", "tenant")]
    assert {r.name for r in catalog.list_databases(registry, "t").collect()} == {"db", "db2"}


def test_list_collections(registry):
    assert [r.id for r in catalog.list_collections(registry, "t", "db2").collect()] == ["4"]
    assert catalog.list_collections(registry).count() == 0


def test_defaults(spark):
    df = spark.createDataFrame([(None,), ("t",)], "tenant string")
    got = {(r.tenant, r.database) for r in catalog.collection_defaults(df).collect()}
    assert got == {("default_tenant", "default_database"), ("t", "default_database")}


def test_get_or_create(spark):
    empty = spark.createDataFrame([], COLLECTION)
    once = catalog.create_collections(requests(spark, "a", "b", "a"), empty)
    assert sorted(r.name for r in once.collect()) == ["a", "b"]
    again = catalog.create_collections(requests(spark, "b", "c"), once)
    ids = {r.name: r.id for r in again.collect()}
    assert set(ids) == {"a", "b", "c"} and ids["b"] == {r.name: r.id for r in once.collect()}["b"]
    assert again.schema == empty.schema


def test_empty_name_is_an_error(spark, registry):
    with pytest.raises(Exception, match="collection name is empty"):
        catalog.create_collections(requests(spark, ""), registry).collect()


def test_summary_flags_mixed_width(spark):
    rows = [("c", [0.1, 0.2]), ("c", [0.3, 0.4]), ("m", [0.1]), ("m", [0.1, 0.2]), ("n", None)]
    df = spark.createDataFrame(rows, "collection_id string, embedding array<float>")
    got = {r.collection_id: (r.records, r.dimension) for r in catalog.collection_summary(df).collect()}
    assert got == {"c": (2, 2), "m": (2, None), "n": (1, None)}


def test_describe_collections(spark, registry):
    rows = spark.createDataFrame([("1", [0.1, 0.2])], "collection_id string, embedding array<float>")
    described = catalog.describe_collections(registry.withColumn("dimension", F.lit(None).cast("int")), rows)
    assert {r.id: (r.records, r.dimension) for r in described.collect()}["1"] == (1, 2)
    assert described.where("records = 0").count() == 3


@pytest.mark.parametrize("bound, way", [(lookup.BROADCAST_ROWS, "table"), (2500, "keys"), (10, "salts")])
def test_lookup_of_a_hot_key(spark, monkeypatch, bound, way):
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", bound)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = lookup.lookup_join(rows, table, ["k"])
    expected = {(r.id, 0 if r.id % 3 == 0 else r.id * 2) for r in rows.collect()}
    assert {(r.id, r.v) for r in got.collect()} == expected
    assert ("_salt" in simple(got)) == (way == "salts")
    # what the keys pick is staged and measured before it is broadcast
    assert way == "salts" or "BroadcastHashJoin" in simple(got)


def test_a_large_payload_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lookup, "BROADCAST_BYTES", 200_000)
    rows = spark.range(3000).select((F.col("id") % 500).alias("k"), "id")
    table = spark.range(3000).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("text"))
    got = lookup.lookup_join(rows, table, ["k"])
    assert "_salt" in simple(got) and got.where("length(text) = 1000").count() == 3000


def test_broadcast_bound_counts_nested_values(spark):
    nested = spark.range(10).select(F.array_repeat(F.lit("y"), 1000).alias("a"), F.parse_json(F.lit('{"k":1}')).alias("m"))
    assert lookup.fits_broadcast(nested) and not lookup.fits_broadcast(nested, size=5000)


def test_broadcast_bound_counts_text(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("name"))
    assert lookup.fits_broadcast(wide)
    assert not lookup.fits_broadcast(wide, size=5000)
    assert not lookup.fits_broadcast(wide, rows=9)
