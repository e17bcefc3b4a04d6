"""Queries over the registry of tenants, databases and collections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoal.functions.ids import collection_uuid, is_uuid
from shoal.operators.lookup import lookup_join
from shoal.schemas import COLLECTION, DEFAULT_DATABASE, DEFAULT_TENANT

SCOPE = ("tenant", "database")


def collection_defaults(df: DataFrame, tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE) -> DataFrame:
    """Fill the tenant and database of requests that give none."""
    return df.withColumns({
        "tenant": F.coalesce(_column_or_null(df, "tenant"), F.lit(tenant)),
        "database": F.coalesce(_column_or_null(df, "database"), F.lit(database)),
    })


def _column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def tenant_exists(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """The requested tenants with `exists`."""
    known = registry.select("tenant").distinct().withColumn("_known", F.lit(True))
    return lookup_join(requested, known, ["tenant"]).select(
        *requested.columns, F.col("_known").isNotNull().alias("exists")
    )


def list_databases(databases: DataFrame, tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Databases of one tenant; also works on a registry of collections."""
    owned = databases.where(F.col("tenant") == tenant)
    if "database" in databases.columns:
        owned = owned.select(F.col("database").alias("id"), F.col("database").alias("name"), "tenant")
    return owned.select("id", "name", "tenant").distinct()


def list_collections(
    registry: DataFrame, tenant: str = DEFAULT_TENANT, database: str = DEFAULT_DATABASE
) -> DataFrame:
    """Collections of one tenant and database."""
    return registry.where((F.col("tenant") == tenant) & (F.col("database") == database))


def first_by_name(registry: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """One collection per full name, the first in list order."""
    window = Window.partitionBy(*SCOPE, "name").orderBy(*order)
    return registry.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def resolve_collection(requests: DataFrame, registry: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """Add `collection_id` for each requested (tenant, database, name); NULL if unknown."""
    known = first_by_name(registry, order).select(*SCOPE, "name", F.col("id").alias("collection_id"))
    return lookup_join(requests, known, [*SCOPE, "name"])


def require_resolved(resolved: DataFrame) -> DataFrame:
    """Fail the job if a name was not found."""
    missing = F.concat(F.lit("collection '"), F.col("name"), F.lit("' not found"))
    checked = F.when(F.col("collection_id").isNull(), F.raise_error(missing)).otherwise(F.col("collection_id"))
    return resolved.withColumn("collection_id", checked)


def resolve_or_uuid(requests: DataFrame, registry: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """A UUID is taken as the id without a lookup; any other text is looked up by name."""
    resolved = resolve_collection(requests, registry, order)
    chosen = F.when(is_uuid(F.col("name")), F.col("name")).otherwise(F.col("collection_id"))
    return resolved.withColumn("collection_id", chosen)


def resolve_or_input(requests: DataFrame, registry: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """The id found by name, else the input itself."""
    resolved = resolve_collection(requests, registry, order)
    return resolved.withColumn("collection_id", F.coalesce("collection_id", "name"))


def _named(requests: DataFrame) -> DataFrame:
    named = F.when(
        F.coalesce(F.col("name"), F.lit("")) == "", F.raise_error(F.lit("collection name is empty"))
    ).otherwise(F.col("name"))
    requests = requests.withColumn("name", named)
    if "metadata" not in requests.columns:
        return requests.select(*SCOPE, "name").distinct()
    # a name that is asked for twice takes the metadata whose text is smallest
    text = F.min(F.col("metadata").cast("string"))
    return requests.groupBy(*SCOPE, "name").agg(F.try_parse_json(text).alias("metadata"))


def create_collections(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry after get-or-create of every requested name, with the metadata asked for, if any."""
    missing = _named(requests).join(registry.select(*SCOPE, "name"), [*SCOPE, "name"], "left_anti")
    given = {
        "id": collection_uuid(F.col("tenant"), F.col("database"), F.col("name")),
        **{c: F.col(c) for c in ("name", *SCOPE, *({"metadata"} & set(missing.columns)))},
    }
    columns = [
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in COLLECTION.fields
        if f.name in registry.columns
    ]
    return registry.unionByName(missing.select(*columns))


def record_count(records: DataFrame, *keys: str) -> DataFrame:
    """Number of records, per key if keys are given."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))


def collection_summary(records: DataFrame, key: str = "collection_id") -> DataFrame:
    """Records and vector width per collection; `dimension` is NULL where widths differ."""
    width = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    summary = records.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        F.min(width).alias("min_dimension"),
        F.max(width).alias("max_dimension"),
    )
    same = F.col("min_dimension") == F.col("max_dimension")
    return summary.withColumn("dimension", F.when(same, F.col("min_dimension")))


def describe_collections(registry: DataFrame, records: DataFrame) -> DataFrame:
    """Registry rows with the record count and dimension their records show."""
    summary = collection_summary(records).select(
        F.col("collection_id").alias("id"), "records", F.col("dimension").alias("_dimension")
    )
    return (
        registry.join(summary, "id", "left")
        .withColumn("records", F.coalesce("records", F.lit(0)))
        .withColumn("dimension", F.coalesce("_dimension", "dimension"))
        .drop("_dimension")
    )
