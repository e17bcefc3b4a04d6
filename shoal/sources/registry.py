"""A registry of collections that outlives the call, on a shared file system.

Every get-or-create that makes something is one commit, in the manner of
`sources.store`. Ids are made from names, so two calls that make the same
collection at once make the same id, and the first commit of an id counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shoal.operators.catalog import create_collections
from shoal.operators.upsert import first_wins
from shoal.schemas import COLLECTION
from shoal.sources.store import append_commit, read_log


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """All collections that were made; none if the registry is new."""
    numbers = {c.folder: c.number for c in read_log(spark, path).commits}
    if not numbers:
        return spark.createDataFrame([], COLLECTION)
    schema = T.StructType([*COLLECTION.fields, T.StructField("write", T.StringType())])
    reader = spark.read.schema(schema).option("basePath", f"{path}/data")
    rows = reader.parquet(*[f"{path}/data/write={w}" for w in numbers])
    order = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])[F.col("write")]
    return first_wins(rows.withColumn("commit", order), ("id",), ("commit",)).select(*COLLECTION.names)


def store_collections(requests: DataFrame, path: str) -> DataFrame:
    """Get or create the requested collections (tenant, database, name, perhaps metadata); the registry after it."""
    spark = requests.sparkSession
    known = load_registry(spark, path)
    made = create_collections(requests, known).join(known.select("id"), "id", "left_anti").select(*COLLECTION.names)
    folder = uuid.uuid4().hex
    made.write.parquet(f"{path}/data/write={folder}")
    n = spark.read.schema(COLLECTION).parquet(f"{path}/data/write={folder}").count()
    if n:
        append_commit(spark, path, folder, n)
    return load_registry(spark, path)
