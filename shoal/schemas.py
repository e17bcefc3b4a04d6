"""Table schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

DEFAULT_TENANT = "default_tenant"
DEFAULT_DATABASE = "default_database"

DATABASE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("tenant", T.StringType()),
])

COLLECTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("tenant", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("metadata", T.VariantType()),
    T.StructField("dimension", T.IntegerType()),
    T.StructField("configuration_json", T.VariantType()),
])

RECORD = T.StructType([
    T.StructField("collection_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("document", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("metadata", T.VariantType()),
])

# A log row is a record plus what orders it among all writes.
LOG_ORDER = ("commit", "file_path", "file_block_start", "line_seq")
LOG_RECORD = T.StructType([
    *RECORD.fields,
    T.StructField("file_path", T.StringType()),
    T.StructField("file_block_start", T.LongType()),
    T.StructField("line_seq", T.LongType()),
    T.StructField("commit", T.LongType()),
])
