"""Vectors kept by the content they were made of, so that no text is embedded twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shoal.operators.embed import Embedder, embed_documents, require_embedder
from shoal.operators.lookup import lookup_join
from shoal.operators.upsert import unmatched
from shoal.session import stage
from shoal.sources.store import insert_records, read_log, records_with_keys


def embed_cached(
    df: DataFrame,
    embedder: Embedder | None,
    cache_path: str,
    model: str,
    *,
    text_col: str = "document",
    out_col: str = "embedding",
) -> DataFrame:
    """Add one vector per text, looked up in a stored table of vectors by content hash.

    Texts that the table of `model` lacks are embedded once each, however many
    rows hold them, and added to it; only the buckets of the asked hashes are read.
    Two jobs that add the same text at once leave one vector of it. A null text
    has a null vector. What is held by most rows is salted on its way to them.
    """
    embedder = require_embedder(embedder)
    spark = df.sparkSession
    keyed = df.withColumn("_content", F.sha2(F.col(text_col).cast("binary"), 256))
    asked = keyed.where(F.col("_content").isNotNull()).groupBy(F.col("_content").alias("id")).agg(F.any_value(text_col).alias("document"))
    asked = stage(asked.select(F.lit(model).alias("collection_id"), "id", "document"), "contents")
    seen = read_log(spark, cache_path)
    fresh = unmatched(asked, records_with_keys(spark, cache_path, asked, seen))
    insert_records(embed_documents(fresh, embedder).drop("document"), cache_path, seen, width=embedder.dim)
    held = records_with_keys(spark, cache_path, asked).select(F.col("id").alias("_content"), F.col("embedding").alias(out_col))
    return lookup_join(keyed.drop(out_col), stage(held, "vectors"), ["_content"]).select(*df.drop(out_col).columns, out_col)
