"""Adding and replacing records by id."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shoal.functions.ids import generated_id, hash_id
from shoal.operators.lookup import fits_broadcast
from shoal.operators.ordering import with_position

RECORD_KEYS = ("collection_id", "id")


def _one_per_key(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    # The row_number = 1 filter makes Spark keep one row per key in every task
    # before the shuffle, so a key that holds most rows sends one row per task.
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_n") == 1).drop("_n")


def last_wins(df: DataFrame, keys: Sequence[str] = RECORD_KEYS, order: Sequence[str] = ("position",)) -> DataFrame:
    """One row per key: the last in `order`."""
    return _one_per_key(df, keys, [F.col(c).desc() for c in order])


def first_wins(df: DataFrame, keys: Sequence[str] = RECORD_KEYS, order: Sequence[str] = ("position",)) -> DataFrame:
    """One row per key: the first in `order`."""
    return _one_per_key(df, keys, [F.col(c).asc() for c in order])


def unmatched(rows: DataFrame, others: DataFrame, keys: Sequence[str] = RECORD_KEYS) -> DataFrame:
    """Rows whose key does not occur in `others`; only the keys of `others` travel.

    Keys of `others` within the bound are broadcast, so that `rows` stay where
    they are. If instead the keys of `rows` are within it, they first pick
    their matches out of `others`, which then stays where it is.
    """
    keys = list(keys)
    found = others.select(*keys)
    if fits_broadcast(found):
        found = F.broadcast(found)
    elif fits_broadcast(rows.select(*keys)):
        found = found.join(F.broadcast(rows.select(*keys)), keys, "left_semi")
    else:
        # a key that others repeat must not travel more than once per task
        found = found.distinct()
    return rows.join(found, keys, "left_anti").select(*rows.columns)


def upsert(
    current: DataFrame,
    batch: DataFrame,
    keys: Sequence[str] = RECORD_KEYS,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """`current` with the rows of `batch` put in by key; the last of a repeated key wins.

    Without `order` the batch must already hold each key once.
    """
    if order:
        batch = last_wins(batch, keys, order)
    batch = batch.select(*current.columns)
    return unmatched(current, batch, keys).unionByName(batch)


def insert_if_absent(
    current: DataFrame,
    batch: DataFrame,
    keys: Sequence[str] = RECORD_KEYS,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """`current` plus the rows of `batch` whose key is new; existing rows stay."""
    if order:
        batch = first_wins(batch, keys, order)
    batch = batch.select(*current.columns)
    return current.unionByName(unmatched(batch, current, keys))


def content_dedupe(df: DataFrame, text_col: str = "document", order: Sequence[str] = ("position",)) -> DataFrame:
    """Id from the content hash, and one record per content: the last in `order`."""
    return last_wins(df.withColumn("id", hash_id(F.col(text_col))), ("id",), order)


def with_generated_ids(
    df: DataFrame,
    run_ns: int | None = None,
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """Fill `id` with ``id-<nanoseconds>-<index>`` where none is given.

    With `order_by` the index is the dense 0-based position in that order.
    Without it the index is only unique, which needs no shuffle.
    """
    run_ns = time.time_ns() if run_ns is None else run_ns
    if order_by:
        positioned = with_position(df, order_by, "_position")
        fresh = generated_id(run_ns, F.col("_position") - 1)
    else:
        positioned = df
        fresh = generated_id(run_ns, F.monotonically_increasing_id())
    given = F.col("id") if "id" in df.columns else F.lit(None).cast("string")
    return positioned.withColumn("id", F.coalesce(given, fresh)).drop("_position")


def zip_batch(df: DataFrame, **arrays: str) -> DataFrame:
    """Pair parallel array columns by position into rows.

    ``zip_batch(df, id="ids", document="documents")`` yields one row per
    element, next to the other columns of `df`.
    """
    sources = set(arrays.values())
    others = [c for c in df.columns if c not in sources]
    zipped = F.arrays_zip(*[F.col(src).alias(name) for name, src in arrays.items()])
    return df.select(*others, F.inline(zipped).alias(*arrays))
