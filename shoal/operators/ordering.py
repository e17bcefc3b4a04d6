"""Row positions, limits, pages and batches in a given total order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from shoal.session import stage

# Up to this many keys the key of a rank is found by a bounded heap of keys in
# every task. Beyond it keys alone are range-partitioned and counted.
HEAP_KEYS = 10_000

# monotonically_increasing_id keeps the row number of a task in its low bits.
ROW_BITS = 33


def with_position(df: DataFrame, order_by: Sequence[str], name: str = "position") -> DataFrame:
    """Add a dense 1-based position in the order of `order_by`, a unique key.

    A window without partition keys would pull every row into one task.
    Instead the rows are range-partitioned and sorted, staged with their slot
    (task, row in task), and each task's rows are shifted by the number of rows
    in the tasks before it. Only one row per task is ever summed in one place.
    """
    slot = F.monotonically_increasing_id()
    slotted = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_slot", slot)
        .withColumn("_part", F.shiftright("_slot", ROW_BITS).cast("int"))
        .withColumn("_row", F.col("_slot").bitwiseAND(F.lit((1 << ROW_BITS) - 1)))
        .drop("_slot")
    )
    staged = stage(slotted, "position")
    before = (
        staged.groupBy("_part")
        .count()
        .select(
            "_part",
            (
                F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
                - F.col("count")
            ).alias("_before"),
        )
    )
    return (
        staged.join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_row") + 1)
        .drop("_part", "_row", "_before")
    )


def keys_at(df: DataFrame, ranks: Sequence[int], order_by: Sequence[str]) -> dict[int, Row]:
    """The key that stands at each of the 1-based `ranks`; ranks beyond the last row are left out.

    Only keys move. One row per rank comes to the driver.
    """
    keys = df.select(*order_by)
    last = max(ranks)
    if last <= HEAP_KEYS:
        first = keys.orderBy(*order_by).limit(last)
        placed = first.withColumn("_rank", F.row_number().over(Window.orderBy(*order_by)))
    else:
        placed = with_position(keys, order_by, "_rank")
    return {r["_rank"]: r for r in placed.where(F.col("_rank").isin([int(n) for n in ranks])).collect()}


def _up_to(df: DataFrame, key: Row, order_by: Sequence[str]) -> Column:
    """Whether a row's key is not after `key`; NULL comes first, as in a sort."""
    inside = F.lit(True)
    for name in reversed(list(order_by)):
        column, value = F.col(name), key[name]
        if value is None:
            inside = column.isNull() & inside
            continue
        value = F.lit(value).cast(df.schema[name].dataType)
        inside = column.isNull() | (column < value) | ((column == value) & inside)
    return F.coalesce(inside, F.lit(False))


def between_ranks(df: DataFrame, after: int, upto: int | None, order_by: Sequence[str]) -> DataFrame:
    """The rows at ranks `after` + 1 to `upto`, where they are and in no order.

    The keys at both ends are looked up first, then the rows are cut by a plain
    filter on the key, which reaches the scan if the key does: no row is moved
    or comes together with the others in one task. `df` is read twice. Only if
    equal keys stand on both sides of an end are the rows given positions.
    """
    ends = [n for n in (after, upto) if n]
    if not ends:
        return df.limit(0) if upto == 0 else df
    found = keys_at(df, sorted({m for n in ends for m in (n, n + 1)}), order_by)
    if any(n in found and n + 1 in found and all(found[n][c] == found[n + 1][c] for c in order_by) for n in ends):
        at = F.col("_position")
        inside = (at > after) & (at <= upto) if upto is not None else at > after
        return with_position(df, order_by, "_position").where(inside).drop("_position")
    if after and after + 1 not in found:
        return df.limit(0)
    if after:
        df = df.where(~_up_to(df, found[after], order_by))
    if upto is not None and upto in found:
        df = df.where(_up_to(df, found[upto], order_by))
    return df


def take_first(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first `n` rows in the order of `order_by`, spread as in `df`; all rows for n ≤ 0."""
    return between_ranks(df, 0, n, order_by) if n > 0 else df


def page_records(
    df: DataFrame,
    ids: DataFrame | Sequence[str] | None = None,
    limit: int | None = None,
    offset: int = 0,
    order_by: Sequence[str] = ("id",),
) -> DataFrame:
    """Records with the given ids, then one page of them in id order.

    A page is cut by the keys at its ends, so no task holds all rows of it or
    before it.
    """
    if offset < 0 or (limit is not None and limit < 0):
        raise ValueError("limit and offset must not be negative")
    if ids is not None:
        if not isinstance(ids, DataFrame):
            ids = df.sparkSession.createDataFrame([(i,) for i in ids], "id string")
        df = df.join(ids.select("id").distinct(), "id", "left_semi")
    if limit == 0:
        return df.limit(0)
    return between_ranks(df, offset, None if limit is None else offset + limit, order_by)


def batch_number(position: Column, size: int = 100) -> Column:
    """0-based batch of a 1-based position; the last batch may be short."""
    size = size if size > 0 else 100
    return F.floor((position - 1) / size).cast("long")


def assign_batches(df: DataFrame, order_by: Sequence[str], size: int = 100) -> DataFrame:
    """Add `position` and the `batch` of at most `size` rows it falls in."""
    return with_position(df, order_by).withColumn("batch", batch_number(F.col("position"), size))
