"""Evaluate an expensive column once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row.

    A lambda body re-evaluates every outer expression it mentions for each
    element; a lambda variable is a plain reference. Binding through a one
    element array turns the former into the latter.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add expensive columns so that they are computed once per row.

    Spark pushes a filter on a computed column below the projection, and then
    computes the column for the filter and again for the result. Passing the
    columns through a generator (one element, so one row) stops that; filters
    on them stay above it. A generator is never pruned, so do not add a column
    this way that may go unread.
    """
    packed = F.struct(*[column.alias(name) for name, column in columns.items()])
    carried = df.select("*", F.explode_outer(F.array(packed)).alias("_computed"))
    kept = [c for c in df.columns if c not in columns]
    return carried.select(*kept, *[F.col(f"_computed.{name}").alias(name) for name in columns])
