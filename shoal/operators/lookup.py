"""Left join of a large table with a table of unique keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from shoal.session import stage

# A lookup table is broadcast only if it is proven to stay below both bounds.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16


def fits_broadcast(df: DataFrame, rows: int | None = None, size: int | None = None) -> bool:
    """Whether rows and bytes of `df` are within bounds; they are added up in the tasks, and only sums leave those."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = BROADCAST_BYTES if size is None else size
    width = sum((_bytes(c, t) for c, t in df.dtypes), F.lit(16 * len(df.columns)))
    seen = df.select(width.alias("bytes")).agg(F.count("*"), F.sum(F.col("bytes").cast("long"))).first()
    return seen[0] <= rows and (seen[1] or 0) <= size


def _bytes(column: str, kind: str):
    """Bytes of a value beyond its fixed part."""
    value = F.col(column)
    if kind in ("string", "binary"):
        extra = F.octet_length(value)
    elif kind == "variant" or kind.startswith(("array", "map", "struct")):
        # as JSON text, which is no shorter than what a broadcast holds by much
        extra = F.octet_length(F.to_json(F.struct(value)))
    else:
        return F.lit(0)
    return F.coalesce(extra, F.lit(0)).cast("long")


def lookup_join(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", small: bool | None = None
) -> DataFrame:
    """Join each row with the one row of `table` that has its key.

    A table within the bound (or known to be `small`) is broadcast. If instead
    the distinct keys of the rows are within it, they pick their part of the
    table, which is then broadcast. Otherwise both sides are shuffled, the rows
    salted and each salt meeting its own copy of the table, so that a key held
    by a large share of the rows spreads over several tasks.
    """
    on = list(on)
    if fits_broadcast(table) if small is None else small:
        return rows.join(F.broadcast(table), on, how)
    keys = rows.select(*on).distinct()
    if fits_broadcast(keys):
        # what the keys pick is written down, so that its own size decides
        picked = stage(table.join(F.broadcast(keys), on, "left_semi"), "picked")
        if fits_broadcast(picked):
            return rows.join(F.broadcast(picked), on, how)
        table = picked
    hashable = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(SALTS).cast("long"))
    every_salt = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return rows.withColumn("_salt", salt).join(table.withColumn("_salt", every_salt), [*on, "_salt"], how).drop("_salt")
