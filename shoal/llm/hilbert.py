"""Sharding along a Hilbert curve. Native: column functions only.

Metadata dimensions are quantised to cells, the cells are numbered along a
Hilbert curve, the rows sorted by that number and cut into shards of equal row
counts. Neighbours on the curve are neighbours in every dimension, so the
minimum and maximum of each dimension prune files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shoal.operators.lookup import lookup_join
from shoal.operators.ordering import with_position
from shoal.session import stage

BITS = 6


def curve_steps(dims: int) -> tuple[list[int], list[int]]:
    """For every state and corner: the curve's digit and the next state.

    A state is the entry corner and direction of a cell, entry * dims + direction.
    """
    ones = (1 << dims) - 1

    def rotate(x: int, by: int) -> int:
        by %= dims
        return (x << by | x >> (dims - by)) & ones if by else x

    def gray(x: int) -> int:
        return x ^ x >> 1

    def rank(x: int) -> int:
        out = 0
        while x:
            out, x = out ^ x, x >> 1
        return out

    def trailing(x: int) -> int:
        return (~x & (x + 1)).bit_length() - 1  # number of trailing ones

    digits, following = [], []
    for entry in range(1 << dims):
        for direction in range(dims):
            for corner in range(1 << dims):
                digit = rank(rotate(corner ^ entry, dims - (direction + 1)))
                start = 0 if digit == 0 else gray(2 * ((digit - 1) // 2))
                turn = 0 if digit == 0 else trailing(digit - 1 if digit % 2 == 0 else digit) % dims
                digits.append(digit)
                following.append((entry ^ rotate(start, direction + 1)) * dims + (direction + turn + 1) % dims)
    return digits, following


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a cell given by one number below 2**bits per dimension."""
    dims = len(cells)
    digits, following = curve_steps(dims)
    digit_of, next_of = (F.array(*[F.lit(x) for x in xs]) for xs in (digits, following))

    def step(state: Column, bit: Column) -> Column:
        corner = sum((F.call_function("shiftright", c.cast("int"), bit).bitwiseAND(1) * (1 << i) for i, c in enumerate(cells)), F.lit(0))
        at = (state["state"] * (1 << dims) + corner + 1).cast("int")
        return F.struct(
            (state["index"] * (1 << dims) + F.element_at(digit_of, at)).alias("index"), F.element_at(next_of, at).alias("state")
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    levels = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(levels, start, step, lambda s: s["index"])


def ranked_cell(rows: DataFrame, column: str, bits: int = BITS) -> DataFrame:
    """Add `column`_cell: the quantile of the value among the different values; nulls in cell 0."""
    values = rows.select(column).where(F.col(column).isNotNull()).distinct()
    values = with_position(values, [column], "at")
    n = max(1, values.count())
    cell = F.floor((F.col("at") - 1) * (1 << bits) / n).cast("int")
    cells = values.select(column, cell.alias(f"{column}_cell"))
    return lookup_join(rows, cells, [column]).fillna(0, [f"{column}_cell"])


def hilbert_shards(
    docs: DataFrame,
    shards: int = 40,
    ident: str = "doc_id",
    text: str = "text",
    dimensions: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """Shard and slot of every document: ident, size, text_crc32, curve, shard, slot.

    The dimensions are the given columns by rank and the size of the text by its
    logarithm. Rows are sorted by place on the curve, then by text checksum, size
    and id, so copies with equal metadata stay side by side; shard sizes differ by one row at
    most. A null text has size 16 and checksum 0, null metadata falls in the
    first cell, repeated rows get places of their own, an empty table gives no
    rows. Only ids and metadata are shuffled, and a cell that holds most rows is
    split by checksum and id.
    """
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long")
    checksum = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    names = [f"d{i}" for i in range(len(dimensions))]
    rows = docs.select(
        F.col(ident).alias("ident"), size.alias("size"), checksum.alias("crc"),
        *[F.col(d).cast("string").alias(n) for d, n in zip(dimensions, names)],
    )
    rows = stage(rows, "metadata")
    total = rows.count()
    for name in names:
        rows = ranked_cell(rows, name)
    log_size = F.least(F.floor(F.log2(F.col("size")) * 2), F.lit((1 << BITS) - 1)).cast("int")
    curve = hilbert_index([*[F.col(f"{n}_cell") for n in names], log_size])
    rows = with_position(rows.select("ident", "size", "crc", curve.alias("curve")), ["curve", "crc", "size", "ident"], "at")
    at = F.col("at") - 1
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    shard = F.expr(f"(at - 1) * {shards} div {max(1, total)}")
    return rows.withColumn("shard", shard).select(
        F.col("ident").alias(ident), "size", F.col("crc").alias("text_crc32"), "curve",
        F.col("shard").cast("int").alias("shard"), (at - begin).alias("slot"),
    )


def write_shards(placed: DataFrame, path: str, shards: int = 40) -> None:
    """Write rows that carry `shard` and `slot`, one folder per shard in slot order."""
    placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
