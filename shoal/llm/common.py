"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shoal.session import ship_package, stage

# Word characters of the operators' contracts, ASCII white space excluded.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_workers(df: DataFrame) -> SparkSession:
    """The session of `df`, after handing this package to the Python workers."""
    ship_package(df.sparkSession)
    return df.sparkSession


def fresh(name: str, columns: list[str]) -> str:
    """`name`, made longer until no column is called so (names differ by more than case)."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = f"_{name}"
    return name


def remainder(ident: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % modulus


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal `keys` in a partition that is sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        begin = 0
        for i, key in enumerate(zip(*columns)):
            if key != current:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield current, held
                held, current, begin = [], key, i
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield current, held


def _fixed(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of links between long ids: one row (id, root) per linked id.

    `root` is the smallest id of the component. Large-star and small-star steps
    alternate until nothing changes; each step is two aggregations and a join on
    the links alone, written to the shared folder, and every step sends one row
    per id and task at most before a shuffle. Self links are allowed, nulls are not.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    links = stage(edges.where(F.col(a) != F.col(b)).select(u, v).distinct(), "links")
    before = _fixed(links)
    while before[0]:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        links = stage(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _fixed(links)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(
        links.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
