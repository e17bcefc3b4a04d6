"""Records written in cells around pivots, so that a search reads only the cells and rings it needs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from shoal.operators.nearest import exact_distance
from shoal.operators.search import (
    BROADCAST_BYTES,
    DEFAULT_RESULTS,
    STATE_PAIRS,
    _candidate_schema,
    _merge_candidates,
    _pass,
    _share,
    _to_matrix,
    _valid,
    _with_bounds,
    few_queries,
    knn,
    result_count,
)
from shoal.session import ship_package

# Cells of a table, and so the vectors and the statistics that come to the driver, at most.
PIVOTS = 256
# Cell of the records that have no vector of the pivots' width.
OUTSIDE = -1
# Distances are widened by this share before a cell or ring is skipped.
SLACK = 1e-9


def write_cells(
    records: DataFrame, path: str, pivots: int = PIVOTS, id_col: str = "id", vector_col: str = "embedding"
) -> None:
    """Write ids and vectors in one folder per cell, in order of the distance from the cell's pivot.

    Pivots are the records with the smallest hashes of the id among those whose
    vector is finite and as wide as most are. A record goes to its nearest
    pivot. The files are ranges of (cell, distance), so a cell that holds most
    of the records is many files, each a ring around the pivot.
    """
    spark = records.sparkSession
    ship_package(spark)
    rows = records.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    fits = F.col("id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    width = F.size("embedding")
    usual = rows.where(fits & (width > 0)).groupBy(width.alias("n")).count().orderBy(F.desc("count"), "n").first()
    chosen = rows.where(fits & (width == (usual["n"] if usual else 0)))
    head = chosen.orderBy(F.xxhash64("id"), "id").limit(pivots).select("embedding").toArrow()
    dim = usual["n"] if usual else 0
    centres = np.unique(_to_matrix(head["embedding"], dim).astype(np.float64), axis=0) if usual else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(centres)
    id_type = rows.schema["id"].dataType
    schema = T.StructType([
        *rows.schema.fields,
        T.StructField("cell", T.IntegerType()),
        T.StructField("pivot_distance", T.DoubleType()),
    ])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        squares = (centres**2).sum(axis=1)
        for batch in batches:
            cell = np.full(batch.num_rows, OUTSIDE, dtype=np.int32)
            away = np.zeros(batch.num_rows)
            if len(centres) and batch.num_rows:
                at, vectors = _valid(pa.array(np.arange(batch.num_rows)), batch["embedding"], centres.shape[1])
                vectors = vectors.astype(np.float64)
                nearest = (squares - 2.0 * (vectors @ centres.T)).argmin(axis=1)
                cell[at] = nearest
                away[at] = np.sqrt(exact_distance(vectors, centres[nearest], "l2"))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["embedding"], pa.array(cell), pa.array(away)],
                ["id", "embedding", "cell", "pivot_distance"],
            )

    placed = rows.mapInArrow(place, schema)
    order = ["cell", "pivot_distance", *(["id"] if not isinstance(id_type, T.MapType) else [])]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("cell").parquet(f"{path}/records")
    centre = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>")
    placed.limit(0).write.parquet(f"{path}/schema")
    stored = _stored(spark, path)
    rings = stored.groupBy("cell").agg(
        F.count("*").alias("rows"), F.min("pivot_distance").alias("nearest"), F.max("pivot_distance").alias("farthest")
    )
    rings.join(F.broadcast(centre), "cell", "left").coalesce(1).write.parquet(f"{path}/cells")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    # an empty table has no file to take the schema from
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(f"{path}/records")


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = DEFAULT_RESULTS) -> tuple[DataFrame, float]:
    """The k nearest records by squared L2, as `knn` gives them, and the share of the records that is read.

    The cells nearest to a query that together hold k records give it a bound.
    A second pass then reads the cells and rings in which a record within the
    bound can lie by the triangle inequality; the others are left out by folder
    and by the statistics of the files. More queries than a broadcast takes, or
    of another width than the pivots, are answered by `knn` over all records.
    The share counts whole cells of both passes, so it may exceed 1.
    """
    k = result_count(k)
    ship_package(spark)
    stored = _stored(spark, path)
    cells = spark.read.parquet(f"{path}/cells").where(F.col("cell") != OUTSIDE).orderBy("cell").toArrow()
    queries = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    everything = stored.select("id", "embedding")
    if cells.num_rows == 0 or not few_queries(queries):
        return knn(everything, queries, k), 1.0
    head = queries.toArrow()
    centres = _to_matrix(cells["centre"], len(cells["centre"][0])).astype(np.float64)
    dim = centres.shape[1]
    widths = set(head["embedding"].combine_chunks().value_lengths().to_pylist())
    if widths != {dim} or head.nbytes > BROADCAST_BYTES or head.num_rows * k > STATE_PAIRS:
        return knn(everything, queries, k), 1.0
    vectors = _to_matrix(head["embedding"], dim).astype(np.float64)
    head, vectors = head.filter(pa.array(np.isfinite(vectors).all(axis=1))), vectors[np.isfinite(vectors).all(axis=1)]
    schema = _candidate_schema(everything, queries)
    if head.num_rows == 0:
        return _merge_candidates(spark.createDataFrame([], schema), k), 0.0
    number, rows, nearest, farthest = (cells[c].to_numpy() for c in ("cell", "rows", "nearest", "farthest"))
    away = np.sqrt(np.stack([exact_distance(q[None, :], centres, "l2") for q in vectors]))

    # the nearest cells of each query, up to the one that makes k records full
    order = away.argsort(axis=1, kind="stable")
    before = np.cumsum(rows[order], axis=1) - rows[order]
    first = np.unique(order[before < k])
    shared = _share(spark, head)
    near = stored.where(F.col("cell").isin(number[first].tolist())).select("id", "embedding")
    near = _merge_candidates(_pass(near, shared, dim, k, "l2", schema), k, keep_key=True)
    bounds = near.where(F.col("rank") == k).select("query_id", F.col("tie_key").alias("bound")).toArrow()
    shared.unpersist()
    head = _with_bounds(head, bounds)

    reach = np.sqrt((head["bound"].to_numpy() + 1.0) * 1e-9)[:, None]
    slack = SLACK * (1.0 + away + np.where(np.isfinite(reach), reach, 0.0))
    low, high = away - reach - slack, away + reach + slack
    meets = (low <= farthest) & (high >= nearest)
    needed = np.flatnonzero(meets.any(axis=0))
    low, high = np.where(meets, low, np.inf).min(axis=0), np.where(meets, high, -np.inf).max(axis=0)
    rings = [
        (F.col("cell") == int(number[c])) & (F.col("pivot_distance") >= float(low[c])) & (F.col("pivot_distance") <= float(high[c]))
        for c in needed
    ]
    within = stored.where(F.col("cell").isin(number[needed].tolist())).where(reduce(lambda a, b: a | b, rings))
    hits = _merge_candidates(_pass(within.select("id", "embedding"), _share(spark, head), dim, k, "l2", schema), k)
    return hits, float(rows[first].sum() + rows[needed].sum()) / float(rows.sum())
