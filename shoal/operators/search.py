"""Exact nearest-neighbour search and the shape of its answers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from shoal.functions.vectors import check_metric, format_distance
from shoal.operators.embed import Embedder, embed_documents
from shoal.operators.lookup import fits_broadcast, lookup_join
from shoal.operators.nearest import NearestRecords
from shoal.operators.ordering import with_position
from shoal.session import scratch_path, ship_package, stage

DEFAULT_RESULTS = 5
ZERO_RESULTS = 3
# Columns of a record that an answer carries unless others are asked for.
INCLUDE = ("document", "metadata")

# Queries up to both bounds are broadcast; more of them are searched in blocks.
BROADCAST_QUERIES = 4096
BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_QUERIES = 16_384
# Pairs that the search of one block holds in a task: queries times results.
STATE_PAIRS = 1 << 20
# From this many results on, a first pass over one in SAMPLE records bounds each
# query's k-th distance, and the second emits only what is within it.
MANY_RESULTS = 100
SAMPLE = 16
# Rows of one Arrow batch of candidates.
EMIT_ROWS = 1 << 16

# First-level groups of one query's candidates, so that no task merges them all.
MERGE_GROUPS = 32

# Answers up to this many rows are broadcast to the records they point at.
BROADCAST_HITS = 200_000


def result_count(n_results: int) -> int:
    """0 stands for the fallback of 3; a negative number is refused."""
    if n_results < 0:
        raise ValueError("n_results must not be negative")
    return n_results or ZERO_RESULTS


def top_k(pairs: DataFrame, k: int, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """The k nearest rows of each query with their 1-based `rank`.

    The filter on the rank makes Spark keep k rows per query in every task
    before the shuffle.
    """
    ranked = rank_in_query(pairs, query_col, id_col)
    return ranked.where(F.col("rank") <= k)


def rank_in_query(pairs: DataFrame, query_col: str = "query_id", id_col: str = "id") -> DataFrame:
    """1-based rank by distance at nine decimals, then id."""
    key = F.col("tie_key") if "tie_key" in pairs.columns else F.round("distance", 9)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy(key, id_col)))


def _merge_candidates(candidates: DataFrame, k: int, keep_key: bool = False) -> DataFrame:
    # Candidates per query grow with the number of tasks. They are cut to k in
    # MERGE_GROUPS groups first, then across the groups.
    within = Window.partitionBy("query_id", "merge_group").orderBy("tie_key", "id")
    first = candidates.withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= k)
    merged = top_k(first.drop("_n", "merge_group"), k)
    return merged if keep_key else merged.drop("tie_key")


def knn(
    records: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_RESULTS,
    metric: str = "l2",
    *,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id_col: str = "query_id",
    query_vector_col: str = "embedding",
    method: str = "auto",
    in_parts: bool = False,
) -> DataFrame:
    """`query_id`, `rank`, `id`, `distance` of the k nearest records per query.

    The search is exact: every record is compared with every query, but pairs
    are only formed inside a task, which keeps k per query. ``matrix``
    broadcasts the queries and refuses more than fit, unless `in_parts`: then one
    matrix after another is broadcast, as by ``blocked``. ``blocked`` broadcasts
    block by block, writes each block's answers down, and takes any number of
    queries and results. ``auto`` takes the former if the queries fit its bounds.
    The records stay where they are; ``blocked`` reads them once per block (twice
    for many results), so write computed vectors to a table first.
    """
    check_metric(metric)
    k = result_count(k)
    ship_package(records.sparkSession)
    records = records.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    queries = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vector_col).alias("embedding"))
    if method not in ("auto", "matrix", "blocked"):
        raise ValueError(f"unknown method {method!r}")
    if method != "blocked" and few_queries(queries):
        head = queries.toArrow()
        if head.nbytes <= BROADCAST_BYTES and (method == "matrix" or head.num_rows * k <= STATE_PAIRS):
            return _merge_candidates(_matrix_candidates(records, queries, head, k, metric), k)
    if method == "matrix" and not in_parts:
        raise ValueError("too many queries to broadcast; use method='blocked'")
    return _blocked_hits(records, queries, k, metric)


def few_queries(queries: DataFrame) -> bool:
    """Whether the queries are within the bound for a broadcast, by counting up to it."""
    return len(queries.select(F.lit(1)).limit(BROADCAST_QUERIES + 1).collect()) <= BROADCAST_QUERIES


def _to_matrix(lists: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _valid(ids: pa.Array, lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the records that have a distance to a query.

    Checked here rather than by a filter in the plan: Spark would push that
    below the projection and compute an embedding column twice.
    """
    fits = pc.and_(ids.is_valid(), pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
    if not pc.all(fits).as_py():
        ids, lists = ids.filter(fits), lists.filter(fits)
    vectors = _to_matrix(lists, dim)
    ids = ids.to_numpy(zero_copy_only=False)
    finite = np.isfinite(vectors).all(axis=1)
    return (ids, vectors) if finite.all() else (ids[finite], vectors[finite])


def _candidate_schema(records: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("id", records.schema["id"].dataType),
        T.StructField("distance", T.DoubleType()),
        T.StructField("tie_key", T.DoubleType()),
        T.StructField("merge_group", T.IntegerType()),
    ])


def _candidate_batches(
    query_ids: pa.Array, state: NearestRecords, id_type: pa.DataType, group: int
) -> Iterator[pa.RecordBatch]:
    state.settle()
    for start in range(0, len(state.query), EMIT_ROWS):
        part = slice(start, start + EMIT_ROWS)
        yield pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(state.query[part])),
                pa.array(state.ids[part].tolist(), type=id_type),
                pa.array(state.distance[part]),
                pa.array(state.tie_key[part]),
                pa.array(np.full(len(state.query[part]), group, dtype=np.int32)),
            ],
            names=["query_id", "id", "distance", "tie_key", "merge_group"],
        )


def _matrix_candidates(
    records: DataFrame, queries: DataFrame, head: pa.Table, k: int, metric: str
) -> DataFrame:
    schema = _candidate_schema(records, queries)
    head = head.filter(head["embedding"].is_valid())
    if head.num_rows == 0:
        return records.sparkSession.createDataFrame([], schema)
    widths = set(head["embedding"].combine_chunks().value_lengths().to_pylist())
    if len(widths) > 1:
        raise ValueError(f"query vectors differ in width: {sorted(widths)}")
    return _pass(records, _share(records.sparkSession, head), widths.pop(), k, metric, schema)


def _share(spark: SparkSession, head: pa.Table):
    """Ids, vectors and, if there are any, the bounds of a block of queries, for all tasks."""
    bounds = head["bound"].to_numpy() if "bound" in head.column_names else None
    return spark.sparkContext.broadcast((head["query_id"].combine_chunks(), head["embedding"].combine_chunks(), bounds))


def _pass(records: DataFrame, shared, dim: int, k: int, metric: str, schema: T.StructType) -> DataFrame:
    """Candidates of the shared queries from one pass over the records, in place."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, lists, bounds = shared.value
        matrix = _to_matrix(lists, dim)
        finite = np.isfinite(matrix).all(axis=1)
        query_ids = query_ids.filter(pa.array(finite))
        state = NearestRecords(matrix[finite], k, metric, bounds=None if bounds is None else bounds[finite])
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("id").type
            state.update(*_valid(batch["id"], batch["embedding"], dim))
        yield from _candidate_batches(query_ids, state, id_type, TaskContext.get().partitionId() % MERGE_GROUPS)

    return records.mapInArrow(search, schema)


def _blocked_hits(
    records: DataFrame, queries: DataFrame, k: int, metric: str, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """The k nearest records of any number of queries, block by block.

    A block is so small that its vectors are within BROADCAST_BYTES and its
    answers within STATE_PAIRS, whatever k is. It is broadcast, the records
    stream past it where they are, and its answers are written down before the
    next one is sent, so one block is in memory at a time. Queries that share an
    id have k answers together, also from several blocks.
    """
    spark = records.sparkSession
    queries = queries.where(F.col("embedding").isNotNull())
    widths = queries.agg(F.min(F.size("embedding")), F.max(F.size("embedding")), F.count("*")).first()
    schema = _candidate_schema(records, queries)
    if widths[2] == 0:
        return _merge_candidates(spark.createDataFrame([], schema), k)
    if widths[0] != widths[1]:
        raise ValueError(f"query vectors differ in width: {widths[0]} to {widths[1]}")
    dim = widths[0]
    size = max(1, min(block_queries, BROADCAST_BYTES // (8 * max(dim, 1)), STATE_PAIRS // k))
    blocks = ceil(widths[2] / size)
    if blocks == 1:
        return _block_hits(records, queries.toArrow(), dim, k, metric, schema)[0].drop("tie_key")
    placed = with_position(queries, ["query_id"], "block")
    placed = placed.withColumn("block", F.floor((F.col("block") - 1) / size).cast("int"))
    placed = stage(placed.repartition(min(blocks, MERGE_GROUPS), "block"), "query-blocks", "block")
    out = scratch_path(spark, "hits")
    for block in range(blocks):
        head = placed.where(F.col("block") == block).drop("block").toArrow()
        hits, shared = _block_hits(records, head, dim, k, metric, schema)
        hits.write.mode("overwrite").parquet(f"{out}/block={block}")
        shared.unpersist()
    return top_k(spark.read.schema(hits.schema).parquet(out).drop("rank"), k).select("query_id", "id", "distance", "rank")


def _block_hits(records: DataFrame, head: pa.Table, dim: int, k: int, metric: str, schema: T.StructType):
    """The k nearest records of one block of queries with their tie keys, still lazy, and what is shared for them."""
    spark = records.sparkSession
    shared = _share(spark, head)
    if k >= MANY_RESULTS:
        some = records.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE).cast("long")) == 0)
        near = _merge_candidates(_pass(some, shared, dim, k, metric, schema), k, keep_key=True)
        bounds = near.where(F.col("rank") == k).select("query_id", F.col("tie_key").alias("bound")).toArrow()
        shared.unpersist()
        shared = _share(spark, _with_bounds(head, bounds))
    return _merge_candidates(_pass(records, shared, dim, k, metric, schema), k, keep_key=True), shared


def _with_bounds(head: pa.Table, bounds: pa.Table) -> pa.Table:
    """Each query with its bound; one with fewer than k records in the sample has none."""
    at = pc.index_in(head["query_id"], value_set=bounds["query_id"].combine_chunks())
    found = pc.fill_null(bounds["bound"].take(at), float("inf")) if bounds.num_rows else pa.array(np.full(head.num_rows, np.inf))
    return head.append_column("bound", found)


def query_response(
    hits: DataFrame, records: DataFrame, max_hits: int | None = None, include: Sequence[str] = INCLUDE
) -> DataFrame:
    """Hits in long form with the asked-for columns of the records they point at.

    `max_hits` is a proven bound of the number of hits; within BROADCAST_HITS
    they are broadcast and the records are scanned in place. Without one the
    hits are staged, so that their size decides before any record is moved.
    """
    wanted = [c for c in include if c in records.columns]
    if max_hits is None:
        hits = stage(hits, "hits")
        small = fits_broadcast(hits, BROADCAST_HITS)
    else:
        small = max_hits <= BROADCAST_HITS
    pointed_at = records.select("id", *wanted)
    if small:
        joined = pointed_at.join(F.broadcast(hits), "id")
    else:
        # One record may be the answer to most queries: find each record once,
        # then hand it to its hits with the skew-safe lookup.
        needed = pointed_at.join(hits.select("id").distinct(), "id", "left_semi")
        joined = lookup_join(hits, needed, ["id"], "inner")
    return joined.select("query_id", "rank", "id", *wanted, "distance")


def query_response_nested(response: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row per query with parallel arrays in rank order (k elements at most).

    With `queries` each of them has a row; one without hits, because nothing is
    stored or its vector is missing or not a number, has empty arrays.
    """
    fields = [c for c in response.columns if c not in ("query_id", "rank")]
    rows = F.collect_list(F.struct("rank", F.struct(*fields).alias("hit")))
    ordered = response.groupBy("query_id").agg(_by_rank(rows).alias("_hits"))
    names = {"id": "ids", "document": "documents", "metadata": "metadatas", "distance": "distances"}
    if queries is not None:
        ordered = queries.select("query_id").distinct().join(ordered, "query_id", "left")
        ordered = ordered.withColumn("_hits", F.coalesce("_hits", F.array().cast(ordered.schema["_hits"].dataType)))
    return ordered.select(
        "query_id",
        *[_field("_hits", f).alias(names.get(f, f)) for f in fields],
    )


def _field(hits: str, name: str):
    return F.transform(hits, lambda h: h["hit"][name])


def _by_rank(rows):
    return F.array_sort(rows, lambda a, b: (a["rank"] - b["rank"]).cast("int"))


def listing_lines(listed: DataFrame) -> DataFrame:
    """One display text per listed record: its id, then content and metadata where asked for and there."""
    parts = [F.concat(F.lit("- "), F.col("id"))]
    if "document" in listed.columns:
        parts.append(F.concat(F.lit("    Content: "), F.col("document")))
    if "metadata" in listed.columns:
        text = F.col("metadata").cast("string")
        parts.append(F.concat(F.lit("    Metadata: "), F.when(text != "{}", text)))
    return listed.select("id", F.concat_ws("\n", *parts).alias("value"))


def query_lines(response: DataFrame) -> DataFrame:
    """Two display lines per hit: rank, distance and id, then the content."""
    # The display format.
    head = F.format_string("  [%d] (Dist: %s) ID: %s", "rank", format_distance(F.col("distance")), "id")
    content = F.concat(F.lit("      Content: "), F.coalesce("document", F.lit("")))
    return response.select("query_id", "rank", F.concat_ws("\n", head, content).alias("value"))


def query_frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Query texts with their position as `query_id`; equal texts stay separate."""
    if not texts:
        raise ValueError("at least one query is required")
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def search_records(
    records: DataFrame,
    queries: DataFrame,
    n_results: int = DEFAULT_RESULTS,
    metric: str = "l2",
    include: Sequence[str] = INCLUDE,
) -> DataFrame:
    """Answer vector queries (`query_id`, `embedding`) over one collection, in long form."""
    k = result_count(n_results)
    # above the bound query_response stages the hits, so that the search runs once
    bound = queries.count() * k if few_queries(queries) else None
    bound = bound if bound is None or bound <= BROADCAST_HITS else None
    return query_response(knn(records, queries, k, metric), records, bound, include)


def query_texts(
    records: DataFrame,
    queries: DataFrame,
    embedder: Embedder | None,
    n_results: int = DEFAULT_RESULTS,
    metric: str = "l2",
    include: Sequence[str] = INCLUDE,
) -> DataFrame:
    """Answer text queries (`query_id`, `text`) over one collection's records, in long form."""
    embedded = embed_documents(queries, embedder, id_col="query_id", text_col="text")
    return search_records(records, embedded, n_results, metric, include)
