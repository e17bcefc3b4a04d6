"""The four whole jobs: import, add, query, list."""

from __future__ import annotations

import time
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shoal.operators.catalog import require_resolved, resolve_collection, resolve_or_input
from shoal.operators.embed import Embedder, embed_documents, require_embedder
from shoal.operators.ingest import import_records, split_lines
from shoal.operators.ordering import page_records
from shoal.operators.search import DEFAULT_RESULTS, INCLUDE, query_frame, query_texts
from shoal.operators.upsert import first_wins, unmatched, with_generated_ids
from shoal.schemas import DEFAULT_DATABASE, DEFAULT_TENANT
from shoal.session import Scratch, stage
from shoal.sources.jsonl import list_files, read_jsonl
from shoal.sources.sinks import write_rejected
from shoal.sources.store import (
    collection_width, current_records, insert_records, list_records, read_log, records_with_keys, write_records,
)
from shoal.streaming.importer import stream_import


def collection_id(
    registry: DataFrame,
    name: str,
    tenant: str = DEFAULT_TENANT,
    database: str = DEFAULT_DATABASE,
    or_input: bool = False,
) -> str:
    """Id of one collection by name; unknown names are an error unless `or_input`."""
    if not name:
        raise ValueError("collection name is required")
    spark = registry.sparkSession
    request = spark.createDataFrame([(tenant, database, name)], "tenant string, database string, name string")
    if or_input:
        return resolve_or_input(request, registry).first()["collection_id"]
    return require_resolved(resolve_collection(request, registry)).first()["collection_id"]


class Imported(NamedTuple):
    commit: int
    records: int


def require_width(spark: SparkSession, log_path: str, target: str, embedder: Embedder) -> int:
    """The embedder's width; an error if the collection already holds vectors of another."""
    width = collection_width(spark, log_path, target)
    if width is not None and width != embedder.dim:
        raise ValueError(f"collection {target!r} holds vectors of width {width}, not {embedder.dim}")
    return embedder.dim


def import_jsonl(
    spark: SparkSession,
    registry: DataFrame,
    collection: str,
    source: str | list[str],
    log_path: str,
    embedder: Embedder | None,
    *,
    tenant: str = DEFAULT_TENANT,
    database: str = DEFAULT_DATABASE,
    rejects_path: str | None = None,
    run: str | None = None,
    batch: int = 0,
    **options,
) -> Imported:
    """Import JSON lines into a collection: parse, extract, embed, upsert.

    `options` are those of `import_records`. The count is that of the accepted
    records; with `rejects_path` the other lines are written there, from the same
    pass over the source. A (run, batch) that was imported before is not again.
    Vectors of another width than the collection's are an error.
    """
    embedder = require_embedder(embedder)
    target = collection_id(registry, collection, tenant, database)
    width = require_width(spark, log_path, target, embedder)
    lines = read_jsonl(spark, source)
    with Scratch(spark):
        rejected = None
        if rejects_path:
            records, rejected = split_lines(lines, **options)
        else:
            records = import_records(lines, **options)
        embedded = embed_documents(records, embedder).withColumn("collection_id", F.lit(target))
        done = write_records(embedded, log_path, run, batch, width=width)
        if rejected is not None:
            write_rejected(rejected, rejects_path, done.number)
    return Imported(done.number, done.records)


def import_in_batches(
    spark: SparkSession,
    registry: DataFrame,
    collection: str,
    source: str,
    log_path: str,
    embedder: Embedder | None,
    run: str,
    *,
    batch_bytes: int = 8 << 30,
    **options,
) -> list[Imported]:
    """Import the files of a folder in name order, one commit per `batch_bytes` of them.

    Batches that were committed stay if a later one fails. The same call again,
    under the same `run` and over the same files, goes on where it stopped.
    """
    if options.get("n_ingest", 0) > 0:
        raise ValueError("batches have no first n records; use import_jsonl for n_ingest")
    groups: list[list[str]] = []
    size = batch_bytes
    for path, length in list_files(spark, source):
        if size + length > batch_bytes or not groups:
            groups.append([])
            size = 0
        groups[-1].append(path)
        size += length
    return [
        import_jsonl(spark, registry, collection, files, log_path, embedder, run=run, batch=i, **options)
        for i, files in enumerate(groups)
    ]


def stream_jsonl_into(
    spark: SparkSession,
    registry: DataFrame,
    collection: str,
    source: str,
    log_path: str,
    checkpoint: str,
    embedder: Embedder | None,
    *,
    tenant: str = DEFAULT_TENANT,
    database: str = DEFAULT_DATABASE,
    **options,
) -> StreamingQuery:
    """Start a continuous import into a collection given by name; an unknown name is an error.

    `options` are those of `stream_import`.
    """
    embedder = require_embedder(embedder)
    target = collection_id(registry, collection, tenant, database)
    require_width(spark, log_path, target, embedder)
    return stream_import(spark, source, log_path, checkpoint, target, embedder=embedder, **options)


def add_documents(
    current: DataFrame,
    documents: DataFrame | Sequence[str],
    target: str,
    embedder: Embedder | None,
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """The records after adding literal documents or a table of them.

    See `new_documents`; `add_to_log` stores them instead.
    """
    return current.unionByName(new_documents(current, documents, target, embedder, ids).select(*current.columns))


def new_documents(
    current: DataFrame,
    documents: DataFrame | Sequence[str],
    target: str,
    embedder: Embedder | None,
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """The embedded records that adding documents brings.

    Ids that are given are used; others are made from the clock, read once.
    Records that already exist stay as they are, and so does the metadata of new ones: none.
    """
    embedder = require_embedder(embedder)
    # Only what is new gets embedded.
    return embed_documents(unmatched(_to_add(current.sparkSession, documents, target, ids), current), embedder)


def _to_add(spark: SparkSession, documents: DataFrame | Sequence[str], target: str, ids: Sequence[str] | None) -> DataFrame:
    """Documents as records without vectors, the first of each id.

    A table needs an order, `position`, if an id may occur twice in it.
    """
    run_ns = time.time_ns()
    if not isinstance(documents, DataFrame):
        texts = list(documents)
        if not texts:
            raise ValueError("no documents provided")
        if ids is not None and len(ids) != len(texts):
            raise ValueError("ids and documents differ in number")
        given = list(ids) if ids is not None else [f"id-{run_ns}-{i}" for i in range(len(texts))]
        documents = spark.createDataFrame(list(zip(given, texts, range(len(texts)))), "id string, document string, position long")
    named = with_generated_ids(documents, run_ns)
    order = ["position"]
    if "position" not in named.columns:
        if "id" in documents.columns:
            # without an order the smallest text of a repeated id is the first
            order = ["document"]
        named = named.withColumn("position", F.lit(0).cast("long"))
    rows = named.withColumns({"collection_id": F.lit(target), "metadata": F.lit(None).cast("variant")})
    return first_wins(rows, order=order)


def add_to_log(
    spark: SparkSession, log_path: str, documents: DataFrame | Sequence[str], target: str, embedder: Embedder | None,
    ids: Sequence[str] | None = None,
) -> Imported:
    """Add documents to a stored collection; only the rows that are new are embedded and written.

    Of the stored records only the buckets of the given ids are read. What others
    add until this is committed stays; if that leaves nothing, `commit` is -1.
    """
    embedder = require_embedder(embedder)
    width = require_width(spark, log_path, target, embedder)
    with Scratch(spark):
        rows = stage(_to_add(spark, documents, target, ids), "to-add")
        seen = read_log(spark, log_path)
        fresh = unmatched(rows, records_with_keys(spark, log_path, rows, seen))
        done = insert_records(embed_documents(fresh, embedder), log_path, seen, width=width)
    return Imported(done.number, done.records) if done else Imported(-1, 0)


def query_collection(
    registry: DataFrame,
    records: DataFrame,
    collection: str,
    queries: DataFrame | list[str],
    embedder: Embedder | None,
    n_results: int = DEFAULT_RESULTS,
    *,
    tenant: str = DEFAULT_TENANT,
    database: str = DEFAULT_DATABASE,
    metric: str = "l2",
    include: Sequence[str] = INCLUDE,
) -> DataFrame:
    """Nearest records of one collection for a batch of query texts, with the asked-for columns."""
    embedder = require_embedder(embedder)
    if not isinstance(queries, DataFrame):
        queries = query_frame(records.sparkSession, queries)
    target = collection_id(registry, collection, tenant, database)
    members = records.where(F.col("collection_id") == target)
    return query_texts(members, queries, embedder, n_results, metric, include)


def list_collection(
    spark: SparkSession,
    registry: DataFrame,
    collection: str,
    log_path: str,
    *,
    tenant: str = DEFAULT_TENANT,
    database: str = DEFAULT_DATABASE,
    ids: Sequence[str] | None = None,
    limit: int | None = None,
    offset: int = 0,
    include: Sequence[str] = ("document", "metadata"),
) -> DataFrame:
    """Current records of a collection given by name, or by id if no such name exists.

    With `ids` only those, of which the buckets of the ids are read; `limit` and
    `offset` cut a page in id order; `include` names the columns next to the id.
    """
    target = collection_id(registry, collection, tenant, database, or_input=True)
    if ids is None:
        records = current_records(spark, log_path, target)
    else:
        keys = spark.createDataFrame([(target, i) for i in ids], "collection_id string, id string")
        records = records_with_keys(spark, log_path, keys)
    return page_records(list_records(records, target, tuple(include)), limit=limit, offset=offset)
