"""Every operator as a query over the shared test tables.

Each function takes the session and a folder of Parquet tables, uses whole
tables and returns a DataFrame of plain columns. `plans.oracles` states the
same answers in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoal.functions.ids import choose_id, collection_uuid, hash_id
from shoal.functions.json import as_map, get_nested, parse_object, stringify
from shoal.functions.tokens import attention_mask, tokenize_words
from shoal.functions.vectors import distance, first_token_pool, format_distance
from shoal.operators import catalog, ingest, ordering, pivots, search, tokens, upsert
from shoal.operators.embed import HashingEmbedder, embed_documents, hashing_embed
from shoal.plans.vector_cache import embed_cached
from shoal.session import allow_duplicate_keys, scratch_path, spread
from shoal.sources.jsonl import read_jsonl
from shoal.sources.store import (
    compact, current_records, insert_records, list_records as records_of, read_log, records_with_keys, vacuum, write_records,
)
from shoal.streaming.importer import stream_import as start_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

FEED_KEY = ("feed", "key1", "key2")
HASH_DIM = 32
RESULTS = 5
RUN_NS = 1_700_000_000_000_000_000
TENANT = "default_tenant"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- inputs derived from the tables -----------------------------------------


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON line per document."""
    line = F.struct(F.col("doc_id").alias("id"), "text", F.struct("lang", "source").alias("meta"), "n_chars")
    return spread(table(spark, sf, "documents")).select(
        F.lit("documents").alias("feed"),
        F.col("doc_id").alias("key1"),
        F.lit(0).cast("long").alias("key2"),
        F.to_json(line).alias("value"),
    )


def feed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A mixed feed: records with ids and without, objects without content, other JSON, prose."""

    def part(name: str, key1: str, key2: str | None, value) -> DataFrame:
        return table(spark, sf, name).select(
            F.lit(name).alias("feed"),
            F.col(key1).alias("key1"),
            (F.col(key2) if key2 else F.lit(0)).cast("long").alias("key2"),
            value.alias("value"),
        )

    no_text = F.struct(F.col("page_id").alias("id"), F.lit(None).cast("string").alias("text"), "url")
    parts = [
        document_lines(spark, sf),
        part("conversations", "conv_id", "turn", F.to_json(F.struct("text", "conv_id", "turn", "role"))),
        part("events", "event_id", None, F.col("props")),
        part("pages", "page_id", None, F.to_json(no_text, {"ignoreNullFields": "false"})),
        part("labels", "doc_id", None, F.to_json(F.array(F.col("doc_id"), F.col("quality"), F.col("toxic")))),
        part("benchmark", "item_id", None, F.col("text")),
    ]
    lines = parts[0]
    for more in parts[1:]:
        lines = lines.unionByName(more)
    return lines


def document_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as records; the source is the collection."""
    return table(spark, sf, "documents").select(
        F.col("source").alias("collection_id"),
        F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        F.col("text").alias("document"),
        F.to_variant_object(F.struct("lang", "n_chars")).alias("metadata"),
        F.col("doc_id").alias("position"),
    )


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """One collection per language (database) and source (name)."""
    names = table(spark, sf, "documents").select(
        F.lit(TENANT).alias("tenant"), F.col("lang").alias("database"), F.col("source").alias("name")
    ).distinct()
    return names.select(
        collection_uuid(F.col("tenant"), F.col("database"), F.col("name")).alias("id"), "name", "tenant", "database"
    )


def name_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Collections asked for by name (known and unknown) and by id."""
    documents = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("request"), F.col("lang").alias("database"), F.col("source").alias("name")
    )
    events = table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.col("event_id")).alias("request"), F.lit("en").alias("database"), F.col("event_type").alias("name")
    )
    by_id = registry(spark, sf).select(F.concat(F.lit("r"), F.col("id")).alias("request"), "database", F.col("id").alias("name"))
    both = documents.unionByName(events).unionByName(by_id)
    return both.withColumn("tenant", F.lit(TENANT))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).withColumnRenamed("id", "query_id")


def hashed_documents(spark: SparkSession, sf: str) -> DataFrame:
    records = spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("document"),
        F.to_variant_object(F.struct("lang", "source")).alias("metadata"),
    )
    return hashing_embed(records, HASH_DIM)


def benchmark_queries(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("document"))
    return hashing_embed(items, HASH_DIM)


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """All words of the documents, with an id made from their hash; other tables' words may be unknown."""
    words = spread(table(spark, sf, "documents")).select(F.explode(tokenize_words(F.col("text"))).alias("token"))
    number = F.conv(F.substring(F.sha2("token", 256), 1, 6), 16, 10).cast("long")
    return words.distinct().select("token", (number % 29000 + 1000).cast("int").alias("token_id"))


def exploded(df: DataFrame, array_col: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(array_col).alias("pos", "value"))


def rounded_hits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


# --- sources, parsing, extraction --------------------------------------------


@query
def read_jsonl_file(spark, sf):
    path = scratch_path(spark, "jsonl")
    document_lines(spark, sf).select("value").write.text(path)
    return ingest.import_records(read_jsonl(spark, path)).select("id", "document")


@query
def parse_records(spark, sf):
    return ingest.parse_records(feed_lines(spark, sf)).select(*FEED_KEY)


@query
def rejected_records(spark, sf):
    return ingest.rejected_records(feed_lines(spark, sf)).select(*FEED_KEY, "value", "reason")


@query
def rejected_counts(spark, sf):
    rejected = ingest.rejected_records(feed_lines(spark, sf))
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query
def require_content(spark, sf):
    return ingest.require_content(ingest.parse_records(feed_lines(spark, sf))).select(*FEED_KEY, "content")


@query
def nested_path(spark, sf):
    allow_duplicate_keys(spark)
    value = get_nested(parse_object(F.col("props")), "k", "string")
    return table(spark, sf, "events").select("event_id", value.alias("k"))


@query
def nested_meta(spark, sf):
    records = ingest.parse_records(document_lines(spark, sf))
    lang = get_nested(F.col("record"), "meta.lang", "string")
    missing = get_nested(F.col("record"), "meta.0", "string")
    return records.select(F.col("key1").alias("doc_id"), lang.alias("lang"), missing.alias("missing"))


@query
def stringify_values(spark, sf):
    records = ingest.parse_records(document_lines(spark, sf))
    return records.select(
        F.col("key1").alias("doc_id"),
        stringify(get_nested(F.col("record"), "n_chars")).alias("number"),
        stringify(get_nested(F.col("record"), "meta")).alias("object"),
    )


@query
def hash_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", hash_id(F.col("text")).alias("id"))


@query
def choose_ids(spark, sf):
    records = ingest.require_content(ingest.parse_records(feed_lines(spark, sf)))
    return records.select(*FEED_KEY, choose_id(F.col("record"), "id", F.col("content")).alias("id"))


@query
def metadata_all(spark, sf):
    records = ingest.import_records(feed_lines(spark, sf), all_metadata=True)
    entries = records.select(*FEED_KEY, F.explode(as_map(F.col("metadata"))).alias("key", "v"))
    return entries.select(*FEED_KEY, "key", stringify(F.col("v")).alias("value"))


@query
def metadata_selected(spark, sf):
    records = ingest.import_records(feed_lines(spark, sf), metadata_keys=["n_chars", "role", "meta.lang"])
    entries = records.select(*FEED_KEY, F.explode(as_map(F.col("metadata"))).alias("key", "v"))
    return entries.select(*FEED_KEY, "key", stringify(F.col("v")).alias("value"))


@query
def import_records(spark, sf):
    records = ingest.import_records(feed_lines(spark, sf), all_metadata=True)
    return records.select(*FEED_KEY, "id", "document", F.col("metadata").cast("string").alias("metadata"))


@query
def import_limit(spark, sf):
    records = ingest.import_records(feed_lines(spark, sf), n_ingest=250, order_by=FEED_KEY)
    return records.select(*FEED_KEY, "id")


@query
def stream_import(spark, sf):
    source, log, checkpoint = (scratch_path(spark, p) for p in ("stream-in", "stream-log", "stream-state"))
    document_lines(spark, sf).select("value").write.text(source)
    start_stream(spark, source, log, checkpoint, "docs", all_metadata=True).awaitTermination()
    records = current_records(spark, log, "docs")
    return records.select("collection_id", "id", "document", F.col("metadata").cast("string").alias("metadata"))


# --- order, pages, batches ---------------------------------------------------


@query
def record_position(spark, sf):
    accepted = ingest.import_records(feed_lines(spark, sf))
    return ordering.with_position(accepted.select(*FEED_KEY), FEED_KEY).select(*FEED_KEY, "position")


@query
def batch_sizes(spark, sf):
    accepted = ingest.import_records(feed_lines(spark, sf)).select(*FEED_KEY)
    batches = ordering.assign_batches(accepted, FEED_KEY, 100)
    return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("records"))


@query
def page_records(spark, sf):
    records = document_records(spark, sf).select("id", "document")
    labelled = table(spark, sf, "labels").select(F.concat(F.lit("d"), F.col("doc_id")).alias("id"))
    return ordering.page_records(records, ids=labelled, limit=50, offset=20)


@query
def generated_ids(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id")
    return upsert.with_generated_ids(documents, RUN_NS, order_by=["doc_id"]).select("doc_id", "id")


# --- adding and replacing ----------------------------------------------------


@query
def last_wins(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.col("role").alias("collection_id"), F.col("conv_id").cast("string").alias("id"), "turn", "text"
    )
    return upsert.last_wins(turns, order=("turn",))


@query
def upsert_records(spark, sf):
    documents = table(spark, sf, "documents")
    own_id = F.concat(F.lit("d"), F.col("doc_id"))
    current = documents.select(own_id.alias("id"), F.col("text").alias("document")).unionByName(
        table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("html").alias("document"))
    )
    changed = documents.select(own_id.alias("id"), F.concat(F.lit("v2 "), F.col("text")).alias("document"), F.lit(1).alias("seq"))
    judged = documents.join(table(spark, sf, "labels"), "doc_id").select(
        own_id.alias("id"), F.concat(F.lit("v3 "), F.col("quality"), F.lit(" "), F.col("text")).alias("document"), F.lit(2).alias("seq")
    )
    fresh = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn")).alias("id"), F.col("text").alias("document"), F.lit(1).alias("seq")
    )
    batch = changed.unionByName(judged).unionByName(fresh)
    return upsert.upsert(current, batch, keys=("id",), order=("seq",)).select("id", "document")


@query
def content_dedupe(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"))
    return upsert.content_dedupe(documents, order=("doc_id",)).select("id", "doc_id")


@query
def add_records(spark, sf):
    documents = table(spark, sf, "documents").withColumn("id", hash_id(F.col("text")))
    labelled = documents.join(table(spark, sf, "labels"), "doc_id", "left_semi")
    current = upsert.first_wins(labelled, ("id",), ("doc_id",)).select("id", "doc_id", F.lit("stored").alias("state"))
    batch = documents.select("id", "doc_id", F.lit("added").alias("state"))
    return upsert.insert_if_absent(current, batch, keys=("id",), order=("doc_id",))


@query
def add_precomputed(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("collection_id"), F.col("vec_id").alias("id"), "embedding"
    )
    stored = rows.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    flagged = stored.withColumn("embedding", F.transform("embedding", lambda x: -x)).select(*rows.columns)
    added = upsert.insert_if_absent(flagged, rows)
    return added.select("collection_id", "id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


@query
def zip_batch(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", F.col("text").alias("document"))
    batches = ordering.assign_batches(documents, ["doc_id"], 100)
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "document")))
    wire = batches.groupBy("batch").agg(rows.alias("rows")).select(
        "batch",
        F.transform("rows", lambda r: r["doc_id"]).alias("ids"),
        F.transform("rows", lambda r: r["document"]).alias("documents"),
    )
    return upsert.zip_batch(wire, id="ids", document="documents")


# --- catalogue -----------------------------------------------------------------


@query
def record_count(spark, sf):
    return catalog.record_count(table(spark, sf, "documents"), "source")


@query
def collection_summary(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("collection_id"), "embedding")
    return catalog.collection_summary(rows)


@query
def list_records(spark, sf):
    listed = records_of(document_records(spark, sf), "src3")
    return listed.withColumn("metadata", F.col("metadata").cast("string"))


@query
def stored_records(spark, sf):
    log = scratch_path(spark, "log")
    records = document_records(spark, sf)
    write_records(records, log)
    write_records(records.join(table(spark, sf, "labels").select(F.col("doc_id").alias("position")), "position", "left_semi")
                  .withColumn("document", F.concat(F.lit("v2 "), F.col("document"))), log)
    return current_records(spark, log).select("collection_id", "id", "document")


@query
def mixed_import(spark, sf):
    """A batch, two streams into two collections, a compaction and another stream into one log."""
    log = scratch_path(spark, "log")

    def stream(lines: DataFrame, collection: str) -> None:
        source, checkpoint = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-state")
        lines.select("value").write.text(source)
        start_stream(spark, source, log, checkpoint, collection).awaitTermination()

    documents, turns = document_lines(spark, sf), table(spark, sf, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    turns = turns.select("role", F.to_json(F.struct("id", "text")).alias("value"))
    write_records(ingest.import_records(documents.where("key1 % 2 = 0")).withColumn("collection_id", F.lit("docs")), log)
    stream(documents.where("key1 % 2 = 1"), "docs")
    stream(turns.where("role = 'user'"), "turns")
    compact(spark, log)
    stream(turns.where("role != 'user'"), "turns")
    return current_records(spark, log).select("collection_id", "id", "document")


@query
def added_records_stored(spark, sf):
    """An add that is stored twice: what is there stays, only new rows are written."""
    log = scratch_path(spark, "log")
    records = document_records(spark, sf)
    write_records(records, log)
    batch = table(spark, sf, "benchmark").select(
        F.lit("src1").alias("collection_id"), F.concat(F.lit("b"), F.col("item_id")).alias("id"), F.col("text").alias("document")
    )
    again = records.select("collection_id", "id", F.lit("changed").alias("document")).unionByName(batch)
    seen = read_log(spark, log)
    for _ in range(2):  # the second look is as old as the first: its rows are taken out at the commit
        insert_records(upsert.unmatched(again, current_records(spark, log, log=seen)), log, seen)
    return current_records(spark, log).select("collection_id", "id", "document")


@query
def overlapping_compactions(spark, sf):
    """A compaction that is refused, as another one and a write were committed since it began."""
    log = scratch_path(spark, "log")
    records = document_records(spark, sf)
    labelled = records.join(table(spark, sf, "labels").select(F.col("doc_id").alias("position")), "position", "left_semi")
    write_records(records, log)
    write_records(labelled.withColumn("document", F.concat(F.lit("v2 "), F.col("document"))), log)
    begun = read_log(spark, log)
    compact(spark, log)
    write_records(records.where("position % 5 = 0").withColumn("document", F.lit("v3")), log)
    compact(spark, log, seen=begun)
    compact(spark, log)
    vacuum(spark, log, older_than=0)
    return current_records(spark, log).select("collection_id", "id", "document")


@query
def records_by_key(spark, sf):
    """Stored records of the labelled documents: only the buckets of their keys are read."""
    log = scratch_path(spark, "log")
    records = document_records(spark, sf)
    write_records(records, log, buckets=64)
    write_records(records.where("position % 3 = 0").withColumn("document", F.concat(F.lit("v2 "), F.col("document"))), log)
    judged = records.join(table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("position")), "position", "left_semi")
    found = records_with_keys(spark, log, judged.select("collection_id", "id"))
    return found.select("collection_id", "id", F.sha2("document", 256).alias("digest"))


@query
def split_import(spark, sf):
    """Records and rejected lines of one pass."""
    records, rejected = ingest.split_lines(feed_lines(spark, sf), all_metadata=True)
    accepted = records.select(*FEED_KEY, "id", F.lit(None).cast("string").alias("reason"))
    return accepted.unionByName(rejected.select(*FEED_KEY, F.lit(None).cast("string").alias("id"), "reason"))


@query
def tenant_exists(spark, sf):
    owners = table(spark, sf, "documents").select(F.col("source").alias("tenant"))
    asked = owners.unionByName(table(spark, sf, "events").select(F.col("event_type").alias("tenant"))).distinct()
    return catalog.tenant_exists(asked, owners)


@query
def list_databases(spark, sf):
    return catalog.list_databases(registry(spark, sf))


@query
def list_collections(spark, sf):
    return catalog.list_collections(registry(spark, sf), database="de")


@query
def describe_collections(spark, sf):
    asked = registry(spark, sf).withColumn("dimension", F.lit(None).cast("int"))
    members = table(spark, sf, "documents").select(
        collection_uuid(F.lit(TENANT), F.col("lang"), F.col("source")).alias("collection_id"), F.col("doc_id").alias("vec_id")
    )
    records = members.join(table(spark, sf, "embeddings"), "vec_id").select("collection_id", "embedding")
    described = catalog.describe_collections(asked, records)
    width = F.coalesce("dimension", F.lit(0)).alias("dimension")
    return described.select("id", "name", "tenant", "database", width, "records")


@query
def collection_defaults(spark, sf):
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") != "user", F.col("role")).alias("tenant")
    )
    return catalog.collection_defaults(turns)


@query
def resolve_collection(spark, sf):
    return catalog.resolve_collection(name_requests(spark, sf), registry(spark, sf))


@query
def resolve_or_uuid(spark, sf):
    return catalog.resolve_or_uuid(name_requests(spark, sf), registry(spark, sf))


@query
def resolve_or_input(spark, sf):
    return catalog.resolve_or_input(name_requests(spark, sf), registry(spark, sf))


@query
def create_collection(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.lit(TENANT).alias("tenant"), F.lit("en").alias("database"), F.col("role").alias("name")
    )
    known = name_requests(spark, sf).join(registry(spark, sf), ["tenant", "database", "name"], "left_semi")
    return catalog.create_collections(turns.unionByName(known.select(*turns.columns)), registry(spark, sf))


# --- tokens and vectors ---------------------------------------------------------


@query
def tokenize_documents(spark, sf):
    words = spread(table(spark, sf, "documents")).select("doc_id", tokenize_words(F.col("text")).alias("words"))
    return words.select("doc_id", F.size("words").alias("n"), F.sha2(F.array_join("words", " "), 256).alias("digest"))


@query
def vocab_lookup(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.posexplode(tokenize_words(F.col("text"))).alias("pos", "word"))
    return tokens.vocab_lookup(words, vocabulary(spark, sf)).select("item_id", "pos", "word", "token_id")


@query
def encode_tokens(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("document"))
    encoded = tokens.encode_tokens(items, vocabulary(spark, sf)).withColumn(
        "id_mask", attention_mask(F.col("input_ids"))
    )
    zipped = F.arrays_zip("input_ids", "attention_mask", "id_mask", "token_type_ids")
    return encoded.select("id", F.posexplode(zipped).alias("pos", "t")).select(
        "id", "pos", "t.input_ids", "t.attention_mask", "t.id_mask", "t.token_type_ids"
    )


@query
def hashing_embed_documents(spark, sf):
    rows = exploded(hashed_documents(spark, sf), "embedding", "id")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def embed_documents_in_workers(spark, sf):
    documents = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document")))
    rows = exploded(embed_documents(documents, HashingEmbedder(HASH_DIM)), "embedding", "id")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def embed_documents_cached(spark, sf):
    """Vectors by content: labelled documents first, then all; each distinct text is embedded once."""
    documents = spread(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document")))
    cache = scratch_path(spark, "vectors")
    labelled = documents.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    embed_cached(labelled, HashingEmbedder(HASH_DIM), cache, "hashing")
    rows = exploded(embed_cached(documents, HashingEmbedder(HASH_DIM), cache, "hashing"), "embedding", "id")
    return rows.withColumn("value", F.round(F.col("value").cast("double"), 6))


@query
def first_token_pooling(spark, sf):
    pooled = table(spark, sf, "embeddings").select("vec_id", first_token_pool(F.col("embedding"), 16).alias("pooled"))
    return exploded(pooled, "pooled", "vec_id").withColumn("value", F.round(F.col("value").cast("double"), 6))


# --- search ----------------------------------------------------------------------


@query
def knn_l2(spark, sf):
    return rounded_hits(search.knn(vectors(spark, sf), vector_queries(spark, sf), RESULTS, "l2"))


@query
def knn_cosine(spark, sf):
    return rounded_hits(search.knn(vectors(spark, sf), vector_queries(spark, sf), RESULTS, "cosine"))


@query
def knn_ip(spark, sf):
    return rounded_hits(search.knn(vectors(spark, sf), vector_queries(spark, sf), RESULTS, "ip"))


@query
def knn_matrix(spark, sf):
    return rounded_hits(search.knn(vectors(spark, sf), vector_queries(spark, sf), 0, "l2", method="matrix", in_parts=True))


@query
def blocked_knn(spark, sf):
    return rounded_hits(search.knn(vectors(spark, sf), vector_queries(spark, sf), RESULTS, "l2", method="blocked"))


@query
def pivot_knn(spark, sf):
    cells = scratch_path(spark, "cells")
    pivots.write_cells(vectors(spark, sf), cells)
    return rounded_hits(pivots.search_cells(spark, cells, vector_queries(spark, sf), RESULTS)[0])


@query
def text_query(spark, sf):
    response = search.search_records(hashed_documents(spark, sf), benchmark_queries(spark, sf), RESULTS)
    return response.withColumn("metadata", F.col("metadata").cast("string")).withColumn("distance", F.round("distance", 6))


@query
def query_response_nested(spark, sf):
    asked = benchmark_queries(spark, sf)
    response = search.search_records(hashed_documents(spark, sf), asked, RESULTS)
    nested = search.query_response_nested(response, asked)
    metadata = F.transform("metadatas", lambda m: m.cast("string"))
    return nested.select(
        "query_id",
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"),
        F.sha2(F.array_join("documents", ","), 256).alias("documents"),
        F.sha2(F.array_join(metadata, ","), 256).alias("metadatas"),
        F.round(F.aggregate("distances", F.lit(0.0), lambda a, d: a + d), 6).alias("distances"),
        F.size("distances").alias("n"),
    )


@query
def listing_lines(spark, sf):
    listed = records_of(document_records(spark, sf), "src3")
    optional = F.when(F.col("document").contains("the"), F.col("document")).alias("document")
    return search.listing_lines(listed.select("id", optional, "metadata")).select("id", F.sha2("value", 256).alias("digest"))


@query
def encode_tokens_joined(spark, sf):
    """The path for vocabularies beyond the broadcast bound; conversation ids repeat."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), "turn", F.col("text").alias("document"))
    encoded = tokens.encode_tokens(turns, vocabulary(spark, sf), max_vocabulary=0)
    zipped = F.arrays_zip("input_ids", "attention_mask", "token_type_ids")
    return encoded.select(
        F.col("id").alias("conv_id"), "turn", F.posexplode(zipped).alias("pos", "z")
    ).where("z.attention_mask = 1").select("conv_id", "turn", "pos", F.col("z.input_ids").alias("token_id"))


@query
def vector_distances(spark, sf):
    """Each vector and the next one, by every metric, as column expressions."""
    left = vectors(spark, sf).withColumnRenamed("embedding", "a")
    right = vectors(spark, sf).select((F.col("id") - 1).alias("id"), F.col("embedding").alias("b"))
    return left.join(right, "id").select(
        "id", *[F.round(distance(F.col("a"), F.col("b"), m), 6).alias(m) for m in ("l2", "cosine", "ip")]
    )


@query
def query_display(spark, sf):
    response = search.search_records(hashed_documents(spark, sf), benchmark_queries(spark, sf), RESULTS)
    numberless = F.regexp_replace("value", r"Dist: [0-9.]+", "Dist: ")
    return search.query_lines(response).select("query_id", "rank", F.sha2(numberless, 256).alias("digest"))


@query
def format_distances(spark, sf):
    hits = search.knn(vectors(spark, sf), vector_queries(spark, sf), RESULTS, "l2")
    return hits.select("query_id", "rank", format_distance(F.col("distance")).alias("shown"))
