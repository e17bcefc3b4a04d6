"""Continuous import of JSON-lines files into a record log."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from shoal.operators.embed import Embedder, embed_documents
from shoal.operators.ingest import CONTENT_KEY, ID_KEY, import_records, split_lines
from shoal.session import Scratch, allow_duplicate_keys, read_text
from shoal.sources.jsonl import stream_jsonl
from shoal.sources.sinks import write_rejected
from shoal.sources.store import write_records


def stream_import(
    spark: SparkSession,
    source: str,
    log_path: str,
    checkpoint: str,
    collection_id: str,
    *,
    embedder: Embedder | None = None,
    content_key: str = CONTENT_KEY,
    id_key: str = ID_KEY,
    all_metadata: bool = False,
    metadata_keys: Sequence[str] = (),
    n_ingest: int = 0,
    max_files_per_trigger: int | None = None,
    processing_time: str | None = None,
    rejects_path: str | None = None,
) -> StreamingQuery:
    """Start importing the files of a folder, those there now and those to come.

    Each micro-batch becomes one commit of the log, named by the query's id, which
    its checkpoint keeps, and the batch number. A batch that is run again after
    a failure is committed once, and no other writer can take its place. Without
    `processing_time` the query stops once the files present are imported. With
    `rejects_path` the lines that give no record are written there.
    """
    if n_ingest > 0:
        raise ValueError("a stream has no first n records; use a batch import for n_ingest")
    allow_duplicate_keys(spark)

    def write_batch(lines: DataFrame, epoch: int) -> None:
        options = dict(content_key=content_key, id_key=id_key, all_metadata=all_metadata, metadata_keys=metadata_keys)
        writer = json.loads(read_text(spark, f"{checkpoint}/metadata"))["id"]
        with Scratch(spark):
            rejected = None
            if rejects_path:
                records, rejected = split_lines(lines, **options)
            else:
                records = import_records(lines, **options)
            records = records.withColumn("collection_id", F.lit(collection_id))
            if embedder is not None:
                records = embed_documents(records, embedder)
            write_records(records, log_path, writer, epoch, width=embedder.dim if embedder is not None else None)
            if rejected is not None:
                write_rejected(rejected, rejects_path, epoch)

    lines = stream_jsonl(spark, source, max_files_per_trigger)
    writer = lines.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
    return writer.trigger(**trigger).start()
