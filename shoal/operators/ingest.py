"""From JSON lines to records: parse, reject, extract, limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from shoal.functions.binding import with_computed
from shoal.functions.ids import choose_id
from shoal.functions.json import (
    LINE_LIMIT_BYTES,
    get_nested,
    metadata_all_except,
    metadata_selected,
    parse_in_array,
    sole_object,
)
from shoal.operators.ordering import take_first
from shoal.session import allow_duplicate_keys, stage

CONTENT_KEY = "text"
ID_KEY = "id"
SOURCE_ORDER = ("file_path", "file_block_start", "line_seq")


def _or_default(key: str | None, default: str) -> str:
    return key or default


def classify_lines(lines: DataFrame, content_key: str = CONTENT_KEY) -> DataFrame:
    """Add `record` (VARIANT), `content`, `reason` and `line_seq` to every line.

    `reason` is NULL for an accepted line, else ``line_too_long``, ``malformed``
    or ``no_content``. `line_seq` grows along each input block.
    """
    allow_duplicate_keys(lines.sparkSession)
    too_long = F.octet_length("value") >= LINE_LIMIT_BYTES
    parsed = with_computed(lines, _parsed=F.when(~too_long, parse_in_array(F.col("value"))))
    checked = with_computed(parsed, record=sole_object(F.col("value"), F.col("_parsed")))
    return checked.select(
        *lines.columns,
        F.monotonically_increasing_id().alias("line_seq"),
        "record",
        get_nested(F.col("record"), _or_default(content_key, CONTENT_KEY), "string").alias("content"),
    ).withColumn(
        "reason",
        F.when(too_long, F.lit("line_too_long"))
        .when(F.col("record").isNull(), F.lit("malformed"))
        .when(F.col("content").isNull(), F.lit("no_content")),
    )


def parse_records(lines: DataFrame) -> DataFrame:
    """Lines that hold exactly one JSON object, with the object as `record`."""
    classified = classify_lines(lines)
    return classified.where(F.col("record").isNotNull()).drop("reason", "content", "value")


def require_content(records: DataFrame, content_key: str = CONTENT_KEY) -> DataFrame:
    """Drop records whose content path is missing or null; keep empty strings."""
    content = get_nested(F.col("record"), _or_default(content_key, CONTENT_KEY), "string")
    return records.withColumn("content", content).where(F.col("content").isNotNull())


def rejected_records(lines: DataFrame, content_key: str = CONTENT_KEY) -> DataFrame:
    """The lines that yield no record, each with its reason."""
    rejected = classify_lines(lines, content_key).where(F.col("reason").isNotNull())
    return rejected.drop("record", "content")


def metadata_column(
    record: Column,
    all_metadata: bool = False,
    metadata_keys: Sequence[str] = (),
    content_key: str = CONTENT_KEY,
    id_key: str = ID_KEY,
) -> Column:
    """All other keys if asked for, else the listed ones, else an empty object."""
    if all_metadata:
        return metadata_all_except(record, content_key, id_key)
    return metadata_selected(record, metadata_keys)


def extract_records(
    records: DataFrame,
    *,
    content_key: str = CONTENT_KEY,
    id_key: str = ID_KEY,
    all_metadata: bool = False,
    metadata_keys: Sequence[str] = (),
) -> DataFrame:
    """`id`, `document` and `metadata` of every record that has content."""
    content_key = _or_default(content_key, CONTENT_KEY)
    id_key = _or_default(id_key, ID_KEY)
    with_content = require_content(records, content_key)
    others = [c for c in with_content.columns if c not in ("value", "record", "content", "reason")]
    return with_content.select(
        choose_id(F.col("record"), id_key, F.col("content")).alias("id"),
        F.col("content").alias("document"),
        metadata_column(F.col("record"), all_metadata, metadata_keys, content_key, id_key).alias("metadata"),
        *others,
    )


def split_lines(
    lines: DataFrame,
    *,
    content_key: str = CONTENT_KEY,
    id_key: str = ID_KEY,
    all_metadata: bool = False,
    metadata_keys: Sequence[str] = (),
    n_ingest: int = 0,
    order_by: Sequence[str] = SOURCE_ORDER,
) -> tuple[DataFrame, DataFrame]:
    """Records and rejected lines from one pass over `lines`.

    What both are read from is staged by outcome: an accepted line keeps its
    record's columns only, a rejected one its text and reason.
    """
    content_key, id_key = _or_default(content_key, CONTENT_KEY), _or_default(id_key, ID_KEY)
    others = [c for c in lines.columns if c != "value"]
    accepted = F.col("reason").isNull()
    outcome = classify_lines(lines, content_key).select(
        accepted.alias("accepted"),
        F.when(accepted, choose_id(F.col("record"), id_key, F.col("content"))).alias("id"),
        F.when(accepted, F.col("content")).alias("document"),
        F.when(accepted, metadata_column(F.col("record"), all_metadata, metadata_keys, content_key, id_key)).alias("metadata"),
        F.when(~accepted, F.col("value")).alias("value"),
        "reason", "line_seq", *others,
    )
    staged = stage(outcome, "lines", "accepted")
    records = staged.where("accepted").select("id", "document", "metadata", *others, "line_seq")
    rejected = staged.where("NOT accepted").select(*lines.columns, "line_seq", "reason")
    return take_first(records, n_ingest, order_by), rejected


def import_records(
    lines: DataFrame,
    *,
    content_key: str = CONTENT_KEY,
    id_key: str = ID_KEY,
    all_metadata: bool = False,
    metadata_keys: Sequence[str] = (),
    n_ingest: int = 0,
    order_by: Sequence[str] = SOURCE_ORDER,
) -> DataFrame:
    """Accepted records of `lines` in one pass, cut to the first `n_ingest` if positive.

    Columns of `lines` other than `value` are kept, so the order key survives.
    """
    extracted = extract_records(
        parse_records(lines),
        content_key=content_key,
        id_key=id_key,
        all_metadata=all_metadata,
        metadata_keys=metadata_keys,
    )
    return take_first(extracted, n_ingest, order_by)
