"""Record and collection identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shoal.functions.json import get_nested

# The four text forms of a UUID that are taken as an id.
UUID_FORMS = (
    r"(?i)^(?:"
    r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    r"|urn:uuid:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    r"|\{[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}"
    r"|[0-9a-f]{32}"
    r")$"
)
HASH_ID_BYTES = 12


def hash_id(content: Column) -> Column:
    """First 12 bytes of SHA-256 of the content, as 24 hex digits."""
    return F.substring(F.sha2(content, 256), 1, 2 * HASH_ID_BYTES)


def choose_id(variant: Column, id_key: str, content: Column) -> Column:
    """The id field when present (an empty string is present), else the content hash."""
    return F.coalesce(get_nested(variant, id_key, "string"), hash_id(content))


def generated_id(run_ns: Column | int, index: Column) -> Column:
    """``id-<run nanoseconds>-<index>``; `run_ns` is read once per call, on the driver."""
    run = F.lit(run_ns) if isinstance(run_ns, int) else run_ns
    return F.concat(F.lit("id-"), run.cast("string"), F.lit("-"), index.cast("string"))


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID_FORMS)


def collection_uuid(tenant: Column, database: Column, name: Column) -> Column:
    """UUID-shaped id derived from the full name, the same on every retry."""
    digest = F.sha2(F.to_json(F.array(tenant, database, name)), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts])
