"""Record tables on a shared file system.

Parquet cannot replace single rows, so a table is a log of writes
(`sources.commit_log`) over folders of data:

``data/write=<uuid>``  the rows of one write, one row per id, by collection and bucket.

The current state is the newest base, less the ids that later commits hold,
plus the last row per id of those. The first write of a table is a base, so a
table that was imported once is scanned in place. A bucket is a hash of
(collection, id) modulo the write's number of buckets, a power of two: whoever
looks for given ids reads the files of their buckets only.
"""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from shoal.operators.lookup import fits_broadcast
from shoal.operators.upsert import RECORD_KEYS, first_wins, last_wins, unmatched
from shoal.schemas import LOG_ORDER, LOG_RECORD, RECORD
from shoal.session import file_system, remove_path
from shoal.sources.commit_log import Commit, Conflict, Log, add_commit, commits, find_batch, read_log

__all__ = [
    "Commit", "Conflict", "Log", "commits", "read_log", "append_commit", "write_records", "insert_records", "current_records",
    "records_with_keys", "list_records", "collection_width", "compact", "vacuum",
]

# Commits since the last base from which an import should be followed by `compact`.
COMPACT_AFTER = 20
# Rows of a base that share a bucket, and buckets of a base at most.
ROWS_PER_BUCKET, MOST_BUCKETS = 250_000, 4096
# Rows of a collection and bucket that a compaction hands to one task, about.
ROWS_PER_TASK = 16_384
# A compaction writes all rows again, so files are packed more closely than by the default.
CODEC = "zstd"
# Data that no current state holds is deleted once it is so old.
KEEP_SECONDS = 7 * 24 * 3600


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])


def bucket_of(buckets: int | Column) -> Column:
    """Bucket of a row by its key."""
    count = F.lit(buckets) if isinstance(buckets, int) else buckets
    return F.pmod(F.xxhash64(*RECORD_KEYS), count.cast("long")).cast("int")


def buckets_for(records: int) -> int:
    """Number of buckets of a base of so many rows."""
    wanted = -(-records // ROWS_PER_BUCKET)
    return min(MOST_BUCKETS, 1 << max(0, wanted - 1).bit_length())


def _write(rows: DataFrame, path: str, buckets: int = 1) -> None:
    """Write rows by collection and bucket; rows that have a `bucket` are placed already."""
    placed = "bucket" in rows.columns
    if not placed:
        # Rebalancing splits a collection that holds most rows over several files
        # and packs small collections together.
        rows = rows.withColumn("bucket", bucket_of(buckets))
        rows = rows.hint("rebalance", "collection_id", *["bucket"] * (buckets > 1))
    if buckets > 1:
        # sorted by id, row groups that cannot hold an id are skipped within a file
        rows = rows.sortWithinPartitions("collection_id", "bucket", "id")
    rows.write.partitionBy("collection_id", "bucket").option("compression", CODEC).parquet(path)


def _folded(spark: SparkSession, path: str, log: Log, buckets: int) -> DataFrame:
    """The current rows as of a reading of the log, placed for a base of so many buckets; every row travels once.

    The shuffle that brings the rows of a key together places them for the files,
    too: by collection and bucket, large ones in parts of about ROWS_PER_TASK.
    A null in a key equals nothing, so all rows of a base with one stay.
    """
    stored = _folders(spark, path, [c for c in [log.base, *log.deltas] if c is not None])
    # the collection is a folder, so counting reads no column
    parts = F.ceil(F.count("*") / (buckets * ROWS_PER_TASK))
    large = stored.groupBy(F.col("collection_id").alias("of")).agg(parts.alias("parts")).where("parts > 1")
    base = F.col("commit") == (log.base.number if log.base else -1)
    part = F.pmod(F.xxhash64(F.lit("part"), *RECORD_KEYS), F.coalesce("parts", F.lit(1).cast("long")))
    place = ["collection_id", "bucket", "part"]
    rows = stored.join(F.broadcast(large), F.col("collection_id").eqNullSafe(F.col("of")), "left")
    rows = rows.withColumns({
        "bucket": bucket_of(buckets), "part": part, "apart": base & (F.col("collection_id").isNull() | F.col("id").isNull()),
    }).repartition(*place)
    latest = Window.partitionBy(*place, "id", "apart").orderBy(base, F.col("commit").desc())
    rows = rows.withColumn("_n", F.row_number().over(latest)).where((F.col("_n") == 1) | F.col("apart"))
    return rows.select(*RECORD.names, "bucket")


def append_commit(spark: SparkSession, path: str, folder: str, records: int) -> Commit:
    """Commit a folder of rows as a write of its own."""
    return add_commit(spark, path, Commit(-1, "delta", folder, 0, folder, records))


def _checked_width(rows: DataFrame, width: int | None) -> DataFrame:
    """Fail the job at a vector of another width."""
    if width is None:
        return rows
    wrong = F.concat(F.lit("record '"), F.col("id"), F.lit(f"' has a vector of another width than {width}"))
    right = F.col("embedding").isNull() | (F.size("embedding") == width)
    return rows.withColumn("embedding", F.when(right, F.col("embedding")).otherwise(F.raise_error(wrong)))


def write_records(
    records: DataFrame,
    path: str,
    writer: str | None = None,
    batch: int = 0,
    *,
    buckets: int = 1,
    width: int | None = None,
) -> Commit:
    """Append one write to a table; a later row replaces an earlier one of its id.

    `records` of the commit counts the rows given, repeated ids included.
    A batch that (writer, batch) has committed already is not written again.
    Without `writer` the write is one of its own. With `width` a vector of
    another width fails the write. `buckets`, a power of two, is worth giving
    for a large first import; `compact` chooses its own.
    """
    spark = records.sparkSession
    if writer is not None:
        done = find_batch(spark, read_log(spark, path), writer, batch)
        if done is not None:
            return done
    folder = uuid.uuid4().hex
    order = [c for c in LOG_ORDER if c != "commit"]
    given = Observation()
    rows = _conform(records, T.StructType([f for f in LOG_RECORD.fields if f.name != "commit"]))
    rows = last_wins(rows.observe(given, F.count(F.lit(1)).alias("n")), order=order)
    _write(_checked_width(rows.select(*RECORD.names), width), f"{path}/data/write={folder}", buckets)
    try:
        n = given.get["n"]
    except Py4JJavaError:  # a plan that turns out empty has nothing to observe
        n = 0
    return add_commit(spark, path, Commit(-1, "delta", writer or folder, batch, folder, n, buckets=buckets))


def insert_records(records: DataFrame, path: str, seen: Log | None = None, *, width: int | None = None) -> Commit | None:
    """Append the records whose id is new; of a repeated id the first. None if nothing is new.

    `seen` is the log as it was when the caller last looked for new ids, if it did.
    What others commit until this write is committed is looked at again just
    before: ids that they hold are taken out, so that what exists stays, whoever
    adds at the same time.
    """
    spark = records.sparkSession
    rows = _conform(records, T.StructType([f for f in LOG_RECORD.fields if f.name != "commit"]))
    rows = first_wins(rows, order=[c for c in LOG_ORDER if c != "commit"]).select(*RECORD.names)
    folder = uuid.uuid4().hex
    if seen is None:
        seen = read_log(spark, path)
        _write(_checked_width(rows, width), f"{path}/data/write={folder}")
        folder, n = _without(spark, path, folder, records_with_keys(spark, path, _rows(spark, path, folder), seen))
    else:
        _write(_checked_width(rows, width), f"{path}/data/write={folder}")
        n = _rows(spark, path, folder).count()
    if not n:
        remove_path(spark, f"{path}/data/write={folder}")
        return None
    looked = [seen.settled]

    def check(log: Log) -> Commit | None:
        nonlocal folder, n
        if log.after > looked[0]:  # the checkpoint may leave out what a base covers by now
            log = read_log(spark, path, every=True)
        # a base holds what was there before; new ids come with deltas only
        news = [c for c in log.commits if c.number > looked[0] and (c.kind == "delta" or c.number == 0)]
        looked[0] = log.settled
        if news:
            folder, n = _without(spark, path, folder, _folders(spark, path, news))
        if not n:
            raise Conflict("every id was added by others meanwhile")
        return entry._replace(folder=folder, records=n)

    entry = Commit(-1, "delta", folder, 0, folder, n)
    try:
        return add_commit(spark, path, entry, check)
    except Conflict:
        remove_path(spark, f"{path}/data/write={folder}")
        return None


def _rows(spark: SparkSession, path: str, folder: str) -> DataFrame:
    return _folders(spark, path, [Commit(0, "delta", "", 0, folder, 0)]).drop("commit")


def _without(spark: SparkSession, path: str, folder: str, others: DataFrame) -> tuple[str, int]:
    """The folder, or a new one in its place, without the ids of others; and its rows."""
    mine = _rows(spark, path, folder)
    before, left = mine.count(), unmatched(mine, others)
    n = left.count()
    if n == before:
        return folder, n
    fresh = uuid.uuid4().hex
    _write(left, f"{path}/data/write={fresh}")
    remove_path(spark, f"{path}/data/write={folder}")
    return fresh, n


def _folders(spark: SparkSession, path: str, of: list[Commit], touched: set[int] | None = None) -> DataFrame:
    """Rows of some writes with the number of their commit; of `touched` buckets only, given modulo the most there are."""
    schema = T.StructType([*RECORD.fields, T.StructField("commit", T.LongType())])
    if not of:
        return spark.createDataFrame([], schema)
    fields = T.StructType([*RECORD.fields, T.StructField("bucket", T.IntegerType()), T.StructField("write", T.StringType())])
    reader = spark.read.schema(fields).option("basePath", f"{path}/data")
    rows = reader.parquet(*[f"{path}/data/write={c.folder}" for c in of])
    if touched is not None:
        # partition columns only, so that files of other buckets are not opened
        wanted = F.lit(False)
        for buckets in {c.buckets for c in of}:
            folders = [c.folder for c in of if c.buckets == buckets]
            inside = F.col("bucket").isin(sorted({t % buckets for t in touched}))
            wanted = wanted | (F.col("write").isin(folders) & inside)
        rows = rows.where(wanted)
    number = F.lit(of[0].number)
    if len(of) > 1:
        number = F.create_map(*[F.lit(x) for c in of for x in (c.folder, c.number)])[F.col("write")]
    return rows.select(*RECORD.names, number.cast("long").alias("commit"))


def _current(spark: SparkSession, path: str, log: Log, where: Column | None, touched: set[int] | None = None) -> DataFrame:
    base = _folders(spark, path, [log.base] if log.base else [], touched).drop("commit")
    deltas = log.deltas
    later = _folders(spark, path, deltas, touched)
    if where is not None:
        base, later = base.where(where), later.where(where)
    # one write holds each id once
    latest = last_wins(later, order=("commit",)) if len(deltas) > 1 else later
    latest = latest.select(*RECORD.names)
    if log.base is None:
        return latest
    if not deltas:
        return base
    return unmatched(base, latest).unionByName(latest)


def current_records(spark: SparkSession, path: str, collection_id: str | None = None, log: Log | None = None) -> DataFrame:
    """The last row per id, as of now or of a reading of the log; one collection's folders only, if one is named."""
    where = None if collection_id is None else F.col("collection_id") == collection_id
    return _current(spark, path, log or read_log(spark, path), where)


def records_with_keys(spark: SparkSession, path: str, keys: DataFrame, log: Log | None = None) -> DataFrame:
    """Current records with the given (collection_id, id); files of other buckets are not read.

    The buckets that the keys fall into come to the driver, MOST_BUCKETS numbers at most.
    """
    log = log or read_log(spark, path)
    keys = keys.select(*RECORD_KEYS)
    live = [c for c in [log.base, *log.deltas] if c is not None]
    most = max([c.buckets for c in live], default=1)
    touched = None
    if most > 1:
        touched = {r[0] for r in keys.select(bucket_of(most)).distinct().collect()}
    found = _current(spark, path, log, None, touched)
    keys = keys.distinct()
    return found.join(F.broadcast(keys) if fits_broadcast(keys) else keys, list(RECORD_KEYS), "left_semi").select(*RECORD.names)


def list_records(records: DataFrame, collection_id: str, include: tuple[str, ...] = ("document", "metadata")) -> DataFrame:
    """Ids and the asked-for columns of one collection; vectors are read only if asked for."""
    return records.where(F.col("collection_id") == collection_id).select("id", *include)


def collection_width(spark: SparkSession, path: str, collection_id: str) -> int | None:
    """Width of the vectors a collection holds, from the first one met; None if it has none."""
    log = read_log(spark, path)
    live = [c for c in [log.base, *log.deltas] if c is not None]
    rows = _folders(spark, path, live).where((F.col("collection_id") == collection_id) & F.col("embedding").isNotNull())
    first = rows.select(F.size("embedding")).head()
    return first[0] if first else None


def compact(spark: SparkSession, path: str, buckets: int | None = None, seen: Log | None = None) -> Commit | None:
    """Fold the newest base and the commits after it into a new base.

    The base covers every number up to the last commit that it was made from; a
    write that is committed meanwhile stays. It is refused if another base was
    committed since this one was begun: then what was written is dropped and the
    other base returned. Nothing that readers may have planned over is deleted;
    see `vacuum`. A stop at any point leaves the current state as it was. `seen`
    is an earlier reading of the log to fold, instead of the newest.
    """
    log = seen or read_log(spark, path)
    log = log._replace(commits=[c for c in log.commits if c.number <= log.settled])
    if not log.deltas:
        return log.base
    if buckets is None:
        buckets = buckets_for(sum(c.records for c in [log.base, *log.deltas] if c is not None))
    folder = uuid.uuid4().hex
    _write(_folded(spark, path, log, buckets), f"{path}/data/write={folder}", buckets)
    n = _folders(spark, path, [Commit(0, "base", "", 0, folder, 0)]).count()

    def check(now: Log) -> None:
        if now.base != log.base:
            raise Conflict(f"base {now.base.number} was committed meanwhile")

    try:
        return add_commit(spark, path, Commit(-1, "base", folder, 0, folder, n, covers=log.settled, buckets=buckets), check)
    except Conflict:
        remove_path(spark, f"{path}/data/write={folder}")
        return read_log(spark, path).base


def vacuum(spark: SparkSession, path: str, older_than: float = KEEP_SECONDS) -> list[str]:
    """Delete what no current state needs and is older than so many seconds; returns the names.

    That is data that a newer base holds, data of writes that never were
    committed, commit files that a checkpoint holds and checkpoints before it.
    Readers and writers that began before that time must be done.
    """
    log = read_log(spark, path)
    live = {f"write={c.folder}" for c in [log.base, *log.deltas] if c is not None}
    now, gone = time.time(), []

    def old(folder: str):
        fs, target = file_system(spark, folder)
        for status in fs.listStatus(target) if fs.exists(target) else []:
            if now - status.getModificationTime() / 1000 >= older_than:
                yield status.getPath().getName()

    gone += [f"data/{name}" for name in old(f"{path}/data") if name not in live]
    for name in old(f"{path}/log"):
        number, _, kind = name.partition(".")
        if number.isdigit() and (int(number) < log.after or (kind == "json" and int(number) == log.after)):
            gone.append(f"log/{name}")
    for name in gone:
        remove_path(spark, f"{path}/{name}")
    return gone
