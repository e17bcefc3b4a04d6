"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# SQL settings the operators rely on or that keep large joins healthy.
SETTINGS = {
    # A repeated key in one JSON object keeps its last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "shoal", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the settings above; `conf` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def allow_duplicate_keys(spark: SparkSession) -> None:
    """Set the one SQL option that JSON parsing needs for right results."""
    key = "spark.sql.variant.allowDuplicateKeys"
    if spark.conf.get(key, "false") != "true":
        spark.conf.set(key, "true")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers, once per application.

    The archive is built on the driver and handed out by Spark's file service.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="shoal-"), "shoal"),
        "zip",
        root_dir=os.path.dirname(package),
        base_dir=os.path.basename(package),
    )
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    # Core settings cannot be set on a running session, so remember it here.
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="shoal-")
    return _local_dirs[application]


class Scratch:
    """Owner of staged paths: what is staged while it is the innermost one goes when it is closed.

    As a context it closes at the end of the block; a result that is still lazy
    must be written before that. `open` and `close` serve owners whose results
    are written by somebody else.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    @contextmanager
    def open(self) -> Iterator[Scratch]:
        token = _owner.set(self)
        try:
            yield self
        finally:
            _owner.reset(token)

    def close(self) -> None:
        while self.paths:
            remove_path(self.spark, self.paths.pop())

    def __enter__(self) -> Scratch:
        self._opened = self.open()
        return self._opened.__enter__()

    def __exit__(self, *error) -> None:
        self._opened.__exit__(*error)
        self.close()


_owner: ContextVar[Scratch | None] = ContextVar("scratch", default=None)
# What is staged outside of any owner.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder; it belongs to the innermost owner."""
    path = f"{shared_dir(spark)}/shoal/{purpose}-{uuid.uuid4().hex}"
    owner = _owner.get()
    (_scratch if owner is None else owner.paths).append(path)
    return path


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete one staged path before its owner closes."""
    owner = _owner.get()
    for paths in (_scratch, owner.paths if owner else []):
        if path in paths:
            paths.remove(path)
    remove_path(spark, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this process staged outside of any owner; call it once no DataFrame needs it any more."""
    while _scratch:
        remove_path(spark, _scratch.pop())


def stage(df: DataFrame, purpose: str, *by: str) -> DataFrame:
    """Write `df` once to the shared folder, in folders by the columns `by`, and read it back.

    Fixes values that depend on how rows fell into tasks (row slots), so that
    later passes agree with each other even after executors are lost.
    """
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# A scan of fewer tasks than this is about a gigabyte at most.
SPREAD_TASKS = 8


def spread(scan: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all cores.

    A small Parquet file is one row group and so one task, which is slow for
    steps that cost far more than moving the row. Scans of SPREAD_TASKS tasks or
    more stay where they are. For plain scans only: counting the tasks of a
    plan with shuffles would run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < min(cores, SPREAD_TASKS) else scan


def file_system(spark: SparkSession, path: str):
    """Spark's file system of a path, and the path as it knows it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, target = file_system(spark, path)
    stream = fs.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch or superseded folder through Spark's file system layer."""
    fs, target = file_system(spark, path)
    fs.delete(target, True)
