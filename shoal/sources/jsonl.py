"""JSON-lines sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from shoal.session import file_system

SOURCE_COLUMNS = ("value", "file_path", "file_block_start")


def _with_source(lines: DataFrame) -> DataFrame:
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block_start"),
    )


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of one or more text files with the file and block they come from.

    Lines end at a newline only; a carriage return before it stays in the
    value, where JSON treats it as white space.
    """
    return _with_source(spark.read.option("lineSep", "\n").text(path))


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files of a folder in name order with their bytes; hidden ones are left out."""
    fs, target = file_system(spark, path)
    found = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(target) if s.isFile()]
    return sorted(f for f in found if not f[0].rpartition("/")[2].startswith(("_", ".")))


def stream_jsonl(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same columns as a stream over the files that arrive in a folder."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _with_source(reader.text(path))
