"""Where answers go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shoal.operators.search import query_lines


def write_query_text(response: DataFrame, path: str) -> None:
    """Write the display lines of a query answer, sorted by query and rank."""
    lines = query_lines(response)
    ordered = lines.repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank")
    ordered.select("value").write.mode("overwrite").text(path)


def write_query_json(response: DataFrame, path: str) -> None:
    """Write an answer, long or nested, as JSON lines."""
    response.write.mode("overwrite").json(path)


def write_rejected(rejected: DataFrame, path: str, epoch: int) -> None:
    """Write the lines that gave no record, with their reasons, next to the epoch they came with."""
    rejected.write.mode("overwrite").json(f"{path}/epoch={epoch}")
