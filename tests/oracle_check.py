"""Compare registered queries with their SQL: python tests/oracle_check.py [sf_dir] [names…]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from shoal.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


# DuckDB column types and the Spark types that count as equal.
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "FLOAT": "float"}


def oracle(sf: str, sql: str) -> tuple[pd.DataFrame, dict[str, str]]:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    relation = con.sql(sql)
    types = {c: TYPES.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    return relation.df(), types


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for column in frame.columns:
        if frame[column].dtype.kind == "f":
            frame[column] = frame[column].round(6) + 0.0
    text = frame.astype(object).where(frame.notna(), None).map(str)
    order = text.sort_values(list(text.columns)).index
    return text.loc[order].reset_index(drop=True)


def differences(spark, sf: str, name: str) -> str | None:
    frame = entry.queries()[name](spark, sf)
    ours, types = frame.toPandas(), dict(frame.dtypes)
    theirs, sql_types = oracle(sf, entry.oracle_sql()[name])
    if types != sql_types:
        return f"columns {sorted(types.items())} != {sorted(sql_types.items())}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = normal(ours), normal(theirs)
    if a.equals(b):
        return None
    wrong = (a != b).any(axis=1)
    return f"{int(wrong.sum())} of {len(a)} rows differ, e.g.\n{a[wrong].head(2)}\n{b[wrong].head(2)}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            problem = differences(spark, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
