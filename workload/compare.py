"""Run queries in Spark and in DuckDB and compare the rows regardless of order."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame


def duckdb_on(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def differences(df: DataFrame, connection, sql: str) -> list[str]:
    """Empty if both give the same rows under the same column names."""
    relation = connection.sql(sql)
    columns = sorted(df.columns)
    if columns != sorted(relation.columns):
        return [f"columns {columns} != {sorted(relation.columns)}"]
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    theirs = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    found = [] if len(mine) == len(theirs) else [f"rows {len(mine)} != {len(theirs)}"]
    pairs = zip(mine, theirs, strict=False)
    return found + [f"{m} != {t}" for m, t in pairs if m != t][:3]
