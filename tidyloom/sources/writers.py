"""Sinks and output names."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.names import SCOPE, data_columns, drop_hidden, ref, scope_of
from tidyloom.operators.order import in_order, is_ordered

_CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "nullValue": "",
    # The CSV writer trims cells unless told not to.
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    *,
    keep_order: bool = True,
    source_column: str | None = None,
) -> None:
    """Write all rows, replacing the target folder; a missing cell becomes ``''``.

    ``keep_order`` sorts by the row order (if the table has one) so that the part
    files, read in the order of their names, give the rows in order. Without it the
    sort is saved. ``source_column`` splits a batch into one folder per source.
    """
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported format: {fmt}")
    if keep_order and is_ordered(df):
        df = in_order(df)
    text = [F.coalesce(ref(c), F.lit("")).alias(c) for c in data_columns(df)]
    if source_column is not None and source_column in data_columns(df):
        raise ValueError(f"the table has a column {source_column!r}: give another source_column")
    if source_column is not None and scope_of(df):
        writer = df.select(*text, ref(SCOPE).alias(source_column)).write
        writer = writer.partitionBy(source_column)
    else:
        writer = drop_hidden(df).select(*text).write
    writer = writer.mode("overwrite")
    if fmt == "csv":
        writer.options(**_CSV_OPTIONS).csv(path)
    else:
        writer.parquet(path)


def cleaned_name(
    name: str | None, extension: str, clock: Callable[[], datetime] = datetime.now
) -> str:
    """``{base}_cleaned_{yyyyMMdd_HHmmss}.{extension}``."""
    base = re.sub(r"\.[^/.]+$", "", name) if name else "cleaned_data"
    return f"{base}_cleaned_{clock():%Y%m%d_%H%M%S}.{extension}"
