"""The data model: every data column is text, and a missing cell is ``''``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.names import data_columns, hidden_columns, ref, refs


def to_text_table(df: DataFrame) -> DataFrame:
    """Cast every data column to text and null to ``''``; keep hidden columns as they are."""
    text = [F.coalesce(ref(c).cast("string"), F.lit("")).alias(c) for c in data_columns(df)]
    return df.select(*text, *refs(hidden_columns(df)))
