"""Looking at the first rows of a cleaned table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.names import data_columns, drop_hidden, ref
from tidyloom.operators.order import in_order, is_ordered
from tidyloom.plans.clean import CleanResult

# Rows of a preview, and what of it fits on a screen.
PREVIEW_ROWS = 100
SCREEN_ROWS, SCREEN_COLUMNS = 50, 20


def preview(result: CleanResult, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows of the whole cleaned table, in row order: a top-k, not a sort."""
    df = result.ordered
    return drop_hidden((in_order(df) if is_ordered(df) else df).limit(rows))


def clip(page: DataFrame, rows: int = SCREEN_ROWS, columns: int = SCREEN_COLUMNS) -> DataFrame:
    """The part of a preview page that is shown: its first rows and columns."""
    return page.select([ref(c) for c in page.columns[:columns]]).limit(rows)


def preview_document(result: CleanResult, rows: int = PREVIEW_ROWS) -> dict[str, Any]:
    """Statistics, column list and first rows as one small document."""
    page = preview(result, rows)
    text = page.select([F.coalesce(ref(c), F.lit("")).alias(c) for c in page.columns])
    stats = result.stats.first()
    return {
        "stats": {} if stats is None else stats.asDict(),
        "data": {
            "columns": data_columns(result.ordered),
            "rows": [row.asDict() for row in text.collect()],
        },
    }
