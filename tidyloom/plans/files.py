"""From a file to a preview or to a cleaned file."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import SparkSession

from tidyloom.plans.clean import CleanResult, clean
from tidyloom.plans.preview import PREVIEW_ROWS, preview_document
from tidyloom.rules import CleaningRules
from tidyloom.sources.readers import load
from tidyloom.sources.writers import cleaned_name, write

Rules = str | Mapping[str, Any] | CleaningRules


def preview_file(
    spark: SparkSession, path: str, rules: Rules, rows: int = PREVIEW_ROWS, **reading: Any
) -> dict[str, Any]:
    """Clean a whole file; return its statistics, columns and first rows."""
    return preview_document(clean(load(spark, path, **reading), rules, cuts="always"), rows)


def export_file(
    spark: SparkSession,
    path: str,
    rules: Rules,
    folder: str,
    fmt: str = "csv",
    *,
    keep_order: bool = True,
    clock: Callable[[], datetime] = datetime.now,
    **reading: Any,
) -> str:
    """Clean a whole file and write all rows below ``folder``; return where."""
    result = clean(load(spark, path, **reading), rules)
    return _written(result, path, folder, fmt, keep_order, clock)


def export_with_stats(
    spark: SparkSession,
    path: str,
    rules: Rules,
    folder: str,
    fmt: str = "csv",
    *,
    keep_order: bool = True,
    clock: Callable[[], datetime] = datetime.now,
    **reading: Any,
) -> tuple[str, dict[str, int]]:
    """``export_file``, and the statistics. The rules are evaluated once: both are read from the table that they gave.

    The statistics are sums over rows of a table that was committed, so a task that was run again counts once.
    """
    result = clean(load(spark, path, **reading), rules, cuts="always")
    target = _written(result, path, folder, fmt, keep_order, clock)
    return target, result.stats.first().asDict()


def _written(
    result: CleanResult, path: str, folder: str, fmt: str, keep_order: bool, clock: Callable[[], datetime]
) -> str:
    name = path.rstrip("/").rpartition("/")[2]
    target = f"{folder.rstrip('/')}/{cleaned_name(name, fmt, clock)}"
    write(result.ordered, target, fmt, keep_order=keep_order)
    return target
