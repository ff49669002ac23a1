"""Replacing cells in place, with an optional per-row count of changed cells."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.names import ref


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold(combine: Callable[[Column, Column], Column], parts: Sequence[Column]) -> Column:
    """Combine in pairs: over a wide table a chain would be too deep for the planner."""
    while len(parts) > 1:
        pairs = zip(parts[::2], parts[1::2], strict=False)
        parts = [combine(a, b) for a, b in pairs] + list(parts[len(parts) - len(parts) % 2 :])
    return parts[0]


def count_true(flags: Sequence[Column]) -> Column:
    """How many of the conditions hold in a row."""
    return fold(add, [f.cast("int") for f in flags]) if flags else F.lit(0)


def replace_cells(
    df: DataFrame, new: Mapping[str, Column], tally: str | None = None
) -> DataFrame:
    """Replace columns by expressions, all in one projection.

    With ``tally`` the number of cells whose text changed is kept in a hidden
    column; it costs nothing unless statistics are asked for, because an unused
    column is pruned.
    """
    replaced = dict(new)
    if tally is not None:
        replaced[tally] = count_true([_text(ref(c)) != _text(e) for c, e in new.items()])
    return df.withColumns(replaced) if replaced else df
