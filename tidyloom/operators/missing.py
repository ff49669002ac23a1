"""Missing values that can be decided from one row: defaults and empty rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.whitespace import is_blank
from tidyloom.names import HIDDEN, known, ref, resolve
from tidyloom.operators.cells import fold, replace_cells

_WANTED = HIDDEN + "wanted"


def fill_default(
    df: DataFrame,
    columns: Sequence[str],
    values: Mapping[str, str],
    only_when_empty: bool = True,
    trim: bool = True,
    tally: str | None = None,
) -> DataFrame:
    """Blank cells take the default of their column (``''`` if none is given)."""

    def filled(c: str) -> Column:
        default = F.lit(values.get(c, ""))
        if not only_when_empty:
            return default
        return F.when(is_blank(ref(c), trim), default).otherwise(ref(c))

    return replace_cells(df, {c: filled(c) for c in known(df, columns)}, tally)


def empty_row(
    df: DataFrame,
    condition: str = "all",
    columns_mode: str = "all",
    columns: Sequence[str] = (),
    trim: bool = True,
) -> Column:
    """True for rows to remove: all target cells blank, or at least one."""
    targets = resolve(df, columns_mode, columns)
    if not targets:
        return F.lit(False)
    blanks = [is_blank(ref(c), trim) for c in targets]
    return fold(and_ if condition == "all" else or_, blanks)


def drop_rows(df: DataFrame, unwanted: Column) -> DataFrame:
    """Remove rows by a test of cells that were computed at some cost.

    A plain filter would be moved in front of the projections it depends on, and all
    their expressions be evaluated twice. It stays behind a projection that depends on
    the task, if only in form.
    """
    wanted = ~unwanted & (F.spark_partition_id() >= 0)
    return df.withColumn(_WANTED, wanted).where(ref(_WANTED)).drop(_WANTED)
