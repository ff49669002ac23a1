"""Duplicate rows.

One shuffle, on the key, of rows already reduced on the map side: each task sends
at most one row per key, so a key that holds a third of the table does not pile up
in one task. There is no window and no join back to the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.functions.text import comparable
from tidyloom.names import BLOCK, CHUNK, FILE, HIDDEN, ROW, data_columns, known, ref, refs, scope_of
from tidyloom.operators.order import packed, position, require_order, unpacked

_PICK = HIDDEN + "pick"
_COUNT = HIDDEN + "count"


def dedup_rows(
    df: DataFrame,
    mode: str = "wholeRow",
    columns: Sequence[str] = (),
    keep: str = "first",
    normalize_text: bool = False,
) -> DataFrame:
    """One row per key: the first, the last, none of a repeated key, or any.

    The key is the whole row or the listed columns (nothing happens if none of them
    exists). ``normalize_text`` compares trimmed lower-case text and returns the
    original. ``any`` takes the smallest row, so a recomputed task picks the same.
    """
    keys = data_columns(df) if mode == "wholeRow" else known(df, columns)
    if not keys:
        return df
    if keep in ("first", "last"):
        require_order(df, f"dedup keep={keep}")
    scope = scope_of(df)
    if normalize_text:
        grouping = [comparable(ref(c)).alias(f"{HIDDEN}key{i}") for i, c in enumerate(keys)]
        rest = [c for c in df.columns if c not in scope]
    else:
        grouping = refs(keys)
        rest = [c for c in df.columns if c not in scope and c not in keys]

    if rest and set(rest) <= {ROW, CHUNK} and _is_number(df, ROW):
        # Whole rows: only the position is left. The chunk rises with the row number,
        # so both can be reduced on their own, in a hash aggregation.
        best = F.max if keep == "last" else F.min
        picks = {c: best(ref(c)) for c in rest}
    elif rest and set(rest) <= {FILE, BLOCK, ROW, CHUNK} and all(_is_number(df, c) for c in rest):
        # Whole rows from files: the position is one number, again in a hash aggregation.
        best = F.max if keep == "last" else F.min
        picks = {_PICK: best(packed(df))}
    elif rest:
        row = _pick(df, rest, keep)
        picks = {_PICK: row}
    else:
        picks = {}
    if keep == "none":
        picks[_COUNT] = F.count("*")
    grouped = df.select("*", *grouping) if normalize_text else df
    names = scope + ([f"{HIDDEN}key{i}" for i in range(len(keys))] if normalize_text else keys)
    if not picks:
        kept = grouped.select(refs(names)).distinct()
    else:
        kept = grouped.groupBy(*refs(names)).agg(*[e.alias(n) for n, e in picks.items()])
    if keep == "none":
        kept = kept.where(ref(_COUNT) == 1)
    if rest and _PICK in picks and not isinstance(kept.schema[_PICK].dataType, T.StructType):
        place = unpacked(df, ref(_PICK))
        return kept.select([place[c].alias(c) if c in place else ref(c) for c in df.columns])
    return kept.select(
        [ref(_PICK)[c].alias(c) if c in rest and c not in picks else ref(c) for c in df.columns]
    )


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.IntegralType)


def _pick(df: DataFrame, rest: Sequence[str], keep: str) -> Column:
    """The columns outside the key, from the row of a group that is kept."""
    row = F.struct(*refs(rest))
    if keep == "first":
        return F.min_by(row, position(df))
    if keep == "last":
        return F.max_by(row, position(df))
    # `none` keeps only groups of one row, where the smallest row is that row.
    return F.min(row)
