"""Column operators: drop, split, merge, remove empty, rename.

Each returns the new DataFrame and how many columns it affected; the counts that
do not depend on the rows are known when the plan is built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.functions.whitespace import WHITE_SPACE, is_blank, split_ws, unless_blank
from tidyloom.names import data_columns, hidden_columns, known, ref, refs, require_free
from tidyloom.operators.cells import count_true

#: Rows that are looked at before a column is evaluated in full.
LOOK_ROWS = 1000


def _strip(name: str) -> str:
    return name.strip(WHITE_SPACE)


def _without(df: DataFrame, gone: Sequence[str]) -> DataFrame:
    return df.select(refs(c for c in df.columns if c not in gone))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, int]:
    """Drop the listed columns; unknown names are ignored."""
    gone = known(df, columns)
    return (_without(df, gone) if gone else df), len(gone)


def split_column(
    df: DataFrame,
    column: str,
    separator: str,
    into: Sequence[str],
    keep_original: bool = True,
) -> tuple[DataFrame, int]:
    """The k-th part of a cell goes to the k-th target, ``''`` if there is none.

    The separator is literal; a blank one means runs of white space in the trimmed
    cell. A target that exists already is left as it is but keeps its position.
    """
    source = _strip(column)
    targets = [_strip(t) for t in into if _strip(t)]
    require_free(targets)
    have = set(data_columns(df))
    if source not in have or not targets:
        return df, 0
    cell = F.coalesce(ref(source), F.lit(""))
    parts = split_ws(cell)

    def part(k: int) -> Column:
        if _strip(separator):
            return F.split_part(cell, F.lit(separator), F.lit(k + 1))
        return F.coalesce(F.get(parts, F.lit(k)), F.lit(""))

    added: dict[str, Column] = {}
    for k, target in enumerate(targets):
        if target not in have and target not in added:
            added[target] = part(k)
    df = df.withColumns(added) if added else df
    return (df if keep_original else _without(df, [source])), len(added)


def merge_columns(
    df: DataFrame,
    columns: Sequence[str],
    separator: str,
    into: str,
    drop_sources: bool = False,
    tally: str | None = None,
) -> tuple[DataFrame, int]:
    """Join the non-blank cells, untrimmed. An existing target is replaced in place.

    Returns the number of dropped sources. ``tally`` marks rows with a value.
    """
    target = _strip(into)
    require_free([target])
    have = set(data_columns(df))
    sources = [c for c in columns if c in have]
    if not target or not sources:
        return df, 0
    new = {target: F.concat_ws(separator, *[unless_blank(ref(c)) for c in sources])}
    if tally is not None:
        filled = [~is_blank(ref(c)) for c in sources]
        new[tally] = (count_true(filled) > 0).cast("int")
    df = df.withColumns(new)
    gone = [c for c in dict.fromkeys(sources) if c != target] if drop_sources else []
    return (_without(df, gone) if gone else df), len(gone)


def empty_columns(df: DataFrame, condition: str = "all", trim: bool = True) -> list[str]:
    """Columns that are blank in every row (``all``; all of them if there are no rows) or in some row (``any``).

    The first rows decide most columns: one filled cell is enough to keep a column, or one blank cell to
    drop it. Only the columns they leave open are read and evaluated in full, by one aggregation.
    """
    columns = data_columns(df)
    wanted = {c: ~is_blank(ref(c), trim) if condition == "all" else is_blank(ref(c), trim) for c in columns}
    if not columns:
        return []
    rows = df.select([wanted[c].alias(f"c{k}") for k, c in enumerate(columns)]).take(LOOK_ROWS)
    seen = {c for k, c in enumerate(columns) if any(r[k] for r in rows)}
    rest = [c for c in columns if c not in seen]
    if rest and len(rows) == LOOK_ROWS:
        found = df.agg(*[F.max(wanted[c]).alias(f"c{k}") for k, c in enumerate(rest)]).first()
        seen |= {c for c, has in zip(rest, found, strict=True) if has}
    return [c for c in columns if (c in seen) == (condition != "all")]


def remove_empty_columns(
    df: DataFrame, condition: str = "all", trim: bool = True
) -> tuple[DataFrame, int]:
    """Drop empty columns. The result's schema depends on the data, so this runs a job."""
    gone = empty_columns(df, condition, trim)
    return (_without(df, gone) if gone else df), len(gone)


def rename_columns(
    df: DataFrame, mappings: Sequence[Mapping[str, str]]
) -> tuple[DataFrame, int]:
    """Rename all at once, so two columns can swap names. Clashing results raise."""
    have = set(data_columns(df))
    names: dict[str, str] = {}
    for pair in mappings:
        old, new = _strip(pair.get("from", "")), _strip(pair.get("to", ""))
        if old in have and new:
            names[old] = new
    if not names:
        return df, 0
    require_free(names.values())
    result = [names.get(c, c) for c in data_columns(df)]
    clashes = sorted({c for c in result if result.count(c) > 1})
    if clashes:
        raise ValueError(f"renaming gives the same name to several columns: {clashes}")
    renamed = [ref(c).alias(names.get(c, c)) for c in data_columns(df)]
    return df.select(*renamed, *refs(hidden_columns(df))), len(names)
