"""Column naming: safe references and the hidden bookkeeping columns.

Tables have arbitrary header text (commas, dots, backticks), so every reference
is quoted. Columns that start with ``HIDDEN`` are bookkeeping (row order, source
scope, change tallies); rules never see them and sinks drop them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = "__tl_"

FILE = HIDDEN + "file"
BLOCK = HIDDEN + "block"
ROW = HIDDEN + "row"
CHUNK = HIDDEN + "chunk"
SCOPE = HIDDEN + "scope"
BOOKKEEPING = (FILE, BLOCK, ROW, CHUNK, SCOPE)


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def refs(names: Iterable[str]) -> list[Column]:
    return [ref(n) for n in names]


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(HIDDEN)]


def hidden_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(HIDDEN)]


def require_free(names: Iterable[str]) -> None:
    """Raise on names that are kept for bookkeeping, instead of losing those columns later."""
    taken = [n for n in names if n.startswith(HIDDEN)]
    if taken:
        raise ValueError(f"column names that start with {HIDDEN} are reserved: {taken}")


def drop_hidden(df: DataFrame) -> DataFrame:
    return df.select(refs(data_columns(df)))


def known(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The listed data columns that exist, once each, in the listed order."""
    have = set(data_columns(df))
    return [n for n in dict.fromkeys(names) if n in have]


def resolve(df: DataFrame, mode: str, names: Iterable[str]) -> list[str]:
    """Target columns of a rule: the listed ones, or every data column."""
    if mode in ("selected", "custom"):
        return known(df, names)
    return data_columns(df)


def scope_of(df: DataFrame) -> list[str]:
    """The column that separates independent tables sharing one scan, if any."""
    return [SCOPE] if SCOPE in df.columns else []
