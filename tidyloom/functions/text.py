"""Text and e-mail clean-up of one cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.functions.whitespace import remove_ws, squeeze_ws, trim_ws


def clean_text(
    c: Column,
    trim: bool = False,
    collapse_spaces: bool = False,
    remove_all_whitespace: bool = False,
) -> Column:
    """Removing all white space wins over collapsing it; trimming comes last."""
    if remove_all_whitespace:
        return remove_ws(c)
    if collapse_spaces:
        c = squeeze_ws(c)
    return trim_ws(c) if trim else c


def clean_email(c: Column, trim: bool = True, lowercase: bool = True) -> Column:
    """Trim and lower-case. Addresses are not validated."""
    if trim:
        c = trim_ws(c)
    return F.lower(c) if lowercase else c


def comparable(c: Column) -> Column:
    """The form in which normalized duplicates are compared."""
    return F.lower(trim_ws(F.coalesce(c, F.lit(""))))
