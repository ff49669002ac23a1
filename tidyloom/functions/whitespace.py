"""Unicode white space and blank cells.

``btrim`` with a literal character set stays on the raw UTF-8 bytes, so trimming
and the blank test need no regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode property White_Space.
WHITE_SPACE_RANGES = (
    (0x0009, 0x000D),
    (0x0020, 0x0020),
    (0x0085, 0x0085),
    (0x00A0, 0x00A0),
    (0x1680, 0x1680),
    (0x2000, 0x200A),
    (0x2028, 0x2029),
    (0x202F, 0x202F),
    (0x205F, 0x205F),
    (0x3000, 0x3000),
)

WHITE_SPACE = "".join(chr(p) for lo, hi in WHITE_SPACE_RANGES for p in range(lo, hi + 1))

# Patterns start with this flag, so that `\s` is the same set. It also widens `\d`:
# they write `[0-9]` for a digit.
UNICODE = "(?U)"


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeeze_ws(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE + r"\s+", " ")


def remove_ws(c: Column) -> Column:
    return F.regexp_replace(c, UNICODE + r"\s+", "")


def split_ws(c: Column) -> Column:
    """The words of a cell; one empty word if it is blank."""
    return F.split(trim_ws(c), UNICODE + r"\s+")


def is_blank(c: Column, trim: bool = True) -> Column:
    """Null, empty, or (with ``trim``) only white space. Never null itself."""
    text = trim_ws(c) if trim else c
    return F.coalesce(text, F.lit("")) == F.lit("")


def unless_blank(c: Column, trim: bool = True) -> Column:
    """The cell, or null where it is blank."""
    return F.when(~is_blank(c, trim), c)
