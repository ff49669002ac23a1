"""Dates in many spellings to one spelling.

A cell is rewritten to ``Y-M-D`` or ``Y-M-D h:m[:s]`` by one expression whose
alternatives exclude each other, and the cast to a zone-free timestamp decides
whether such a date exists. The text of that timestamp has a fixed width, so the
output formats are made from its parts and no zone can shift them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.functions.whitespace import UNICODE, is_blank

# The output formats as templates over the parts of the timestamp
# text, $1 year, $2 month, $3 day, $4 hour, $5 minute, $6 second.
OUTPUT_FORMATS = {
    "YYYY-MM-DD": "$1-$2-$3",
    "YYYY/MM/DD": "$1/$2/$3",
    "YYYY-MM-DD HH:mm": "$1-$2-$3 $4:$5",
    "YYYY-MM-DD HH:mm:ss": "$1-$2-$3 $4:$5:$6",
    "YYYY/MM/DD HH:mm": "$1/$2/$3 $4:$5",
    "YYYY/MM/DD HH:mm:ss": "$1/$2/$3 $4:$5:$6",
    "YYYY年MM月DD日": "$1年$2月$3日",
    "YYYY年MM月DD日 HH时mm分": "$1年$2月$3日 $4时$5分",
    "YYYY年MM月DD日 HH时mm分ss秒": "$1年$2月$3日 $4时$5分$6秒",
    "ISO": "$1-$2-$3T$4:$5:$6.000Z",
}
DEFAULT_FORMAT = "YYYY-MM-DD"

# Marks that stand for a separator, and their replacement. The last
# one has no counterpart and is deleted.
MARKS, MARK_TARGETS = "年月日时分：秒", "-- :::"

_TIMESTAMP_TEXT = "^(.{4})-(..)-(..) (..):(..):(..)$"

_SEP = r"(?:\s*[-年月]\s*|[/.])"
_ZONE = "(Z|[+-][0-9]{2}:?[0-9]{2})"
_CLOCK = "([0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2})?)"
_YEAR_FIRST = (
    rf"([0-9]{{4}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{1,2}})"
    rf"(?:(?:[\s日]+|T){_CLOCK}(?:\.[0-9]+)?\s*+{_ZONE}?)?"
)
_COMPACT = "([0-9]{4})([0-9]{2})([0-9]{2})"
_DAY_FIRST = rf"([0-9]{{1,2}}){_SEP}([0-9]{{1,2}}){_SEP}([0-9]{{4}})"

# The last alternative takes whatever is no date and leaves all groups empty.
DATE_PATTERN = (
    rf"{UNICODE}(?s)^\s*(?:{_YEAR_FIRST}|{_COMPACT}|{_DAY_FIRST})[\s日]*+:?\s*+$|^.*$"
)
# Quantifiers that take all they can, and a start only at the first of several spaces,
# keep the time linear in the length of a cell.
_BESIDE_SEPARATORS = UNICODE + r"(?<!\s)\s++([:-])\s*+|([:-])\s++"
_REWRITTEN = "$1$6$11-$2$7$10-$3$8$9 $4"
_REWRITTEN_ZONE = "$5"


def _tidy(c: Column) -> Column:
    """Marks to separators, and no white space next to ``:`` and ``-``."""
    separated = F.translate(c, MARKS, MARK_TARGETS)
    return F.regexp_replace(separated, _BESIDE_SEPARATORS, "$1$2")


def _wall_time(c: Column) -> Column:
    return F.regexp_replace(c, DATE_PATTERN, _REWRITTEN).try_cast("timestamp_ntz")


def parse_date(c: Column, timezone: str = "local") -> Column:
    """Zone-free timestamp, or null if the cell is no existing date.

    A fraction of a second is ignored. A zone suffix is ignored for ``local``; for
    ``utc`` the time is moved to UTC, from the zone named by the suffix or else
    from the zone of the session.
    """
    # Most dates need no tidying, and what can be read without it reads the same with it.
    as_is = F.when(~(c.contains("时") | c.contains("：")), _wall_time(c))
    wall = F.coalesce(as_is, _wall_time(_tidy(c)))
    if timezone != "utc":
        return wall
    zone = F.regexp_replace(_tidy(c), DATE_PATTERN, _REWRITTEN_ZONE)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.substring(digits, 1, 2).try_cast("int")
    minutes = F.substring(digits, 3, 2).try_cast("int")
    sign = F.when(zone.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    by_offset = F.timestamp_add("MINUTE", -sign * (hours * 60 + minutes), wall)
    return (
        F.when(zone == "Z", wall)
        .when((hours <= 23) & (minutes <= 59), by_offset)
        .otherwise(F.convert_timezone(None, F.lit("UTC"), wall))
    )


def render_date(timestamp: Column, output_format: str = DEFAULT_FORMAT) -> Column:
    template = OUTPUT_FORMATS.get(output_format, OUTPUT_FORMATS[DEFAULT_FORMAT])
    text = timestamp.cast("string")
    if OUTPUT_FORMATS["YYYY-MM-DD HH:mm:ss"].startswith(template):
        # `$1` stands for four characters, the other parts for two, as they do.
        return F.substring(text, 1, len(template) + 2)
    return F.regexp_replace(text, _TIMESTAMP_TEXT, template)


def clean_date(
    c: Column,
    output_format: str = DEFAULT_FORMAT,
    on_invalid: str = "keep",
    timezone: str = "local",
) -> Column:
    rendered = render_date(parse_date(c, timezone), output_format)
    if on_invalid == "empty":
        return F.coalesce(rendered, F.when(is_blank(c), c).otherwise(F.lit("")))
    return F.coalesce(rendered, c)
