"""Money: the first number of a cell in one layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.functions.whitespace import UNICODE

#: Bits by which a large number is multiplied at once: limbs of nine digits times that stay below 2^63.
STEP = 29
#: Binary places of numbers that can reach half of the eighteenth decimal place.
MOST_BITS = 120

NUMBER = r"[-+]?[0-9]*\.?[0-9]+"


def parse_number(c: Column) -> Column:
    """First number of the cell, after removing commas and white space."""
    joined = F.regexp_replace(c, UNICODE + r"[,\s]+", "")
    return F.regexp_extract(joined, NUMBER, 0).try_cast("double")


def _exact(number: Column) -> Column:
    """The decimal value of a double from 2^34 to 2^62, digit by digit.

    A formatted double ends where its shortest spelling ends. In this range it has at
    most 18 binary places, and they are 18 decimal places: 10^18 / 2^18 = 5^18.
    """
    whole = number.cast("bigint")
    places = ((number - whole) * (1 << 18)).cast("bigint") * 5**18
    fraction = places.cast("decimal(18,0)") * F.lit("1e-18").cast("decimal(18,18)")
    return (whole.cast("decimal(19,0)") + fraction.cast("decimal(18,18)")).cast("decimal(38,18)")


def _exact_large(number: Column) -> Column:
    """The decimal value of a double from 2^62 to below 2^125: multiples of 2^62 and the rest, both exact."""
    high = F.floor(number / float(1 << 62))
    low = (number - high.cast("double") * float(1 << 62)).cast("bigint")
    unit = F.lit(str(1 << 62)).cast("decimal(19,0)")
    return (high.cast("decimal(19,0)") * unit + low.cast("decimal(19,0)")).cast("decimal(38,0)")


def _limbs(number: Column) -> Column:
    """The digits of a double from 2^125 on: its 53 leading bits times a power of two, in limbs of nine digits."""
    shift = F.floor(F.log2(number)).cast("int") - 54  # the leading bits end two places above it
    top = (number / F.pow(F.lit(2.0), shift)).cast("bigint")
    base = F.lit(10**9).cast("bigint")

    def times(limbs: Column, factor: Column) -> Column:
        def add(acc: Column, limb: Column) -> Column:
            value = limb * factor + acc["carry"]
            out = F.concat(acc["out"], F.array(value % base))
            return F.struct(F.call_function("div", value, base).alias("carry"), out.alias("out"))

        zero = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            limbs, zero, add, lambda acc: F.when(acc["carry"] > 0, F.concat(acc["out"], F.array(acc["carry"]))).otherwise(acc["out"])
        )

    steps = F.call_function("div", shift, F.lit(STEP)).cast("int")
    last = F.pow(F.lit(2.0), shift % STEP).cast("bigint")
    limbs = F.aggregate(
        F.sequence(F.lit(0), steps),
        F.array(top % base, F.call_function("div", top, base)),
        lambda acc, k: times(acc, F.when(k == 0, last).otherwise(F.lit(1 << STEP).cast("bigint"))),
    )
    padded = F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0"))
    return F.ltrim(F.array_join(padded, ""), F.lit("0"))


def _places(number: Column, places: int) -> tuple[Column, Column]:
    """Whole part and ``places`` decimal digits of a double below 2^34, rounded from its exact value, ties to even.

    With ``m / 2^k`` for the number, ``m * 10^places`` is divided by ``2^k`` in whole numbers of at most 38 digits.
    """
    k = 53 - F.coalesce(F.floor(F.log2(number)), F.lit(53)).cast("int")
    near = k <= MOST_BITS  # smaller numbers are less than half of the last digit
    power = F.element_at(F.array(*[F.lit(str(1 << n)).cast("decimal(38,0)") for n in range(MOST_BITS + 1)]), F.least(k, F.lit(MOST_BITS)) + 1)
    top = F.when(near, (number * F.pow(F.lit(2.0), k)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    scaled = (top.cast("decimal(18,0)") * F.lit(str(10**places)).cast("decimal(19,0)")).cast("decimal(38,0)")
    rest = scaled % power
    down = ((scaled - rest) / power).cast("decimal(31,0)")
    up = (rest > power - rest) | ((rest == power - rest) & (down % 2 == 1))
    digits = (down + F.when(up, 1).otherwise(0).cast("decimal(1,0)")).cast("decimal(31,0)")
    unit = F.lit(str(10**places)).cast("decimal(19,0)")
    fraction = digits % unit
    return ((digits - fraction) / unit).cast("bigint"), F.lpad(fraction.cast("bigint").cast("string"), places, "0")


def clean_currency(
    c: Column,
    symbol: str = "¥",
    decimal_places: int = 2,
    thousands_separator: bool = True,
) -> Column:
    """Symbol, sign, number. Ties round to even. A cell without a number is kept.

    A number is the nearest double, as in the rules' definition, with all its digits and up to 18
    exact decimal places; further places are zeros. A number beyond 1.8e308 is infinite.
    """
    number = parse_number(c)
    layout = "#,##0" if thousands_separator else "0"
    point = "." + "0" * decimal_places if decimal_places else ""

    def text(value: Column) -> Column:
        return F.call_function("format_number", value, F.lit(layout + point))

    size = F.abs(number)
    large = _limbs(size)
    if thousands_separator:
        large = F.regexp_replace(large, "(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")
    # A negative number keeps its sign when it is rounded to zero, and so does a negative zero.
    sign = F.when(number.cast("string").startswith("-"), "-").otherwise("")
    small = text(number)
    if decimal_places > 5:
        places = min(decimal_places, 18)
        whole, fraction = _places(size, places)
        head = F.call_function("format_number", whole, F.lit(layout))
        small = F.concat(sign, head, F.lit("."), fraction, F.lit("0" * (decimal_places - places)))
    written = (
        F.when(size < float(1 << 34), small)
        .when(size < float(1 << 62), text(_exact(number)))
        .when(size < float(1 << 125), text(_exact_large(number)))
        .when(size < float("inf"), F.concat(sign, large, F.lit(point)))
        .otherwise(text(number))
    )
    return F.coalesce(F.concat(F.lit(symbol), written), c)
