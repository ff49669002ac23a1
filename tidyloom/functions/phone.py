"""Phone numbers: strip international prefixes, keep digits."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidyloom.functions.whitespace import UNICODE


def strip_pattern(country_code: str) -> str:
    """One expression for everything that is deleted from a phone number.

    At the start of the cell: any run of ``+86``, ``+(86)``, ``(86)``, ``(+86)``,
    then any run of the bare country code. Anywhere else: all but the digits. A
    lone ``+`` needs no case of its own, as it is not a digit.
    """
    # Possessive loops never give back a code: nothing that follows could make them, and
    # they need no stack for cells with many codes.
    any_code = r"\s*(?:\+\s*[0-9]+|\+\s*\(\s*[0-9]+\s*\)|\(\s*\+?[0-9]+\s*\))\s*"
    prefix = f"(?:{any_code})++"
    if country_code:
        own_code = rf"(?:\s*{country_code}\s*)"
        prefix = f"(?:{prefix}{own_code}*+|{own_code}++)"
    return f"{UNICODE}^{prefix}|[^0-9]+"


def clean_phone(c: Column, country_code: str = "", output: str = "digits") -> Column:
    """Digits, or E.164 with the country code in front; null if no digit is left."""
    code = re.sub("[^0-9]", "", country_code)
    digits = F.nullif(F.regexp_replace(c, strip_pattern(code), ""), F.lit(""))
    if output == "E164":
        return F.concat(F.lit("+" + code), digits)
    return digits
