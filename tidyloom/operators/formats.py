"""Format operators over the target columns of a table. All are row-local."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidyloom.functions.dates import clean_date
from tidyloom.functions.money import clean_currency
from tidyloom.functions.phone import clean_phone
from tidyloom.functions.text import clean_email, clean_text
from tidyloom.names import known, ref, resolve
from tidyloom.operators.cells import replace_cells
from tidyloom.rules import CurrencyFormat, DateFormat, EmailFormat, PhoneFormat, TextFormat


def format_text(df: DataFrame, rule: TextFormat, tally: str | None = None) -> DataFrame:
    targets = resolve(df, rule.columns_mode, rule.columns)
    if not (rule.trim or rule.collapse_spaces or rule.remove_all_whitespace):
        targets = []
    return replace_cells(
        df,
        {
            c: clean_text(ref(c), rule.trim, rule.collapse_spaces, rule.remove_all_whitespace)
            for c in targets
        },
        tally,
    )


def format_email(df: DataFrame, rule: EmailFormat, tally: str | None = None) -> DataFrame:
    return _each(df, rule.columns, tally, lambda c: clean_email(c, rule.trim, rule.lowercase))


def format_phone(df: DataFrame, rule: PhoneFormat, tally: str | None = None) -> DataFrame:
    return _each(df, rule.columns, tally, lambda c: clean_phone(c, rule.country_code, rule.output))


def format_date(df: DataFrame, rule: DateFormat, tally: str | None = None) -> DataFrame:
    return _each(
        df,
        rule.columns,
        tally,
        lambda c: clean_date(c, rule.output_format, rule.on_invalid, rule.timezone),
    )


def format_currency(df: DataFrame, rule: CurrencyFormat, tally: str | None = None) -> DataFrame:
    return _each(
        df,
        rule.columns,
        tally,
        lambda c: clean_currency(c, rule.symbol, rule.decimal_places, rule.thousands_separator),
    )


def _each(df: DataFrame, columns: Sequence[str], tally: str | None, make) -> DataFrame:
    return replace_cells(df, {c: make(ref(c)) for c in known(df, columns)}, tally)
