"""``clean(table, rules) -> (table', stats)`` as one DataFrame plan.

The rules run in a fixed order whatever the document says: drop, split, merge,
text, e-mail, duplicates, phone, date, currency, defaults, directional fill, empty
rows, empty columns, rename. ``dedup_stage="last"`` moves the duplicates behind the
empty columns.

The plan is lazy, with two exceptions that need a job while it is built: removing
empty columns (the schema depends on the data) and cutting the lineage. A cut
writes the table once to the reliable checkpoint folder where more than one later
consumer would otherwise repeat a shuffle of the whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.names import BOOKKEEPING, HIDDEN, SCOPE, data_columns, drop_hidden, ref, refs, require_free
from tidyloom.operators.columns import (
    drop_columns,
    merge_columns,
    remove_empty_columns,
    rename_columns,
    split_column,
)
from tidyloom.operators.dedup import dedup_rows
from tidyloom.operators.fill import fill_directional
from tidyloom.operators.formats import (
    format_currency,
    format_date,
    format_email,
    format_phone,
    format_text,
)
from tidyloom.operators.missing import drop_rows, empty_row, fill_default
from tidyloom.operators.order import attach_key_order, depends_on_splits, without_order
from tidyloom.plans.stats import COLUMN_COUNTERS, TALLIES, Measure, stats_frame
from tidyloom.rules import CleaningRules
from tidyloom.session import cut
from tidyloom.sources.text_table import to_text_table
from tidyloom.streaming.guard import require_row_local


_GONE = HIDDEN + "gone"


@dataclass(frozen=True)
class CleanResult:
    """The cleaned table, still in step with its row order, and its statistics."""

    ordered: DataFrame
    measures: tuple[Measure, ...]
    column_counts: Mapping[str, int]

    @cached_property
    def df(self) -> DataFrame:
        """The cleaned table without bookkeeping columns."""
        return drop_hidden(self.ordered)

    @cached_property
    def stats(self) -> DataFrame:
        """One row (one per source in a batch) with the 18 counters."""
        return stats_frame(self.measures, self.column_counts)


def clean(
    df: DataFrame,
    rules: str | Mapping[str, Any] | CleaningRules,
    *,
    order_by: str | Sequence[str] | None = None,
    scope: str | None = None,
    dedup_stage: str = "native",
    cuts: str = "needed",
) -> CleanResult:
    """Apply a rule document to a table.

    ``order_by`` names a unique key that gives the order of the rows; without it, tables
    read by ``tidyloom.sources`` have the order of their files. ``scope`` names a column that separates
    independent tables: duplicates, fills and statistics stay within its values.

    ``cuts`` says where the lineage is cut: where a later step would repeat a shuffle of
    the whole table or must find the same scan again (``needed``), also after duplicates
    and at the point where the statistics are counted, for a caller that reads both the table
    and the statistics: both then come from one evaluation of the rules behind the duplicates
    (``always``), or nowhere (``never``).
    """
    rules = CleaningRules.parse(rules)
    if dedup_stage not in ("native", "last"):
        raise ValueError(f"unknown dedup_stage: {dedup_stage}")
    if cuts not in ("needed", "always", "never"):
        raise ValueError(f"unknown cuts: {cuts}")
    require_row_local(df, rules)

    df = _prepared(df, rules, order_by, scope)
    missing, cols = rules.missing, rules.columns
    dedup_early = rules.dedup.enabled and dedup_stage == "native"
    dedup_late = rules.dedup.enabled and dedup_stage == "last"
    fills, prunes = missing.fill_forward_backward.enabled, cols.remove_empty_cols.enabled
    trim = missing.trim_whitespace_for_empty_check
    counts = dict.fromkeys(COLUMN_COUNTERS, 0) | {"colsBefore": len(data_columns(df))}
    measures = []

    df = _reshape(df, rules, counts)
    df = _tidy_text(df, rules)
    if dedup_early:
        measures.append(Measure(df, "before"))
        df = _cut_if(fills or prunes, _dedup(df, rules), cuts)
    df = _unify_formats(df, rules)

    if missing.fill_default.enabled:
        d = missing.fill_default
        df = fill_default(df, d.columns, d.values, d.only_when_empty, trim, TALLIES["default"])
    if fills:
        # A fill reads the table twice and must find the same chunks both times.
        if depends_on_splits(df) and not dedup_early and cuts != "never":
            df = cut(df)
        f = missing.fill_forward_backward
        df = fill_directional(df, f.columns, f.directions, f.limit, trim, TALLIES["directional"])
        if cuts == "needed":
            df = _cut_if(prunes, df, cuts)

    gone = F.lit(False)
    if missing.remove_empty_rows.enabled:
        r = missing.remove_empty_rows
        gone = empty_row(df, r.condition, r.columns_mode, r.columns, trim)
    if cuts == "always":
        df = cut(df.withColumn(_GONE, gone))
        gone = ref(_GONE)
    measures.append(Measure(df, "after" if dedup_early else "only", gone))
    if missing.remove_empty_rows.enabled:
        df = drop_rows(df, gone)
    df = _without_tallies(df)

    if prunes:
        condition = cols.remove_empty_cols.condition
        df, counts["removedEmptyCols"] = remove_empty_columns(df, condition, trim)
    if dedup_late:
        df = _cut_if(False, _dedup(df, rules), cuts)
        measures.append(Measure(df, "last"))
    if cols.rename.enabled:
        df, counts["renamedColumns"] = rename_columns(df, cols.rename.mappings)
    counts["colsAfter"] = len(data_columns(df))
    return CleanResult(df, tuple(measures), counts)


def _reshape(df: DataFrame, rules: CleaningRules, counts: dict[str, int]) -> DataFrame:
    drop, split, merge = rules.columns.drop, rules.columns.split, rules.columns.merge
    if drop.enabled:
        df, counts["droppedColumns"] = drop_columns(df, drop.columns)
    if split.enabled:
        df, counts["splitColumnsAdded"] = split_column(
            df, split.column, split.separator, split.into, split.keep_original
        )
    if merge.enabled:
        df, dropped = merge_columns(
            df, merge.columns, merge.separator, merge.into, merge.drop_sources, TALLIES["merged"]
        )
        counts["droppedColumns"] += dropped
    return df


def _tidy_text(df: DataFrame, rules: CleaningRules) -> DataFrame:
    if rules.format.text.enabled:
        df = format_text(df, rules.format.text, TALLIES["text"])
    if rules.format.email.enabled:
        df = format_email(df, rules.format.email, TALLIES["email"])
    return df


def _unify_formats(df: DataFrame, rules: CleaningRules) -> DataFrame:
    if rules.format.phone.enabled:
        df = format_phone(df, rules.format.phone, TALLIES["phone"])
    if rules.format.date.enabled:
        df = format_date(df, rules.format.date, TALLIES["date"])
    if rules.format.currency.enabled:
        df = format_currency(df, rules.format.currency, TALLIES["currency"])
    return df


def _prepared(
    df: DataFrame,
    rules: CleaningRules,
    order_by: str | Sequence[str] | None,
    scope: str | None,
) -> DataFrame:
    """All-text table with its scope and row order as hidden columns."""
    keys = [order_by] if isinstance(order_by, str) else order_by or []
    require_free(c for c in df.columns if c not in (*BOOKKEEPING, *keys))
    if scope is not None:
        others = [c for c in df.columns if c != scope]
        named = F.coalesce(ref(scope).cast("string"), F.lit(""))
        df = df.select(*refs(others), named.alias(SCOPE))
    if order_by is not None:
        fills = rules.missing.fill_forward_backward.enabled
        df = attach_key_order(without_order(df), order_by, chunked=fills)
    return to_text_table(df)


def _cut_if(needed: bool, df: DataFrame, cuts: str) -> DataFrame:
    return cut(df) if cuts == "always" or (cuts == "needed" and needed) else df


def _dedup(df: DataFrame, rules: CleaningRules) -> DataFrame:
    d = rules.dedup
    return dedup_rows(_without_tallies(df), d.mode, d.columns, d.keep, d.normalize_text)


def _without_tallies(df: DataFrame) -> DataFrame:
    tallies = {*TALLIES.values(), _GONE}
    return df.select(refs(c for c in df.columns if c not in tallies))
