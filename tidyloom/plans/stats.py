"""The 18 counters of a cleaning run, as a DataFrame.

A counter refers to the rows present at its step, so the table is measured at most
twice: before duplicates go, and before empty rows go. Each measure is one map-side
aggregation over the per-row tallies that the operators carry along. They are plain
aggregations, not accumulators or ``observe``: those count a task again when it is
recomputed after an executor is lost.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.names import HIDDEN, ref, refs, scope_of

# Tally of an operator -> hidden column, and counter it feeds.
TALLIES = {
    t: f"{HIDDEN}n_{t}"
    for t in (
        "text", "email", "merged", "phone", "date", "currency", "default", "directional",
    )
}
CELL_COUNTERS = {
    "filledDefaultCells": "default",
    "filledForwardBackwardCells": "directional",
    "formattedDateCells": "date",
    "formattedCurrencyCells": "currency",
    "normalizedPhoneCells": "phone",
    "normalizedEmailCells": "email",
    "cleanedTextCells": "text",
}

# The counters, in reporting order.
COUNTERS = (
    "rowsBefore",
    "rowsAfter",
    "colsBefore",
    "colsAfter",
    "removedEmptyRows",
    "removedEmptyCols",
    "filledDefaultCells",
    "filledForwardBackwardCells",
    "removedDuplicates",
    "formattedDateCells",
    "formattedCurrencyCells",
    "normalizedPhoneCells",
    "normalizedEmailCells",
    "cleanedTextCells",
    "renamedColumns",
    "droppedColumns",
    "splitColumnsAdded",
    "mergedColumnsAdded",
)
SHAPE_COUNTERS = COUNTERS[:4]
# Known when the plan is built, from the names of the columns alone.
COLUMN_COUNTERS = (
    "colsBefore",
    "colsAfter",
    "removedEmptyCols",
    "renamedColumns",
    "droppedColumns",
    "splitColumnsAdded",
)


@dataclass(frozen=True)
class Measure:
    """A point of the plan at which rows and tallies are counted.

    ``point`` is ``only`` (no duplicates removed in between), ``before`` and
    ``after`` the duplicates, or ``last`` when they go at the end.
    """

    df: DataFrame
    point: str
    removed: Column | None = None

    def aggregate(self) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        rows = F.count("*")
        removed = zero if self.removed is None else F.count_if(self.removed)
        sums = {
            "in_rows": rows if self.point in ("only", "before") else zero,
            "mid_rows": rows if self.point in ("only", "after") else zero,
            "out_rows": rows if self.point == "last" else zero,
            "removed": removed,
            "has_last": F.lit(1 if self.point == "last" else 0).cast("bigint"),
        }
        for tally, column in TALLIES.items():
            held = column in self.df.columns
            value = F.coalesce(F.sum(ref(column)), F.lit(0)).cast("bigint") if held else zero
            sums[tally] = value
        scoped = self.df.groupBy(*refs(scope_of(self.df)))
        return scoped.agg(*[e.alias(n) for n, e in sums.items()])


def stats_frame(measures: Sequence[Measure], column_counts: Mapping[str, int]) -> DataFrame:
    scope = scope_of(measures[0].df)
    parts = reduce(DataFrame.unionByName, [m.aggregate() for m in measures])
    sums = [c for c in parts.columns if c not in scope]
    total = parts.groupBy(*refs(scope)).agg(*[F.sum(c).alias(c) for c in sums])

    kept = F.col("mid_rows") - F.col("removed")
    rows_after = F.when(F.col("has_last") > 0, F.col("out_rows")).otherwise(kept)
    values = {
        "rowsBefore": F.col("in_rows"),
        "rowsAfter": rows_after,
        "removedEmptyRows": F.col("removed"),
        "removedDuplicates": F.col("in_rows") - F.col("removed") - rows_after,
        "mergedColumnsAdded": (F.col("merged") > 0).cast("bigint"),
        **{counter: F.col(tally) for counter, tally in CELL_COUNTERS.items()},
        **{counter: F.lit(n) for counter, n in column_counts.items()},
    }
    return total.select(
        *refs(scope), *[values[c].cast("bigint").alias(c) for c in COUNTERS]
    )


def shrink_rate(before: str = "rowsBefore", after: str = "rowsAfter") -> Column:
    """How much smaller the table got, in percent with one decimal."""
    rate = (F.col(before) - F.col(after)) / F.nullif(F.col(before), F.lit(0)) * 100
    return F.coalesce(F.format_number(rate, 1), F.lit("0.0"))


def nothing_matched() -> Column:
    """True if no rule changed anything: all change counters are zero."""
    return reduce(
        lambda a, b: a & b,
        [F.col(c) == 0 for c in COUNTERS if c not in SHAPE_COUNTERS],
    )
