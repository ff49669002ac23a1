"""Rules on a stream.

Row-local rules are projections and filters, so they run on a streaming DataFrame
as they are. Duplicates, directional fill and empty columns need the whole table
in order and are refused there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidyloom.rules import CleaningRules


def require_row_local(df: DataFrame, rules: CleaningRules) -> None:
    if not df.isStreaming or rules.row_local:
        return
    named = {
        "dedup": rules.dedup.enabled,
        "fillForwardBackward": rules.missing.fill_forward_backward.enabled,
        "removeEmptyCols": rules.columns.remove_empty_cols.enabled,
    }
    bad = ", ".join(name for name, on in named.items() if on)
    raise ValueError(f"these rules need a complete table and cannot run on a stream: {bad}")
