"""Many sources, each with its own rules.

Sources with equal rules and equal columns share one scan and one plan, in which
the file is the scope: duplicates, fills and statistics stay within a file. Rules
whose result schema depends on the data (empty columns) get a plan per source.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidyloom.names import FILE, SCOPE, data_columns, ref
from tidyloom.plans.clean import CleanResult, clean
from tidyloom.rules import CleaningRules
from tidyloom.sources.readers import format_of, is_known, layouts_of, load


def sources_in(spark: SparkSession, folder: str) -> list[str]:
    """The files below a folder whose extension names a known format, in path order."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return sorted(path for path in listing.inputFiles() if is_known(path))


@dataclass(frozen=True)
class Batch:
    """The sources cleaned by one plan. ``result.ordered`` has the source as scope."""

    sources: tuple[str, ...]
    result: CleanResult


def clean_many(
    spark: SparkSession,
    rules_by_source: Mapping[str, str | Mapping[str, Any] | CleaningRules],
    fmt: str | None = None,
    *,
    multi_line: bool = False,
) -> list[Batch]:
    """Clean each source by its rules. A source is a file; each path counts once."""
    groups: dict[tuple, list[str]] = {}
    rules_of = {}
    formats = {path: fmt or format_of(path) for path in rules_by_source}
    layouts = layouts_of(spark, formats, multi_line)
    for i, (path, document) in enumerate(rules_by_source.items()):
        rules = CleaningRules.parse(document)
        source_format, layout = formats[path], layouts[path]
        alone = i if rules.columns.remove_empty_cols.enabled else None
        text = json.dumps(rules.to_document(), sort_keys=True)
        key = (text, layout.key, source_format, alone)
        groups.setdefault(key, []).append(path)
        rules_of[key] = rules, layout.header
    return [
        Batch(tuple(paths), _clean_group(spark, paths, key[2], *rules_of[key], multi_line))
        for key, paths in groups.items()
    ]


def _clean_group(
    spark: SparkSession, paths: Sequence[str], fmt: str, rules: CleaningRules, header: Sequence[str | None] | None, multi_line: bool
) -> CleanResult:
    table = load(spark, paths, fmt, multi_line=multi_line, by_path=True, header=header)
    return clean(table.withColumnRenamed(FILE, SCOPE), rules)


def by_source(batch: Batch, source_column: str = "source") -> DataFrame:
    """The cleaned rows of a batch with the path of their source."""
    df = batch.result.ordered
    if source_column in data_columns(df):
        raise ValueError(f"the table has a column {source_column!r}: give another source_column")
    return df.select(
        ref(SCOPE).alias(source_column), *[ref(c) for c in data_columns(df)]
    )
