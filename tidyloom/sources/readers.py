"""Scans: files and tables as text tables with their row order.

CSV is read without type inference, so ``007`` and ``1.50`` stay as they are. Short
rows are padded with ``''`` and long rows cut at the width of the header. Lines
without any character are skipped by the CSV source; ``,,,`` is a row.

A CSV scan applies one header by position to every file and ends a record at each line
break, so files with other headers and cells with line breaks would give wrong rows
without an error. ``load`` looks for both in one pass over the lines and raises.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.names import require_free
from tidyloom.operators.order import attach_file_order
from tidyloom.sources.headers import normalize_headers
from tidyloom.sources.text_table import to_text_table

FILE_FORMATS = ("csv", "parquet", "json")

_CSV_OPTIONS = {
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "inferSchema": "false",
    "maxCharsPerColumn": "-1",
}


def _extension(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2].rpartition(".")[2].lower()


def is_known(path: str) -> bool:
    return _extension(path) in FILE_FORMATS


def format_of(path: str) -> str:
    """The format named by the extension of a path, in any case."""
    if not is_known(path):
        raise ValueError(f"unsupported format: {path}")
    return _extension(path)


def load(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    *,
    multi_line: bool = False,
    header_style: str = "native",
    validate: bool = True,
    schema: T.StructType | str | None = None,
    by_path: bool = False,
    header: Sequence[str | None] | None = None,
) -> DataFrame:
    """A text table from one source. Files carry their row order; tables need ``order_by``.

    Several paths of one format are one table. CSV files must have one header, in one order;
    parquet files may have different columns, which are matched by name. ``validate=False``
    saves the pass over the lines of CSV files that are known to be sound: the first header found is
    then applied to all of them. ``schema`` gives the columns of JSON, which are otherwise inferred
    from the whole input. ``by_path`` marks rows with the path of their file instead of its number.
    ``header`` has the raw cells of the header of sound CSV files, whose lines are then read once.
    """
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt.lower() if fmt else format_of(paths[0])
    if fmt == "csv":
        return _read_csv(spark, paths, multi_line, header_style, validate, by_path, header)
    if fmt == "parquet":
        scan = spark.read.option("mergeSchema", True).parquet(*paths)
    elif fmt == "json":
        reader = spark.read.option("primitivesAsString", True).option("multiLine", multi_line)
        scan = (reader.schema(schema) if schema is not None else reader).json(paths)
    elif fmt == "table":
        scan = spark.table(paths[0])
    else:
        raise ValueError(f"unsupported format: {fmt}")
    require_free(scan.columns)
    return to_text_table(scan if fmt == "table" else attach_file_order(scan, by_path))


@dataclass(frozen=True)
class Layout:
    """What the columns of a source are, and the raw header of a CSV file. Sources of one ``key`` can be read together."""

    key: str
    header: tuple[str | None, ...] | None = None


def layouts_of(
    spark: SparkSession, formats: Mapping[str, str], multi_line: bool = False
) -> dict[str, Layout]:
    """The layouts of sources, given by format.

    All CSV files are looked at by one job, which also raises on unsound ones, so that they can be
    loaded with their ``header`` and without another pass over their lines.
    """
    headers = csv_headers(spark, [p for p, f in formats.items() if f == "csv"], multi_line, validate=True)
    reader = spark.read.option("multiLine", multi_line)
    return {
        path: Layout(repr(normalize_headers(headers[path])), tuple(headers[path]))
        if fmt == "csv"
        else Layout(reader.format(fmt).load(path).schema.json())
        for path, fmt in formats.items()
    }


def csv_header(spark: SparkSession, path: str, multi_line: bool = False) -> list[str | None]:
    """The raw cells of the first line of a file, or of the first file of a folder that has one."""
    lines = lines_of(spark, [path]).where("block = 0 and value <> ''").orderBy("file", "number")
    return _cells(spark, lines.select("value", "file").head(), multi_line)


def csv_headers(
    spark: SparkSession, paths: Sequence[str], multi_line: bool = False, validate: bool = False
) -> dict[str, list[str | None]]:
    """The header of each of many files, by one job; a file without lines has none.

    ``validate`` raises if a quoted cell goes on in the next line, unless lines are joined by ``multi_line``.
    """
    if not paths:
        return {}
    lines = _inspected(spark, paths).select("header", "file", "odd").where("header is not null").collect()
    found = {urlsplit(r["file"]).path: r for r in lines}
    if validate and not multi_line:
        _require_whole(min((r["file"] for r in lines if r["odd"]), default=None))
    by_path = {p: found.get(quote(urlsplit(p).path if "://" in p else p.removeprefix("file:"))) for p in paths}
    return {p: _cells(spark, r and (r["header"], r["file"]), multi_line) for p, r in by_path.items()}


def _inspected(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file, header, odd)`` of each file, in one pass: its first line, and how many lines have an odd number of quotes."""
    first = F.expr("min_by(value, number) filter (where block = 0 and value <> '')")
    # Quotes come in pairs within a record, so an odd line is part of a longer one.
    odd = F.count_if(F.length("value") % 2 != F.length(F.replace("value", F.lit('"'))) % 2)
    return lines_of(spark, paths).groupBy("file").agg(
        F.regexp_replace(first, "^\ufeff", "").alias("header"), odd.alias("odd")
    )


def _require_whole(broken: str | None) -> None:
    if broken:
        raise ValueError(f"a quoted cell goes on in the next line in {broken}: use multi_line=True")


def lines_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(value, file, block, number)`` of each line; the number rises with the lines of a split."""
    number = F.monotonically_increasing_id().alias("number")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start")]
    return spark.read.text(list(paths)).select("value", place[0], place[1].alias("block"), number)


def _cells(spark: SparkSession, first: tuple | None, multi_line: bool) -> list[str | None]:
    """The cells of a header from its line and file."""
    if not first:
        return []
    line, file = first
    if line.count('"') % 2 and multi_line:  # a name with a line break
        reader = spark.read.options(**_CSV_OPTIONS).option("multiLine", True)
        cells = list(reader.option("header", False).csv(unquote(file)).head())
    else:
        cells = [c or None for c in next(csv.reader([line]))]
    return [c.removeprefix("\ufeff") if c else c for c in cells]


def _inspect(spark: SparkSession, paths: Sequence[str], multi_line: bool) -> tuple | None:
    """The first header with its file, after a pass over all lines that raises on unsound files.

    Two reductions, by file and of the files' rows, so one row comes to the driver.
    """
    files = _inspected(spark, paths).where("header is not null")
    low, high, broken = files.agg(
        F.min(F.struct("header", "file")),
        F.max(F.struct("header", "file")),
        F.min(F.when(F.col("odd") > 0, F.col("file"))),
    ).first()
    if low and low["header"] != high["header"]:
        raise ValueError(
            f"files with different headers in one table: {low['file']} has {low['header']!r}, "
            f"{high['file']} has {high['header']!r}"
        )
    if not multi_line:
        _require_whole(broken)
    return low


def _read_csv(
    spark: SparkSession, paths: Sequence[str], multi_line: bool, header_style: str, validate: bool,
    by_path: bool, header: Sequence[str | None] | None,
) -> DataFrame:
    if header is not None:
        cells = list(header)
    elif validate:
        cells = _cells(spark, _inspect(spark, paths, multi_line), multi_line)
    else:
        cells = next((h for p in paths if (h := csv_header(spark, p, multi_line))), [])
    names = normalize_headers(cells, header_style)
    require_free(names)
    folded = {n.lower() for n in names}
    if len(folded) < len(names) and spark.conf.get("spark.sql.caseSensitive") != "true":
        raise ValueError("headers differ only in case: set spark.sql.caseSensitive=true")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.options(**_CSV_OPTIONS).option("multiLine", multi_line)
    scan = reader.option("header", True).schema(schema).csv(list(paths))
    return to_text_table(attach_file_order(scan, by_path))
