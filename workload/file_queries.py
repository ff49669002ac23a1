"""Queries through files: each writes a table in an awkward form to the shared folder and reads it back."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.names import SCOPE
from tidyloom.plans.clean import clean
from tidyloom.plans.files import export_file
from tidyloom.session import checkpoint_dir
from tidyloom.sources.batch import by_source, clean_many, sources_in
from tidyloom.sources.readers import load
from tidyloom.sources.records import record_account
from workload.fixtures import EVENTS

Query = Callable[[SparkSession, str], DataFrame]

#: Duplicates, fill and empty rows, which depend on the order of the rows in each file.
ORDERED_RULES = {
    "dedup": {"enabled": True, "mode": "byColumns", "columns": ["kind", "user", "reading"], "keep": "first"},
    "missing": {
        "fillForwardBackward": {"enabled": True, "columns": ["reading"], "limit": 2},
        "removeEmptyRows": {"enabled": True, "condition": "any", "columnsMode": "custom", "columns": ["reading", "user"]},
    },
}
COUNTED = ["rowsBefore", "rowsAfter", "removedEmptyRows", "removedDuplicates", "filledForwardBackwardCells"]

#: Records of `customer` in five forms, and some lines without any character. Fixed values.
RECORD = '''
case when c_custkey % 5 = 0 then concat_ws(",", c_custkey, c_name, c_mktsegment, c_nationkey)
     when c_custkey % 5 = 1 then concat(c_custkey, ",", c_name, if(c_custkey % 50 = 6, "\\n", ""))
     when c_custkey % 5 = 2 then concat_ws(",", c_custkey, c_name, c_mktsegment, c_nationkey, "more", "")
     when c_custkey % 5 = 3 then concat(c_custkey, ",\\"", c_name, ", Inc\\",\\"said \\"\\"", c_mktsegment, "\\"\\"\\",", c_nationkey)
     else concat(c_custkey, ",,  ,") end
'''
CLOCK = datetime(2024, 1, 2, 3, 4, 5)


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4()}"


def _raw_csv(spark: SparkSession, sf_dir: str, header: str) -> str:
    """Write the records as they are, below a header, in several files."""
    path = _folder(spark)
    lines = spark.read.parquet(f"{sf_dir}/customer.parquet").repartition(3).select(F.expr(RECORD).alias("line"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines.select(F.when(first, F.concat(F.lit(f"{header}\n"), "line")).otherwise(F.col("line"))).write.text(path)
    return path


def _ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short records padded, long ones cut, quoted cells with commas and quotes, empty lines skipped."""
    return clean(load(spark, _raw_csv(spark, sf_dir, "id,name,segment,nation"), "csv"), {}).df


def _account(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = record_account(spark, _raw_csv(spark, sf_dir, "id,name,segment,nation"))
    sums = [F.sum(c).alias(c) for c in ("records", "short", "long", "broken", "empty_lines")]
    return found.agg(F.max("columns").alias("columns"), *sums)


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank and a repeated header."""
    return clean(load(spark, _raw_csv(spark, sf_dir, "id, ,name,name"), "csv"), {}).df


def _export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a file to a cleaned file with a name of its own, and back."""
    rules = {"format": {"text": {"enabled": True, "trim": True}, "currency": {"enabled": True, "columns": ["c_acctbal"]}}}
    target = export_file(spark, f"{sf_dir}/customer.parquet", rules, _folder(spark), "csv", clock=lambda: CLOCK)
    return clean(load(spark, target, "csv"), {}).df.withColumn("file", F.lit(target.rpartition("/")[2]))


def _event_files(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """`events` in eight files, each in the order of the events."""
    path = _folder(spark)
    rows = EVENTS.frame(spark, sf_dir).withColumn("part", F.col("rk") % 8).repartition(8, "part")
    writer = rows.sortWithinPartitions("part", "rk").drop("rk").write.partitionBy("part")
    if fmt == "csv":
        writer.option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    else:
        writer.parquet(path)
    return path


def _batches(spark: SparkSession, sf_dir: str):
    files = sources_in(spark, _event_files(spark, sf_dir, "parquet"))
    return clean_many(spark, dict.fromkeys(files, ORDERED_RULES))


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many files in one plan: duplicates and fills stay within a file."""
    part = F.regexp_extract("source", r"part=(\d+)", 1).alias("source")
    parts = [by_source(b).select(part, "id", "kind", "user", "reading") for b in _batches(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)


def _many_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.regexp_extract(SCOPE, r"part=(\d+)", 1).alias("source")
    return reduce(DataFrame.unionByName, [b.result.stats.select(part, *COUNTED) for b in _batches(spark, sf_dir)])


def _first_of_files(keep: str) -> Query:
    """Which row of a key stays is told by its identifier: the first, or last, in the order of files and lines."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table = load(spark, _event_files(spark, sf_dir, "csv"), "csv").drop("part")
        rule = {"enabled": True, "mode": "byColumns", "columns": ["kind", "user"], "keep": keep}
        return clean(table, {"dedup": rule}).df

    return run


def _filled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fill that goes on across the files of one table."""
    table = load(spark, _event_files(spark, sf_dir, "csv"), "csv").drop("part")
    rule = {"enabled": True, "columns": ["sparse"], "directions": {"sparse": "both"}, "limit": 500}
    return clean(table.select("id", "sparse", *[c for c in table.columns if c.startswith("__")]), {"missing": {"fillForwardBackward": rule}}).df


def queries() -> dict[str, Query]:
    return {
        "csv_ragged": _ragged,
        "csv_ragged_account": _account,
        "csv_headers": _headers,
        "export_round_trip": _export,
        "clean_many_shared": _many,
        "clean_many_stats": _many_stats,
        "dedup_files_first": _first_of_files("first"),
        "dedup_files_last": _first_of_files("last"),
        "fill_files": _filled_files,
    }
