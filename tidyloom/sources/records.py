"""An account of the records of CSV files, from their raw lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.sources.readers import lines_of


def record_account(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``(file, columns, records, short, long, broken, empty_lines)`` of each file.

    Reading pads short records and cuts long ones without a word; this tells how many there
    are. ``columns`` is the width of the header, the first line with any character, which is no record.
    A record is ``short`` or ``long`` if it has fewer or more cells. A line is ``broken`` if a quoted
    cell goes on in the next one: it is counted as that, not as a record. Lines without
    any character are skipped by the reader. An empty file has no columns and no records.

    One pass over the lines: they are counted by file and number of cells on the map side, so
    what is shuffled is a few rows per file, however large it is.
    """
    line = F.col("value")
    # Quoted parts hide their commas; a doubled quote is the seam of two such parts.
    bare = F.regexp_replace(line, '"[^"]*"', "")
    cells = F.length(bare) - F.length(F.replace(bare, F.lit(","))) + 1
    odd = F.contains(bare, F.lit('"'))
    kind = F.when(line == "", 0).when(odd, -1).otherwise(cells).cast("int").alias("cells")
    header = F.expr("min(if(block = 0 and value <> '', number, null))").alias("first")
    widths = lines_of(spark, [path] if isinstance(path, str) else list(path)).groupBy("file", kind).agg(F.count("*").alias("n"), header)
    width = F.expr("min_by(cells, first) filter (where first is not null)").alias("columns")
    files = widths.groupBy("file").agg(width, F.collect_list(F.struct("cells", "n")).alias("counts"))

    def total(test: str):
        return F.expr(f"aggregate(filter(counts, c -> {test}), 0L, (a, c) -> a + c.n)")

    headers = F.when(F.col("columns") > 0, 1).otherwise(0)
    return files.select(
        "file",
        F.coalesce(F.greatest("columns", F.lit(0)), F.lit(0)).alias("columns"),
        (total("c.cells > 0") - headers).alias("records"),
        total("c.cells > 0 and c.cells < columns").alias("short"),
        total("c.cells > columns").alias("long"),
        total("c.cells < 0").alias("broken"),
        total("c.cells = 0").alias("empty_lines"),
    )
