"""Row order that survives shuffles.

Order-dependent rules need a position per row and, for filling, contiguous chunks
of bounded size. The position is attached once, next to the source, as hidden
columns:

* parquet files: (file, number of the row in it);
* other files: (file, start of the split, running number within the task). The number
  counts up inside a split, so this is the order of the rows in the files;
* a given ``order_by``: a unique key of the table.

Files are numbered in the order of their paths, from the listing that the scan has made anyway.
All parts of a position are thus whole numbers, and fit together in one of fixed width (``packed``).

A chunk is a contiguous run of at most ``CHUNK_ROWS`` rows. Nothing here shuffles,
except for keys that are neither integers nor evenly spread: those are sorted once
and the sorted table is written to the checkpoint folder, since the bounds of a
range partitioning may change when it is evaluated again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyloom.names import BLOCK, CHUNK, FILE, HIDDEN, ROW, ref, refs, scope_of
from tidyloom.session import cut

# The unit of parallelism of a fill: a task holds whole chunks, so they are kept small.
CHUNK_ROWS = 1 << 18

# Files whose numbers are a constant of the plan, and bytes of their paths that are broadcast.
FEW_FILES, LISTING_BYTES = 32, 64 << 20

# Decimal places of a packed position: 10 for the row (a task has at most 2^33), 15 for the byte at which its split starts.
_WIDE = "decimal(38,0)"
_UNITS = {FILE: 10**25, BLOCK: 10**10, ROW: 1}

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_ordered(df: DataFrame) -> bool:
    return ROW in df.columns


def _numbers_rows(df: DataFrame) -> bool:
    """Whether the source (parquet) knows the number of a row in its file."""
    return "row_index" in df.select("_metadata").schema["_metadata"].dataType.fieldNames()


def attach_file_order(df: DataFrame, by_path: bool = False) -> DataFrame:
    """Position from the scan itself. ``df`` must come straight from a file source.

    With ``by_path``, ``FILE`` is the path of the file instead of its number.
    """
    position = {FILE: F.col("_metadata.file_path")}
    if _numbers_rows(df):
        position[ROW] = F.col("_metadata.row_index")
    else:
        position[BLOCK] = F.col("_metadata.file_block_start")
        position[ROW] = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ordered = df.select("*", *[e.alias(c) for c, e in position.items()])
    if not by_path:
        ordered = _numbered(ordered, sorted(set(df.inputFiles())))
    return ordered.withColumn(CHUNK, _chunk_of(ref(ROW), CHUNK_ROWS))


def _numbered(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Replace the path of each row's file by its number.

    A few paths are looked up in a constant, which is pruned where no rule needs the order.
    """
    unknown = F.raise_error(F.concat(F.lit("a file that was not listed: "), ref(FILE))).cast("bigint")
    if len(paths) <= 1:
        return df.withColumn(FILE, F.lit(0).cast("bigint"))
    # A listing writes local paths with three slashes, a row's file with one.
    named = {spelled: k for k, p in enumerate(paths) for spelled in (p, p.replace("file:///", "file:/", 1))}
    if len(paths) <= FEW_FILES:
        number = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])[ref(FILE)].cast("bigint")
        return df.withColumn(FILE, F.coalesce(number, unknown))
    path, number = HIDDEN + "path", HIDDEN + "number"
    table = df.sparkSession.createDataFrame(list(named.items()), f"{path} string, {number} bigint")
    if sum(map(len, paths)) <= LISTING_BYTES:
        table = F.broadcast(table)
    joined = df.join(table, ref(FILE) == ref(path), "left")
    return joined.withColumn(FILE, F.coalesce(ref(number), unknown)).drop(path, number)


def depends_on_splits(df: DataFrame) -> bool:
    """Whether another scan of the same files may cut them into other chunks.

    The order of the rows is the same then, but their numbers are not: the splits of
    a text file follow the number of cores at hand when the scan starts.
    """
    return BLOCK in df.columns


def attach_key_order(
    df: DataFrame,
    order_by: str | Sequence[str],
    chunked: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Position from a unique, never-null key. ``chunked`` only matters for filling."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    position = ref(keys[0]) if len(keys) == 1 else F.struct(*refs(keys))
    if not chunked:
        return df.withColumn(ROW, position)
    if len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, _INTEGERS):
        width = _even_width(df, keys[0], chunk_rows)
        if width is not None:
            number = position.cast("bigint")
            return df.withColumns({ROW: number, CHUNK: _chunk_of(number, width)})
    in_order = df.orderBy(*refs(keys)).withColumn(ROW, F.monotonically_increasing_id())
    return cut(in_order.withColumn(CHUNK, _chunk_of(ref(ROW), chunk_rows)))


def _chunk_of(number: Column, width: int) -> Column:
    """``number div width``: rises with the number, and cannot overflow."""
    return F.call_function("div", number, F.lit(width).cast("bigint"))


def _even_width(df: DataFrame, key: str, chunk_rows: int) -> int | None:
    """Width of equal key ranges that hold a bounded number of rows, if there is one.

    Reads the key column only. Without this check a key with dense and empty
    stretches could put most rows in one range.
    """
    number = ref(key).cast("bigint")
    low, high, rows, nulls = df.agg(
        F.min(number), F.max(number), F.count("*"), F.count_if(number.isNull())
    ).first()
    if nulls:
        raise ValueError(f"order_by {key!r} is null in {nulls} rows: it must be a unique key")
    if not rows:
        return 1
    parallel = df.sparkSession.sparkContext.defaultParallelism
    chunks = max(parallel, -(-rows // chunk_rows))
    width = min(max(1, -(-(high - low + 1) // chunks)), (1 << 63) - 1)
    if width <= chunk_rows:
        return width  # unique integers: a range cannot hold more rows than its width
    sizes = df.groupBy(_chunk_of(number, width).alias(CHUNK)).count()
    largest = sizes.agg(F.max("count")).first()[0]
    return width if largest <= 4 * chunk_rows else None


def without_order(df: DataFrame) -> DataFrame:
    return df.select(refs(c for c in df.columns if c not in (FILE, BLOCK, ROW, CHUNK)))


def position_columns(df: DataFrame) -> list[str]:
    """Sorting by these columns gives the order of the rows."""
    return scope_of(df) + [c for c in (FILE, BLOCK, ROW) if c in df.columns]


def chunk_columns(df: DataFrame) -> list[str]:
    return scope_of(df) + [c for c in (FILE, BLOCK, CHUNK) if c in df.columns]


def with_solid_chunks(df: DataFrame) -> DataFrame:
    """``df`` with chunk columns that are known never to be null.

    They never are. Saying so keeps null filters, and with them differences between
    otherwise equal branches of a plan, out of the joins on them.
    """
    zero = {"string": F.lit("")}
    types = dict(df.dtypes)
    return df.withColumns(
        {c: F.coalesce(ref(c), zero.get(types[c], F.lit(0))) for c in chunk_columns(df)}
    )


def packed(df: DataFrame) -> Column:
    """The position as one number of fixed width, of which an aggregation can keep the least or the largest in place."""
    columns = [c for c in (FILE, BLOCK, ROW) if c in df.columns]
    if columns == [ROW]:
        return ref(ROW)
    parts = [ref(c).cast(_WIDE) * F.lit(str(_UNITS[c])).cast(_WIDE) for c in columns]
    return reduce(lambda a, b: a + b, [p.cast(_WIDE) for p in parts]).cast(_WIDE)


def unpacked(df: DataFrame, value: Column) -> dict[str, Column]:
    """The hidden columns of the row with that packed position."""
    if not {FILE, BLOCK} & set(df.columns):
        row = {ROW: value}
    else:
        units = {c: F.lit(str(_UNITS[c])).cast(_WIDE) for c in (FILE, BLOCK)}
        rest = value % units[FILE]
        row = {
            FILE: F.floor((value - rest) / units[FILE]).cast("bigint"),
            BLOCK: F.floor((rest - rest % units[BLOCK]) / units[BLOCK]).cast("bigint"),
            ROW: (rest % units[BLOCK] if BLOCK in df.columns else rest).cast("bigint"),
        }
    return {c: e for c, e in (row | {CHUNK: _chunk_of(row[ROW], CHUNK_ROWS)}).items() if c in df.columns}


def position(df: DataFrame) -> Column:
    """The position as one comparable value."""
    columns = position_columns(df)
    return ref(columns[0]) if len(columns) == 1 else F.struct(*refs(columns))


def in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*refs(position_columns(df)))


def require_order(df: DataFrame, what: str) -> None:
    if not is_ordered(df):
        raise ValueError(f"{what} depends on the order of the rows: give order_by a unique key")
