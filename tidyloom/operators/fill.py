"""Directional fill over the whole table without a global window.

The order is cut into contiguous chunks of bounded size (see ``order``).

1. Each chunk is summed up in one row: how many rows it has, and its first and last
   value. This reduces the table on the map side. With a limit, a second such pass
   counts the rows behind the last and in front of the first value, so that distances
   across chunks are known without numbering all rows.
2. What a chunk sees outside itself is a scan over these rows, in order. As long as
   more than ``TOP_ROWS`` of them depend on each other, they are sorted into ranges of that
   size, whatever files or stretches they come from; each range is summed up in turn, the
   scan is solved for the ranges first, and carried down into them.
3. The carried values are joined to the table on the chunk, and running windows inside
   a chunk find the nearest value before and after a row. "After" is a running
   window in descending order, because a frame that reaches forward to the end is
   evaluated anew for every row. The windows take the only shuffle of the table: the
   join is broadcast or partitioned alike.

The rows of steps 1 and 2 are written to the checkpoint folder, so their number is known
before anything is gathered or broadcast. All columns share the windows and the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyloom.functions.whitespace import is_blank
from tidyloom.names import HIDDEN, ROW, known, ref, refs, scope_of
from tidyloom.operators.cells import count_true
from tidyloom.operators.order import (
    chunk_columns,
    position_columns,
    require_order,
    with_solid_chunks,
)
from tidyloom.session import cut

#: Rows of summaries that one window may hold, and bytes of them that are broadcast.
TOP_ROWS = 1 << 16
BROADCAST_BYTES = 32 << 20

# Where a direction looks for a value, in order of preference.
_SIDES = {"forward": ("prev",), "backward": ("next",), "both": ("prev", "next")}

_NUMBER = HIDDEN + "number"
_SIZE = HIDDEN + "size"
_START = HIDDEN + "start"
_ABOVE = HIDDEN + "above"


@dataclass(frozen=True)
class _Look:
    """One column looked up on one side, and the hidden columns of that lookup."""

    column: str
    side: str
    index: int

    def at(self, level: str) -> str:
        return f"{HIDDEN}{level}_{self.side}{self.index}"


def fill_directional(
    df: DataFrame,
    columns: Sequence[str],
    directions: Mapping[str, str] | None = None,
    limit: int | None = None,
    trim: bool = True,
    tally: str | None = None,
) -> DataFrame:
    """Fill blank cells from the nearest non-blank cell of the column.

    ``directions`` maps a column to ``forward`` (the default), ``backward`` or
    ``both`` (forward wins). At most ``limit`` cells of a gap are filled per direction.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    wanted = {c: (directions or {}).get(c, "forward") for c in known(df, columns)}
    targets = {c: _SIDES[d] for c, d in wanted.items() if d in _SIDES}
    if not targets or limit == 0:
        return df.withColumn(tally, F.lit(0)) if tally else df
    require_order(df, "directional fill")
    df = with_solid_chunks(df)

    looks = [_Look(c, side, i) for i, (c, sides) in enumerate(targets.items()) for side in sides]
    counted = limit is not None
    ends = cut(_chunk_ends(df, looks, trim))
    if counted:
        ends = cut(_counted_ends(df, ends, looks))
    carried = _small(_carried(ends, scope_of(df), chunk_columns(df)[len(scope_of(df)) :], looks, counted))
    joined = _near(df, looks, trim, counted).join(carried, chunk_columns(df))

    new, fills = {}, []
    for c in targets:
        found = [_found(look, limit) for look in looks if look.column == c]
        filled = F.when(is_blank(ref(c), trim), F.coalesce(*found))
        fills.append(filled.isNotNull())
        new[c] = F.coalesce(filled, ref(c))
    kept = list(df.columns)
    if tally is not None:
        new[tally] = count_true(fills)
        kept.append(tally)
    return joined.withColumns(new).select(refs(dict.fromkeys(kept)))


def _running(by: Sequence[str], order: Sequence[str], side: str, own_row: bool = False):
    """Window of the rows before (``prev``) or after (``next``) the current one."""
    keys = refs(order) if side == "prev" else [c.desc() for c in refs(order)]
    end = Window.currentRow if own_row else -1
    window = Window.partitionBy(*refs(by)).orderBy(*keys)
    return window.rowsBetween(Window.unboundedPreceding, end)


def _near(df: DataFrame, looks: Sequence[_Look], trim: bool, counted: bool) -> DataFrame:
    """Nearest (row number, value) on each side of a row, within its chunk."""
    on, order = chunk_columns(df), position_columns(df)
    number = F.lit(0)
    if counted:
        number = F.row_number().over(Window.partitionBy(*refs(on)).orderBy(*refs(order)))
    df = df.withColumn(_NUMBER, number.cast("bigint"))
    return df.withColumns(
        {
            look.at("near"): F.last(
                F.when(~is_blank(ref(look.column), trim), _pair(ref(_NUMBER), ref(look.column))),
                ignorenulls=True,
            ).over(_running(on, order, look.side, own_row=True))
            for look in looks
        }
    )


def _chunk_ends(df: DataFrame, looks: Sequence[_Look], trim: bool) -> DataFrame:
    """One row per chunk: its size, and the value that the chunks around it look at, with its position."""
    order = F.struct(*refs(position_columns(df)))
    ends = [F.count("*").alias(_SIZE)]
    for look in looks:
        cell = ref(look.column)
        held = F.when(~is_blank(cell, trim), order)
        ends.append(_outermost(look, _pair(ref(ROW).cast("bigint"), cell), held).alias(look.at("end")))
    return df.groupBy(*refs(chunk_columns(df))).agg(*ends)


def _counted_ends(df: DataFrame, ends: DataFrame, looks: Sequence[_Look]) -> DataFrame:
    """``ends`` with row numbers in the chunk instead of positions.

    A second pass over positions only: within a chunk they are whole numbers, so the rows
    behind the last value, or in front of the first, are counted in a hash aggregation.
    """
    on = chunk_columns(df)
    places = ends.select(*refs(on), *[ref(look.at("end"))["at"].alias(look.at("end")) for look in looks])
    row = ref(ROW).cast("bigint")
    outer = {look: row > ref(look.at("end")) if look.side == "prev" else row < ref(look.at("end")) for look in looks}
    counts = df.select(*refs(on), ref(ROW)).join(_small(places), on).groupBy(*refs(on)).agg(
        *[F.count_if(test).alias(look.at("outer")) for look, test in outer.items()]
    )
    joined = ends.join(_small(cut(counts)), on)
    return joined.select(
        *refs(on), ref(_SIZE),
        *[
            F.when(
                ref(look.at("end")).isNotNull(),
                _pair(ref(_SIZE) - ref(look.at("outer")) if look.side == "prev" else ref(look.at("outer")) + 1, ref(look.at("end"))["v"]),
            ).alias(look.at("end"))
            for look in looks
        ],
    )


def _small(table: DataFrame) -> DataFrame:
    """A table that was cut, marked for broadcasting if its rows and its text are few."""
    texts = [ref(f.name)["v"] for f in table.schema if "v" in getattr(f.dataType, "names", [])]
    size = sum([F.coalesce(F.octet_length(t), F.lit(0)) for t in texts], F.lit(len(table.columns) * 32).cast("bigint"))
    total = table.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def _carried(
    parts: DataFrame, scope: Sequence[str], order: Sequence[str], looks: Sequence[_Look], counted: bool, depth: int = 0
) -> DataFrame:
    """Per part: rows in front of it, and the nearest value outside it on each side."""
    most = parts.groupBy(*refs(scope)).count().agg(F.max("count")).first()[0] or 0
    on = [*scope, *order]
    if most <= TOP_ROWS:
        return cut(_within(parts, scope, order, looks, counted).select(*refs(on), ref(_START), *_carries(looks)))
    ranges = -(-parts.count() // TOP_ROWS)
    number = f"{HIDDEN}range{depth}"
    placed = cut(parts.repartitionByRange(ranges, *refs(on)).withColumn(number, F.spark_partition_id()))
    level = [*scope, number]
    inside = _within(placed, level, order, looks, counted)
    above = _carried(cut(_range_ends(inside, level, order, looks)), scope, [number], looks, counted, depth + 1)
    above = above.withColumnsRenamed({_START: _ABOVE, **{look.at("carry"): look.at("out") for look in looks}})
    joined = inside.join(_small(above), level)
    nearest = [
        F.coalesce(_moved(ref(look.at("carry")), ref(_ABOVE)), ref(look.at("out"))).alias(look.at("carry"))
        for look in looks
    ]
    return cut(joined.select(*refs(on), (ref(_START) + ref(_ABOVE)).alias(_START), *nearest))


def _within(
    parts: DataFrame, level: Sequence[str], order: Sequence[str], looks: Sequence[_Look], counted: bool
) -> DataFrame:
    """The scan within each value of ``level``: rows in front, and the nearest value on each side, of each part."""
    parts = _from_start(parts, level, order, looks, counted)
    return parts.withColumns(
        {
            look.at("carry"): F.last(ref(look.at("end")), ignorenulls=True).over(_running(level, order, look.side))
            for look in looks
        }
    )


def _carries(looks: Sequence[_Look]) -> list[Column]:
    return [ref(look.at("carry")) for look in looks]


def _range_ends(parts: DataFrame, level: Sequence[str], order: Sequence[str], looks: Sequence[_Look]) -> DataFrame:
    """The ends of the parts, whose row numbers start with the range, summed up once more per range."""
    ends = [F.sum(_SIZE).alias(_SIZE)]
    for look in looks:
        end = ref(look.at("end"))
        held = F.when(end.isNotNull(), F.struct(*refs(order)))
        ends.append(_outermost(look, end, held).alias(look.at("end")))
    return parts.groupBy(*refs(level)).agg(*ends)


def _outermost(look: _Look, value: Column, order: Column) -> Column:
    """Looking back one meets the last value of a part first, looking ahead the first.
    Parts whose ``order`` is null hold no value and are passed over."""
    return F.max_by(value, order) if look.side == "prev" else F.min_by(value, order)


def _from_start(
    parts: DataFrame, by: Sequence[str], order: Sequence[str], looks: Sequence[_Look], counted: bool
) -> DataFrame:
    """Add the number of rows before each part and count row numbers from there."""
    if not counted:
        return parts.withColumn(_START, F.lit(0).cast("bigint"))
    before = F.sum(_SIZE).over(_running(by, order, "prev"))
    parts = parts.withColumn(_START, F.coalesce(before, F.lit(0)))
    return parts.withColumns(
        {look.at("end"): _moved(ref(look.at("end")), ref(_START)) for look in looks}
    )


def _pair(number: Column, value: Column) -> Column:
    return F.struct(number.alias("at"), value.alias("v"))


def _moved(pair: Column, rows: Column) -> Column:
    """A (row number, value) pair with ``rows`` more rows in front of it."""
    return F.when(pair.isNotNull(), _pair(pair["at"] + rows, pair["v"]))


def _found(look: _Look, limit: int | None) -> Column:
    """The nearest value on one side, if it is close enough."""
    near = _moved(ref(look.at("near")), ref(_START))
    found = F.coalesce(near, ref(look.at("carry")))
    if limit is None:
        return found["v"]
    distance = F.abs(ref(_START) + ref(_NUMBER) - found["at"])
    return F.when(distance <= limit, found["v"])
