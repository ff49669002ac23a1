"""Near-duplicate documents by SimHash fingerprints, searched with pivot distance tables.

Every distinct fingerprint gets a table row with its Hamming distances to ``len(PIVOTS)`` reference
fingerprints. For two fingerprints that differ in at most ``RADIUS`` bits, no such distance can
differ by more than ``RADIUS``, so a pair whose largest coordinate difference is larger is discarded
without a look at the fingerprints; the survivors are verified.

Which pairs meet at all is settled by equality, as a distributed join needs it: ``RADIUS`` differing
bits leave at least two of five stretches of the fingerprint unchanged, so each fingerprint stands in
ten groups, one for each pair of stretches. That loses nothing, and a pair is reported by the first
of its groups only. Equal fingerprints are one row from the start, so copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from operator import and_, or_

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import column, join_hot, map_pandas, narrow, sized
from tidyloom.llm.components import smallest_members
from tidyloom.names import HIDDEN, require_free
from tidyloom.session import cut

WORDS, SEED, RADIUS = 3, 42, 3
#: Reference fingerprints: multiples of the golden ratio's bits, modulo 2**64.
PIVOTS = [(k * 0x9E3779B97F4A7C15) % (1 << 64) for k in range(1, 17)]
#: Bit ranges of the five stretches.
STRETCHES = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]
_ID, _KEY, _COPIES = (HIDDEN + x for x in ("kept_id", "kept_key", "copies"))
#: Shingles counted at once.
SLICE = 1 << 15

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None) -> int:
    """64 bits as a signed number; zero for a text without words."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    keep = ~blank
    keep[:-1] |= blank[:-1] & ~blank[1:]  # one blank before each word
    joined = np.where(blank, np.uint8(32), raw)[keep].tobytes().lstrip(b" ")
    if not joined:
        return 0
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(joined))
    n = max(1, len(starts) - WORDS + 1)
    ends = ends[min(WORDS, len(starts)) - 1 :]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for s in range(0, n, SLICE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[s : min(n, s + SLICE)].tolist(), ends[s : s + SLICE].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """``(doc_id, fp)`` of each row, from the whole text; with ``keyed`` also ``text_key``, a hash of the text."""
    rows = narrow(df, id_col, text_col)
    if keyed:
        rows = rows.withColumn("text_key", F.xxhash64("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(fp=np.array([fingerprint(t) for t in b["text"]], np.int64))

    return map_pandas(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, {'text_key bigint, ' if keyed else ''}fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(stretches: tuple[int, ...]) -> int:
    return _signed(sum(((1 << (hi - lo)) - 1) << lo for lo, hi in (STRETCHES[k] for k in stretches)))


def pivot_table(fps: DataFrame) -> DataFrame:
    """``(fp, near, far)``: the distances to the first and the last eight pivots, a byte each."""

    def packed(pivots: list[int]) -> Column:
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("bigint"), 8 * k) for k, p in enumerate(pivots)]
        return reduce(lambda a, b: a.bitwiseOR(b), parts)

    return fps.select("fp", packed(PIVOTS[:8]).alias("near"), packed(PIVOTS[8:]).alias("far"))


def close_pairs(fps: DataFrame) -> DataFrame:
    """All pairs ``(a, b)``, ``a < b``, of the distinct fingerprints ``fps(fp)`` within ``RADIUS`` bits, each once."""
    groups = list(combinations(range(len(STRETCHES)), 2))
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(g))) for g in groups])
    rows = pivot_table(fps).select("fp", "near", "far", F.posexplode(keys).alias("part", "key"))
    a, b = rows.alias("a"), rows.alias("b")
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))

    def coordinate(name: str, k: int) -> Column:
        side = [F.shiftright(F.col(f"{s}.{name}"), 8 * k).bitwiseAND(F.lit(255)) for s in "ab"]
        return F.abs(side[0] - side[1]) <= RADIUS

    survives = reduce(and_, [coordinate(name, k) for name in ("near", "far") for k in range(8)])
    first = reduce(
        or_,
        [
            reduce(and_, [F.col("a.part") == n, *[apart.bitwiseAND(F.lit(_mask((k,)))) != 0 for k in range(g[1]) if k != g[0]]])
            for n, g in enumerate(groups)
        ],
    )
    same_group = (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key"))
    pairs = a.join(b, same_group & (F.col("a.fp") < F.col("b.fp")) & survives & (F.bit_count(apart) <= RADIUS) & first)
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = True) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of each row; with ``keyed`` also ``text_key`` and ``kept``.

    A null text is like an empty one: fingerprint zero, linked as any other. Repeated rows have one
    component and are each returned. A null identifier is never the smallest; a component of nulls
    only has a null ``component_id``. Identifiers may repeat with other texts, so rows are told apart by
    identifier and hash of the text: ``kept`` are the rows of the smallest such pair of each component,
    more than one only if that row is repeated. Other columns are not read.
    """
    rows = cut(fingerprints(df, id_col, text_col, keyed))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")) if keyed else F.min("doc_id")
    nodes = cut(rows.groupBy(F.col("fp").alias("node")).agg(least.alias("id"), F.count("*").alias("copies")))
    links = close_pairs(nodes.select(F.col("node").alias("fp")))
    members = cut(smallest_members(nodes, links).withColumnRenamed("node", "fp"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    found = join_hot(rows, members, "fp", "copies")
    if not keyed:
        return found.select("doc_id", text, "component_id")
    first = F.col("component_id.doc_id")
    kept = F.col("doc_id").eqNullSafe(first) & (F.col("text_key") == F.col("component_id.text_key"))
    return found.select("doc_id", text, first.alias("component_id"), "text_key", kept.alias("kept"))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group: of those with the smallest identifier, that with the smallest hash of its text.

    A group of null identifiers only keeps one of them. Of rows with equal identifiers and texts one is
    taken, whatever their other columns hold. Reserved column names raise.
    """
    require_free(docs.columns)
    kept = found.where("kept").groupBy(F.col("doc_id").alias(_ID), F.col("text_key").alias(_KEY))
    kept = cut(kept.agg(F.count("*").alias(_COPIES)))
    key = F.xxhash64(column(text_col))
    same = column(id_col).eqNullSafe(F.col(_ID)) & (key == F.col(_KEY))
    single = docs.join(kept.where(F.col(_COPIES) == 1), same, "left_semi")
    repeated = docs.join(sized(kept.where(F.col(_COPIES) > 1)), same).dropDuplicates([_ID, _KEY])
    return single.unionByName(repeated.select(*[column(c) for c in docs.columns]))
