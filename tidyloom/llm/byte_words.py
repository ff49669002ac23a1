"""Words of many texts at once: bounds and hashes over the bytes of an Arrow column.

No Python object is made for a word. A byte table says which bytes belong to words, so words are
maximal runs of such bytes within one text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from tidyloom.llm.common import batches

_ODD = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 4096

#: Words between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of ASCII letters and digits and of all other characters beyond ASCII.
ALPHANUMERIC = np.ones(256, bool)
ALPHANUMERIC[[b for b in range(0x80) if not chr(b).isalnum()]] = False


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with batches of bounded bytes."""
    batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins and the last one ends; a null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_bounds(raw: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of the first word of each text (and of all words at the end)."""
    member = inside[raw]
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    full = np.flatnonzero(bounds[1:] > bounds[:-1])  # a text begins and ends its words, whatever stands beside it
    first[bounds[full]] = member[bounds[full]]
    last[bounds[full + 1] - 1] = member[bounds[full + 1] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lanes_of(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros stand behind the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of words of which ``left`` bytes are left, zeros behind their ends."""
    return lanes[at] & _MASKS[np.minimum(left, 8)]


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word."""
    lanes, size = lanes_of(raw), ends - starts
    out = size.astype(np.uint64) * _OTHER
    live = np.flatnonzero(size <= LONG)
    at, left = starts[live], size[live]
    while len(live):
        acc = (out[live] ^ lane(lanes, at, left)) * _ODD
        acc ^= acc >> np.uint64(29)
        acc *= _OTHER
        out[live] = acc ^ (acc >> np.uint64(32))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].tobytes())
    return out


def same_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each word of ``raw`` has the bytes of its counterpart in ``other``, which ends with eight spare bytes."""
    size = ends - starts
    out = size == to - at
    live = np.flatnonzero(out & (size <= LONG))
    mine, its = lanes_of(raw), np.ndarray((len(other) - 7,), "<u8", other, 0, (1,))
    a, b, left = starts[live], at[live], size[live]
    while len(live):
        same = lane(mine, a, left) == lane(its, b, left)
        out[live[~same]] = False
        more = same & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    for k in np.flatnonzero(out & (size > LONG)).tolist():
        out[k] = bool((raw[starts[k] : ends[k]] == other[at[k] : to[k]]).all())
    return out


def mix(acc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """One more hash into a sequence of hashes."""
    acc = (acc ^ value) * _ODD
    acc ^= acc >> np.uint64(32)
    return acc


def slices(bounds: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Consecutive texts of about ``size`` bytes together; a longer text stands alone."""
    out, a, n = [], 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        b = min(b, n)
        out.append((a, b))
        a = b
    return out
