"""Repeated passages, found with prefix-partitioned suffix trees over words.

A suffix is what follows a word of a text, up to ``window`` words; it is spelled in chunks of a few
words, each one symbol of the tree. Suffixes are split by their prefixes into groups that fit in
memory: first by one chunk; the suffixes of a group that is too large by two chunks, and so on. The
sizes are counted over all suffixes before anything is moved. A group's subtree is built from the
sorted suffixes and the lengths of the prefixes that neighbours share; its internal nodes of the full
depth are the repeats, and what hangs below them are their places.

Most suffixes share with no other one even the sequence of words that a window is sure to hold, so
they would be leaves at the root of every tree and need not travel. Each window has one landmark, the
sequence of about half its words with the least hash; equal windows have equal landmarks. Only windows
whose landmark stands in more than one place become suffixes.

Texts are kept in files of about ``PART_BYTES`` in the shared folder, each read by one task a pass.
Equal suffixes of a file are one from the start, so a passage that stands everywhere sends one row a file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.byte_words import SPACED, hash_words, map_arrow, mix, slices, texts, word_bounds
from tidyloom.llm.common import file_system, map_pandas, narrow, new_folder, one_file_a_task
from tidyloom.session import cut

WINDOW = 35
#: Bytes of text in a file and worked on at once; suffixes of a group; landmarks counted by a task.
PART_BYTES, SLICE_BYTES, GROUP, BUCKET = 32 << 20, 1 << 20, 1 << 20, 1 << 21
_PLACE = np.uint64((1 << 28) - 1)


@dataclass(frozen=True)
class Spelling:
    """How a window of words is spelled in chunks; the last chunk may overlap the one before it."""

    window: int

    @property
    def size(self) -> int:
        return max(1, self.window // 5)

    @property
    def offsets(self) -> list[int]:
        whole = list(range(0, self.window - self.size + 1, self.size))
        return whole if whole[-1] == self.window - self.size else [*whole, self.window - self.size]

    @property
    def symbol(self) -> str:
        """A window has 128 bits at least."""
        return "<u4" if len(self.offsets) > 3 else "<u8"

    @property
    def landmark(self) -> int:
        """Chunks of a landmark."""
        return (len(self.offsets) + 1) // 2

    def chunks(self, h: np.ndarray) -> np.ndarray:
        """The hash of the chunk that begins at each word."""
        n = max(0, len(h) - self.size + 1)
        acc = np.zeros(n, np.uint64)
        for j in range(self.size):
            acc = mix(acc, h[j : j + n])
        return acc

    def prefix(self, chunks: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
        """The hash of the first ``depth`` chunks of the windows that begin at these words."""
        acc = np.zeros(len(at), np.uint64)
        for o in self.offsets[:depth]:
            acc = mix(acc, chunks[at + o])
        return acc

    def keys(self, chunks: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The symbols of windows, one row each."""
        shift = np.uint64(32 if self.symbol == "<u4" else 0)
        return np.stack([(chunks[at + o] >> shift).astype(self.symbol) for o in self.offsets], axis=1)


@dataclass(frozen=True)
class Words:
    """The words of consecutive texts: bounds, first word of each text, chunk hashes, windows and their landmarks."""

    raw: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    chunks: np.ndarray
    windows: np.ndarray
    landmarks: np.ndarray
    marks: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, bounds: np.ndarray, spelling: Spelling) -> Words:
        starts, ends, first = word_bounds(raw, bounds, SPACED)
        chunks = spelling.chunks(hash_words(raw, starts, ends))
        stop = np.repeat(first[1:], np.diff(first))
        windows = np.flatnonzero(np.arange(len(starts)) + spelling.window <= stop)
        gram = spelling.size * spelling.landmark
        n = max(0, len(starts) - gram + 1)
        every = np.arange(n)
        grams = spelling.prefix(chunks, every, spelling.landmark)
        # The least hash of a window, and the leftmost of several, with its place in the lower bits.
        least = (grams & ~_PLACE) | every.astype(np.uint64)
        width, done = spelling.window - gram + 1, 1
        while done < width:
            step = min(done, width - done)
            least = np.minimum(least[: len(least) - step], least[step:])
            done += step
        landmarks = (least[windows] & _PLACE).astype(np.int64)
        return cls(raw, bounds, starts, ends, first, chunks, windows, landmarks, grams[landmarks])


def _parts(df: DataFrame, spelling: Spelling, part_bytes: int) -> DataFrame:
    """Write the texts to files: ``(part, words, marks)`` of each, with the distinct hashes of its landmarks.

    ``marks`` are 8-byte numbers in ascending order, doubled if the file has the landmark in several places.
    """
    folder = new_folder(df.sparkSession, "substrings")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        writer, path, size, words, marks = None, None, 0, 0, []

        def close() -> pa.RecordBatch:
            nonlocal writer, size, words, marks
            writer.close()
            found, count = np.unique(np.concatenate([np.empty(0, np.uint64), *marks]), return_counts=True)
            data = np.repeat(found, np.minimum(count, 2)).astype("<u8").tobytes()
            out = pa.RecordBatch.from_pydict({"part": [path], "words": pa.array([words], pa.int64()), "marks": pa.array([data], pa.binary())})
            writer, size, words, marks = None, 0, 0, []
            return out

        for batch in batches:
            table = pa.Table.from_batches([batch])
            raw, bounds = texts(table["text"])
            for a, b in slices(bounds, SLICE_BYTES):
                if writer is None:
                    path = f"{folder}/{uuid.uuid4()}.parquet"
                    writer = pq.ParquetWriter(path.replace(folder, base), table.schema, filesystem=store, compression="zstd")
                writer.write_table(table.slice(a, b - a), row_group_size=b - a)
                found = Words.of(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], spelling)
                # A place counts once, of however many windows it is the landmark.
                own = np.flatnonzero(np.diff(found.landmarks, prepend=-1))
                marks.append(found.marks[own])
                size, words = size + int(bounds[b] - bounds[a]), words + len(found.starts)
                if size >= part_bytes:
                    yield close()
        if writer is not None:
            yield close()

    return cut(map_arrow(df, write, "part string, words bigint, marks binary"))


def _repeated_marks(parts: DataFrame, buckets: int) -> DataFrame:
    """``(part, data)``: the landmarks of each file that stand in more than one place of the corpus, in pieces."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, data in zip(b["part"], b["marks"], strict=True):
                marks = np.frombuffer(data, "<u8")
                bucket = ((marks >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[by], np.arange(buckets + 1))
                marks = marks[by]
                has = np.flatnonzero(np.diff(edge))
                yield pd.DataFrame({"bucket": has, "part": part, "marks": [marks[edge[k] : edge[k + 1]].tobytes() for k in has]})

    def count(group: pd.DataFrame) -> pd.DataFrame:
        marks = [np.frombuffer(m, "<u8") for m in group["marks"]]
        found, times = np.unique(np.concatenate(marks), return_counts=True)
        often = found[times > 1]
        data = [np.unique(m[np.isin(m, often)]).tobytes() for m in marks]
        out = pd.DataFrame({"part": group["part"], "data": data})
        return out[out["data"].map(len) > 0]

    moved = map_pandas(parts.select("part", "marks"), split, "bucket int, part string, marks binary")
    return moved.groupBy("bucket").applyInPandas(count, "part string, data binary")


def _by_part(parts: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(part, data)``: each file once, with all its pieces."""
    gathered = pieces.groupBy("part").agg(F.collect_list("data").alias("data"))
    return one_file_a_task(cut(parts.select("part").join(gathered, "part", "left")))


def _read(part: str, spelling: Spelling) -> Iterator[tuple[pa.Array, int, Words]]:
    """The texts of a file slice by slice: identifiers, the number of the first word, and the words."""
    store, at = file_system(part)
    before = 0
    with store.open_input_file(at) as stream:
        file = pq.ParquetFile(stream)
        for k in range(file.num_row_groups):
            table = file.read_row_group(k)
            words = Words.of(*texts(table["text"]), spelling)
            yield table["doc_id"].combine_chunks(), before, words
            before += len(words.starts)


@dataclass(frozen=True)
class Suffixes:
    """The suffixes of one file that may repeat: keys, prefix hashes by depth, places and how often each stands in the file."""

    keys: np.ndarray
    prefixes: np.ndarray
    place: np.ndarray
    many: np.ndarray
    known: np.ndarray

    @classmethod
    def of(cls, part: str, marks: np.ndarray, spelling: Spelling) -> Suffixes:
        """Equal suffixes become one; ``known`` are the places of those that repeat within the file already."""
        depth = len(spelling.offsets)
        keys, prefixes, places = [np.empty((0, depth), spelling.symbol)], [np.empty((0, depth), np.uint64)], [np.empty(0, np.int64)]
        for _, before, words in _read(part, spelling):
            at = words.windows[np.isin(words.marks, marks)]
            keys.append(spelling.keys(words.chunks, at))
            prefixes.append(np.stack([spelling.prefix(words.chunks, at, d) for d in range(1, depth + 1)], axis=1))
            places.append(at + before)
        k, p, place = np.concatenate(keys), np.concatenate(prefixes), np.concatenate(places)
        order = np.lexsort(k.T[::-1])
        new = np.append(True, (k[order][1:] != k[order][:-1]).any(axis=1))[: len(order)]
        edge = np.flatnonzero(new)
        times = np.diff(np.append(edge, len(order)))
        pick = order[edge]
        known = np.sort(place[order[np.repeat(times, times) > 1]])
        return cls(k[pick], p[pick], place[pick], times > 1, known)


def runs(places: np.ndarray) -> bytes:
    """Ascending places as pairs of 4 bytes: the first of consecutive ones, and how many."""
    edge = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    return np.stack([places[edge], np.diff(np.append(edge, len(places)))], axis=1).astype("<u4").tobytes()


def deep_nodes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree of ``keys``: their order, and begin and end of the leaves below each internal node of full depth.

    Sorted suffixes and the lengths of the prefixes that neighbours share are the tree: an internal node of a
    depth is a maximal run of neighbours that share at least so much.
    """
    order = np.lexsort(keys.T[::-1])
    same = keys[order][1:] == keys[order][:-1]
    shared = np.where(same.all(axis=1), keys.shape[1], same.argmin(axis=1)) if len(keys) > 1 else np.empty(0, int)
    deep = np.concatenate([[False], shared >= keys.shape[1], [False]])
    return order, np.flatnonzero(deep[1:] & ~deep[:-1]), np.flatnonzero(deep[:-1] & ~deep[1:]) + 1


def _grouping(prefixes: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Depth and group of each suffix: ``levels`` has the number of groups by depth and those that are too large."""
    depth = np.zeros(len(prefixes), np.int32)
    group = np.zeros(len(prefixes), np.int64)
    open_ = np.ones(len(prefixes), bool)
    for d, (groups, large) in enumerate(levels):
        group[open_] = (prefixes[open_, d] >> np.uint64(16)) % np.uint64(groups)
        depth[open_] = d
        open_ &= np.isin(group, large)
    return depth, group


def _prefix_levels(marked: DataFrame, spelling: Spelling, words: int, group_size: int) -> list[tuple[int, np.ndarray]]:
    """By depth, the number of groups and the groups that are split by a longer prefix.

    All suffixes are counted; the driver gets the numbers of the groups that are too large, at most one
    for each ``group_size`` suffixes.
    """
    levels, total = [], words
    for d in range(len(spelling.offsets)):
        levels.append((max(1, -(-total * 4 // group_size)), np.empty(0, np.int64)))
        if d + 1 == len(spelling.offsets):
            break

        def count(batches: Iterator[pd.DataFrame], levels=tuple(levels), d=d) -> Iterator[pd.DataFrame]:
            for b in batches:
                for part, data in zip(b["part"], b["data"], strict=True):
                    found = Suffixes.of(part, _joined(data, "<u8"), spelling)
                    depth, group = _grouping(found.prefixes, list(levels))
                    number, times = np.unique(group[depth == d], return_counts=True)
                    yield pd.DataFrame({"group": number, "n": times})

        counts = map_pandas(marked, count, "group bigint, n bigint").groupBy("group").agg(F.sum("n").alias("n"))
        large = counts.where(F.col("n") > group_size).collect()
        levels[-1] = (levels[-1][0], np.array(sorted(r["group"] for r in large), np.int64))
        if not large:
            break
        total = sum(r["n"] for r in large)
    return levels


def _joined(data, kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[np.frombuffer(x, kind) for x in (data if data is not None else [])]])


def _repeats(marked: DataFrame, spelling: Spelling, levels: list[tuple[int, np.ndarray]]) -> DataFrame:
    """``(part, data)``: runs of words of each file at which a repeated window begins."""
    depths = len(spelling.offsets)

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, data in zip(b["part"], b["data"], strict=True):
                found = Suffixes.of(part, _joined(data, "<u8"), spelling)
                depth, group = _grouping(found.prefixes, levels)
                by = np.lexsort((group, depth))
                edge = np.flatnonzero(np.diff(group[by], prepend=-1) | np.diff(depth[by], prepend=-1))
                place = np.where(found.many, 0xFFFFFFFF, found.place).astype("<u4")
                for k, a in enumerate(edge):
                    at = by[a : edge[k + 1] if k + 1 < len(edge) else len(by)]
                    yield pd.DataFrame({
                        "depth": [depth[at[0]]], "group": [group[at[0]]], "part": [part], "known": [None],
                        "keys": [found.keys[at].tobytes()], "places": [place[at].tobytes()],
                    })
                if len(found.known):
                    yield pd.DataFrame({"depth": [-1], "group": [zlib.crc32(part.encode())], "part": [part], "known": [runs(found.known)], "keys": [None], "places": [None]})

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        known = group["known"].notna()
        out = [group.loc[known, ["part", "known"]].rename(columns={"known": "data"})]
        rest = group[~known]
        if len(rest):
            keys = [np.frombuffer(x, spelling.symbol).reshape(-1, depths) for x in rest["keys"]]
            places = np.concatenate([np.frombuffer(x, "<u4") for x in rest["places"]])
            part = np.repeat(np.arange(len(rest)), [len(k) for k in keys])
            order, begin, end = deep_nodes(np.concatenate(keys))
            below = order[np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange(int((end - begin).sum()))]
            below = below[places[below] != 0xFFFFFFFF]
            below = below[np.lexsort((places[below], part[below]))]
            edge = np.searchsorted(part[below], np.arange(len(rest) + 1))
            names = rest["part"].to_numpy()
            has = np.flatnonzero(np.diff(edge))
            out.append(pd.DataFrame({"part": names[has], "data": [runs(places[below[edge[k] : edge[k + 1]]].astype(np.int64)) for k in has]}))
        return pd.concat(out)

    moved = map_pandas(marked, suffixes, "depth int, group bigint, part string, known binary, keys binary, places binary")
    return moved.groupBy("depth", "group").applyInPandas(tree, "part string, data binary")


def repeated_passages(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    part_bytes: int = PART_BYTES, group_size: int = GROUP,
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, removed)`` of each row: the text without the words of repeated windows.

    Words are separated by ASCII white space and compared as they are; ``kept`` joins those that stay with one
    space, ``removed`` lists the runs of the others as numbers of words, ends exclusive. Every place of a
    repeated window loses its words, the first one too, and windows are judged on the input. Overlapping places
    of one text count. A null or empty text has no words; a text of fewer words than ``window`` loses none.
    Every row is a text of its own, so repeated rows are copies of each other; identifiers, null or not, are
    only passed on. An empty table gives no rows. Other columns are not read.
    """
    spelling = Spelling(window)
    rows = narrow(df, id_col, text_col)
    parts = _parts(rows, spelling, part_bytes)
    words, marks = parts.agg(F.sum("words"), F.sum(F.octet_length("marks"))).first()
    buckets = max(1, -(-(marks or 0) // (8 * BUCKET)))
    marked = _by_part(parts, _repeated_marks(parts, buckets))
    levels = _prefix_levels(marked, spelling, words or 0, group_size)
    found = _by_part(parts, _repeats(marked, spelling, levels))
    kind = dict(rows.dtypes)["doc_id"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["data"].to_pylist(), strict=True):
                begin = _joined(data, "<u4").reshape(-1, 2).astype(np.int64)
                begin = begin[np.argsort(begin[:, 0])]
                for ids, before, read in _read(part, spelling):
                    yield _without(ids, read, begin, before, window)

    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept string, removed array<struct<start:int,end:int>>"
    return map_arrow(found, remove, schema)


def _without(ids: pa.Array, words: Words, begin: np.ndarray, before: int, window: int) -> pa.RecordBatch:
    """The rows of one slice; ``begin`` has the runs of the whole file."""
    n = len(words.starts)
    a, z = np.searchsorted(begin[:, 0] + begin[:, 1], before, "right"), np.searchsorted(begin[:, 0], before + n)
    low = np.maximum(begin[a:z, 0] - before, 0)
    high = np.minimum(begin[a:z, 0] + begin[a:z, 1] - before, n) + window - 1
    change = np.bincount(low, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(high, n), minlength=n + 1)[: n + 1]
    gone = np.cumsum(change)[:n] > 0
    stay = np.flatnonzero(~gone)
    doc = np.repeat(np.arange(len(ids)), np.diff(words.first))
    kept = np.bincount(doc[stay], minlength=len(ids))
    # Bytes of the words that stay, and one separator behind all but the last of a text.
    mark = np.zeros(len(words.raw) + 1, np.int8)
    mark[words.starts[stay]] += 1
    mark[words.ends[stay]] -= 1
    mask = np.cumsum(mark, dtype=np.int8)[:-1] > 0
    follows = np.flatnonzero(doc[stay][1:] == doc[stay][:-1]) if len(stay) else stay
    spaces = words.ends[stay[follows]]
    mask[spaces] = True
    raw = words.raw.copy()
    raw[spaces] = 32
    sizes = np.concatenate([[0], np.cumsum(mask)])[words.bounds]
    text = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(sizes.astype("<i8").tobytes()), pa.py_buffer(raw[mask].tobytes())])
    # Runs of words that go, within a text.
    out = np.flatnonzero(gone)
    fresh = np.append(True, (np.diff(out) != 1) | (doc[out][1:] != doc[out][:-1]))[: len(out)]
    edge = np.flatnonzero(fresh)
    last = np.append(edge[1:], len(out))[: len(edge)] - 1
    own = doc[out[edge]]
    span = pa.StructArray.from_arrays(
        [pa.array((out[edge] - words.first[own]).astype(np.int32)), pa.array((out[last] + 1 - words.first[own]).astype(np.int32))], ["start", "end"]
    )
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(ids) + 1)).astype(np.int32)), span)
    n_words = np.diff(words.first)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words.astype(np.int64)), pa.array((n_words - kept).astype(np.int64)), text.cast(pa.string()), spans],
        ["doc_id", "n_words", "n_removed", "kept", "removed"],
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts and the SHA-256 of the kept words of each row of ``repeated_passages``."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
