"""Packing of examples into training sequences: vector bin packing by the dot-product heuristic.

A sequence has three limits at once: tokens, segments, and tokens that bear loss. An example goes into
the open sequence for which the dot product of its needs and the sequence's free capacities (each in
shares of its limit) is largest. If it fits nowhere, it is cut so that one sequence is filled up.
The last free segment of a sequence is kept for a piece that fills it. What is open at the end of a
task is laid out anew into full sequences and, for the rest, sequences whose lengths are powers of
two, which need no padding.

Every task packs the rows it reads: there is no shuffle, and memory holds the open sequences only.
Documents of different groups, as of different languages, are packed apart.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyloom.llm.common import column, map_pandas
from tidyloom.llm.tokenizing import word_cache

MAX_TOKENS, MAX_SEGMENTS, OPEN = 4096, 64, 48
#: Groups for which a task holds open sequences; those of the group unused for longest are finished first.
GROUPS = 64
END_ID = 2


@dataclass
class Example:
    """Ids of one example, and which of them bear loss (None: all)."""

    doc_id: int | None
    ids: np.ndarray
    loss: np.ndarray | None = None
    bearing: np.ndarray = field(init=False)

    def __post_init__(self):
        flags = np.ones(len(self.ids), np.int64) if self.loss is None else self.loss.astype(np.int64)
        self.bearing = np.concatenate([[0], np.cumsum(flags)])

    def loss_in(self, start: int, stop: int) -> int:
        return int(self.bearing[stop] - self.bearing[start])

    def longest(self, start: int, tokens: int, loss: int) -> int:
        """The end of the longest piece from ``start`` within both limits."""
        end = int(np.searchsorted(self.bearing, self.bearing[start] + loss, "right")) - 1
        return min(len(self.ids), start + tokens, end)


Piece = tuple[Example, int, int]


class Packer:
    """Takes examples and gives finished sequences, lists of pieces."""

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_TOKENS):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.limit = np.array([tokens, segments, loss], float)
        self.free = np.zeros((0, 3))
        self.bins: list[list[Piece]] = []

    def add(self, example: Example) -> Iterator[list[Piece]]:
        tokens, _, loss = (int(x) for x in self.limit)
        at, n = 0, len(example.ids)
        while at < n:
            end = example.longest(at, tokens, loss)
            if end - at == tokens:
                yield [(example, at, end)]
                at = end
                continue
            if end < n:  # the loss limit cuts before the token limit
                at, done = self._place(example, at, end)
            else:
                at, done = self._place(example, at, n)
            yield from done

    def _place(self, example: Example, at: int, end: int) -> tuple[int, list[list[Piece]]]:
        """Put ``at`` to ``end``, or as much as fills a sequence, somewhere; the new position and what was finished."""
        need = np.array([end - at, 1, example.loss_in(at, end)], float)
        if len(self.bins):
            left = self.free - need
            fits = (left >= 0).all(axis=1) & ((left[:, 1] > 0) | (left[:, 0] == 0))
            if fits.any():
                gain = np.where(fits, (self.free / self.limit) @ (need / self.limit), -1)
                return end, self._put(int(gain.argmax()), example, at, end)
            # Fill up the fullest sequence that this piece can fill.
            full = (self.free[:, 0] < need[0]) & (self.free[:, 1] >= 1)
            for b in np.argsort(np.where(full, self.free[:, 0], np.inf), kind="stable")[: int(full.sum())]:
                stop = at + int(self.free[b, 0])
                if example.loss_in(at, stop) <= self.free[b, 2]:
                    return stop, self._put(int(b), example, at, stop)
        done = []
        if len(self.bins) >= OPEN:
            done = self._lay_out([self._pop(int(self.free[:, 0].argmin()))])
        self.bins.append([])
        self.free = np.vstack([self.free, self.limit])
        return end, done + self._put(len(self.bins) - 1, example, at, end)

    def _pop(self, b: int) -> list[Piece]:
        self.free = np.delete(self.free, b, axis=0)
        return self.bins.pop(b)

    def _put(self, b: int, example: Example, at: int, end: int) -> list[list[Piece]]:
        self.bins[b].append((example, at, end))
        self.free[b] -= (end - at, 1, example.loss_in(at, end))
        return [self._pop(b)] if self.free[b, 0] == 0 else []

    def finish(self) -> list[list[Piece]]:
        bins, self.bins, self.free = self.bins, [], np.zeros((0, 3))
        return self._lay_out(bins)

    def _lay_out(self, bins: list[list[Piece]]) -> list[list[Piece]]:
        """The pieces of unfinished sequences in full sequences, or such of a power of two."""
        pieces = [p for b in bins for p in b][::-1]
        tokens, segments, loss = (int(x) for x in self.limit)
        done = []
        while pieces:
            taken, size, bearing = [], 0, 0
            while pieces and len(taken) < segments and size < tokens:
                example, a, z = pieces.pop()
                stop = min(z, example.longest(a, tokens - size, loss - bearing))
                if stop > a:
                    taken.append((example, a, stop))
                    size, bearing = size + stop - a, bearing + example.loss_in(a, stop)
                if stop < z:
                    pieces.append((example, stop, z))
                    break
            keep = size if size == tokens else 1 << (size.bit_length() - 1)
            while size > keep:  # give back what is above the power of two
                example, a, z = taken.pop()
                back = min(z - a, size - keep)
                pieces.append((example, z - back, z))
                if z - back > a:
                    taken.append((example, a, z - back))
                size -= back
            done.append(taken)
        return done


def pack(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int | None = None, end_id: int = END_ID,
    prompt_col: str | None = None, group_col: str | None = None,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, segment, loss_tokens)``, a row for each piece.

    A document is its ids and the end id, all of which bear loss. With ``prompt_col`` the ids of that text stand in
    front of it and bear no loss (instruction data); a null prompt has none. A null or empty text is the end id alone.
    With ``group_col`` a sequence holds documents of one value of that column only, which is returned as ``group``; null
    is a value too.
    Every row is a document, whether or not its identifier is null or repeated. Sequences are numbered
    within a task (the task's number stands in the upper bits), so a task that is run again gives the
    same rows if it reads the same, as it does from files. An empty table gives no rows. Other columns
    are not read.
    """
    prompt = F.lit(None).cast("string") if prompt_col is None else column(prompt_col)
    group = F.lit(None).cast("string") if group_col is None else column(group_col).cast("string")
    rows = df.select(column(id_col).alias("doc_id"), column(text_col).alias("text"), prompt.alias("prompt"), group.alias("group"))
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens", "group"]
    wanted = names[:-1] if group_col is None else names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, packers = word_cache(tokenizer), {}
        number, out = TaskContext.get().partitionId() << 40, []

        def packer_of(group: str | None) -> Packer:
            if group not in packers and len(packers) >= GROUPS:
                unused = next(iter(packers))
                take(unused, packers.pop(unused).finish())
            packers[group] = packers.pop(group, None) or Packer(tokens, segments, tokens if loss is None else loss)
            return packers[group]

        def take(group: str | None, sequences: Iterable[list[Piece]]) -> None:
            nonlocal number
            for sequence in sequences:
                at = 0
                for k, (example, a, z) in enumerate(sequence):
                    crc = zlib.crc32(example.ids[a:z].astype("<u4").tobytes())
                    out.append((example.doc_id, a, z - a, crc, len(example.ids), number, at, k, example.loss_in(a, z), group))
                    at += z - a
                number += 1

        def rows_out() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=names)[wanted]
            out.clear()
            return frame

        end = np.array([end_id], np.uint32)
        for b in batches:
            groups = b["group"].astype(object).where(b["group"].notna(), None)
            for i, group, before, ids in zip(b["doc_id"], groups, cache.encode(list(b["prompt"])), cache.encode(list(b["text"])), strict=True):
                loss_flags = np.append(np.zeros(len(before), bool), np.ones(len(ids) + 1, bool)) if len(before) else None
                take(group, packer_of(group).add(Example(None if pd.isna(i) else i, np.concatenate([before, ids, end]), loss_flags)))
            if out:
                yield rows_out()
        for group, packer in packers.items():
            take(group, packer.finish())
        if out:
            yield rows_out()

    fields = ", ".join(f"{n} bigint" for n in names[1:7])
    last = "" if group_col is None else ", group string"
    return map_pandas(rows, run, f"doc_id {kind}, {fields}, segment int, loss_tokens bigint{last}")
