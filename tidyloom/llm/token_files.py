"""Token files compressed by a grammar (Re-Pair), with random access to documents.

A file holds blocks of at most ``BLOCK_IDS`` ids, each with a grammar of its own. A block is compressed
in rounds: the most frequent pairs of neighbouring symbols, no two of which share a symbol in a way
that could make their places overlap, become nonterminals and are replaced everywhere from left to
right; rounds go on until no pair has ``LEAST_PLACES`` places. A pair never reaches across two documents.

Block layout, little-endian:

    magic ``RPB1``; documents, ids, rules, symbols, terminals (u64 each); width of a symbol in bytes (u64)
    rules: left, right, expansion length (u32 each)
    documents: identifier (i64), 1 if it is null (u8), first symbol (u32), ids (u32)
    symbols

A symbol below ``terminals`` is an id, the others are rules in order. Expansion lengths let a reader
skip to the n-th id of a document without expanding what stands before it.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyloom.llm.common import file_system, map_pandas, narrow, new_folder, one_file_a_task
from tidyloom.llm.tokenizing import word_cache
from tidyloom.session import cut

BLOCK_IDS, SHARD_BYTES = 1 << 22, 24 << 20
RULES_A_ROUND, LEAST_PLACES = 8000, 16
#: Bits of the hash by which pairs are counted, and places above which their number makes no difference.
SLOT_BITS, MOST_PLACES = 20, 1 << 16
END_ID = 0
MAGIC = b"RPB1"
_ODDS = np.array([0x9E3779B1, 0x85EBCA77], np.uint32)


def compress(ids: np.ndarray, starts: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), their expansion lengths, the symbols, and the first symbol of each document."""
    seq = ids.astype(np.uint32)
    first = np.zeros(len(seq), bool)
    first[starts] = True
    left, right, size = (np.empty(0, np.uint32) for _ in range(3))
    # Places of pairs that may still be frequent: a pair gets no more places, so only new pairs join them.
    places = np.flatnonzero(~first[1:])
    while len(places):
        places, pairs, slots, frequent = _frequent(seq, places, 4 * RULES_A_ROUND)
        chosen = _disjoint(frequent, RULES_A_ROUND)
        if not len(chosen):
            break
        new = terminals + len(left) + np.arange(len(chosen), dtype=np.uint32)
        a, b = (chosen >> np.uint64(32)).astype(np.uint32), chosen.astype(np.uint32)
        left, right = np.append(left, a), np.append(right, b)
        grown = [np.where(x < terminals, 1, size[np.maximum(x.astype(np.int64) - terminals, 0)] if len(size) else 1) for x in (a, b)]
        size = np.append(size, (grown[0] + grown[1]).astype(np.uint32))
        rule_of = np.full(1 << SLOT_BITS, -1, np.int32)
        rule_of[_slots(a, b)] = np.arange(len(chosen))
        rule = rule_of[slots]
        near = np.flatnonzero(rule >= 0)
        hit = near[chosen[rule[near]] == pairs[near]]
        at, rule = places[hit], rule[hit]
        # Places overlap only in runs of one symbol: take every second of a run.
        run = np.append(True, at[1:] != at[:-1] + 1)
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, rule = at[take], rule[take]
        seq[at] = new[rule]
        stay, live = np.ones(len(seq), bool), np.zeros(len(seq), bool)
        stay[at + 1] = False
        live[places] = True
        seq, first, live = seq[stay], first[stay], live[stay]
        at -= np.arange(len(at))
        live[at] = True
        live[at[at > 0] - 1] = True
        live[:-1] &= ~first[1:]
        live[-1] = False
        places = np.flatnonzero(live)
    return np.stack([left, right]), size, seq, np.flatnonzero(first)


def _slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * _ODDS[0] ^ b * _ODDS[1]) >> np.uint32(32 - SLOT_BITS)


def _frequent(seq: np.ndarray, places: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of ``places`` those of pairs that may be frequent, the pairs there, their slots, and the frequent ones by falling frequency.

    These are the pairs of at least ``LEAST_PLACES`` places, about the first ``most``. Places are counted by a
    hash first, so only those of pairs that may be among them are looked at further.
    """
    a, b = seq[places], seq[places + 1]
    slot = _slots(a, b)
    count = np.bincount(slot, minlength=1 << SLOT_BITS)
    live = np.flatnonzero((count >= LEAST_PLACES)[slot])
    places, slot = places[live], slot[live]
    pairs = (a[live].astype(np.uint64) << np.uint64(32)) | b[live]
    reach = np.cumsum(np.bincount(np.minimum(count, MOST_PLACES))[::-1])[::-1]  # slots of so many places at least
    least = max(LEAST_PLACES, int(np.count_nonzero(reach >= most)) - 1)
    while True:
        ordered = np.sort(pairs[(count >= least)[slot]] if least > LEAST_PLACES else pairs)
        edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        times = np.diff(np.append(edge, len(ordered)))
        often = np.flatnonzero(times >= least)
        if len(often) or least == LEAST_PLACES:
            return places, pairs, slot, ordered[edge[often[np.lexsort((ordered[edge[often]], -times[often]))]]]
        least = LEAST_PLACES  # only pairs that share a slot reached that number


def _disjoint(pairs: np.ndarray, most: int) -> np.ndarray:
    """Of pairs by falling frequency, the first whose left symbol is no earlier right symbol, and the other way round.

    Of those that share a slot the first is taken; the others' turn comes in a later round.
    """
    lefts, rights, taken, keep = set(), set(), set(), []
    slots = _slots((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
    for p, slot in zip(pairs.tolist(), slots.tolist(), strict=True):
        a, b = p >> 32, p & 0xFFFFFFFF
        if slot in taken or a in rights or b in lefts or (a == b and (a in lefts or b in rights)):
            continue
        lefts.add(a)
        rights.add(b)
        taken.add(slot)
        keep.append(p)
        if len(keep) == most:
            break
    return np.array(keep, np.uint64)


def expansions(rules: np.ndarray, size: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray]:
    """All rules' expansions in one array, and where each begins. A rule refers to earlier rules only."""
    begin = np.cumsum(size, dtype=np.int64) - size
    flat = np.empty(int(size.sum()), np.uint32)
    for k, (a, b) in enumerate(rules.T.tolist()):
        at = begin[k]
        for x in (a, b):
            n = 1 if x < terminals else int(size[x - terminals])
            flat[at : at + n] = x if x < terminals else flat[begin[x - terminals] : begin[x - terminals] + n]
            at += n
    return flat, begin


def expand(symbols: np.ndarray, rules: np.ndarray, size: np.ndarray, terminals: int) -> np.ndarray:
    flat, begin = expansions(rules, size, terminals)
    own = np.arange(terminals, dtype=np.uint32)
    table = np.concatenate([own, flat])
    begins = np.concatenate([np.arange(terminals), terminals + begin])
    sizes = np.concatenate([np.ones(terminals, np.int64), size.astype(np.int64)])
    n = sizes[symbols]
    at = np.repeat(begins[symbols] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return table[at]


class Block:
    """One block, read or to be written."""

    def __init__(self, doc_ids: np.ndarray, null: np.ndarray, first: np.ndarray, counts: np.ndarray, rules: np.ndarray, size: np.ndarray, symbols: np.ndarray, terminals: int):
        self.doc_ids, self.null, self.first, self.counts = doc_ids, null, first, counts
        self.rules, self.size, self.symbols, self.terminals = rules, size, symbols, terminals

    @classmethod
    def of(cls, doc_ids: list[int | None], documents: list[np.ndarray]) -> Block:
        counts = np.array([len(d) for d in documents], np.uint32)
        ids = np.concatenate(documents)
        terminals = int(ids.max()) + 1
        starts = np.cumsum(counts, dtype=np.int64) - counts
        rules, size, symbols, first = compress(ids, starts, terminals)
        null = np.array([i is None for i in doc_ids], np.uint8)
        return cls(np.array([i or 0 for i in doc_ids], np.int64), null, first.astype(np.uint32), counts, rules, size, symbols, terminals)

    def write(self, out: BinaryIO) -> None:
        top = self.terminals + len(self.size)
        kind = np.dtype("<u2") if top <= 1 << 16 else np.dtype("<u4")
        out.write(MAGIC + struct.pack("<6Q", len(self.doc_ids), int(self.counts.sum()), len(self.size), len(self.symbols), self.terminals, kind.itemsize))
        for part, k in ((self.rules[0], "<u4"), (self.rules[1], "<u4"), (self.size, "<u4"), (self.doc_ids, "<i8"), (self.null, "u1"), (self.first, "<u4"), (self.counts, "<u4"), (self.symbols, kind)):
            out.write(np.ascontiguousarray(part.astype(k)).tobytes())

    @classmethod
    def read(cls, stream: BinaryIO) -> Block | None:
        """The next block; None at the end of the file."""
        magic = stream.read(4)
        if not magic:
            return None
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        docs, total, rules, symbols, terminals, width = struct.unpack("<6Q", stream.read(48))

        def array(n: int, kind: str) -> np.ndarray:
            data = stream.read(n * np.dtype(kind).itemsize)
            return np.frombuffer(data, kind, n)

        left, right, size = (array(rules, "<u4") for _ in range(3))
        doc_ids, null, first, counts = array(docs, "<i8"), array(docs, "u1"), array(docs, "<u4"), array(docs, "<u4")
        block = cls(doc_ids, null, first, counts, np.stack([left, right]), size, array(symbols, f"<u{width}").astype(np.uint32), terminals)
        if int(counts.sum()) != total:
            raise ValueError("a damaged block of token ids")
        return block

    def documents(self) -> list[np.ndarray]:
        """All documents' ids, expanded together."""
        ids = expand(self.symbols, self.rules, self.size, self.terminals)
        return np.split(ids, np.cumsum(self.counts, dtype=np.int64)[:-1])

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the k-th document; only symbols that overlap the range are expanded."""
        stop = int(self.counts[k]) if stop is None else min(stop, int(self.counts[k]))
        last = int(self.first[k + 1]) if k + 1 < len(self.first) else len(self.symbols)
        symbols = self.symbols[int(self.first[k]) : last].astype(np.int64)
        n = np.where(symbols < self.terminals, 1, self.size[np.maximum(symbols - self.terminals, 0)] if len(self.size) else 1).astype(np.int64)
        ends = np.cumsum(n)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends - n, stop, "left"))
        out: list[int] = []
        stack = symbols[a:b][::-1].tolist()
        while stack:
            x = stack.pop()
            if x < self.terminals:
                out.append(x)
            else:
                stack += [int(self.rules[1][x - self.terminals]), int(self.rules[0][x - self.terminals])]
        skip = start - int(ends[a] - n[a]) if a < len(ends) else 0
        return np.array(out[skip : skip + max(0, stop - start)], np.uint32)


def write_tokens(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shard_bytes: int | None = None
) -> DataFrame:
    """Tokenize all texts and write files in ascending order of the identifiers: ``(shard, path, ids, bytes)``.

    A file gets about ``shard_bytes`` of text. Larger files save tasks and take no more memory, which
    holds one block of ids.

    ``shard`` numbers the files in that order. Tasks name their files anew and report them at their end,
    so files of lost or repeated tasks are on no list.
    """
    rows = narrow(df, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 8)).first()[0] or 0
    shards = max(1, -(-int(total) // (shard_bytes or SHARD_BYTES)))
    rows = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
    folder = new_folder(df.sparkSession, "tokens")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_cache(tokenizer)
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"part-{shard:06d}-{uuid.uuid4()}.rpair"
        stream, names, held, size, ids, written = None, [], [], 0, 0, 0

        def flush() -> None:
            nonlocal stream, names, held, size, ids, written
            if stream is None:
                stream = store.open_output_stream(f"{base}/{name}")
            block = io.BytesIO()
            Block.of(names, held).write(block)
            stream.write(block.getvalue())
            ids, written = ids + size, written + block.tell()
            names, held, size = [], [], 0

        end = np.array([end_id], np.uint32)
        for b in batches:
            for i, got in zip(b["doc_id"], cache.encode(list(b["text"])), strict=True):
                got = np.append(got, end)
                if size and size + len(got) > BLOCK_IDS:
                    flush()
                names.append(None if pd.isna(i) else int(i))
                held.append(got)
                size += len(got)
        if held:
            flush()
        if stream is not None:
            stream.close()
            yield pd.DataFrame([(shard, f"{folder}/{name}", ids, written)], columns=["shard", "path", "ids", "bytes"])

    return cut(map_pandas(rows, write, "shard int, path string, ids bigint, bytes bigint"))


def read_tokens(files: DataFrame) -> DataFrame:
    """``(doc_id, start, ids)`` of each document of ``files(shard, path, ids)``; ``start`` counts the ids of all documents before it.

    One row a file is summed up in one task; the documents are read by as many tasks as there are files.
    """
    return _read(files, "ids array<bigint>", lambda ids: ids.astype(np.int64))


def _read(files: DataFrame, field: str, value) -> DataFrame:
    name = field.split()[0]
    before = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = cut(files.select("path", F.coalesce(before, F.lit(0)).alias("start")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                store, at = file_system(path)
                with store.open_input_file(at) as stream:
                    while (block := Block.read(stream)) is not None:
                        starts = start + np.cumsum(block.counts, dtype=np.int64) - block.counts
                        start += int(block.counts.sum())
                        ids = pd.array(np.where(block.null, 0, block.doc_ids), "Int64")
                        ids[block.null.astype(bool)] = pd.NA
                        out = pd.DataFrame({"doc_id": ids, "start": starts, "n_tokens": block.counts.astype(np.int64)})
                        out[name] = [value(d) for d in block.documents()]
                        yield out

    return map_pandas(one_file_a_task(placed), read, f"doc_id bigint, start bigint, n_tokens bigint, {field}")


def encode_and_read(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts as token files and read them back: ``(doc_id, start, n_tokens, ids_crc32)``.

    A null or empty text is the end id alone. Rows with null identifiers come first, rows of one identifier
    in the order of their texts; every row is a document. An empty table gives no file. Other columns
    are not read.
    """
    files = write_tokens(df, tokenizer, id_col, text_col)
    return _read(files, "ids_crc32 bigint", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))
