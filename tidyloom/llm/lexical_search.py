"""Ranked lexical search over bit-sliced Bloom signatures.

Every document gets a Bloom signature of its terms. The signatures of a block of documents are stored
by slices: one row of bits for each signature position, one bit for each document. The slices of a
term, and-ed, tell which documents may hold it; they overestimate, and never miss one. A term that
stands in a document at least 2, 4, ... times is entered once more for each such level, so the slices
of a level bound the number of its places too. The sums of the terms' weights over the slices of a level,
times what a place of that level can add to a score, are an upper bound of the score of each document.

Documents with the largest bounds are scored exactly from their texts, which gives the score that the
tenth has to beat; all documents whose bound reaches it are scored exactly as well. No other one can
be among the first ten.

Blocks hold documents of about the same number of terms, so long documents do not fill the signatures
of short ones. A file of the index has the texts, another one the slices, the documents' lengths and the
lexicon (how many documents hold a term) of about ``PART_BYTES`` of text. Terms are told apart by 64
bits of a hash; that two of ``n`` terms of a corpus share them has the probability ``n**2 / 2**65``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyloom.llm.byte_words import ALPHANUMERIC, hash_words, map_arrow, mix, slices, texts, word_bounds
from tidyloom.llm.common import column, file_system, map_pandas, narrow, new_folder, one_file_a_task
from tidyloom.session import cut

TOP = 10
#: Text and documents of a file, text worked on at once, items (and their terms) that are looked up together.
PART_BYTES, PART_DOCS, SLICE_BYTES, ITEMS, ITEM_TERMS = 32 << 20, 1 << 14, 1 << 20, 256, 1 << 13
#: Bits of a signature for each entry, and bits of a block of slices.
BITS, BLOCK_BITS = 16, 1 << 23
#: A level has the terms with at least so many places; fixed constants of the score.
LEVELS = (1, 2, 4, 8, 16)
SCALE, K, FLAT, SLOPE = 1_000_000_000, 1000, 10, 90

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Terms:
    """The distinct terms of consecutive texts: number of the text, hash and places of each, and the texts' lengths."""

    doc: np.ndarray
    hash: np.ndarray
    tf: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, raw: np.ndarray, bounds: np.ndarray) -> Terms:
        raw = _LOWER[raw]
        starts, ends, first = word_bounds(raw, bounds, ALPHANUMERIC)
        h, length = hash_words(raw, starts, ends), np.diff(first)
        doc = np.repeat(np.arange(len(length)), length)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
        edge = np.flatnonzero(new)
        return cls(doc[edge], h[edge], np.diff(np.append(edge, len(h))), length)


def positions(h: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a term of a level in a signature."""
    s = mix(h, np.uint64(level + 1))
    return ((s & np.uint64(0xFFFFFFFF)) % np.uint64(bits)).astype(np.int64), ((s >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def signature_blocks(terms: Terms) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(bits, documents, slices)``: the slices have a row for each of ``bits`` positions, eight documents a byte."""
    entries = np.zeros(len(terms.length), np.int64)
    for level in LEVELS:
        entries += np.bincount(terms.doc[terms.tf >= level], minlength=len(entries))
    size = np.ceil(np.log2(np.maximum(entries, 16))).astype(np.int64)
    begin = np.searchsorted(terms.doc, np.arange(len(entries) + 1))
    for s in np.unique(size[entries > 0]).tolist():
        bits = BITS << s
        docs = np.flatnonzero((size == s) & (entries > 0))
        step = max(8, BLOCK_BITS // bits)
        for a in range(0, len(docs), step):
            some = docs[a : a + step]
            count = begin[some + 1] - begin[some]
            column = np.repeat(np.arange(len(some)), count)
            at = np.arange(len(column)) + np.repeat(begin[some] - (np.cumsum(count) - count), count)
            matrix = np.zeros((bits, len(some)), bool)
            for n, level in enumerate(LEVELS):
                has = terms.tf[at] >= level
                for p in positions(terms.hash[at[has]], n, bits):
                    matrix[p, column[has]] = True
            yield bits, some, np.packbits(matrix, axis=1)


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the index: ``(part, docs, terms)``, the files with their numbers of documents that have terms and of all terms."""
    folder = new_folder(df.sparkSession, "signatures")
    signature = pa.schema([("bits", pa.int64()), ("docs", pa.binary()), ("lengths", pa.binary()), ("slices", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        writer, name, size, held = None, None, 0, []

        def close() -> pa.RecordBatch:
            nonlocal writer, size, held
            writer.close()
            before = np.cumsum([0, *[len(t.length) for t in held]])
            joined = Terms(
                np.concatenate([t.doc + b for t, b in zip(held, before, strict=False)]),
                *[np.concatenate([getattr(t, f) for t in held]) for f in ("hash", "tf", "length")],
            )
            writer, size, held = None, 0, []
            lexicon, count = np.unique(joined.hash, return_counts=True)
            pq.write_table(pa.table({"hash": lexicon.view(np.int64), "df": count}), f"{base}/{name}.lexicon", filesystem=store, compression="zstd")
            with pq.ParquetWriter(f"{base}/{name}.slices", signature, filesystem=store, compression="zstd") as out:
                for bits, docs, rows in signature_blocks(joined):
                    row = [bits, docs.astype("<i4").tobytes(), joined.length[docs].astype("<i4").tobytes(), rows.tobytes()]
                    out.write_table(pa.table([[x] for x in row], schema=signature))
            numbers = [int((joined.length > 0).sum()), int(joined.length.sum())]
            return pa.RecordBatch.from_pydict({"part": [f"{folder}/{name}"], "docs": pa.array(numbers[:1], pa.int64()), "terms": pa.array(numbers[1:], pa.int64())})

        for batch in batches:
            table = pa.Table.from_batches([batch])
            raw, bounds = texts(table["text"])
            for a, b in slices(bounds, SLICE_BYTES):
                if writer is None:
                    name = str(uuid.uuid4())
                    writer = pq.ParquetWriter(f"{base}/{name}.texts", table.schema, filesystem=store, compression="zstd")
                writer.write_table(table.slice(a, b - a), row_group_size=b - a)
                held.append(Terms.of(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]))
                size += int(bounds[b] - bounds[a])
                if size >= PART_BYTES or sum(len(t.length) for t in held) >= PART_DOCS:
                    yield close()
        if writer is not None:
            yield close()

    return cut(map_arrow(narrow(df, id_col, text_col), run, "part string, docs bigint, terms bigint"))


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> list[str]:
    """Files of the items' distinct terms, at most ``ITEMS`` items in each: ``(item_id, hashes)``."""
    folder = new_folder(items.sparkSession, "items")
    rows = items.select(column(id_col).alias("item_id"), column(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            raw, bounds = texts(batch["text"])
            terms = Terms.of(raw, bounds)
            begin = np.searchsorted(terms.doc, np.arange(len(bounds)))
            for a, b in ((s, min(z, s + ITEMS)) for a, z in slices(begin, ITEM_TERMS) for s in range(a, z, ITEMS)):
                name = f"{uuid.uuid4()}.items"
                data = [terms.hash[begin[k] : begin[k + 1]].tobytes() for k in range(a, b)]
                pq.write_table(pa.table({"item_id": batch["item_id"].slice(a, b - a), "hashes": pa.array(data, pa.binary())}), f"{base}/{name}", filesystem=store)
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"]})

    return sorted(r["path"] for r in cut(map_arrow(rows, run, "path string")).collect())


def _load(path: str, columns: list[str] | None = None) -> pa.Table:
    store, at = file_system(path)
    return pq.read_table(at, columns=columns, filesystem=store)


@dataclass(frozen=True)
class Items:
    """One block of items: identifiers, vocabulary with weights, and the terms of each item by number."""

    ids: pa.ChunkedArray
    terms: np.ndarray
    weight: np.ndarray
    of: list[np.ndarray]

    @classmethod
    def load(cls, path: str, weights: str | None = None) -> Items:
        table = _load(path)
        hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        terms = np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]))
        weight = np.zeros(len(terms), np.int64)
        if weights is not None:
            known = _load(weights)
            weight[np.searchsorted(terms, known["hash"].to_numpy().view(np.uint64))] = known["weight"].to_numpy()
        return cls(table["item_id"], terms, weight, [np.searchsorted(terms, h) for h in hashes])


def _weights(parts: DataFrame, paths: list[str], docs: int) -> dict[int, str]:
    """By block of items, the file with the weights of its terms that the corpus has."""
    folder = new_folder(parts.sparkSession, "weights")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in b["part"]:
                lexicon = _load(f"{part}.lexicon")
                known, df = lexicon["hash"].to_numpy().view(np.uint64), lexicon["df"].to_numpy()
                for k, path in enumerate(paths):
                    terms = Items.load(path).terms
                    at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                    has = known[at] == terms if len(known) else np.zeros(len(terms), bool)
                    yield pd.DataFrame({"block": k, "hash": terms[has].view(np.int64), "df": df[at[has]]})

    def weigh(group: pd.DataFrame) -> pd.DataFrame:
        by_df = {n: math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in group["df"].unique().tolist()}
        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        name = f"{uuid.uuid4()}.weights"
        pq.write_table(pa.table({"hash": group["hash"].to_numpy(), "weight": group["df"].map(by_df).to_numpy()}), f"{base}/{name}", filesystem=store)
        return pd.DataFrame({"block": [group["block"].iloc[0]], "path": [f"{folder}/{name}"]})

    counts = map_pandas(one_file_a_task(parts), count, "block int, hash bigint, df bigint").groupBy("block", "hash").agg(F.sum("df").alias("df"))
    return {r["block"]: r["path"] for r in cut(counts.groupBy("block").applyInPandas(weigh, "block int, path string")).collect()}


def saturation(tf, m: np.ndarray) -> np.ndarray:
    """What ``tf`` places add for each unit of weight in a document with that ``m``."""
    return (SCALE * tf) // (K * tf + 8 * m)


def upper_bounds(items: Items, bits: int, packed: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Items by documents of a block: no score is larger."""
    total, before = np.zeros((len(items.of), len(m))), np.zeros(len(m), np.int64)
    for n, level in enumerate(LEVELS):
        most = saturation(2 * level - 1, m) if n + 1 < len(LEVELS) else np.full(len(m), SCALE // K)
        a, b = positions(items.terms, n, bits)
        rows = packed[a] & packed[b]
        some = rows.any(axis=1)
        present = np.unpackbits(rows, axis=1, count=len(m))
        for i, terms in enumerate(items.of):
            terms = terms[some[terms]]
            if len(terms):
                total[i] += (items.weight[terms].astype(np.float64) @ present[terms]) * (most - before)
        before = most
    return total


class _Part:
    """A file of the index, searched for the items of one block."""

    def __init__(self, part: str, docs: int, terms: int):
        self.part, self.docs, self.terms = part, docs, terms
        store, at = file_system(f"{part}.texts")
        self.file = pq.ParquetFile(store.open_input_file(at))
        groups = [self.file.metadata.row_group(k).num_rows for k in range(self.file.num_row_groups)]
        self.begin = np.cumsum([0, *groups])
        self.ids = self.file.read(columns=["doc_id"])["doc_id"].combine_chunks()

    def m(self, length: np.ndarray) -> np.ndarray:
        return FLAT + (SLOPE * length.astype(np.int64) * self.docs) // self.terms

    def bounds(self, items: Items) -> np.ndarray:
        out = np.zeros((len(items.of), int(self.begin[-1])))
        store, at = file_system(f"{self.part}.slices")
        with store.open_input_file(at) as stream:
            file = pq.ParquetFile(stream)
            for k in range(file.num_row_groups):
                row = file.read_row_group(k).to_pylist()[0]
                docs = np.frombuffer(row["docs"], "<i4")
                packed = np.frombuffer(row["slices"], np.uint8).reshape(row["bits"], -1)
                out[:, docs] = upper_bounds(items, row["bits"], packed, self.m(np.frombuffer(row["lengths"], "<i4")))
        return out

    def exact(self, items: Items, wanted: np.ndarray) -> np.ndarray:
        """The scores of the wanted (items by documents); others are zero."""
        out = np.zeros(wanted.shape, np.int64)
        for k in range(len(self.begin) - 1):
            low = int(self.begin[k])
            need = np.flatnonzero(wanted[:, low : int(self.begin[k + 1])].any(axis=0))
            if not len(need):
                continue
            column = self.file.read_row_group(k, columns=["text"])["text"].combine_chunks().take(pa.array(need))
            found = Terms.of(*texts(column))
            at = np.minimum(np.searchsorted(items.terms, found.hash), len(items.terms) - 1)
            has = items.terms[at] == found.hash
            doc, term, tf = found.doc[has], at[has], found.tf[has].astype(np.int64)
            adds = items.weight[term] * saturation(tf, self.m(found.length)[doc])
            for a in range(0, len(need), 256):
                some = slice(*np.searchsorted(doc, [a, a + 256]))
                docs = need[a : a + 256]
                table = np.zeros((len(items.terms), len(docs)), np.int64)
                table[term[some], doc[some] - a] = adds[some]
                for i in np.flatnonzero(wanted[:, low + docs].any(axis=1)):
                    own = np.flatnonzero(wanted[i, low + docs])
                    out[i, low + docs[own]] = table[np.ix_(items.of[i], own)].sum(axis=0)
        return out

    def best(self, items: Items, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and score of the first documents of this file for each item."""
        bound = self.bounds(items)
        n = min(top, bound.shape[1])
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, np.argpartition(-bound, n - 1, axis=1)[:, :n], True, axis=1)
        first &= bound > 0
        score = self.exact(items, first)
        least = np.sort(score, axis=1)[:, -n] if bound.shape[1] >= top else np.zeros(len(bound), np.int64)
        score += self.exact(items, (bound >= np.maximum(least, 1)[:, None]) & ~first)
        item, doc = np.nonzero(score > 0)
        value = score[item, doc]
        # All that tie with the last are kept: identifiers decide between them later.
        least = np.sort(score, axis=1)[:, -n]
        keep = value >= least[item]
        return item[keep], doc[keep], value[keep]


def search(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", top: int = TOP,
) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of each item with a score above 0.

    A null or empty text has no terms: as a document it is never found and not counted, as an item it gives no
    rows. Documents of one score are ranked by their identifiers, a null one last; repeated rows are each ranked,
    and repeated items each answered. Without documents or items there are no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = build_index(docs, id_col, text_col)
    paths = _item_blocks(items, item_col, item_text_col)
    total = parts.agg(F.sum("docs"), F.sum("terms")).first()
    n, length = total[0] or 0, total[1] or 0
    ids, item_ids = (dict(t.dtypes)[c] for t, c in ((docs.select(column(id_col).alias("i")), "i"), (items.select(column(item_col).alias("i")), "i")))
    schema = f"item bigint, item_id {item_ids}, doc_id {ids}, score bigint"
    if not n or not paths:
        return spark.createDataFrame([], schema).select("item_id", F.lit(0).alias("rank"), "doc_id", "score")
    weights = _weights(parts, paths, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["part"].to_pylist():
                part = _Part(name, n, length)
                for k in sorted(weights):
                    block = Items.load(paths[k], weights[k])
                    item, doc, score = part.best(block, top)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((k << 32) + item), block.ids.combine_chunks().take(pa.array(item)), part.ids.take(pa.array(doc)), pa.array(score)],
                        ["item", "item_id", "doc_id", "score"],
                    )

    found = map_arrow(one_file_a_task(parts), run, schema)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
