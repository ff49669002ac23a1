"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a posting ``(term, row, pos)`` for every word of the training documents that the test
items use at all, sorted by term, and one entry per document with its length. It is written once to
the shared folder. Each window of a test item is looked up by its rarest term; the list is moved by
the term's place in the item, which gives alignments of item and document. The list of the second
rarest term, moved likewise, thins them out, and what is left is intersected with the lists of all
terms of the item. A window occurs where all its words stand on one alignment.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyloom.llm.common import column, sized
from tidyloom.names import HIDDEN, require_free
from tidyloom.session import cut

WINDOW = 10
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words in lower case (ASCII letters only); an empty array for null."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.coalesce(F.split(lower, _BETWEEN), F.array().cast("array<string>")), "")


@dataclass
class Index:
    """``postings(term, row, pos)``; ``documents(row, doc_id, n_words)``; ``vocabulary(term, word)``."""

    postings: DataFrame
    documents: DataFrame
    vocabulary: DataFrame


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, item, k, n, word)``: the k-th of n words. ``item`` numbers the rows, as identifiers may repeat."""
    rows = items.select(column(id_col).alias("item_id"), words(column(text_col)).alias("w"))
    rows = rows.withColumn("item", F.monotonically_increasing_id())
    return cut(rows.select("item_id", "item", F.size("w").alias("n"), F.posexplode("w").alias("k", "word")))


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index the words of ``docs`` that ``vocabulary(term, word)`` has.

    Postings of other words can never be asked for and are not stored. A document ends with an empty
    word, whose place is its length; it stands under the term -1.
    """
    rows = docs.select(column(id_col).alias("doc_id"), words(column(text_col)).alias("w"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    tokens = rows.select("row", "doc_id", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
    end = vocabulary.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("term"), F.lit("").alias("word"))
    terms = sized(vocabulary.select("term", "word").unionByName(end))
    found = tokens.join(terms, "word").select("term", "row", "pos", F.expr("if(term = -1, doc_id, null)").alias("doc_id"))
    stored = cut(found.sortWithinPartitions("term", "row", "pos"))
    ends = stored.where("term = -1").select("row", "doc_id", F.col("pos").alias("n_words"))
    return Index(stored.where("term >= 0").select("term", "row", "pos"), ends, vocabulary)


def index_for(docs: DataFrame, item_rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    vocabulary = cut(item_rows.select("word").distinct().withColumn("term", F.monotonically_increasing_id()))
    return build_index(docs, vocabulary, id_col, text_col)


def _terms(index: Index, item_rows: DataFrame) -> DataFrame:
    """The words of the items with their terms and numbers of postings."""
    frequency = index.postings.groupBy("term").agg(F.count("*").alias("cf"))
    known = index.vocabulary.join(frequency, "term", "left").na.fill(0, ["cf"])
    return cut(item_rows.join(known, "word").select("item_id", "item", "n", "k", "term", "cf"))


def phrase_hits(index: Index, item_rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(row, item, item_id, pos)``: every word of a document inside an occurrence of a window of an item, once per alignment."""
    terms = _terms(index, item_rows)
    size = F.least(F.col("n"), F.lit(window))
    starts = terms.select("item", size.alias("size"), "n", F.col("k").alias("start")).where("start <= n - size")
    places = starts.select("item", "start", "size", F.explode(F.expr("sequence(start, start + size - 1)")).alias("k"))
    inside = places.join(terms.select("item", "k", "term", "cf"), ["item", "k"])
    ranked = inside.withColumn("rank", F.row_number().over(W.partitionBy("item", "start").orderBy("cf", "k")))
    # A window of one word has no second rarest term and is found by its only one.
    windows = ranked.groupBy("item", "start", "size").agg(
        F.min("cf").alias("least"),
        F.min(F.when(F.col("rank") == 1, F.struct("term", "k"))).alias("r1"),
        F.min(F.when(F.col("rank") == 2, F.struct("term", "k"))).alias("r2"),
    )
    pairs = windows.where("least > 0").select(
        "item", "start", "size", F.col("r1.term").alias("t1"), F.col("r1.k").alias("k1"),
        F.coalesce("r2.term", "r1.term").alias("t2"), F.coalesce("r2.k", "r1.k").alias("k2"),
    )
    # Windows of one pair of terms overlap in it, so together they are less than two windows long.
    ends = [F.min("start").alias("low"), F.max(F.expr("start + size - 1")).alias("high")]
    windows = cut(pairs.groupBy("item", "t1", "k1", "t2", "k2").agg(*ends))

    rarest = sized(windows.select(F.col("t1").alias("term"), "item", "k1").distinct())
    aligned = index.postings.join(rarest, "term").select("row", "item", "k1", (F.col("pos") - F.col("k1")).alias("at"))
    second = sized(windows.select("item", "k1", "t2", "k2", "low", "high"))
    expected = aligned.join(second, ["item", "k1"]).select("row", "item", "at", "low", "high", F.col("t2").alias("term"), (F.col("at") + F.col("k2")).alias("pos"))
    lists = index.postings.join(sized(windows.select(F.col("t2").alias("term")).distinct()), "term", "left_semi")
    likely = cut(expected.join(lists, ["row", "pos", "term"]).select("row", "item", "at", "low", "high").distinct())

    # All lists, of the documents that are left.
    where = sized(likely.select("row").distinct())
    lists = index.postings.join(where, "row", "left_semi")
    asked = likely.select("row", "item", "at", F.explode(F.sequence("low", "high")).alias("k")).distinct()
    full = asked.join(sized(terms.select("item", "k", "term")), ["item", "k"]).withColumn("pos", F.col("at") + F.col("k"))
    met = full.join(lists, ["row", "pos", "term"]).select("row", "item", "at", "k", "pos")
    # Runs of consecutive words of one alignment; a run of a window's length holds one.
    line = W.partitionBy("row", "item", "at").orderBy("k")
    runs = met.withColumn("run", F.col("k") - F.row_number().over(line))
    runs = runs.withColumn("length", F.count("*").over(W.partitionBy("row", "item", "at", "run")))
    lengths = sized(item_rows.select("item", "item_id", F.least("n", F.lit(window)).alias("size")).distinct())
    return runs.join(lengths, "item").where("length >= size").select("row", "item", "item_id", "pos")


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keyed: bool = True,
) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)`` of each row of ``docs``; with ``keyed`` also ``text_key``.

    ``text_key`` is a hash of the text, which tells rows of one identifier apart.
    Null and empty texts have no words and no hits; an item without words has no window, one of fewer
    than ``window`` words is one window. Repeated rows are separate documents with equal results.
    Items of one identifier count once, a null identifier not at all (its windows do mark words).
    Without items, or without documents, there are no hits. Other columns are not read.
    """
    item_rows = item_words(items, item_col, item_text_col)
    if keyed:
        row_key = F.struct(column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("text_key"))
        docs, id_col, text_col = docs.select(row_key.alias("doc_id"), column(text_col).alias("text")), "doc_id", "text"
    index = index_for(docs, item_rows, id_col, text_col)
    hits = cut(phrase_hits(index, item_rows, window))
    places = hits.select("row", "pos").distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    named = hits.select("row", F.col("item_id").cast("string").alias("name")).where("name is not null").distinct()
    named = named.groupBy("row").agg(F.sort_array(F.collect_list("name")).alias("names"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    out = index.documents.join(places.join(named, "row", "left"), "row", "left")
    return out.select(
        "doc_id.doc_id" if keyed else "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(names).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
        *(["doc_id.text_key"] if keyed else []),
    )


def proximity_matches(index: Index, item_rows: DataFrame, slack: int = 5, window: int = WINDOW) -> DataFrame:
    """``(doc_id, item_id, first, last)``: places where the words of a window of an item stand together, though not as a phrase.

    A window counts with its words that the corpus has, of which it needs two: each of the others must stand
    on its side of the rarest one, at most ``slack`` words farther from it than in the item. Of several
    places of a word the one nearest to its place in the item is taken. ``first`` and ``last`` span all
    these words; windows with one span give one row. Items of one word match nothing.
    """
    terms = _terms(index, item_rows)
    size = F.least(F.col("n"), F.lit(window))
    starts = terms.select("item", size.alias("size"), "n", F.col("k").alias("start")).where("start <= n - size")
    places = starts.select("item", "start", F.explode(F.expr("sequence(start, start + size - 1)")).alias("k"))
    known = places.join(terms.where("cf > 0").select("item", "k", "term", "cf"), ["item", "k"])
    whole = W.partitionBy("item", "start")
    known = known.withColumn("rank", F.row_number().over(whole.orderBy("cf", "k"))).withColumn("known", F.count("*").over(whole))
    known = cut(known.where("known > 1"))
    anchors = known.where("rank = 1").select("item", "start", "known", F.col("k").alias("k1"), F.col("term").alias("t1"))
    second = known.where("rank = 2").select("item", "start", F.col("k").alias("k2"), F.col("term").alias("t2"))
    windows = sized(anchors.join(second, ["item", "start"]))

    def reach(at: str, k1: str, k: str) -> Column:
        after, before = f"sequence({at} + 1, {at} + {k} - {k1} + {slack})", f"sequence({at} + {k} - {k1} - {slack}, {at} - 1)"
        return F.explode(F.expr(f"if({k} > {k1}, {after}, {before})"))

    rarest = sized(windows.select("item", "k1", "t1", "k2", "t2").distinct())
    found = index.postings.join(rarest, F.col("term") == F.col("t1")).select("row", "item", "k1", "k2", F.col("pos").alias("at"), F.col("t2").alias("term"))
    expected = found.withColumn("pos", reach("at", "k1", "k2"))
    lists = index.postings.join(sized(windows.select(F.col("t2").alias("term")).distinct()), "term", "left_semi")
    likely = cut(expected.join(lists, ["row", "pos", "term"]).select("row", "item", "at", "k1", "k2").distinct())

    # All lists, of the documents that are left.
    lists = index.postings.join(sized(likely.select("row").distinct()), "row", "left_semi")
    others = sized(known.where("rank > 1").select("item", "start", "k", "term"))
    asked = likely.join(windows.select("item", "start", "known", "k1", "k2"), ["item", "k1", "k2"]).join(others, ["item", "start"])
    met = asked.withColumn("pos", reach("at", "k1", "k")).join(lists, ["row", "pos", "term"])
    away = F.abs(F.expr("pos - at - k + k1"))
    met = met.groupBy("row", "item", "start", "known", "at", "k").agg(F.min(F.struct(away.alias("away"), "pos")).alias("near"))
    spans = met.groupBy("row", "item", "start", "known", "at").agg(
        F.count("*").alias("n"), F.min("near.pos").alias("low"), F.max("near.pos").alias("high")
    )
    spans = spans.where("n = known - 1").select("row", "item", F.least("low", "at").alias("first"), F.greatest("high", "at").alias("last")).distinct()
    names = sized(item_rows.select("item", "item_id").distinct())
    return spans.join(names, "item").join(index.documents, "row").select("doc_id", "item_id", "first", "last")


def drop_contaminated(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, told apart by identifier and text. Reserved column names raise."""
    require_free(docs.columns)
    row, key = HIDDEN + "hit_id", HIDDEN + "hit_key"
    hit = sized(found.where("contaminated").select(F.col("doc_id").alias(row), F.col("text_key").alias(key)).distinct())
    same = column(id_col).eqNullSafe(F.col(row)) & (F.xxhash64(column(text_col)) == F.col(key))
    return docs.join(hit, same, "left_anti")
