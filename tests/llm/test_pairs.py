"""Near-duplicates and decontamination against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import (
    SF,
    TEXTS,
    awkward,
    components,
    contamination_rows,
    embedding_rows,
    empty,
    rows_of,
    simhash_rows,
    sort_rows,
)
from tidyloom.llm import components as graph
from tidyloom.llm import contamination, embedding_dedup, simhash
from tidyloom.llm.common import join_hot
from tidyloom.llm.components import connected_components


@pytest.mark.parametrize("links_a_task", [1 << 20, 40])
def test_components(spark, monkeypatch, links_a_task):
    monkeypatch.setattr(graph, "LINKS_A_TASK", links_a_task)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 560)]
    got = dict(rows_of(connected_components(spark.createDataFrame(links, "a bigint, b bigint")), "node", "root"))
    want = components(600, links)
    linked = {x for p in links if p[0] != p[1] for x in p}
    assert got == {x: want[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == sort_rows(simhash_rows(rows))


def test_close_pairs_are_all_found_once(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(-(1 << 63), (1 << 63) - 1, 40)
    near = [int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 63, (12, 2))]
    fps = sorted({*map(int, seeds), *near, 0, -1, 1, 7, 15})
    got = rows_of(simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp bigint")), "a", "b")
    mask = (1 << 64) - 1
    want = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & mask).bit_count() <= 3]
    assert got == sorted(want) and len(want) > 500


def test_simhash_of_awkward_tables(spark):
    got = rows_of(simhash.near_duplicates(awkward(spark)), "doc_id", "fingerprint", "component_id")
    assert got == sort_rows(simhash_rows(TEXTS))
    kept = simhash.keep_one(awkward(spark), simhash.near_duplicates(awkward(spark)))
    assert kept.columns == awkward(spark).columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in simhash_rows(TEXTS)}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_embeddings_of_a_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()][:250]
    some = spark.createDataFrame(rows, df.select("vec_id", "embedding", "label").schema)
    got = rows_of(embedding_dedup.near_duplicates(some), "vec_id", "n_links", "component_id", "kept")
    assert got == sort_rows(embedding_rows(rows))


def test_embeddings_in_many_tiles(spark, monkeypatch):
    """Small tiles, so that every kind of meeting occurs."""
    monkeypatch.setattr(embedding_dedup, "TILE", 5)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 12))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.22, 12)).tolist(), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = rows_of(embedding_dedup.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    want = sort_rows(embedding_rows(rows))
    assert got == want and sum(r[1] for r in want) > 200


def test_awkward_embeddings(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], None),
        (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1),
        (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.001], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0], 2), (14, [-0.0, 3.0], 1), (0, [0.0, 2.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("node", F.lit(1)).withColumn("cell", F.lit("x"))
    got = rows_of(embedding_dedup.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    assert got == sort_rows(embedding_rows(rows))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, [1.0], None)], "vec_id bigint, embedding array<double>, label int")
    assert rows_of(embedding_dedup.near_duplicates(null), "vec_id", "n_links", "component_id", "kept") == [(None, 0, None, True)]


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def test_decontamination_of_documents(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    want = contamination_rows([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows_of(contamination.decontaminate(docs, items), *COLUMNS) == sort_rows(want)
    assert sum(r[-1] for r in want) > 10


def test_decontamination_of_awkward_tables(spark):
    items = [(1, "A b c"), (2, None), (3, ""), (4, "lorem"), (1, "d e"), (None, "word"), (5, "a a"), (6, "b c d e f"), (6, "b c d e f"), (7, "nothing here")]
    table = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, term int, word string")
    got = contamination.decontaminate(awkward(spark), table)
    assert rows_of(got, *COLUMNS) == sort_rows(contamination_rows(TEXTS, items))
    clean = contamination.drop_contaminated(awkward(spark), got)
    assert clean.columns == awkward(spark).columns
    assert len(rows_of(clean, "doc_id")) == sum(not r[-1] for r in contamination_rows(TEXTS, items))
    assert contamination.decontaminate(empty(spark), table).count() == 0
    assert {r["n_hit"] for r in contamination.decontaminate(awkward(spark), table.limit(0)).collect()} == {0}


#: Null and repeated identifiers with clean and contaminated texts, near-duplicates and copies.
ROWS = [
    (None, "p q r s"), (None, "leak of words here"), (None, "p q r s"), (None, "t u v w"), (7, "leak of words here"), (7, "one clean text"),
    (7, "one clean text"), (8, "one clean text"), (3, "t u v w"), (None, None), (9, "another clean text of seven words"),
]


def test_rows_of_one_identifier_are_told_apart(spark):
    docs = awkward(spark, ROWS)
    items = spark.createDataFrame([(1, "leak of words here")], "item_id bigint, text string")
    clean = contamination.drop_contaminated(docs, contamination.decontaminate(docs, items))
    assert rows_of(clean, "doc_id", "text") == sort_rows([r for r in ROWS if r[1] != "leak of words here"])
    kept = simhash.keep_one(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    want = [(None, "p q r s"), (7, "leak of words here"), (7, "one clean text"), (3, "t u v w"), (None, None), (9, "another clean text of seven words")]
    assert rows_of(kept, "doc_id", "text") == sort_rows(want)


def test_hits_on_random_words(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcd") for _ in range(n))
    docs, items = [(i, text(60)) for i in range(40)], [(i, text(rng.randint(1, 8))) for i in range(25)]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(contamination.decontaminate(d, i, window=4), *COLUMNS) == sort_rows(contamination_rows(docs, items, 4))


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x rare y y odd z"), (2, "odd rare"), (3, "rare y y y y y y y odd")], "doc_id bigint, text string")
    items = contamination.item_words(spark.createDataFrame([(9, "rare odd"), (8, "rare")], "item_id bigint, text string"))
    index = contamination.index_for(docs, items)
    assert rows_of(contamination.proximity_matches(index, items, 3), "doc_id", "item_id", "first", "last") == [(1, 9, 1, 4)]


def test_proximity_of_windows(spark):
    """A word that the corpus lacks, a passage of a long item, and two rare words without the others."""
    docs = [(1, "x one two three four y"), (2, "x e f so g h y"), (3, "one far four"), (4, "h g f e")]
    items = [(1, "one two lacking three four"), (2, "q1 x a b c d e f g h q2 y")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    rows = contamination.item_words(i)
    found = contamination.proximity_matches(contamination.index_for(d, rows), rows, 2, 4)
    assert rows_of(found, "doc_id", "item_id", "first", "last") == [(1, 1, 1, 3), (1, 1, 2, 4), (2, 2, 1, 2), (2, 2, 1, 4), (2, 2, 1, 5), (2, 2, 2, 5), (2, 2, 4, 6)]


def test_decontamination_is_native(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = contamination.decontaminate(docs, items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_hot_keys_are_taken_out_before_the_shuffle(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 7).when(F.col("id") < 1010, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = join_hot(left, right, "k", "n", parts=100)
    assert got.count() == 2990 and got.where("k = 7 and n = 1000").count() == 1000
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()
