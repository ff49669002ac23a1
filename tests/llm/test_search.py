"""Ranked search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import LOWER, SF, TEXTS, awkward, empty, rows_of, sort_rows
from tidyloom.llm import byte_words, lexical_search

COLUMNS = ("item_id", "rank", "doc_id", "score")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, top=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total, df = len(counts), sum(c.total() for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for i, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 90 + (90 * c.total() * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(terms(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored)[:top])]
    return sort_rows(out)


def found(docs, items, **options):
    return rows_of(lexical_search.search(docs, items, **options), *COLUMNS)


def test_search_of_documents(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert found(docs, items) == want and len(want) > 300


@pytest.mark.parametrize(("part_docs", "items_a_block", "bits"), [(7, 3, 1), (40, 256, 16)])
def test_random_texts(spark, monkeypatch, part_docs, items_a_block, bits):
    """Many files and blocks; signatures of one bit an entry hold many wrong ones, which may not change a result."""
    monkeypatch.setattr(lexical_search, "PART_DOCS", part_docs)
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", 300)
    monkeypatch.setattr(lexical_search, "ITEMS", items_a_block)
    monkeypatch.setattr(lexical_search, "BITS", bits)
    rng = random.Random(part_docs)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 30, 300]))) for i in range(90)] + [(200 + i, "w1 w2 w2 w3") for i in range(25)]
    items = [(i, text(rng.randint(1, 12))) for i in range(10)] + [(20, "w1 w3"), (21, "nowhere")]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2), spark.createDataFrame(items, "item_id bigint, text string")
    assert found(d, i) == ranked(docs, items)
    assert found(d, i, top=2) == ranked(docs, items, 2)


def test_awkward_tables(spark):
    items = [(1, "A b c"), (2, None), (3, ""), (4, "lorem LOREM"), (1, "d e"), (None, "word ñandúes"), (5, "12345 " + "x" * 300_000), (6, "b"), (6, "b")]
    table = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id bigint, text string, rank int, item string")
    got = lexical_search.search(awkward(spark), table)
    assert rows_of(got, *COLUMNS) == ranked(TEXTS, items)
    assert got.columns == list(COLUMNS)
    assert lexical_search.search(empty(spark), table).count() == 0
    assert lexical_search.search(awkward(spark), table.limit(0)).count() == 0


def test_bounds_hold_and_are_close():
    """No bound is below a score, and few documents besides the first have a bound that reaches the tenth score."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"t{x}" for x in rng.zipf(1.3, size=rng.integers(20, 400)) if x < 5000) for _ in range(600)]
    found = lexical_search.Terms.of(*byte_words.texts(pa.array(texts)))
    vocabulary = np.unique(found.hash)
    weight = rng.integers(100, 8000, len(vocabulary))
    of = [rng.choice(len(vocabulary), 20, replace=False) for _ in range(30)]
    items = lexical_search.Items(None, vocabulary, weight, of)
    m = 10 + 90 * found.length * len(texts) // found.length.sum()
    exact = np.zeros((len(of), len(texts)), np.int64)
    adds = weight[np.searchsorted(vocabulary, found.hash)] * lexical_search.saturation(found.tf, m[found.doc])
    for i, t in enumerate(of):
        mine = np.isin(found.hash, vocabulary[t])
        exact[i] = np.bincount(found.doc[mine], adds[mine], len(texts)).astype(np.int64)
    bound = np.zeros(exact.shape)
    for bits, docs, packed in lexical_search.signature_blocks(found):
        bound[:, docs] = lexical_search.upper_bounds(items, bits, packed, m[docs])
    assert (bound >= exact).all()
    tenth = np.sort(exact, axis=1)[:, -10]
    assert (bound >= tenth[:, None]).mean() < 0.1
