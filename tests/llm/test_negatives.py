"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import rows_of, sort_rows
from tidyloom.llm import hard_negatives
from tidyloom.llm.hard_negatives import Asks, CoverTree, descend

COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(rows, every, positives=5, negatives=5, low=80):
    usable = [
        (i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (i, label, v) in enumerate(usable):
        if i is None or i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, u, strict=True)), j is None, j or 0, j, other) for k, (j, other, u) in enumerate(usable) if k != n and len(u) == len(v)]
        for s, _, _, p, _ in sorted(x for x in others if x[4] == label)[:positives]:
            fit = sorted(x for x in others if x[4] != label and low * -s <= 100 * -x[0] <= 100 * -s)[:negatives]
            out += [(i, p, k + 1, x[3], -s, -x[0]) for k, x in enumerate(fit)]
    return sort_rows(out)


def got(spark, rows, every, label="int", **options):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<double>, label {label}")
    df = df.withColumn("row", F.lit(1)).withColumn("rank", F.lit("x")).repartition(3)
    return rows_of(hard_negatives.mine(df, F.col("vec_id") % every == 0, **options), *COLUMNS)


@pytest.mark.parametrize("numbers", [40, 1 << 19])
def test_random_vectors(spark, monkeypatch, numbers):
    """Clusters, copies and ties, in trees of several sizes."""
    monkeypatch.setattr(hard_negatives, "TREE_NUMBERS", numbers)
    monkeypatch.setattr(hard_negatives, "TREES_A_MEETING", 3)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 4)
    monkeypatch.setattr(hard_negatives, "CENTRES", 5)
    rng = np.random.default_rng(numbers)
    centres = rng.normal(0, 0.5, (6, 5))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.1, 5)).tolist(), int(rng.integers(3))) for i in range(240)]
    rows += [(300 + i, rows[0][1], i % 3) for i in range(80)]  # a third are copies
    rows += [(500 + i, rng.normal(0, 1, 3).tolist(), i % 2) for i in range(20)]
    want = mined(rows, 10)
    assert got(spark, rows, 10) == want and len(want) > 300
    if numbers == 40:
        assert got(spark, rows, 10, positives=2, negatives=3, low=95) == mined(rows, 10, 2, 3, 95)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], "a"), (0, [1.0, 0.0], "a"), (1, [1.0, 0.1], "b"), (None, [1.0, 0.1], "b"), (None, [1.0, 0.1], "a"),
        (2, None, "a"), (3, [nan, 1.0], "a"), (4, [inf, 1.0], "b"), (5, [None, 1.0], "b"), (6, [1.0, 0.1], None), (7, [], "a"), (8, [], "b"), (9, [], "a"),
        (10, [0.0, 0.0], "b"), (11, [0.0, 0.0], "a"), (20, [-1.0, 0.0], "c"), (30, [0.5, 0.2, 0.1], "a"), (31, [0.5, 0.2, 0.0], "a"), (32, [0.5, 0.2, 0.0], "b"),
        (40, [1e6, -2.5e6], "a"), (41, [1e6, -2.5e6], "a"), (42, [0.9e6, -2.4e6], "b"),
    ]
    want, have = mined(rows, 1), got(spark, rows, 1, label="string")
    assert have == want and len(want) > 20
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_a_score_beyond_64_bits_raises():
    x = np.array([[2.0**40, 2.0**40]])
    with pytest.raises(OverflowError):
        hard_negatives.products(x, x)


def tree_of(seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (40, 16))
    return np.floor(256 * (centres[rng.integers(0, 40, 2000)] + rng.normal(0, spread, (2000, 16))))


def test_every_node_covers_what_is_below():
    x = tree_of(1, 0.3)
    tree = CoverTree.of(x)
    norm = np.linalg.norm(x, axis=1)
    y = np.hstack([x, np.sqrt(np.maximum(0, tree.length**2 - norm**2))[:, None]]) / tree.length

    def below(n):
        out = []
        for c, b in zip(tree.child[tree.begin[n] : tree.begin[n + 1]], tree.below[tree.begin[n] : tree.begin[n + 1]], strict=True):
            rows = below(b) if b >= 0 else [c]
            if b >= 0:
                angle = np.arccos(np.clip(y[rows] @ y[c], -1, 1))
                assert angle.max() <= tree.radius[b] + 1e-9 and tree.radius[b] <= tree.radius[n] / 2 + 1e-6
            out += rows
        return out

    assert sorted(below(0)) == list(range(2000))


def test_windows_skip_most_of_a_clustered_tree():
    x = tree_of(2, 0.02)
    tree, n = CoverTree.of(x), np.arange(2000)
    zero, one = np.zeros(2000, np.int64), np.ones((5, 1), np.int64)
    asks = Asks(x[:5], zero[:5] + 1, n[:5], one * -(1 << 62), one * (1 << 62), False, 5)
    assert descend(tree, asks, n, zero, zero, n) < 5 * 2000 * 0.3
    score = (x[:5] @ x.T).astype(np.int64)
    for a in range(5):
        want = sorted((-score[a, j], j) for j in range(2000) if j != a)[:5]
        assert [(-r[2], r[4]) for r in asks.found[asks.found[:, 0] == a].tolist()] == want
    # A window in the middle of the scores.
    low = np.sort(score, axis=1)[:, [1000]]
    asks = Asks(x[:5], zero[:5] + 1, n[:5], low - 1000, low, False, 5)
    assert descend(tree, asks, n, zero, zero, n) < 5 * 2000 * 0.6
    assert (asks.found[asks.found[:, 3] == 0][:, 2] <= low[asks.found[:, 0], 0]).all()
