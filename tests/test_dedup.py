"""Duplicates against the row-by-row definition."""

import random

import pytest

from tidyloom.names import FILE, SCOPE
from tidyloom.operators.dedup import dedup_rows
from tidyloom.operators.order import attach_key_order, in_order
from tidyloom.sources.readers import load


def expected(rows, key, keep):
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(key(row), []).append(i)
    if keep == "none":
        return sorted(g[0] for g in groups.values() if len(g) == 1)
    return sorted(g[0] if keep == "first" else g[-1] for g in groups.values())


@pytest.fixture
def table(text):
    rng = random.Random(1)
    cells = ["x", "X ", " x", "y", "", " ", "z"]
    # One key holds a third of all rows.
    rows = [
        ("", "", "") if rng.random() < 0.33 else tuple(rng.choice(cells) for _ in range(3))
        for _ in range(600)
    ]
    return rows, attach_key_order(text(["a", "b", "c"], rows).repartition(3), "k", chunked=False)


def kept(df):
    return sorted(r["k"] for r in df.collect())


@pytest.mark.parametrize("keep", ["first", "last", "none"])
@pytest.mark.parametrize("normalize", [False, True])
def test_by_columns(table, keep, normalize):
    rows, df = table
    same = (lambda v: v.strip().lower()) if normalize else (lambda v: v)
    got = dedup_rows(df, "byColumns", ["b", "a", "zz"], keep, normalize)
    assert kept(got) == expected(rows, lambda r: (same(r[0]), same(r[1])), keep)
    assert got.columns == df.columns
    for r in got.collect():
        assert (r["a"], r["b"], r["c"]) == rows[r["k"]]


@pytest.mark.parametrize("keep", ["first", "last", "none"])
@pytest.mark.parametrize("normalize", [False, True])
@pytest.mark.parametrize("chunked", [False, True])
def test_whole_rows(table, keep, normalize, chunked):
    rows, df = table
    df = attach_key_order(df.drop("__tl_row"), "k", chunked=chunked).drop("k")
    same = (lambda v: v.strip().lower()) if normalize else (lambda v: v)
    got = dedup_rows(df, "wholeRow", (), keep, normalize)
    positions = sorted(r["__tl_row"] for r in got.collect())
    assert positions == expected(rows, lambda r: tuple(map(same, r)), keep)


def test_any_keeps_one_row_per_key(table):
    rows, df = table
    got = dedup_rows(df, "byColumns", ["a"], "whatever").collect()
    assert sorted(r["a"] for r in got) == sorted({r[0] for r in rows})
    assert all((r["a"], r["b"], r["c"]) == rows[r["k"]] for r in got)


def test_whole_rows_without_an_order(table):
    rows, df = table
    df = df.drop("k", "__tl_row")
    got = dedup_rows(df, "wholeRow", keep="any").collect()
    assert sorted(map(tuple, got)) == sorted(set(rows))
    once = dedup_rows(df, "wholeRow", keep="none").collect()
    assert sorted(map(tuple, once)) == sorted(r for r in set(rows) if rows.count(r) == 1)


def test_no_known_key_columns_is_no_change(table):
    _, df = table
    assert dedup_rows(df, "byColumns", []) is df
    assert dedup_rows(df, "byColumns", ["zz"]) is df


def test_scopes_do_not_mix(spark):
    rows = [("s1", 0, "x"), ("s2", 1, "x"), ("s1", 2, "x"), ("s2", 3, "y")]
    df = attach_key_order(spark.createDataFrame(rows, f"{SCOPE} string, k long, a string"), "k")
    assert kept(dedup_rows(df, "byColumns", ["a"])) == [0, 1, 3]
    assert kept(dedup_rows(df, "byColumns", ["a"], "last", True)) == [1, 2, 3]


def test_needs_an_order(text):
    with pytest.raises(ValueError, match="order"):
        dedup_rows(text(["a"], [("x",)]), "byColumns", ["a"], "first")


def test_whole_rows_from_files_are_reduced_by_hash(spark, tmp_path):
    """The position is one number of fixed width, so no task sorts its rows; the right row stays."""
    for k, cells in enumerate(["a\nb\na\n", "b\nc\na\n", "c\nd\n"]):
        (tmp_path / f"{k}.csv").write_text("v\n" + cells)
    table = load(spark, str(tmp_path), "csv")
    for keep, want in (("first", [("a", 0), ("b", 0), ("c", 1), ("d", 2)]), ("last", [("b", 1), ("a", 1), ("c", 2), ("d", 2)])):
        kept = dedup_rows(table, keep=keep)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
        assert kept.columns == table.columns
        assert [(r["v"], r[FILE]) for r in in_order(kept).collect()] == want
