"""Directional fill against the row-by-row definition."""

import random

import pytest

from tidyloom.names import SCOPE, drop_hidden
from tidyloom.operators import fill as fill_module
from tidyloom.operators import order
from tidyloom.operators.fill import fill_directional
from tidyloom.operators.order import attach_key_order

LIMITS = [None, 1, 3, 40]


def blank(cell):
    return cell is None or not cell.strip()


def fill_one_way(cells, limit):
    last, since, out = None, 0, []
    for cell in cells:
        if not blank(cell):
            last, since = cell, 0
        elif last is not None and (limit is None or since < limit):
            cell, since = last, since + 1
        out.append(cell)
    return out


def fill(cells, direction, limit):
    if direction in ("forward", "both"):
        cells = fill_one_way(cells, limit)
    if direction in ("backward", "both"):
        cells = fill_one_way(cells[::-1], limit)[::-1]
    return cells


def sparse_cells(rng, n):
    """Runs of blanks of very different lengths."""
    cells = []
    while len(cells) < n:
        cells += [rng.choice(["", " ", None]) for _ in range(rng.choice([0, 0, 1, 2, 5, 30, 150]))]
        cells += [f" v{len(cells)}"]
    return cells[:n]


@pytest.fixture
def small_groups(monkeypatch):
    """Several chunks in a range and several levels of ranges, even on a small table."""
    monkeypatch.setattr(fill_module, "TOP_ROWS", 3)


@pytest.mark.parametrize("limit", LIMITS)
def test_equals_the_sequential_definition(text, small_groups, limit):
    rng = random.Random(str(limit))
    n = 700
    names = {"f": "forward", "b": "backward", "o": "both", "e": "both", "g": "forward"}
    cells = {c: sparse_cells(rng, n) for c in names}
    cells["e"] = [""] * n  # nothing to fill from
    cells["g"] = [""] * 333 + ["g"] + [""] * (n - 334)
    table = text(list(names), list(zip(*cells.values(), strict=True)))
    ordered = attach_key_order(table, "k", chunk_rows=25)
    assert ordered.select(order.CHUNK).distinct().count() == 28
    df = fill_directional(ordered, list(names), names, limit, tally="__tl_n")
    got = df.orderBy("k").collect()
    filled = 0
    for c, direction in names.items():
        expected = fill(cells[c], direction, limit)
        assert [r[c] for r in got] == expected
        filled += sum(blank(a) and not blank(b) for a, b in zip(cells[c], expected, strict=True))
    assert sum(r["__tl_n"] for r in got) == filled
    assert drop_hidden(df).columns == table.columns


@pytest.mark.parametrize("limit", [None, 2])
def test_rows_missing_from_the_middle(text, small_groups, limit):
    """Positions with holes, as after removing duplicates: distance counts rows."""
    cells = sparse_cells(random.Random(5), 600)
    keep = [i for i in range(600) if i % 7 not in (1, 2) and not 100 <= i < 260]
    table = attach_key_order(text(["a"], [(c,) for c in cells]), "k", chunk_rows=20)
    table = table.where("k % 7 not in (1, 2) and not (k >= 100 and k < 260)")
    got = fill_directional(table, ["a"], {"a": "both"}, limit).orderBy("k").collect()
    assert [r["a"] for r in got] == fill([cells[i] for i in keep], "both", limit)


@pytest.mark.parametrize("limit", [None, 3])
def test_scopes_do_not_mix(spark, small_groups, limit):
    rng = random.Random(9)
    tables = {s: sparse_cells(rng, n) for s, n in {"a": 400, "b": 1, "c": 90, "d": 5}.items()}
    tables["d"] = [""] * 5
    data = [(s, i, c) for s, cells in tables.items() for i, c in enumerate(cells)]
    rng.shuffle(data)
    numbered = [(s, i + 1000 * "abcd".index(s), c) for s, i, c in data]
    df = spark.createDataFrame(numbered, f"{SCOPE} string, k bigint, a string")
    ordered = attach_key_order(df, "k", chunk_rows=30)
    got = fill_directional(ordered, ["a"], {"a": "both"}, limit).orderBy("k").collect()
    for s, cells in tables.items():
        assert [r["a"] for r in got if r[SCOPE] == s] == fill(cells, "both", limit)


def test_default_direction_unknown_direction_and_zero(text):
    table = attach_key_order(text(["a", "b"], [("x", "x"), ("", ""), ("", "")]), "k")
    df = fill_directional(table, ["a", "b", "zz"], {"b": "sideways"}).orderBy("k")
    assert [(r["a"], r["b"]) for r in df.collect()] == [("x", "x"), ("x", ""), ("x", "")]
    zero = fill_directional(table, ["a"], limit=0, tally="__tl_n").orderBy("k").collect()
    assert [r["a"] for r in zero] == ["x", "", ""] and [r["__tl_n"] for r in zero] == [0, 0, 0]


def test_forward_wins_in_a_short_gap(text):
    table = attach_key_order(text(["a"], [(c,) for c in ["a", "", "", "", "b"]]), "k")
    got = fill_directional(table, ["a"], {"a": "both"}, 1).orderBy("k").collect()
    assert [r["a"] for r in got] == ["a", "a", "", "b", "b"]


def test_blank_test_without_trimming(text):
    table = attach_key_order(text(["a"], [(c,) for c in ["a", " ", "", None]]), "k")
    got = fill_directional(table, ["a"], trim=False).orderBy("k").collect()
    assert [r["a"] for r in got] == ["a", " ", " ", " "]


def test_needs_an_order_and_a_sound_limit(text):
    with pytest.raises(ValueError, match="order"):
        fill_directional(text(["a"], [("",)]), ["a"])
    with pytest.raises(ValueError, match="limit"):
        fill_directional(attach_key_order(text(["a"], [("",)]), "k"), ["a"], limit=-1)
