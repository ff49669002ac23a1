import pytest

from tidyloom.operators.missing import drop_rows, empty_row, fill_default


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("k").collect()]


def test_fill_default(text):
    table = text(["a", "b"], [("x", ""), (" ", None), (None, "y")])
    df = fill_default(table, ["a", "b", "zz"], {"a": "A"})
    assert rows(df, "a", "b") == [("x", ""), ("A", ""), ("A", "y")]


def test_fill_default_overwrites(text):
    table = text(["a", "b"], [("x", "z"), (" ", None)])
    df = fill_default(table, ["a", "b"], {"a": "A"}, only_when_empty=False)
    assert rows(df, "a", "b") == [("A", ""), ("A", "")]


def test_fill_default_without_trimming(text):
    df = fill_default(text(["a"], [(" ",), ("",)]), ["a"], {"a": "A"}, trim=False)
    assert rows(df, "a") == [(" ",), ("A",)]


def test_fill_default_counts_changed_cells(text):
    table = text(["a", "b"], [("", ""), ("x", "B"), (" ", None)])
    df = fill_default(table, ["a", "b"], {"a": "A"}, tally="__tl_n")
    assert rows(df, "__tl_n") == [(1,), (0,), (1,)]


ROWS = [("x", "y"), ("", "y"), (" ", None), ("　", "")]


@pytest.mark.parametrize(
    "options, kept",
    [
        ({"condition": "all", "columns_mode": "custom", "columns": ["a", "b"]}, [0, 1]),
        ({"condition": "any", "columns_mode": "custom", "columns": ["a", "b", "zz"]}, [0]),
        ({"condition": "any", "columns_mode": "custom", "columns": ["b"]}, [0, 1]),
        ({"condition": "any", "columns_mode": "custom", "columns": []}, [0, 1, 2, 3]),
        ({"condition": "any", "columns_mode": "custom", "columns": ["zz"]}, [0, 1, 2, 3]),
        ({"condition": "all"}, [0, 1, 2, 3]),  # the key column is never blank
        ({"condition": "any"}, [0]),
        (
            {"condition": "all", "columns_mode": "custom", "columns": ["a"], "trim": False},
            [0, 2, 3],
        ),
    ],
)
def test_remove_empty_rows(text, options, kept):
    table = text(["a", "b"], ROWS).selectExpr("cast(k as string) k", "a", "b")
    assert rows(drop_rows(table, empty_row(table, **options)), "k") == [(str(i),) for i in kept]
