import pytest
from pyspark.sql import functions as F

from tidyloom.names import data_columns
from tidyloom.operators.columns import (
    drop_columns,
    empty_columns,
    merge_columns,
    remove_empty_columns,
    rename_columns,
    split_column,
)


def rows(df, *columns):
    picked = df.orderBy("k").collect()
    return [tuple(r[c] for c in columns) for r in picked]


def test_drop_ignores_unknown_names(text):
    df, n = drop_columns(text(["a", "b,c", "d.e"], [("1", "2", "3")]), ["b,c", "x", "d.e", "d.e"])
    assert df.columns == ["k", "a"] and n == 2


def test_split_literal_separator(text):
    table = text(["a"], [("x.y.z",), ("x..",), ("",), (None,), ("x",)])
    df, n = split_column(table, " a ", ".", [" p ", "", "q", "r"])
    assert n == 3 and df.columns == ["k", "a", "p", "q", "r"]
    assert rows(df, "p", "q", "r") == [
        ("x", "y", "z"), ("x", "", ""), ("", "", ""), ("", "", ""), ("x", "", ""),
    ]


def test_split_on_white_space(text):
    table = text(["a"], [("  x \t　y  ",), ("",), ("  ",), ("x y z",)])
    df, _ = split_column(table, "a", " ", ["p", "q"], keep_original=False)
    assert df.columns == ["k", "p", "q"]
    assert rows(df, "p", "q") == [("x", "y"), ("", ""), ("", ""), ("x", "y")]


def test_split_keeps_an_existing_target(text):
    df, n = split_column(text(["a", "b"], [("1-2-3", "old")]), "a", "-", ["x", "b", "y", "x"])
    assert n == 2
    assert rows(df, "a", "b", "x", "y") == [("1-2-3", "old", "1", "3")]


def test_split_without_a_source_or_targets_does_nothing(text):
    table = text(["a"], [("1",)])
    for source, targets in (("z", ["p"]), ("a", []), ("a", [" "]), ("", ["p"])):
        df, n = split_column(table, source, "-", targets)
        assert df.columns == table.columns and n == 0


def test_merge_joins_what_is_not_blank(text):
    table = text(["a", "b", "c"], [("A", " ", "B"), ("", None, "　"), (" A", "x", "B ")])
    df, dropped = merge_columns(table, ["a", "b", "zz", "c"], "-", " m ")
    assert df.columns == ["k", "a", "b", "c", "m"] and dropped == 0
    assert rows(df, "m") == [("A-B",), ("",), (" A-x-B ",)]


def test_merge_into_a_source_and_drop_the_others(text):
    df, dropped = merge_columns(text(["a", "b", "c"], [("1", "2", "3")]), ["a", "b"], "", "b", True)
    assert df.columns == ["k", "b", "c"] and dropped == 1
    assert rows(df, "b", "c") == [("12", "3")]


def test_empty_columns(text):
    table = text(["a", "b", "c", "d"], [("", "x", " ", "x"), (None, "y", "x", "y")]).drop("k")
    assert empty_columns(table, "all") == ["a"]
    assert empty_columns(table, "any") == ["a", "c"]
    assert empty_columns(table, "any", trim=False) == ["a"]
    df, n = remove_empty_columns(table, "any")
    assert df.columns == ["b", "d"] and n == 2


def test_empty_columns_of_an_empty_table(text):
    table = text(["a", "b"], [("1", "2")]).drop("k").where("a = 'none'")
    assert remove_empty_columns(table, "all")[0].columns == []
    assert remove_empty_columns(table, "any")[0].columns == ["a", "b"]


def test_rename_at_once(text):
    table = text(["a", "b", "c,d"], [("1", "2", "3")])
    pairs = [("a", "b"), (" b ", " a "), ("c,d", "e.f"), ("zz", "q"), ("a", ""), ("", "x")]
    df, n = rename_columns(table, [{"from": f, "to": t} for f, t in pairs])
    assert df.columns == ["k", "b", "a", "e.f"] and n == 3
    assert rows(df, "a", "b") == [("2", "1")]


def test_rename_to_a_name_in_use_raises(text):
    with pytest.raises(ValueError, match="same name"):
        rename_columns(text(["a", "b"], [("1", "2")]), [{"from": "a", "to": "b"}])


def test_hidden_columns_stay_hidden(text):
    table = text(["a", "b"], [("1", "2")]).withColumnRenamed("k", "__tl_row")
    assert data_columns(rename_columns(table, [{"from": "a", "to": "c"}])[0]) == ["c", "b"]
    assert "__tl_row" in remove_empty_columns(table)[0].columns


@pytest.mark.parametrize("condition", ["all", "any"])
def test_columns_that_the_first_rows_decide_are_not_evaluated_in_full(spark, condition):
    """A cell far down that cannot be evaluated is never met; what the first rows leave open is decided by all rows."""
    far = F.col("id") >= 50_000
    first, late = ("x", "") if condition == "all" else ("", "x")
    df = spark.range(0, 60_000, 1, 3).select(
        F.when(far, F.raise_error(F.lit("evaluated"))).otherwise(F.lit(first)).alias("decided"),
        F.when(far, F.lit(first)).otherwise(F.lit(late)).alias("late"),
        F.lit(late).alias("never"),
    )
    want = ["never"] if condition == "all" else ["decided", "late"]
    assert empty_columns(df, condition) == want
    assert empty_columns(df.limit(0), condition) == (df.columns if condition == "all" else [])
