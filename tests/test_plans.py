"""The physical plans: what is shuffled, what is read, and that no row is in Python."""

import re

import pytest

from tidyloom.operators import fill
from tidyloom.operators.fill import fill_directional
from tidyloom.operators.order import attach_key_order
from tidyloom.plans.clean import clean
from tidyloom.session import cut
from tidyloom.sources.readers import load
from workload.queries import queries

SF = "/root/testdata/sf0.001"
ROW_LOCAL = (
    "drop_", "rename_", "split_", "merge_", "text_", "email_", "phone_", "date_", "currency_",
    "fill_default", "fill_overwrite", "remove_empty_rows", "to_text",
)


@pytest.fixture
def plan(spark):
    """The physical plan as it would run at scale: no broadcast, no adaptive shortcuts."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(text):
    return re.findall(r"(?<!Reused)Exchange (\w+)", text)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_query_runs_rows_in_python(spark, plan, name):
    text = plan(queries()[name](spark, SF))
    assert "Python" not in text and "Arrow" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    if name.startswith(ROW_LOCAL):
        assert exchanges(text) == []


@pytest.mark.parametrize("name", [n for n in queries() if n.startswith("dedup_")])
def test_duplicates_take_one_shuffle_after_a_map_side_reduction(spark, plan, name):
    text = plan(queries()[name](spark, SF))
    assert exchanges(text) == ["hashpartitioning"]
    above, below = text.split("Exchange hashpartitioning")
    assert "Aggregate" in above and "Aggregate" in below
    assert "Window" not in text and "Join" not in text


FILLS = ["ffill", "bfill", "fill_both", "ffill_limit", "fill_both_limit"]


@pytest.mark.parametrize("name", FILLS)
def test_a_fill_shuffles_the_table_once(spark, plan, name):
    """For the windows. The summaries of chunks were solved before; they are read from one small table."""
    text = plan(queries()[name](spark, SF))
    assert exchanges(text).count("hashpartitioning") == 1
    assert "SinglePartition" not in text and "rangepartitioning" not in text and "SortMergeJoin" not in text
    assert text.count("FileScan") == 2 and text.count("BroadcastHashJoin") == 1


def test_large_summaries_of_a_fill_are_joined_without_another_shuffle(spark, plan, monkeypatch):
    monkeypatch.setattr(fill, "BROADCAST_BYTES", -1)
    for name in FILLS:
        text = plan(queries()[name](spark, SF))
        tables = [part for part in text.split("Exchange hashpartitioning")[1:] if "events.parquet" in part.split("FileScan")[1]]
        assert len(tables) == 1 and "SinglePartition" not in text


@pytest.mark.parametrize("limit", [None, 3])
def test_no_window_of_a_fill_grows_with_the_files(spark, tmp_path, monkeypatch, limit):
    """Each of 400 files is a chunk. What is gathered in one task stays below the bound."""
    path = str(tmp_path / "many")
    rows = spark.range(0, 4000, 1, 400).selectExpr("lpad(id, 5, '0') as k", "if(id % 97 = 0, cast(id as string), '') as a")
    rows.write.parquet(path)
    monkeypatch.setattr(fill, "TOP_ROWS", 16)
    gathered = []

    def watched(df):
        if "SinglePartition" in df._jdf.queryExecution().executedPlan().toString():
            gathered.append(df.count())
        return cut(df)

    monkeypatch.setattr(fill, "cut", watched)
    got = fill_directional(load(spark, path, "parquet"), ["a"], limit=limit)
    assert gathered and max(gathered) <= 16
    cells = {int(r["k"]): r["a"] for r in got.collect()}
    assert len(cells) == 4000
    for k, a in cells.items():
        near = k - k % 97
        assert a == (str(near) if limit is None or k - near <= limit else "")


def test_unused_columns_are_not_read(spark, plan):
    df = spark.read.parquet(f"{SF}/customer.parquet")
    rules = {
        "columns": {"drop": {"enabled": True, "columns": ["c_acctbal", "c_nationkey"]}},
        "format": {"text": {"enabled": True, "trim": True}},
    }
    text = plan(clean(df, rules).df)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert schema == "c_custkey:bigint,c_name:string,c_mktsegment:string"


def test_tallies_cost_nothing_unless_asked_for(spark, plan):
    df = attach_key_order(spark.read.parquet(f"{SF}/customer.parquet"), "c_custkey", chunked=False)
    rules = {"format": {"text": {"enabled": True, "trim": True}}, "dedup": {"enabled": True}}
    result = clean(df, rules)
    assert "__tl_n_" not in plan(result.df) and "__tl_n_" in plan(result.stats)


def test_removing_empty_rows_does_not_evaluate_the_formats_twice(spark, plan):
    df = spark.read.parquet(f"{SF}/customer.parquet")
    rules = {
        "format": {"phone": {"enabled": True, "columns": ["c_name"]}},
        "missing": {"removeEmptyRows": {"enabled": True, "condition": "any"}},
    }
    assert plan(clean(df, rules).df).count("regexp_replace") == 1


def test_table_and_statistics_come_from_one_evaluation(spark, plan):
    """With ``cuts="always"`` neither plan holds a rule any more; the counters are those of separate evaluations."""
    df = attach_key_order(spark.read.parquet(f"{SF}/events.parquet"), "event_id")
    rules = {
        "format": {"text": {"enabled": True, "trim": True, "collapseSpaces": True}},
        "missing": {
            "fillForwardBackward": {"enabled": True, "columns": ["props"], "limit": 1},
            "removeEmptyRows": {"enabled": True, "condition": "any"},
        },
    }
    once, twice = clean(df, rules, cuts="always"), clean(df, rules, cuts="never")
    for frame in (once.df, once.stats):
        text = plan(frame)
        assert "regexp" not in text and "events.parquet" not in text and text.count("FileScan") == 1
    assert once.stats.collect() == twice.stats.collect()
    assert once.df.count() == twice.df.count() and once.df.columns == twice.df.columns
