import pytest
from pyspark.sql import functions as F

from tidyloom.names import CHUNK, FILE, ref
from tidyloom.operators import order
from tidyloom.operators.order import attach_file_order, attach_key_order, in_order, packed, unpacked
from tidyloom.session import cut
from tidyloom.sources.readers import load


def test_even_keys_need_no_shuffle(text):
    df = attach_key_order(text(["a"], [("x",)] * 100), "k", chunk_rows=10)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    sizes = df.groupBy(CHUNK).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) == 10


def test_negative_keys_rise_with_their_chunks(spark):
    df = attach_key_order(spark.range(-50, 50), "id", chunk_rows=10)
    chunks = [r[CHUNK] for r in df.orderBy("id").collect()]
    assert chunks == sorted(chunks)


@pytest.mark.parametrize("extra", [[], [2**62], [-(2**62), 2**62]])
def test_dense_and_distant_keys_still_give_bounded_chunks(spark, monkeypatch, extra):
    """One stretch holds nearly all rows: equal ranges do not work, sorting does."""
    keys = spark.range(2000).select("id")
    if extra:
        keys = keys.union(spark.createDataFrame([(e,) for e in extra], "id bigint"))
    sorted_once = []
    monkeypatch.setattr(order, "cut", lambda df: sorted_once.append(1) or cut(df))
    df = attach_key_order(keys, "id", chunk_rows=50)
    assert len(sorted_once) == (1 if extra else 0)
    assert df.groupBy(CHUNK).count().agg(F.max("count")).first()[0] <= 200
    got = [r["id"] for r in in_order(df).collect()]
    assert got == sorted(got) and len(got) == 2000 + len(extra)


def test_text_and_compound_keys(spark):
    df = spark.range(300).selectExpr("id % 7 AS a", "lpad(cast(id as string), 4, '0') AS b")
    got = [(r["a"], r["b"]) for r in in_order(attach_key_order(df, ["a", "b"])).collect()]
    assert got == sorted(got) and len(got) == 300
    unchunked = attach_key_order(df, ["a", "b"], chunked=False)
    assert [(r["a"], r["b"]) for r in in_order(unchunked).collect()] == got


def test_empty_table(spark):
    assert in_order(attach_key_order(spark.range(0), "id")).count() == 0


def test_file_order_over_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(order, "CHUNK_ROWS", 16)
    lines = [f"{name}{i:04d},{'x' * (i % 50)}" for name in "abc" for i in range(500)]
    for name in "abc":
        body = "\n".join(x for x in lines if x.startswith(name))
        (tmp_path / f"{name}.csv").write_text(f"id,t\n{body}\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        scan = spark.read.schema("id string, t string").csv(str(tmp_path), header=True)
        df = attach_file_order(scan)
        assert df.rdd.getNumPartitions() > 8
        assert [r["id"] for r in in_order(df).collect()] == [x.split(",")[0] for x in lines]
        assert df.groupBy(*order.chunk_columns(df)).count().agg(F.max("count")).first()[0] <= 16
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_parquet_rows_are_numbered_by_the_file(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "p"))
    df = attach_file_order(spark.read.parquet(str(tmp_path / "p")))
    assert [r["id"] for r in in_order(df.repartition(5)).collect()] == list(range(100))


@pytest.mark.parametrize("few", [32, 1])
def test_files_are_numbered_in_the_order_of_their_paths(spark, tmp_path, monkeypatch, few):
    """Odd names, a constant of the plan or a join; positions survive packing."""
    monkeypatch.setattr(order, "FEW_FILES", few)
    names = ["a b.csv", "a%20b.csv", "ä.csv", "z+1.csv", "b#2.csv"]
    for name in names:
        (tmp_path / name).write_text("x,f\n" + "\n".join(f"{i},{name}" for i in range(50)))
    df = load(spark, str(tmp_path), "csv")
    assert ("Join" in df._jdf.queryExecution().optimizedPlan().toString()) == (few == 1)
    place = packed(df)
    back = df.withColumn("p", place).select("x", "f", FILE, *[(ref(c) == e).alias(f"ok{i}") for i, (c, e) in enumerate(unpacked(df, F.col("p")).items())])
    rows = back.collect()
    assert len(rows) == 250 and all(all(v for k, v in r.asDict().items() if k.startswith("ok")) for r in rows)
    numbers = {(r["f"], r[FILE]) for r in rows}
    assert len(numbers) == 5 and {n for _, n in numbers} == set(range(5))
    ordered = df.withColumn("p", place).orderBy("p").collect()
    assert [(r["f"], r["x"]) for r in ordered] == [(r["f"], r["x"]) for r in in_order(df).collect()]
    assert [int(r["x"]) for r in ordered] == list(range(50)) * 5
