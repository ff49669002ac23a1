import pytest

from tidyloom.plans.clean import clean


def on(**rule):
    return {"enabled": True, **rule}


@pytest.fixture
def stream(spark, tmp_path):
    rows = [(f" {i} ", f"+86 {i}") for i in range(20)]
    spark.createDataFrame(rows, "a string, b string").write.json(str(tmp_path / "in"))
    return spark.readStream.schema("a string, b string").json(str(tmp_path / "in"))


def test_row_local_rules_run_on_a_stream(spark, stream, tmp_path):
    rules = {
        "format": {"text": on(trim=True), "phone": on(columns=["b"])},
        "columns": {"rename": on(mappings=[{"from": "b", "to": "phone"}])},
        "missing": {"removeEmptyRows": on()},
    }
    query = (
        clean(stream, rules)
        .df.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted((str(i), str(i)) for i in range(20))


@pytest.mark.parametrize(
    "rules",
    [
        {"dedup": on(keep="none")},
        {"missing": {"fillForwardBackward": on(columns=["a"])}},
        {"columns": {"removeEmptyCols": on()}},
    ],
)
def test_whole_table_rules_are_refused_on_a_stream(stream, rules):
    with pytest.raises(ValueError, match="stream"):
        clean(stream, rules)
