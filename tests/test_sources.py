import datetime

import pytest

from tidyloom.names import data_columns, drop_hidden
from tidyloom.operators.order import in_order
from tidyloom.plans.clean import clean
from tidyloom.plans.files import export_file, export_with_stats, preview_file
from tidyloom.plans.preview import preview
from tidyloom.sources import readers
from tidyloom.sources.batch import by_source, clean_many, sources_in
from tidyloom.sources.generator import VALUES, dirty_table
from tidyloom.sources.headers import normalize_headers
from tidyloom.sources.readers import csv_headers, format_of, load
from tidyloom.sources.text_table import to_text_table
from tidyloom.sources.records import record_account
from tidyloom.sources.writers import cleaned_name, write


def on(**rule):
    return {"enabled": True, **rule}


def table(df):
    return [tuple(r) for r in drop_hidden(in_order(df)).collect()]


def test_headers():
    names = ["a", "", None, "a", " ", "a", "a_1"]
    assert normalize_headers(names) == [
        "a", "Unnamed_2", "Unnamed_3", "a_1", "Unnamed_5", "a_2", "a_1_1",
    ]
    assert normalize_headers(names, "web") == ["a", "列2", "列3", "a_2", "列5", "a_3", "a_1"]


def test_formats_by_extension():
    assert [format_of(p) for p in ("/x/A.CSV", "b.Parquet", "c.json/")] == ["csv", "parquet", "json"]
    for bad in ("a.xlsx", "table", "a", "x.csv/a"):
        with pytest.raises(ValueError, match="unsupported"):
            format_of(bad)


def test_csv_is_all_text_with_repaired_header(spark, tmp_path):
    path = tmp_path / "In.CSV"
    path.write_text(
        '﻿id,"address,code",,id\n'
        "007,1.50, x ,z\n"
        '"a ""q"" b","1,2"\n'
        "1,2,3,4,5,6\n"
        ",,,\n"
        '"","  ",b,c\n',
        encoding="utf-8",
    )
    df = load(spark, str(path))
    assert data_columns(df) == ["id", "address,code", "Unnamed_3", "id_1"]
    assert table(df) == [
        ("007", "1.50", " x ", "z"),
        ('a "q" b', "1,2", "", ""),
        ("1", "2", "3", "4"),
        ("", "", "", ""),
        ("", "  ", "b", "c"),
    ]


def test_headers_that_differ_in_case(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,id\n1,2\n")
    assert table(load(spark, str(tmp_path / "a.csv"))) == [("1", "2")]
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        with pytest.raises(ValueError, match="caseSensitive"):
            load(spark, str(tmp_path / "a.csv"))
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")


def test_reserved_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,__tl_row\n1,2\n")
    with pytest.raises(ValueError, match="reserved"):
        load(spark, str(tmp_path / "a.csv"))


def test_a_given_order_replaces_the_order_of_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,a,v\n3,x,p\n1,x,q\n2,y,\n")
    source = load(spark, str(tmp_path / "a.csv"))
    rules = {"dedup": on(mode="byColumns", columns=["a"], keep="first")}
    assert [r["k"] for r in preview(clean(source, rules)).collect()] == ["3", "2"]
    assert [r["k"] for r in preview(clean(source, rules, order_by="k")).collect()] == ["1", "2"]
    fill = {"missing": {"fillForwardBackward": on(columns=["v"])}}
    assert [r["v"] for r in preview(clean(source, fill)).collect()] == ["p", "q", "q"]
    assert [r["v"] for r in preview(clean(source, fill, order_by="k")).collect()] == ["q", "q", "p"]


def test_line_breaks_inside_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"Eve\n",1\nx,2\n')
    assert table(load(spark, str(tmp_path / "a.csv"), multi_line=True)) == [
        ("Eve\n", "1"), ("x", "2"),
    ]


def test_header_only_and_missing_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    df = load(spark, str(tmp_path / "a.csv"))
    assert data_columns(df) == ["a", "b"] and df.count() == 0
    with pytest.raises(Exception, match="(?i)path"):
        load(spark, str(tmp_path / "none.csv"))


def test_json_parquet_and_tables(spark, tmp_path):
    source = spark.createDataFrame([(1, 2.5, None), (2, None, True)], "a int, b double, c boolean")
    expected = [("1", "2.5", ""), ("2", "", "true")]
    source.coalesce(1).write.json(str(tmp_path / "t.json"))
    source.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert table(load(spark, str(tmp_path / "t.json"))) == expected
    assert table(load(spark, str(tmp_path / "t.parquet"))) == expected
    source.createOrReplaceTempView("a_table")
    assert sorted(map(tuple, load(spark, "a_table", "table").collect())) == expected
    with pytest.raises(ValueError, match="unsupported"):
        load(spark, "x", "orc")


def test_text_table_keeps_hidden_columns(spark):
    df = to_text_table(spark.createDataFrame([(1, None)], "__tl_row int, a string"))
    assert df.collect()[0].asDict() == {"a": "", "__tl_row": 1}


def test_write_and_read_back(spark, tmp_path):
    rows = [(str(i), c) for i, c in enumerate(["", " padded ", 'q"uote', "a,b", "line\nbreak", None] * 20)]
    df = spark.createDataFrame(rows, "`a,b` string, c string").coalesce(1)
    df.write.parquet(str(tmp_path / "in.parquet"))
    source = load(spark, str(tmp_path / "in.parquet"))
    expected = [(a, c or "") for a, c in rows]
    for fmt in ("csv", "parquet"):
        out = str(tmp_path / f"out.{fmt}")
        write(source.repartition(7), out, fmt)
        write(source.repartition(7), out, fmt)  # replaces the first
        again = load(spark, out, fmt, multi_line=fmt == "csv")
        assert table(again) == expected
    with pytest.raises(ValueError, match="unsupported"):
        write(source, str(tmp_path / "x"), "xlsx")


def test_file_order_reaches_the_rules(spark, tmp_path):
    lines = [f"{i},{i % 3},{'' if i % 4 else i}" for i in range(400)]
    (tmp_path / "a.csv").write_text("id,key,v\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        source = load(spark, str(tmp_path / "a.csv"))
        rules = {
            "dedup": on(mode="byColumns", columns=["key"], keep="last"),
        }
        assert [r["id"] for r in preview(clean(source, rules)).collect()] == ["397", "398", "399"]
        filled = clean(source, {"missing": {"fillForwardBackward": on(columns=["v"], limit=2)}})
        got = [r["v"] for r in in_order(filled.ordered).collect()]
        assert got == [str(i - i % 4) if i % 4 < 3 else "" for i in range(400)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_from_file_to_preview_and_to_file(spark, tmp_path):
    (tmp_path / "people.csv").write_text("name,phone\n Bo ,+86 1\n,\n Bo ,+86 1\nAl,2\n")
    rules = {
        "format": {"text": on(trim=True), "phone": on(columns=["phone"])},
        "dedup": on(),
        "missing": {"removeEmptyRows": on()},
    }
    source = str(tmp_path / "people.csv")
    document = preview_file(spark, source, rules, rows=1)
    assert document["data"] == {
        "columns": ["name", "phone"], "rows": [{"name": "Bo", "phone": "1"}],
    }
    assert document["stats"]["rowsBefore"] == 4 and document["stats"]["rowsAfter"] == 2
    clock = lambda: datetime.datetime(2024, 1, 2, 3, 4, 5)
    out = export_file(spark, source, rules, str(tmp_path), clock=clock)
    assert out == f"{tmp_path}/people_cleaned_20240102_030405.csv"
    assert table(load(spark, out)) == [("Bo", "1"), ("Al", "2")]


def test_output_names():
    clock = lambda: datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert cleaned_name("a.b.csv", "csv", clock) == "a.b_cleaned_20240102_030405.csv"
    assert cleaned_name("", "parquet", clock) == "cleaned_data_cleaned_20240102_030405.parquet"
    assert cleaned_name(None, "csv", clock).startswith("cleaned_data_cleaned_")


def test_batch_shares_scans_but_not_rows(spark, tmp_path):
    files = {"a": "k,v\nx,1\nx,1\ny,\n", "b": "k,v\nx,1\nz,\n", "c": "k,v\nx, \nx, \n", "d": "k\n1\n"}
    paths = {}
    for name, body in files.items():
        paths[name] = str(tmp_path / f"{name}.csv")
        (tmp_path / f"{name}.csv").write_text(body)
    shared = {
        "dedup": on(),
        "missing": {"fillForwardBackward": on(columns=["v"], directions={"v": "both"})},
    }
    other = {"columns": {"removeEmptyCols": on()}}
    (tmp_path / "notes.txt").write_text("no table")
    found = sources_in(spark, str(tmp_path))
    assert [p.rpartition("/")[2] for p in found] == ["a.csv", "b.csv", "c.csv", "d.csv"]
    batches = clean_many(
        spark, {paths["a"]: shared, paths["c"]: other, paths["b"]: shared, paths["d"]: shared}
    )
    assert [tuple(p.rpartition("/")[2] for p in b.sources) for b in batches] == [
        ("a.csv", "b.csv"), ("c.csv",), ("d.csv",),
    ]
    got = sorted((r["source"][-5:], r["k"], r["v"]) for r in by_source(batches[0]).collect())
    assert got == [
        ("a.csv", "x", "1"), ("a.csv", "y", "1"), ("b.csv", "x", "1"), ("b.csv", "z", "1"),
    ]
    stats = sorted((r["__tl_scope"][-5:], r["rowsBefore"], r["rowsAfter"], r["removedDuplicates"])
                   for r in batches[0].result.stats.collect())
    assert stats == [("a.csv", 3, 2, 1), ("b.csv", 2, 2, 0)]
    assert batches[1].result.df.columns == ["k"]
    out = str(tmp_path / "out")
    write(batches[0].result.ordered, out, "csv", source_column="source")
    assert spark.read.csv(out, header=True).select("source").distinct().count() == 2


def test_generated_table_is_deterministic(spark):
    df = dirty_table(spark.range(3000))
    rows = df.count()
    assert 3000 + 5 <= rows <= 3000 + 60
    assert df.select("row_key").distinct().count() == rows
    assert df.columns == ["row_key", "ID", *VALUES]
    again = dirty_table(spark.range(0, 3000, 1, 7).repartition(3))
    assert df.exceptAll(again).count() == 0 and again.exceptAll(df).count() == 0
    empty = df.where("ID is null")
    assert empty.count() > 0 and empty.where("phone is not null").count() == 0
    names = [c for c in df.columns if c != "row_key"]
    assert df.where("ID is not null").groupBy([f"`{n}`" for n in names]).count().where("count > 1").count() > 0
    for name, values in VALUES.items():
        assert {r[0] for r in df.select(f"`{name}`").distinct().collect()} == set(values) | {None}
    assert dirty_table(spark.range(3000), seed=1).exceptAll(df).count() > 0


def _csv_folder(tmp_path, **files):
    for name, content in files.items():
        (tmp_path / f"{name}.csv").write_text(content, encoding="utf-8")
    return str(tmp_path)


def test_empty_first_file_does_not_hide_the_header(spark, tmp_path):
    path = _csv_folder(tmp_path, a="", b="id,v\n1,x\n", c="\n\nid,v\n2,y\n")
    df = load(spark, path, "csv")
    assert data_columns(df) == ["id", "v"]
    assert sorted(tuple(r) for r in df.select("id", "v").collect()) == [("1", "x"), ("2", "y")]


@pytest.mark.parametrize("other", ["v,id\nx,2\n", "id,v,w\n2,x,y\n", "id\n2\n"])
def test_unlike_headers_raise(spark, tmp_path, other):
    path = _csv_folder(tmp_path, a="id,v\n1,x\n", b=other)
    with pytest.raises(ValueError, match="different headers"):
        load(spark, path, "csv")


def test_byte_order_marks_are_no_difference(spark, tmp_path):
    path = _csv_folder(tmp_path, a="﻿id,v\n1,x\n", b="id,v\n2,y\n")
    assert load(spark, path, "csv").count() == 2


def test_line_break_in_a_cell(spark, tmp_path):
    path = _csv_folder(tmp_path, a='id,v\n1,"x\ny"\n2,"a ""b"""\n')
    with pytest.raises(ValueError, match="multi_line"):
        load(spark, path, "csv")
    rows = load(spark, path, "csv", multi_line=True).select("id", "v").collect()
    assert [tuple(r) for r in rows] == [("1", "x\ny"), ("2", 'a "b"')]


def test_path_with_a_blank_and_a_header_with_a_line_break(spark, tmp_path):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "c d.csv").write_text('id,"v\nw"\n1,x\n', encoding="utf-8")
    assert data_columns(load(spark, str(folder), "csv", multi_line=True)) == ["id", "v\nw"]


def test_parquet_files_with_different_columns(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(1, "x")], "id int, a string").write.parquet(path)
    spark.createDataFrame([(2, "y", "z")], "id int, a string, b string").write.mode("append").parquet(path)
    df = load(spark, path)
    assert data_columns(df) == ["id", "a", "b"]
    assert sorted(tuple(r) for r in df.select("id", "b").collect()) == [("1", ""), ("2", "z")]


def test_json_with_a_given_schema(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"id": 1, "a": "x"}\nnot json\n', encoding="utf-8")
    df = load(spark, str(tmp_path / "t.json"), schema="id string, a string")
    assert data_columns(df) == ["id", "a"]
    assert df.count() == 2


def test_reserved_names_raise(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = spark.createDataFrame([("1", "2")], "id string, `__tl_b` string")
    df.write.parquet(path)
    plain = spark.createDataFrame([("1", "2")], "id string, b string")
    with pytest.raises(ValueError, match="reserved"):
        load(spark, path)
    for table, columns in [
        (df, {}),
        (plain, {"rename": {"enabled": True, "mappings": [{"from": "b", "to": "__tl_b"}]}}),
        (plain, {"split": {"enabled": True, "column": "b", "separator": ",", "into": ["__tl_m"]}}),
        (plain, {"merge": {"enabled": True, "columns": ["b"], "separator": ",", "into": "__tl_m"}}),
    ]:
        with pytest.raises(ValueError, match="reserved"):
            clean(table, {"columns": columns})


def test_source_column_that_the_table_has(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("id,source\n1,x\n", encoding="utf-8")
    (batch,) = clean_many(spark, {path: {}})
    with pytest.raises(ValueError, match="source_column"):
        by_source(batch)
    with pytest.raises(ValueError, match="source_column"):
        write(batch.result.ordered, str(tmp_path / "out"), source_column="source")
    assert by_source(batch, "file").columns == ["file", "id", "source"]


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    paths = {}
    for i in range(12):
        path = tmp_path / f"part {i}.csv"
        path.write_text("a,b\n 1,2\n" if i % 2 else "b,a,c\n1,2,3\n", encoding="utf-8")
        paths[str(path)] = {"format": {"text": on(trim=True)}}
    (tmp_path / "none.csv").write_text("", encoding="utf-8")
    paths[str(tmp_path / "none.csv")] = {}
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    headers = csv_headers(spark, list(paths))
    assert len(tracker.getJobIdsForGroup(None)) - before <= 2
    assert [len(h) for h in headers.values()] == [3, 2] * 6 + [0]
    batches = clean_many(spark, paths)
    assert sorted(len(b.sources) for b in batches) == [1, 6, 6]
    rows = [r for b in batches for r in by_source(b).collect()]
    assert len(rows) == 12 and {r["a"] for r in rows} == {"1", "2"}


def test_cut_tables_can_be_released(spark):
    from tidyloom.session import cut, fit_shuffles, release_cuts

    release_cuts(spark)
    table = cut(spark.range(5))
    path = table.inputFiles()[0]
    assert release_cuts(spark) == 1 and release_cuts(spark) == 0
    assert not __import__("os").path.exists(path.removeprefix("file://"))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    assert fit_shuffles(spark, "/root/testdata/sf0.001", 1 << 10) > 50
    spark.conf.set("spark.sql.shuffle.partitions", width)


def test_null_in_the_order_raises(spark):
    df = spark.createDataFrame([(1, "a"), (None, "")], "k bigint, v string")
    rules = {"missing": {"fillForwardBackward": on(columns=["v"])}}
    with pytest.raises(ValueError, match="null"):
        clean(df, rules, order_by="k")


def test_account_of_records(spark, tmp_path):
    """Short, long and broken records, quoted commas and quotes, files of different widths."""
    files = {
        "a.csv": 'id,name\n\n1,"x, y"\n2\n3,"say ""a,b""",z\n,\n',
        "b.csv": '\n\nid,"na,me",q\r\n1,2,3\r\n"open\r\nclose",2,3\r\n',
        "c.csv": "",
        "d.csv": "only\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, newline="")
    got = {r["file"].rpartition("/")[2]: tuple(r)[1:] for r in record_account(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (2, 4, 1, 1, 0, 1), "b.csv": (3, 1, 0, 0, 2, 2), "d.csv": (1, 0, 0, 0, 0, 0)}
    assert record_account(spark, str(tmp_path / "c.csv")).count() == 0


def test_account_says_what_reading_pads_and_cuts(spark, tmp_path):
    lines = ["a,b,c"] + [",".join("x" * (1 + i % 4)) for i in range(200)]
    for k in range(3):
        (tmp_path / f"{k}.csv").write_text("\n".join(lines))
    found = record_account(spark, str(tmp_path)).collect()
    assert [(r["records"], r["short"], r["long"]) for r in found] == [(200, 100, 50)] * 3
    table = load(spark, str(tmp_path), "csv")
    assert table.count() == 600 and table.where("c = ''").count() == 300


def test_a_batch_of_csv_files_is_looked_at_by_one_pass(spark, tmp_path, monkeypatch):
    """Headers and soundness of all files at once; then each group is read, whatever the number of files."""
    for k in range(6):
        (tmp_path / f"{k}.csv").write_text("id,v\n" + "\n".join(f"{i},{'' if i % 2 else k}" for i in range(4)))
    (tmp_path / "other.csv").write_text("id,w\n1,2\n")
    rules = {"missing": {"fillForwardBackward": {"enabled": True, "columns": ["v", "w"]}}}
    passes, lines = [], readers.lines_of
    monkeypatch.setattr(readers, "lines_of", lambda spark, paths: passes.append(len(paths)) or lines(spark, paths))
    files = sources_in(spark, str(tmp_path))
    batches = clean_many(spark, dict.fromkeys(files, rules))
    assert passes == [7] and sorted(len(b.sources) for b in batches) == [1, 6]
    large = next(b for b in batches if len(b.sources) == 6)
    got = {(r["source"].rpartition("/")[2], r["id"]): r["v"] for r in by_source(large).collect()}
    assert got == {(f"{k}.csv", str(i)): str(k) for k in range(6) for i in range(4)}
    (tmp_path / "2.csv").write_text('id,v\n"1\n2",3\n')
    with pytest.raises(ValueError, match="2.csv"):
        clean_many(spark, dict.fromkeys(files, rules))


def test_export_with_statistics(spark, tmp_path):
    (tmp_path / "t.csv").write_text("k,v\n1, a \n2,\n1, a \n3,  \n,\n")
    rules = {
        "format": {"text": {"enabled": True, "trim": True}},
        "dedup": {"enabled": True, "mode": "wholeRow"},
        "missing": {"removeEmptyRows": {"enabled": True, "condition": "all"}},
    }
    target, stats = export_with_stats(spark, str(tmp_path / "t.csv"), rules, str(tmp_path / "out"))
    assert [tuple(r) for r in drop_hidden(in_order(load(spark, target, "csv"))).collect()] == [("1", "a"), ("2", ""), ("3", "")]
    counts = {c: stats[c] for c in ("rowsBefore", "rowsAfter", "removedDuplicates", "removedEmptyRows", "cleanedTextCells")}
    assert counts == {"rowsBefore": 5, "rowsAfter": 3, "removedDuplicates": 1, "removedEmptyRows": 1, "cleanedTextCells": 3}
