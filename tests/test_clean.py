import json
import random

import pytest

from tidyloom.plans.clean import clean
from tidyloom.plans.preview import clip, preview, preview_document
from tidyloom.plans.stats import COUNTERS, nothing_matched, shrink_rate
from tidyloom.sources.generator import dirty_table
from tidyloom.sources.readers import load


def on(**rule):
    return {"enabled": True, **rule}


# Fixed values, the hand-made edge table: padded, blank and repeated cells, all date shapes, and
# three empty rows (first, in the middle, last).
COLUMNS = [
    "id", "user_name", "age", "phone", "email", "join_date", "salary", "address_code",
    "first_name", "last_name", "drop_me", "empty_col", "notes",
]
EMPTY = (None,) * len(COLUMNS)
CHARLIE = ("3", "Charlie", None, "137 0000 3333", "CHARLIE@EXAMPLE.COM", "2023.03.03",
           "€ 3456.789", "GZ-300000", "C", "harlie", "x", None, None)
EDGE = [
    EMPTY,
    ("1", "Alice", "25", "+86 138-0000-1111", " ALICE@Example.com ", "2023-01-01",
     "$1,234.56", "BJ-100000", "A", "lice", "x", None, "good"),
    ("2", "Bob", "30", "13911112222", "bob@example.com", "2023/02/02",
     "¥ 2345.6", "SH-200000", "B", "ob", "x", None, "bad"),
    CHARLIE,
    CHARLIE,
    EMPTY,
    (" 4 ", "David", "40", "010-88889999", "david@example.com", "2023年10月11日",
     "4567", "SZ-400000", "D", "avid", "x", None, None),
    ("5", "Eve", "22", "13611114444", "EVE@example.com", "2023-05-01 12:30:00",
     "-5678.9", "HZ-500000", "E", "ve", "x", None, None),
    ("6", "Frank", "290", " 135 2222 5555 ", " frank@example.com", "2023 - 11- 30 20 ：20:10",
     "6789.01", "CD-600000", "F", "rank", "x", None, "ok"),
    ("", "Ghost", None, None, "ghost@example", "2023年09月02日 16 时 49 分",
     None, "", "", "", "x", None, " "),
    ("7", "Grace", "28", "(+86) 134-3333-6666", "Grace@example.com", "20231225",
     "RMB 7890.123", "NJ-700000", "G", "race", "x", None, None),
    EMPTY,
]
RULES = {
    "columns": {
        "drop": on(columns=["drop_me"]),
        "split": on(column="address_code", separator="-", into=["area", "zip"], keepOriginal=False),
        "merge": on(columns=["first_name", "last_name"], separator="", into="full", dropSources=True),
        "removeEmptyCols": on(condition="all"),
        "rename": on(mappings=[{"from": "full", "to": "name"}, {"from": "zip", "to": "postcode"}]),
    },
    "format": {
        "text": on(trim=True),
        "email": on(columns=["email"]),
        "phone": on(columns=["phone"], countryCode="86", output="E164"),
        "date": on(columns=["join_date"], outputFormat="YYYY-MM-DD HH:mm"),
        "currency": on(columns=["salary"]),
    },
    "dedup": on(mode="wholeRow", keep="first"),
    "missing": {
        "removeEmptyRows": on(condition="all"),
        "fillDefault": on(columns=["age"], values={"age": "0"}),
        "fillForwardBackward": on(columns=["notes"], directions={"notes": "forward"}, limit=1),
    },
}


@pytest.fixture
def edge(text):
    return text(COLUMNS, EDGE)


def cleaned(table, rules, **options):
    df = table.withColumnRenamed("k", "__tl_k")
    return clean(df, rules, order_by="__tl_k", **options)


def test_every_rule_on_the_edge_table(edge):
    result = cleaned(edge, RULES)
    assert result.df.columns == [
        "id", "user_name", "age", "phone", "email", "join_date", "salary", "notes",
        "area", "postcode", "name",
    ]
    # Removing duplicates leaves one of the empty rows; its age becomes 0, so it stays.
    assert [tuple(r) for r in preview(result).collect()] == [
        ("", "", "0", None, "", "", "", "", "", "", ""),
        ("1", "Alice", "25", "+8613800001111", "alice@example.com", "2023-01-01 00:00",
         "¥1,234.56", "good", "BJ", "100000", "Alice"),
        ("2", "Bob", "30", "+8613911112222", "bob@example.com", "2023-02-02 00:00",
         "¥2,345.60", "bad", "SH", "200000", "Bob"),
        ("3", "Charlie", "0", "+8613700003333", "charlie@example.com", "2023-03-03 00:00",
         "¥3,456.79", "bad", "GZ", "300000", "Charlie"),
        ("4", "David", "40", "+8601088889999", "david@example.com", "2023-10-11 00:00",
         "¥4,567.00", "", "SZ", "400000", "David"),
        ("5", "Eve", "22", "+8613611114444", "eve@example.com", "2023-05-01 12:30",
         "¥-5,678.90", "", "HZ", "500000", "Eve"),
        ("6", "Frank", "290", "+8613522225555", "frank@example.com", "2023-11-30 20:20",
         "¥6,789.01", "ok", "CD", "600000", "Frank"),
        ("", "Ghost", "0", None, "ghost@example", "2023-09-02 16:49",
         "", "ok", "", "", ""),
        ("7", "Grace", "28", "+8613433336666", "grace@example.com", "2023-12-25 00:00",
         "¥7,890.12", "", "NJ", "700000", "Grace"),
    ]


def test_statistics_on_the_edge_table(edge):
    stats = cleaned(edge, RULES).stats
    assert stats.columns == list(COUNTERS)
    assert {f.dataType.simpleString() for f in stats.schema} == {"bigint"}
    assert stats.first().asDict() == {
        "rowsBefore": 12,
        "rowsAfter": 9,
        "colsBefore": 13,
        "colsAfter": 11,
        "removedEmptyRows": 0,
        "removedEmptyCols": 1,
        "filledDefaultCells": 3,
        "filledForwardBackwardCells": 2,
        "removedDuplicates": 3,
        "formattedDateCells": 8,
        "formattedCurrencyCells": 7,
        "normalizedPhoneCells": 7,
        "normalizedEmailCells": 5,
        # id, phone, two e-mails and a note; the join date is not padded.
        "cleanedTextCells": 5,
        "renamedColumns": 2,
        "droppedColumns": 3,
        "splitColumnsAdded": 2,
        "mergedColumnsAdded": 1,
    }


def test_empty_document_only_makes_text(edge):
    result = clean(edge.drop("k"), {})
    assert result.df.columns == COLUMNS
    assert sorted(map(tuple, result.df.collect())) == sorted(
        tuple(c or "" for c in row) for row in EDGE
    )
    stats = result.stats.select("*", nothing_matched().alias("none"), shrink_rate().alias("rate"))
    row = stats.first()
    assert row["none"] and row["rate"] == "0.0" and row["rowsAfter"] == 12


def test_empty_table(edge):
    result = cleaned(edge.where("k < 0"), RULES)
    assert result.df.columns == [] and result.df.count() == 0
    row = result.stats.select("*", shrink_rate().alias("rate")).first()
    assert row["rowsBefore"] == 0 and row["rowsAfter"] == 0 and row["rate"] == "0.0"
    assert row["removedEmptyCols"] == 12


def test_dedup_stage_last(edge):
    """Empty rows go first, so they are no duplicates; blank columns go before the key."""
    rules = {**RULES, "missing": {"removeEmptyRows": on()}}
    native, last = cleaned(edge, rules), cleaned(edge, rules, dedup_stage="last")
    assert sorted(map(tuple, native.df.collect()), key=repr) == sorted(
        map(tuple, last.df.collect()), key=repr
    )
    a, b = native.stats.first(), last.stats.first()
    assert (a["removedDuplicates"], a["removedEmptyRows"], a["rowsAfter"]) == (3, 1, 8)
    assert (b["removedDuplicates"], b["removedEmptyRows"], b["rowsAfter"]) == (1, 3, 8)
    for bad in ({"dedup_stage": "first"}, {"cuts": "often"}):
        with pytest.raises(ValueError, match="unknown"):
            clean(edge, {}, **bad)


def test_rules_see_original_names_and_are_applied_in_order(text):
    table = text(["a", "b"], [(" +86 1 ", "x"), ("+86 1", "x")])
    rules = {
        "columns": {"rename": on(mappings=[{"from": "a", "to": "phone"}])},
        "format": {"phone": on(columns=["a", "phone"]), "text": on(trim=True)},
        "dedup": on(),
    }
    # Equal after trimming, so duplicates; digits afterwards; renamed at the end.
    assert [tuple(r) for r in cleaned(table, rules).df.collect()] == [("1", "x")]


def test_order_dependent_rules_need_an_order(edge):
    with pytest.raises(ValueError, match="order_by"):
        clean(edge, {"dedup": on()})
    with pytest.raises(ValueError, match="order_by"):
        clean(edge, {"missing": {"fillForwardBackward": on(columns=["notes"])}})
    assert clean(edge, {"dedup": on(keep="none")}).df.count() == 12


def test_preview_document(edge):
    document = preview_document(cleaned(edge, RULES), rows=2)
    assert json.loads(json.dumps(document)) == document
    assert document["data"]["columns"][0] == "id" and len(document["data"]["rows"]) == 2
    assert document["data"]["rows"][0]["phone"] == ""
    assert document["stats"]["rowsAfter"] == 9
    page = clip(preview(cleaned(edge, RULES)), rows=3, columns=2)
    assert page.columns == ["id", "user_name"] and page.count() == 3


@pytest.mark.parametrize("cuts", ["needed", "always", "never"])
def test_scope_keeps_tables_apart(spark, cuts):
    rows = [("s1", 0, "x", "n"), ("s2", 1, "x", ""), ("s1", 2, "x", "n"), ("s2", 3, "y", "m")]
    df = spark.createDataFrame(rows, "s string, k long, a string, b string")
    rules = {
        "columns": {"drop": on(columns=["k"])},
        "dedup": on(),
        "missing": {"fillForwardBackward": on(columns=["b"])},
    }
    result = clean(df, rules, order_by="k", scope="s", cuts=cuts)
    assert result.df.columns == ["a", "b"]
    # The gap in s2 is not filled from s1.
    assert [tuple(r) for r in preview(result).collect()] == [("x", "n"), ("x", ""), ("y", "m")]
    stats = {r["__tl_scope"]: r for r in result.stats.collect()}
    assert (stats["s1"]["rowsBefore"], stats["s1"]["removedDuplicates"]) == (2, 1)
    assert (stats["s2"]["rowsBefore"], stats["s2"]["removedDuplicates"]) == (2, 0)


def test_statistics_agree_with_the_rows(spark):
    """Random rule sets on a generated table: the counters add up."""
    rng = random.Random(4)
    table = dirty_table(spark.range(800))
    for _ in range(4):
        pick = lambda: rng.random() < 0.6
        rules = {
            "format": {
                "text": {"enabled": pick(), "trim": True},
                "phone": {"enabled": pick(), "columns": ["phone"]},
                "date": {"enabled": pick(), "columns": ["join_date"], "onInvalid": "empty"},
            },
            "dedup": {
                "enabled": pick(),
                "mode": rng.choice(["wholeRow", "byColumns"]),
                "columns": ["user_name", "status"],
                "keep": rng.choice(["first", "last", "none"]),
            },
            "missing": {
                "removeEmptyRows": {"enabled": pick(), "condition": rng.choice(["all", "any"])},
                "fillForwardBackward": {"enabled": pick(), "columns": ["city"], "limit": 1},
            },
            "columns": {"drop": on(columns=["row_key", "extra_col1", "extra_col2"])},
        }
        stage, cuts = rng.choice(["native", "last"]), rng.choice(["needed", "always", "never"])
        result = clean(table, rules, order_by="row_key", dedup_stage=stage, cuts=cuts)
        s = result.stats.first()
        assert s["rowsBefore"] == table.count()
        assert s["rowsAfter"] == result.df.count()
        assert s["colsAfter"] == len(result.df.columns) == 12
        assert s["rowsBefore"] - s["removedEmptyRows"] - s["removedDuplicates"] == s["rowsAfter"]


def test_formatting_twice_changes_nothing(spark):
    rules = {
        "format": {
            "text": on(trim=True, collapseSpaces=True),
            "email": on(columns=["email"]),
            "date": on(columns=["join_date"]),
        }
    }
    once = clean(dirty_table(spark.range(300)), rules)
    twice = clean(once.df, rules)
    assert twice.stats.select(nothing_matched()).first()[0]


def test_a_fill_over_text_files_reads_one_scan(spark, tmp_path):
    """Another scan may cut the file into other splits, and so into other chunks."""
    body = "".join(f"{i},{'' if i % 3 else i}\n" for i in range(300))
    (tmp_path / "a.csv").write_text("k,v\n" + body)
    rules = {"missing": {"fillForwardBackward": on(columns=["v"])}}
    source = load(spark, str(tmp_path / "a.csv"))
    filled = clean(source, rules)
    assert not any("a.csv" in f for f in filled.df.inputFiles())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        assert [r["v"] for r in preview(filled, 300).collect()] == [
            str(i - i % 3) for i in range(300)
        ]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
