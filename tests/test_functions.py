"""Cell functions against tables of examples and against plain Python."""

import datetime
import math
import random
import re
import sys
from decimal import Decimal

import pytest

from tidyloom.functions.dates import OUTPUT_FORMATS, clean_date
from tidyloom.functions.money import clean_currency
from tidyloom.functions.phone import clean_phone
from tidyloom.functions.text import clean_email, clean_text
from tidyloom.functions.whitespace import WHITE_SPACE, is_blank, trim_ws


def test_white_space_is_the_unicode_property():
    # Python also counts four separators (U+001C to U+001F) that Unicode does not.
    every = {chr(p) for p in range(0x110000) if chr(p).isspace()}
    assert set(WHITE_SPACE) == every - {chr(p) for p in range(0x1C, 0x20)}


def test_trim_and_blank(column):
    cells = ["　a b\t", WHITE_SPACE, "", None, "\n x", "​"]
    assert column(cells, trim_ws) == ["a b", "", "", None, "x", "​"]
    assert column(cells, is_blank) == [False, True, True, True, False, False]
    untrimmed = column(cells, lambda c: is_blank(c, trim=False))
    assert untrimmed == [False, False, True, True, False, False]


def test_text(column):
    cells = [" a \t b　", "", None]
    assert column(cells, lambda c: clean_text(c, trim=True)) == ["a \t b", "", None]
    assert column(cells, lambda c: clean_text(c, collapse_spaces=True)) == [" a b ", "", None]
    both = column(cells, lambda c: clean_text(c, trim=True, collapse_spaces=True))
    assert both == ["a b", "", None]
    none = column(cells, lambda c: clean_text(c, True, True, remove_all_whitespace=True))
    assert none == ["ab", "", None]


def test_email(column):
    cells = ["  ALICE@Example.com ", "invalid-email", None]
    assert column(cells, clean_email) == ["alice@example.com", "invalid-email", None]
    assert column(cells, lambda c: clean_email(c, trim=False))[0] == "  alice@example.com "
    assert column(cells, lambda c: clean_email(c, lowercase=False))[0] == "ALICE@Example.com"


PHONES = {
    "+86 138-0000-1111": "13800001111",
    "(+86) 134-3333-6666": "13433336666",
    "+8613800001111": None,
    "+1 (555) 123-4567": "1234567",
    "无效号码": None,
    "010-88889999": "01088889999",
    " 135 2222 5555 ": "13522225555",
    "": None,
    "a123": "123",
}


def test_phone_examples(column):
    assert column(list(PHONES), lambda c: clean_phone(c, "86")) == list(PHONES.values())
    assert column([None], clean_phone) == [None]
    e164 = column(["86 86 138", "138", "x"], lambda c: clean_phone(c, "+86", "E164"))
    assert e164 == ["+86138", "+86138", None]
    assert column(["138"], lambda c: clean_phone(c, "", "E164")) == ["+138"]


def test_phone_equals_repeated_stripping(column):
    """One deletion pattern against deleting prefixes until nothing changes."""
    rng = random.Random(7)
    pieces = ["+", "(", ")", " ", "　", "8", "6", "86", "+86", "(86)", "(+86)", "1", "-", "x", "\t"]
    cells = ["".join(rng.choices(pieces, k=rng.randint(0, 9))) for _ in range(4000)]
    s = f"[{re.escape(WHITE_SPACE)}]*"
    code = re.compile(rf"^{s}(?:\+{s}[0-9]+|\+{s}\({s}[0-9]+{s}\)|\({s}\+?[0-9]+{s}\)){s}")

    def strip(cell, pattern):
        while (shorter := pattern.sub("", cell)) != cell:
            cell = shorter
        return cell

    for country in ("", "86", "8"):
        def expected(cell):
            cell = strip(cell, code)
            if country:
                cell = strip(cell, re.compile(f"^{s}{country}{s}"))
            return re.sub("[^0-9]", "", cell) or None

        got = column(cells, lambda c, cc=country: clean_phone(c, cc))
        assert got == [expected(c) for c in cells]


DATES = {
    "2023-01-01": "2023-01-01 00:00:00",
    "2023/2/2": "2023-02-02 00:00:00",
    "2023.03.03": "2023-03-03 00:00:00",
    "2023年10月11日": "2023-10-11 00:00:00",
    "2023-05-01 12:30:00": "2023-05-01 12:30:00",
    "2023 - 11- 30 20 ：20:10": "2023-11-30 20:20:10",
    "2023年09月02日 16 时 49 分": "2023-09-02 16:49:00",
    "2023年1月2日3时4分5秒": "2023-01-02 03:04:05",
    "20231225": "2023-12-25 00:00:00",
    "02/03/2023": "2023-03-02 00:00:00",
    "29.2.2024": "2024-02-29 00:00:00",
    "2023-01-01T10:00:00+08:00": "2023-01-01 10:00:00",
    "2023-01-01 10:00:00.123 -0530": "2023-01-01 10:00:00",
    "2023-01-01T10:00Z": "2023-01-01 10:00:00",
    "　2023-01-01\t": "2023-01-01 00:00:00",
    "2023-01-01 :": "2023-01-01 00:00:00",
    "0000-01-01": "0000-01-01 00:00:00",
    "9999-12-31 23:59:59": "9999-12-31 23:59:59",
    "2023-02-30": None,
    "2023-02-29": None,
    "2023-13-01": None,
    "20231301": None,
    "32/01/2023": None,
    "2023-01-01 23:59:60": None,
    "2023-01-01 24:00": None,
    "2023-01-01T 10:00": None,
    "2023,01,02": None,
    "soon": None,
}


@pytest.mark.parametrize("on_invalid", ["keep", "empty"])
def test_date_examples(column, on_invalid):
    got = column(list(DATES), lambda c: clean_date(c, "YYYY-MM-DD HH:mm:ss", on_invalid))
    other = {"keep": lambda raw: raw, "empty": lambda raw: ""}[on_invalid]
    assert got == [v or other(k) for k, v in DATES.items()]
    assert column(["", " ", None], lambda c: clean_date(c, "ISO", on_invalid)) == ["", " ", None]


def test_date_formats(column):
    made = {
        "YYYY-MM-DD": "%Y-%m-%d",
        "YYYY/MM/DD": "%Y/%m/%d",
        "YYYY-MM-DD HH:mm": "%Y-%m-%d %H:%M",
        "YYYY-MM-DD HH:mm:ss": "%Y-%m-%d %H:%M:%S",
        "YYYY/MM/DD HH:mm": "%Y/%m/%d %H:%M",
        "YYYY/MM/DD HH:mm:ss": "%Y/%m/%d %H:%M:%S",
        "YYYY年MM月DD日": "%Y年%m月%d日",
        "YYYY年MM月DD日 HH时mm分": "%Y年%m月%d日 %H时%M分",
        "YYYY年MM月DD日 HH时mm分ss秒": "%Y年%m月%d日 %H时%M分%S秒",
        "ISO": "%Y-%m-%dT%H:%M:%S.000Z",
    }
    assert set(made) == set(OUTPUT_FORMATS)
    when = datetime.datetime(2023, 4, 5, 6, 7, 8)
    for name, pattern in made.items():
        assert column([str(when)], lambda c, n=name: clean_date(c, n)) == [when.strftime(pattern)]
    assert column([str(when)], lambda c: clean_date(c, "no such format")) == ["2023-04-05"]


def test_date_does_not_depend_on_the_session_zone(spark, column):
    # 02:30 did not exist on that day in New York.
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        cells = ["2023-03-12 02:30:00"]
        assert column(cells, lambda c: clean_date(c, "YYYY-MM-DD HH:mm:ss")) == cells
        utc = lambda c: clean_date(c, "YYYY-MM-DD HH:mm", timezone="utc")
        assert column(["2023-01-01 10:00", "2023-01-01 10:00 Z"], utc) == [
            "2023-01-01 15:00",
            "2023-01-01 10:00",
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_date_in_utc(column):
    utc = lambda c: clean_date(c, "YYYY-MM-DD HH:mm", timezone="utc")
    cells = {
        "2023-01-01T10:00+08:00": "2023-01-01 02:00",
        "2023-01-01 22:00:00 -0530": "2023-01-02 03:30",
        "2023-01-01 10:00 +99:00": "2023-01-01 10:00",
        "2023-01-01": "2023-01-01 00:00",
        "never": "never",
    }
    assert column(list(cells), utc) == list(cells.values())


def test_dates_equal_a_plain_parser(column):
    rng = random.Random(11)

    def number(width):
        return str(rng.randint(0, 10**width - 1)).zfill(rng.choice([1, width]))

    def cell():
        sep = lambda: rng.choice(["-", "/", ".", " - ", "- "])
        year = rng.choice(["2023", "2024", "0001", "99"])
        day = f"{year}{sep()}{rng.randint(0, 13)}{sep()}{rng.randint(0, 32)}"
        if rng.random() < 0.2:
            day = f"{rng.randint(0, 32)}{sep()}{rng.randint(0, 13)}{sep()}{year}"
        if rng.random() < 0.5:
            return day
        joint = rng.choice([" ", "T", "  ", " T"])
        clock = ":".join([number(2), number(2), number(2)][: rng.randint(1, 3)])
        return day + joint + clock + rng.choice(["", "", ".5", "Z", " +08:00", "+0800", "x", ":"])

    def parse(raw):
        v = re.sub(r"\s*-\s*", "-", re.sub(r"\s*:\s*", ":", raw)).strip()
        v = re.sub(r"\s+", " ", v).removesuffix(":")
        shapes = (
            r"(?P<Y>\d{4})[-/.](?P<M>\d{1,2})[-/.](?P<D>\d{1,2})[ T](?P<h>\d{1,2}):(?P<m>\d{1,2})"
            r"(:(?P<s>\d{1,2}))?(\.\d+)? ?(Z|[+-]\d\d:?\d\d)?",
            r"(?P<Y>\d{4})[-/.](?P<M>\d{1,2})[-/.](?P<D>\d{1,2})",
            r"(?P<D>\d{1,2})[-/.](?P<M>\d{1,2})[-/.](?P<Y>\d{4})",
        )
        for shape in shapes:
            if match := re.fullmatch(shape, v):
                parts = {k: int(x or 0) for k, x in match.groupdict().items()}
                try:
                    when = datetime.datetime(
                        parts["Y"], parts["M"], parts["D"],
                        parts.get("h", 0), parts.get("m", 0), parts.get("s", 0),
                    )
                except ValueError:
                    continue
                return when.isoformat(" ")
        return raw

    cells = [cell() for _ in range(3000)]
    got = column(cells, lambda c: clean_date(c, "YYYY-MM-DD HH:mm:ss"))
    assert got == [parse(c) for c in cells]
    assert 500 < sum(g != c for g, c in zip(got, cells, strict=True))


MONEY = {
    "$1,234.56": "¥1,234.56",
    "¥ 2345.6": "¥2,345.60",
    "€ 3456.789": "¥3,456.79",
    "-5678.9": "¥-5,678.90",
    "RMB 7890.123": "¥7,890.12",
    "0.125": "¥0.12",
    "0.375": "¥0.38",
    "2.675": "¥2.67",
    "1\t234": "¥1,234.00",
    "+5": "¥5.00",
    ".5": "¥0.50",
    "-0.001": "¥-0.00",
    "1 000 000": "¥1,000,000.00",
    "abc": "abc",
    "": "",
}


def test_money_examples(column):
    assert column(list(MONEY), clean_currency) == list(MONEY.values())
    plain = lambda c: clean_currency(c, "$", 0, thousands_separator=False)
    assert column(["1234.5", "-1235.5", None], plain) == ["$1234", "$-1236", None]


def test_money_equals_exact_rounding(column):
    rng = random.Random(3)
    numbers = [round(rng.uniform(-1e6, 1e6), rng.randint(0, 5)) for _ in range(2000)]
    numbers += [rng.randint(-10**6, 10**6) / 8 for _ in range(500)]  # ties
    numbers += [rng.uniform(-1, 1) * 10 ** rng.randint(6, 15) for _ in range(2000)]
    for places in (0, 1, 2, 3, 5):
        got = column([str(n) for n in numbers], lambda c, p=places: clean_currency(c, "", p))
        assert got == [f"{n:,.{places}f}" for n in numbers]


def test_money_keeps_the_digits_of_large_numbers(column):
    rng = random.Random(4)
    numbers = [rng.uniform(-1, 1) * 10 ** rng.randint(15, 37) for _ in range(2000)]
    numbers += [s * 2.0**k for k in range(33, 126) for s in (1, -1)]
    numbers += [61102227457330143937.125, 2.0**62 - 512, 2.0**62 + 1024]
    for places in (0, 2):
        got = column([repr(n) if "e" not in repr(n) else f"{n:.0f}" for n in numbers], lambda c, p=places: clean_currency(c, "", p))
        assert got == [f"{n:,.{places}f}" for n in numbers]


def spelled(n):
    """A decimal spelling of a double without an exponent."""
    text = repr(n)
    return text if "e" not in text else f"{Decimal(text):f}"


def test_money_of_any_size(column):
    rng = random.Random(5)
    numbers = [rng.choice([1, -1]) * rng.uniform(1, 10) * 10.0 ** rng.randint(30, 307) for _ in range(400)]
    numbers += [s * 2.0**k for k in range(120, 1024, 7) for s in (1, -1)]
    numbers += [2.0**125, -(2.0**125), sys.float_info.max, math.nextafter(2.0**125, 0), math.nextafter(2.0**125, math.inf)]
    for places in (0, 2, 7):
        got = column([spelled(n) for n in numbers], lambda c, p=places: clean_currency(c, "", p))
        assert got == [f"{n:,.{places}f}" for n in numbers]
    assert column(["1" + "0" * 400], lambda c: clean_currency(c, "", 0)) == ["∞"]
    plain = column([spelled(n) for n in numbers], lambda c: clean_currency(c, "$", 0, thousands_separator=False))
    assert plain == [f"${n:.0f}" for n in numbers]


@pytest.mark.parametrize("places", [6, 9, 12, 18, 20])
def test_money_with_many_places(column, places):
    """Every double is rounded from its exact value, ties to even; places beyond the eighteenth are zeros."""
    rng = random.Random(places)
    numbers = [rng.choice([1, -1]) * rng.uniform(0, 10) * 10.0 ** rng.randint(-25, 18) for _ in range(800)]
    numbers += [s * n / 2**k for k in (1, 7, 13, 19, 40) for n in (1, 3, 2**33 + 1) for s in (1, -1)]  # ties among them
    numbers += [0.0, 5e-324, 2.5e-19, 5e-19, 1.5e-18, 2.0**34 - 2.0**-18, 2.0**34]
    exact = min(places, 18)
    got = column([spelled(n) for n in numbers], lambda c: clean_currency(c, "", places))
    assert got == [f"{n:,.{exact}f}" + "0" * (places - exact) for n in numbers]


def test_long_cells_take_linear_time(column):
    """Cells that make a backtracking pattern quadratic, or exhaust its stack."""
    n = 200_000
    gap = " " * n
    long = [f"2023-01-01{gap}x", f"2023-01-01 10:00{gap}x", f"{gap}x", f"a{gap}:{gap}b", "日" * n]
    assert column(long, lambda c: clean_date(c)) == long
    spaced = [f"2023-01-01{gap}10:00{gap}", f"2023{gap}-{gap}1-1"]
    assert column(spaced, lambda c: clean_date(c)) == ["2023-01-01"] * 2
    codes = ["(1)" * n + "5", "+1 " * n + "5", "86 " * n + "5", f"+{gap}5", f"({gap}5"]
    assert column(codes, lambda c: clean_phone(c, "86")) == ["5", "5", "5", None, "5"]
    assert column([f"RMB{gap}1{gap}2,", "1" * 300 + "x"], lambda c: clean_currency(c))[0] == "¥12.00"
    assert column([f"{gap}a{gap}b{gap}"], lambda c: clean_text(c, True, True)) == ["a b"]
    assert column([f"{gap}a{gap}b{gap}"], lambda c: clean_text(c, True)) == [f"a{gap}b"]
