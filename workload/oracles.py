"""The checks: each query again, in SQL over the same tables."""

from __future__ import annotations

from workload.fixtures import CUSTOMER, DOCUMENTS, EVENTS, BOUND, LARGE, LINEITEM, ORDERS, View


# The code points with the Unicode property White_Space.
_WS_BODY = (
    r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS = f"[{_WS_BODY}]"


def _trim(x: str) -> str:
    return f"trim({x}, '{WHITE_SPACE}')"


def _squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def _blank(x: str) -> str:
    return f"(coalesce({_trim(x)}, '') = '')"


def _over(view: View, changed: dict[str, str], only: list[str] | None = None, tail: str = "") -> str:
    """The view with some cells replaced."""
    names = only or list(view.columns)
    cells = ", ".join(f'{changed.get(c, _q(c))} AS {_q(c)}' for c in names)
    return f"WITH t AS ({view.sql}) SELECT {cells} FROM t {tail}"


def _q(name: str) -> str:
    return f'"{name}"'


def _phone(x: str, code: str = "", e164: bool = False) -> str:
    any_code = rf"\+{WS}*[0-9]+|\+{WS}*\({WS}*[0-9]+{WS}*\)|\({WS}*\+?[0-9]+{WS}*\)"
    for prefix in (any_code, code):
        if prefix:
            x = f"regexp_replace({x}, '^({WS}*({prefix}){WS}*)+', '')"
    digits = f"nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '')"
    return f"('+{code}' || {digits})" if e164 else digits


# A date by its form: every run of digits is a `#`, white space is gone. What the runs mean
# follows from their number and lengths; the calendar decides the rest.
_FORM = f"regexp_replace(regexp_replace(odate, '[0-9]+', '#', 'g'), '{WS}+', '', 'g')"
_KNOWN_FORM = (
    "^(#|#[-/.]#[-/.]#|(#[-/.]#[-/.]#T?|#年#月#日)?(#[:：]#([:：]#)?|#时#分(#秒)?)?([.]#)?(Z|[+-]#:?#?)?|#年#月#日)$"
)


def _dated(source: str) -> str:
    """Table expressions up to ``p``: the rows of ``source`` with ``moment``, their ``odate`` as a timestamp."""
    return f"""
r AS (SELECT *, regexp_extract_all(odate, '[0-9]+') AS g, {_FORM} AS form FROM {source}),
y AS (SELECT *, CASE WHEN NOT regexp_matches(form, '{_KNOWN_FORM}') THEN NULL
                     WHEN len(g) = 1 AND length(g[1]) = 8
                       THEN [substr(g[1], 1, 4), substr(g[1], 5, 2), substr(g[1], 7, 2)]
                     WHEN len(g) >= 3 AND length(g[1]) = 4 THEN [g[1], g[2], g[3]]
                     WHEN len(g) = 3 AND length(g[3]) = 4 THEN [g[3], g[2], g[1]] END AS day
      FROM r),
p AS (SELECT * EXCLUDE (g, form, day), g[-2] AS hours, form LIKE '%+%' AS zoned, try_strptime(
        array_to_string(day, '-') || ' ' || coalesce(g[4], '0') || ':' || coalesce(g[5], '0') || ':'
          || CASE WHEN form LIKE '%#:#:#%' OR form LIKE '%：#:#%' OR form LIKE '%秒%' THEN g[6] ELSE '0' END,
        '%Y-%m-%d %H:%M:%S') AS moment FROM y)"""


def _date(fmt: str, on_invalid: str = "keep", utc: bool = False) -> str:
    shift = "CASE WHEN zoned THEN CAST(hours AS INTEGER) ELSE 0 END" if utc else "0"
    other = "odate" if on_invalid == "keep" else f"CASE WHEN {_blank('odate')} THEN odate ELSE '' END"
    return (
        f"WITH t AS ({ORDERS.sql}), {_dated('t')}"
        f" SELECT id, coalesce(strftime(moment - to_hours({shift}), '{fmt}'), {other}) AS odate FROM p"
    )


def _money(x: str, places: int = 2, grouped: bool = True, symbol: str = "¥") -> str:
    number = (
        f"try_cast(nullif(regexp_extract(regexp_replace({x}, '[,{_WS_BODY}]', '', 'g'),"
        r" '[-+]?[0-9]*\.?[0-9]+'), '') AS DOUBLE)"
    )
    comma = "," if grouped else ""
    return (
        f"CASE WHEN {number} IS NULL THEN {x}"
        f" ELSE '{symbol}' || format('{{:{comma}.{places}f}}', {number}) END"
    )


def _fill(view: View, sides: dict[str, str], limit: int | None = None, source: str = "") -> str:
    """Global windows: nearest value and its distance on both sides."""
    base = source or view.sql
    near, out = [], []
    for c, side in sides.items():
        value = f"CASE WHEN NOT {_blank(c)} THEN {c} END"
        at = f"CASE WHEN NOT {_blank(c)} THEN rn END"
        for tag, fn, frame in (
            ("p", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"),
            ("n", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"),
        ):
            over = f"OVER (ORDER BY rn ROWS BETWEEN {frame})"
            near.append(f"{fn}({value} IGNORE NULLS) {over} AS {c}_{tag}")
            near.append(f"{fn}({at} IGNORE NULLS) {over} AS {c}_{tag}_at")
        far = "true" if limit is None else "abs(rn - {}) <= " + str(limit)
        options = {
            tag: f"CASE WHEN {far.format(f'{c}_{tag}_at')} THEN {c}_{tag} END" for tag in "pn"
        }
        use = {"forward": "p", "backward": "n", "both": "pn"}[side]
        found = ", ".join(options[tag] for tag in use)
        out.append(f"CASE WHEN {_blank(c)} THEN coalesce({found}, {c}) ELSE {c} END AS {c}")
    return (
        f"WITH t AS (SELECT *, row_number() OVER (ORDER BY rk) AS rn FROM ({base})),"
        f" w AS (SELECT *, {', '.join(near)} FROM t) SELECT id, {', '.join(out)} FROM w"
    )


def _dedup(view: View, keys: list[str], keep: str, only: list[str], where: str = "") -> str:
    by = ", ".join(keys)
    if keep == "none":
        rule = f"count(*) OVER (PARTITION BY {by}) = 1"
    else:
        order = {"first": "rk", "last": "rk DESC"}.get(keep, keep)
        rule = f"row_number() OVER (PARTITION BY {by} ORDER BY {order}) = 1"
    cells = ", ".join(only)
    return f"WITH t AS ({view.sql}) SELECT {cells} FROM t {where} QUALIFY {rule}"


def _changed(old: str, new: str) -> str:
    return f"count(*) FILTER (WHERE coalesce({old}, '') <> coalesce({new}, ''))"


def _part(x: str, k: int) -> str:
    return f"split_part({x}, ',', {k})"


_ADDRESS = '"address,code"'
_MERGED = (
    "concat_ws('-', CASE WHEN NOT {0} THEN segment END, CASE WHEN NOT {1} THEN nation END,"
    " CASE WHEN NOT {2} THEN empty END)"
).format(_blank("segment"), _blank("nation"), _blank("empty"))
_WORDS = f"regexp_split_to_array({_trim(_ADDRESS)}, '{WS}+')"
_CUSTOMER_COLUMNS = list(CUSTOMER.columns)

_TEXT_COLUMNS = ["name", "segment", "email", "phone", "balance", "address,code", "empty", "id", "nation"]


def _stats_cells() -> str:
    text = {c: _trim(_q(c)) for c in _TEXT_COLUMNS}
    cleaned = " + ".join(_changed(_q(c), e) for c, e in text.items())
    email = f"lower({_trim('email')})"
    default = f"CASE WHEN {_blank('segment')} THEN 'NONE' ELSE segment END"
    trimmed = ", ".join(f"{text[c]} AS {_q(c)}" for c in _TEXT_COLUMNS)
    return f"""
WITH t AS ({CUSTOMER.sql}),
a AS (SELECT {cleaned} AS cleanedTextCells FROM t),
u AS (SELECT {trimmed} FROM t),
b AS (SELECT {_changed('email', email)} AS normalizedEmailCells,
             {_changed('phone', _phone('phone', '86'))} AS normalizedPhoneCells,
             {_changed('balance', _money('balance'))} AS formattedCurrencyCells,
             {_changed('segment', default)} AS filledDefaultCells FROM u)
SELECT CAST(cleanedTextCells AS BIGINT) AS cleanedTextCells, normalizedEmailCells,
       normalizedPhoneCells, formattedCurrencyCells, filledDefaultCells FROM a, b"""


_ROWS_KEPT = f"""
WITH t AS ({EVENTS.sql}),
d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY kind, "user", reading ORDER BY rk) = 1),
r AS (SELECT *, row_number() OVER (ORDER BY rk) AS rn FROM d),
f AS (SELECT *, CASE WHEN NOT {_blank('reading')} THEN rn END AS pos FROM r),
g AS (SELECT *, max(pos) OVER (ORDER BY rn) AS p FROM f),
h AS (SELECT *, {_blank('reading')} AND rn - p <= 2 AS filled FROM g),
c AS (SELECT (SELECT count(*) FROM t) AS before, count(*) AS mid,
             count(*) FILTER (WHERE filled) AS fills,
             count(*) FILTER (WHERE {_blank('reading')} AND filled IS NOT TRUE
                              OR {_blank('"user"')}) AS gone FROM h)"""

_SHAPE = f"""
WITH t AS ({CUSTOMER.sql})
SELECT CAST(9 AS BIGINT) AS colsBefore, CAST(7 AS BIGINT) AS colsAfter,
       CAST(2 AS BIGINT) AS removedEmptyCols, CAST(1 AS BIGINT) AS renamedColumns,
       CAST(4 AS BIGINT) AS droppedColumns, CAST(3 AS BIGINT) AS splitColumnsAdded,
       CAST(max(CASE WHEN {_blank('segment')} AND {_blank('nation')} THEN 0 ELSE 1 END) AS BIGINT)
         AS mergedColumnsAdded
FROM t"""


def _full() -> str:
    """Every rule of the ``clean_full`` query, one step per table expression."""
    return f"""
WITH t AS ({ORDERS.sql}),
s AS (SELECT id, customer, odate, price, priority, status, note, rk,
             split_part(code, '-', 1) AS grade, split_part(code, '-', 2) AS bucket FROM t),
m AS (SELECT *, concat_ws('/', CASE WHEN NOT {_blank('status')} THEN status END,
                          CASE WHEN NOT {_blank('customer')} THEN customer END) AS owner FROM s),
x AS (SELECT {', '.join(f"{_trim(c)} AS {c}" for c in
      ('id', 'customer', 'odate', 'price', 'priority', 'status', 'grade', 'bucket', 'owner'))}, rk
      FROM m),
d AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY customer, grade ORDER BY rk) = 1),
{_dated('d')},
f AS (SELECT id, customer, grade, bucket, owner, rk, status,
             coalesce(strftime(moment, '%Y/%m/%d'),
                      CASE WHEN {_blank('odate')} THEN odate ELSE '' END) AS odate,
             CASE WHEN {_blank(_money('price', 1, True, '$'))} THEN '-'
                  ELSE {_money('price', 1, True, '$')} END AS price, priority,
             row_number() OVER (ORDER BY rk) AS rn FROM p),
g AS (SELECT *, last_value(CASE WHEN NOT {_blank('priority')} THEN priority END IGNORE NULLS)
                  OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pv,
                last_value(CASE WHEN NOT {_blank('priority')} THEN rn END IGNORE NULLS)
                  OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING) AS pa FROM f)
SELECT id, customer, odate, price,
       CASE WHEN {_blank('priority')} AND rn - pa <= 3 THEN pv ELSE priority END AS urgency,
       status, grade, bucket, owner
FROM g WHERE NOT {_blank('odate')}"""


# The value lists of the volume fixture, and its rates: rows a repeated row, rows an empty one.
_VALUES: dict[str, tuple[str | None, ...]] = {
    "user_name": ("Alice", "Bob", " Charlie ", "Dave", "Eve\n", "", None, "Frank  "),
    "age": ("25", "30", "45", "", " 22 ", None, "99"),
    "phone": (
        "+86 138-0000-1111",
        "(+86) 134-3333-6666",
        "13911112222",
        " +1 (555) 123-4567 ",
        "无效号码",
        "",
        None,
    ),
    "email": (
        "ALICE@Example.com", "  bob@test.com  ", "CHARLIE@DOMAIN.COM", "", None, "invalid-email",
    ),
    "join_date": (
        "2023-01-01",
        "2023/02/02",
        "2023.03.03",
        "2023年10月11日",
        "2023 - 11- 30 20 ：20:10",
        "20231225",
        "",
        None,
    ),
    "salary": ("RMB 7890.123", "1,234.56", " 5000 ", "-100.5", "¥9999", "", None),
    "province": ("浙江省", "广东省", "北京市", "", None),
    "city": ("杭州市", "深圳市", "广州市", "", None),
    "district": ("西湖区", "南山区", "天河区", "", None),
    "status": ("active", " inactive ", "PENDING", "", None),
    "address,code": ("Address1,100000", "Address2, 200000", "Address3", "", None),
    "extra_col1": ("",),
    "extra_col2": ("",),
}
_DUPLICATE_EVERY, _EMPTY_EVERY = 200, 500


def _generated() -> str:
    def mixed(salt: int) -> str:
        once = f"((c_custkey % 2147483647) * 48271 + {(salt + 1) * 1009}) % 2147483647"
        return f"(({once}) * 48271 % 2147483647)"

    cells = []
    for i, (name, values) in enumerate(_VALUES.items()):
        listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
        cells.append(
            f"list_extract([{listed}]::VARCHAR[], ({mixed(i)} // 64) % {len(values)} + 1) AS {_q(name)}"
        )
    names = ", ".join(f"CASE WHEN copy < 2 THEN {_q(n)} END AS {_q(n)}" for n in ["ID", *_VALUES])
    key = f"{mixed(900)} * 4294967296 + (c_custkey % 1073741824) * 4"
    return f"""
WITH b AS (SELECT {key} AS k, {mixed(901)} AS chance,
                  'U-' || lpad(CAST(c_custkey AS VARCHAR),
                               CAST(greatest(5, length(CAST(c_custkey AS VARCHAR))) AS INTEGER),
                               '0') AS "ID",
                  {', '.join(cells)} FROM customer),
c AS (SELECT *, 0 AS copy FROM b
      UNION ALL SELECT *, 1 FROM b WHERE chance % {_DUPLICATE_EVERY} = 0
      UNION ALL SELECT *, 2 FROM b WHERE chance % {_EMPTY_EVERY} = 1)
SELECT k + copy AS row_key, {names} FROM c"""


def _many() -> str:
    return f"""
SELECT 'customer' AS source, {_trim('c_name')} AS name,
       {_money('cast(c_acctbal AS string)')} AS balance FROM customer
UNION ALL
SELECT 'supplier', {_trim('s_name')}, {_money('cast(s_acctbal AS string)', 0, False, '$')}
FROM supplier"""


def oracle_sql() -> dict[str, str]:
    from workload import file_oracles  # it uses the helpers of this module

    all_text = {c: _trim(_q(c)) for c in _CUSTOMER_COLUMNS}
    some_blank = " AND ".join(f"NOT {_blank(c)}" for c in ("name", "segment", "phone"))
    any_value = " OR ".join(f"NOT {_blank(c)}" for c in ("name", "segment", "phone"))
    full_row = " AND ".join(f"NOT {_blank(_q(c))}" for c in _CUSTOMER_COLUMNS if c != "empty")
    event_keys = ["kind", '"user"']
    event_row = ["kind", '"user"', "reading", "sparse"]
    return {
        "to_text_table": (
            "SELECT coalesce(cast(c_custkey AS string), '') AS c_custkey,"
            " coalesce(c_name, '') AS c_name,"
            " coalesce(cast(c_nationkey AS string), '') AS c_nationkey,"
            " coalesce(cast(c_acctbal AS string), '') AS c_acctbal,"
            " coalesce(c_mktsegment, '') AS c_mktsegment FROM customer"
        ),
        "preview_first_100": _over(CUSTOMER, all_text, tail="ORDER BY rk LIMIT 100"),
        "preview_clip": _over(CUSTOMER, all_text, ["id", "name", "segment"], "ORDER BY rk LIMIT 50"),
        "drop_columns": _over(CUSTOMER, {}, [c for c in _CUSTOMER_COLUMNS if c not in ("nation", "empty")]),
        "rename_columns": (
            f"WITH t AS ({CUSTOMER.sql}) SELECT id, name AS full_name, segment, email, phone, balance,"
            f" {_ADDRESS} AS address, nation, empty FROM t"
        ),
        "rename_swap": (
            f"WITH t AS ({CUSTOMER.sql}) SELECT id, name AS email, segment, email AS name, phone,"
            f" balance, {_ADDRESS}, nation, empty FROM t"
        ),
        "split_literal": (
            f"WITH t AS ({CUSTOMER.sql}) SELECT id, {_ADDRESS}, {_part(_ADDRESS, 1)} AS place,"
            f" {_part(_ADDRESS, 2)} AS code, {_part(_ADDRESS, 3)} AS extra FROM t"
        ),
        "split_whitespace": (
            f"WITH t AS ({CUSTOMER.sql}) SELECT id, {_ADDRESS}, coalesce({_WORDS}[1], '') AS w1,"
            f" coalesce({_WORDS}[2], '') AS w2, coalesce({_WORDS}[3], '') AS w3 FROM t"
        ),
        "split_drop_original": (
            f"WITH t AS ({CUSTOMER.sql}) SELECT id, {_part(_ADDRESS, 1)} AS place,"
            f" {_part(_ADDRESS, 2)} AS code FROM t"
        ),
        "split_existing_target": (
            f"WITH t AS ({CUSTOMER.sql}) SELECT id, name, {_ADDRESS},"
            f" {_part(_ADDRESS, 1)} AS place, {_part(_ADDRESS, 3)} AS extra FROM t"
        ),
        "merge_columns": f"WITH t AS ({CUSTOMER.sql}) SELECT id, segment, nation, empty, {_MERGED} AS merged FROM t",
        "merge_into_existing": f"WITH t AS ({CUSTOMER.sql}) SELECT id, nation, empty, {_MERGED} AS segment FROM t",
        "merge_drop_sources": f"WITH t AS ({CUSTOMER.sql}) SELECT id, {_MERGED} AS segment FROM t",
        "remove_empty_cols_all": _over(ORDERS, {}, [c for c in ORDERS.columns if c != "note"]),
        "remove_empty_cols_any": _over(ORDERS, {}, ["id", "customer", "price", "status", "code"]),
        "text_trim": _over(CUSTOMER, all_text),
        "text_collapse": _over(CUSTOMER, {c: _squeeze(_q(c)) for c in _CUSTOMER_COLUMNS}),
        "text_remove_all": _over(
            CUSTOMER, {c: f"regexp_replace({_q(c)}, '{WS}+', '', 'g')" for c in _CUSTOMER_COLUMNS}
        ),
        "text_selected": _over(
            CUSTOMER, {"name": _trim(_squeeze("name")), "phone": _trim(_squeeze("phone"))}
        ),
        "text_documents": _over(DOCUMENTS, {"text": _trim(_squeeze("text"))}),
        "email_normalize": _over(CUSTOMER, {"email": f"lower({_trim('email')})"}, ["id", "email"]),
        "phone_digits": _over(CUSTOMER, {"phone": _phone("phone")}, ["id", "phone"]),
        "phone_cc_digits": _over(CUSTOMER, {"phone": _phone("phone", "86")}, ["id", "phone"]),
        "phone_e164": _over(CUSTOMER, {"phone": _phone("phone", "86", True)}, ["id", "phone"]),
        "date_iso_day": _date("%Y-%m-%d"),
        "date_slash": _date("%Y/%m/%d"),
        "date_minutes": _date("%Y-%m-%d %H:%M"),
        "date_seconds": _date("%Y-%m-%d %H:%M:%S"),
        "date_slash_minutes": _date("%Y/%m/%d %H:%M"),
        "date_slash_seconds": _date("%Y/%m/%d %H:%M:%S"),
        "date_chinese": _date("%Y年%m月%d日"),
        "date_chinese_minutes": _date("%Y年%m月%d日 %H时%M分"),
        "date_chinese_seconds": _date("%Y年%m月%d日 %H时%M分%S秒"),
        "date_iso": _date("%Y-%m-%dT%H:%M:%S.000Z"),
        "date_invalid_empty": _date("%Y-%m-%d %H:%M:%S", "empty"),
        "date_invalid_keep": _date("%Y/%m/%d", "keep"),
        "date_utc": _date("%Y-%m-%d %H:%M:%S", "keep", utc=True),
        "currency_default": _over(CUSTOMER, {"balance": _money("balance")}, ["id", "balance"]),
        "currency_no_thousands": _over(ORDERS, {"price": _money("price", 2, False)}, ["id", "price"]),
        "currency_0dp": _over(ORDERS, {"price": _money("price", 0)}, ["id", "price"]),
        "currency_unparsed": _over(
            CUSTOMER, {"balance": _money("balance", 1, True, "$")}, ["id", "balance"],
            "WHERE id IS NOT NULL",
        ),
        "currency_lineitem": _over(LINEITEM, {"price": _money("price", 1), "flag": _trim(_squeeze("flag"))}),
        "fill_default": _over(
            CUSTOMER,
            {c: f"CASE WHEN {_blank(c)} THEN '{v}' ELSE {c} END" for c, v in
             (("segment", "NONE"), ("email", ""), ("phone", "0"))},
        ),
        "fill_overwrite": _over(CUSTOMER, {"segment": "'X'", "email": "''"}),
        "fill_untrimmed": _over(
            CUSTOMER, {"segment": "CASE WHEN segment = '' THEN 'NONE' ELSE segment END"},
            ["id", "segment"],
        ),
        "ffill": _fill(EVENTS, {"reading": "forward", "sparse": "forward"}),
        "bfill": _fill(EVENTS, {"reading": "backward", "sparse": "backward"}),
        "fill_both": _fill(EVENTS, {"reading": "both", "sparse": "both"}),
        "ffill_limit": _fill(EVENTS, {"reading": "forward", "sparse": "forward"}, 2),
        "fill_both_limit": _fill(EVENTS, {"reading": "both", "sparse": "both"}, 600),
        "fill_directions": _fill(EVENTS, {"reading": "backward", "sparse": "both"}, 3),
        "remove_empty_rows_all": _over(
            CUSTOMER, {}, ["name", "segment", "phone"], f"WHERE {any_value}"
        ),
        "remove_empty_rows_any": _over(
            CUSTOMER, {}, [c for c in _CUSTOMER_COLUMNS if c != "empty"], f"WHERE {full_row}"
        ),
        "remove_empty_rows_custom": _over(CUSTOMER, {}, tail=f"WHERE {some_blank}"),
        "dedup_row_first": f"WITH t AS ({EVENTS.sql}) SELECT DISTINCT {', '.join(event_row)} FROM t",
        "dedup_cols_first": _dedup(EVENTS, event_keys, "first", ["id", *event_row]),
        "dedup_cols_last": _dedup(EVENTS, event_keys, "last", ["id", *event_row]),
        "dedup_none": _dedup(EVENTS, ["reading"], "none", ["id", *event_row]),
        "dedup_any": _dedup(
            EVENTS, event_keys, "id, reading, sparse", ["id", *event_row]
        ),
        "dedup_normalized": _dedup(
            EVENTS, [f"lower({_trim('kind')})", f"lower({_trim('\"user\"')})"], "first", ["id", *event_row]
        ),
        "dedup_documents": _dedup(
            DOCUMENTS, [f"lower({_trim('text')})"], "first", ["id", "text", "lang", "source"]
        ),
        "stats_cells": _stats_cells(),
        "stats_rows": _ROWS_KEPT + (
            " SELECT before AS rowsBefore, mid - gone AS rowsAfter, gone AS removedEmptyRows,"
            " before - mid AS removedDuplicates, fills AS filledForwardBackwardCells FROM c"
        ),
        "stats_columns": _SHAPE,
        "shrink_rate": _ROWS_KEPT + (
            " SELECT format('{:.1f}', (before - (mid - gone)) / before * 100) AS shrink_rate,"
            " false AS nothing_matched FROM c"
        ),
        "stats_dates": f"WITH t AS ({ORDERS.sql}), {_dated('t')}"
        f" SELECT {_changed('odate', "coalesce(strftime(moment, '%Y/%m/%d'), odate)")} AS formattedDateCells FROM p",
        "nothing_matched": f"WITH t AS ({CUSTOMER.sql})"
        f" SELECT count(*) FILTER (WHERE nation <> {_trim('nation')}) = 0 AS nothing_matched FROM t",
        "currency_large": _over(LARGE, {"price": _money("price")}),
        "csv_round_trip": _over(CUSTOMER, all_text),
        "dedup_csv_row_first": f"WITH t AS ({EVENTS.sql}) SELECT DISTINCT {', '.join(event_row)} FROM t",
        "dedup_row_normalized": _dedup(
            EVENTS, [f"lower({_trim(c)})" for c in event_row], "first", event_row
        ),
        "dedup_stage_last": _dedup(EVENTS, event_keys, "first", ["id", *event_row], f"WHERE NOT {_blank('reading')}"),
        "clean_full": _full(),
        "clean_many": _many(),
        "generated_dirty_table": _generated(),
        "currency_9dp": _over(ORDERS, {"price": _money("price", 9)}, ["id", "price"]),
        "currency_bound": _over(BOUND, {"price": _money("price")}),
        **file_oracles.oracle_sql(),
    }
