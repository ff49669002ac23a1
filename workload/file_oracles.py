"""SQL checks of the queries through files: what the files hold, stated on the tables they are made of."""

from __future__ import annotations

from workload.fixtures import EVENTS
from workload.oracles import _blank, _money, _trim

_RECORDS = "FROM customer"
#: The second to fourth cell of a record.
_CELLS = [
    "CASE c_custkey % 5 WHEN 3 THEN c_name || ', Inc' WHEN 4 THEN '' ELSE c_name END",
    "CASE c_custkey % 5 WHEN 1 THEN '' WHEN 3 THEN 'said \"' || c_mktsegment || '\"' WHEN 4 THEN '  ' ELSE c_mktsegment END",
    "CASE WHEN c_custkey % 5 IN (1, 4) THEN '' ELSE cast(c_nationkey AS string) END",
]
_ID = "cast(c_custkey AS string)"

_ACCOUNT = """
SELECT 4 AS columns, count(*) AS records,
       count(*) FILTER (WHERE c_custkey % 5 = 1) AS short,
       count(*) FILTER (WHERE c_custkey % 5 = 2) AS long,
       0 AS broken, count(*) FILTER (WHERE c_custkey % 50 = 6) AS empty_lines FROM customer"""

_TABLE = (
    "SELECT coalesce(cast(c_custkey AS string), '') AS c_custkey,"
    f" {_trim('c_name')} AS c_name, cast(c_nationkey AS string) AS c_nationkey,"
    f" {_money('cast(c_acctbal AS string)')} AS c_acctbal, {_trim('c_mktsegment')} AS c_mktsegment,"
    " 'customer_cleaned_20240102_030405.csv' AS file FROM customer"
)

#: Each file is a table of its own.
_BY_FILE = f"""
WITH t AS (SELECT *, rk % 8 AS part FROM ({EVENTS.sql})),
d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY part, kind, "user", reading ORDER BY rk) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY rk) AS rn FROM d),
w AS (SELECT *, last_value(CASE WHEN NOT {_blank('reading')} THEN reading END IGNORE NULLS) OVER o AS v,
             last_value(CASE WHEN NOT {_blank('reading')} THEN rn END IGNORE NULLS) OVER o AS pos
      FROM n WINDOW o AS (PARTITION BY part ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, CASE WHEN {_blank('reading')} AND rn - pos <= 2 THEN v ELSE reading END AS filled FROM w)"""
_KEPT = f"NOT {_blank('filled')} AND NOT {_blank('\"user\"')}"


def _kept(order: str) -> str:
    return (
        f"WITH t AS (SELECT *, rk % 8 AS part FROM ({EVENTS.sql}))"
        ' SELECT id, kind, "user", reading, sparse FROM t'
        f' QUALIFY row_number() OVER (PARTITION BY kind, "user" ORDER BY part {order}, rk {order}) = 1'
    )


_FILLED = f"""
WITH t AS (SELECT *, row_number() OVER (ORDER BY rk % 8, rk) AS rn FROM ({EVENTS.sql})),
w AS (SELECT *, last_value(CASE WHEN sparse <> '' THEN sparse END IGNORE NULLS) OVER p AS pv,
             last_value(CASE WHEN sparse <> '' THEN rn END IGNORE NULLS) OVER p AS pa,
             first_value(CASE WHEN sparse <> '' THEN sparse END IGNORE NULLS) OVER n AS nv,
             first_value(CASE WHEN sparse <> '' THEN rn END IGNORE NULLS) OVER n AS na
      FROM t WINDOW p AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    n AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT id, coalesce(CASE WHEN rn - pa <= 500 THEN pv END, CASE WHEN na - rn <= 500 THEN nv END, '') AS sparse FROM w"""


def oracle_sql() -> dict[str, str]:
    two, three, four = _CELLS
    return {
        "csv_ragged": f"SELECT {_ID} AS id, {two} AS name, {three} AS segment, {four} AS nation {_RECORDS}",
        "csv_ragged_account": _ACCOUNT,
        "csv_headers": f'SELECT {_ID} AS id, {two} AS "Unnamed_2", {three} AS name, {four} AS name_1 {_RECORDS}',
        "export_round_trip": _TABLE,
        "clean_many_shared": f'{_BY_FILE} SELECT cast(part AS string) AS source, id, kind, "user", filled AS reading FROM f WHERE {_KEPT}',
        "clean_many_stats": f"""{_BY_FILE}
SELECT cast(part AS string) AS source, (SELECT count(*) FROM t WHERE t.part = f.part) AS "rowsBefore",
       count(*) FILTER (WHERE {_KEPT}) AS "rowsAfter", count(*) FILTER (WHERE NOT ({_KEPT})) AS "removedEmptyRows",
       (SELECT count(*) FROM t WHERE t.part = f.part) - count(*) AS "removedDuplicates",
       count(*) FILTER (WHERE {_blank('reading')} AND NOT {_blank('filled')}) AS "filledForwardBackwardCells" FROM f GROUP BY part""",
        "dedup_files_first": _kept(""),
        "dedup_files_last": _kept("DESC"),
        "fill_files": _FILLED,
    }
