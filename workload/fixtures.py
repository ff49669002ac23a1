"""Dirty text tables, derived from the given tables.

The projections use only syntax that Spark SQL and DuckDB share, so the same text
serves the query and its check. Every view covers its whole table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class View:
    table: str
    key: str
    columns: dict[str, str]

    @property
    def sql(self) -> str:
        return self.select(self.columns)

    def select(self, columns: dict[str, str]) -> str:
        """The view as a text table: missing cells are ``''``."""
        cells = ", ".join(
            f"coalesce(cast({e} as string), '') AS \"{c}\"" for c, e in columns.items()
        )
        return f"SELECT {cells}, {self.key} AS rk FROM {self.table}"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        exprs = [f"{e} AS `{c}`" for c, e in self.columns.items()]
        return df.selectExpr(*exprs, f"{self.key} AS rk")


_DAY = "cast(cast(o_orderdate as date) as string)"
_Y, _M, _D = f"substr({_DAY}, 1, 4)", f"substr({_DAY}, 6, 2)", f"substr({_DAY}, 9, 2)"


def _two(number: str) -> str:
    return f"lpad(cast({number} as string), 2, '0')"


_H, _I, _S = _two("o_orderkey % 24"), _two("o_orderkey % 60"), _two("o_custkey % 60")

CUSTOMER = View(
    "customer",
    "c_custkey",
    {
        "id": "c_custkey",
        "name": (
            "case c_custkey % 5 when 0 then '  ' || c_name || ' '"
            " when 1 then chr(9) || c_name when 2 then '　' || c_name || '　'"
            " when 3 then replace(c_name, '#', ' ' || chr(9) || ' # ') else '' end"
        ),
        "segment": (
            "case c_custkey % 6 when 0 then lower(c_mktsegment) when 1 then c_mktsegment || ' '"
            " when 2 then '   ' when 3 then null else c_mktsegment end"
        ),
        "email": (
            "case c_custkey % 7 when 0 then null when 1 then 'invalid-email'"
            " when 2 then '  ' || replace(c_name, '#', '.') || '@Example.com '"
            " when 3 then upper(replace(c_name, '#', '.')) || '@EXAMPLE.COM'"
            " else lower(replace(c_name, '#', '.')) || '@example.com' end"
        ),
        "phone": (
            "case c_custkey % 9"
            " when 0 then '+86 138-' || lpad(cast(c_custkey as string), 8, '0')"
            " when 1 then '(+86) 134-3333-' || lpad(cast(c_custkey as string), 6, '0')"
            " when 2 then '139' || lpad(cast(c_custkey as string), 8, '0')"
            " when 3 then ' +1 (555) 123-' || cast(c_custkey as string) || ' '"
            " when 4 then '无效号码' when 5 then '' when 6 then null"
            " when 7 then '86 86 ' || cast(c_custkey as string)"
            " else '+' || cast(c_custkey as string) end"
        ),
        "balance": (
            "case c_custkey % 6 when 0 then '$' || cast(c_acctbal as string)"
            " when 1 then '¥ ' || cast(c_acctbal as string)"
            " when 2 then 'RMB ' || chr(9) || cast(c_acctbal as string) || ' '"
            " when 3 then '' when 4 then cast(c_acctbal / 8 as string) else 'none' end"
        ),
        "address,code": (
            "case c_custkey % 4 when 0 then 'City' || cast(c_nationkey as string) || ', '"
            " || cast(c_custkey as string) || ',x,y' when 1 then 'Town ' || c_name"
            " when 2 then ',,' else null end"
        ),
        "nation": "c_nationkey",
        "empty": "case when c_custkey % 2 = 0 then '' else ' ' end",
    },
)

ORDERS = View(
    "orders",
    "o_orderkey",
    {
        "id": "o_orderkey",
        "customer": "o_custkey",
        "odate": (
            f"case o_orderkey % 12 when 0 then {_DAY} when 1 then replace({_DAY}, '-', '/')"
            f" when 2 then replace({_DAY}, '-', '.')"
            f" when 3 then {_Y} || '年' || {_M} || '月' || {_D} || '日'"
            f" when 4 then {_DAY} || ' ' || {_H} || ':' || {_I} || ':' || {_S}"
            f" when 5 then {_Y} || ' - ' || {_M} || '- ' || {_D} || ' ' || {_H} || ' ：'"
            f" || {_I} || ':' || {_S}"
            f" when 6 then {_Y} || '年' || {_M} || '月' || {_D} || '日 ' || {_H} || ' 时 '"
            f" || {_I} || ' 分' when 7 then {_Y} || {_M} || {_D}"
            f" when 8 then {_D} || '/' || {_M} || '/' || {_Y}"
            f" when 9 then {_DAY} || 'T' || {_H} || ':' || {_I} || ':' || {_S} || '.250+08:00'"
            f" when 10 then {_Y} || '-02-30'"
            " else case o_orderkey % 5 when 0 then '' when 1 then null when 2 then 'soon'"
            f" else {_DAY} || ' 25:00' end end"
        ),
        "price": (
            "case o_orderkey % 4 when 0 then '$' || cast(o_totalprice as string)"
            " when 1 then cast(o_totalprice as string) || ' USD' when 2 then"
            " '-' || cast(o_totalprice as string) else 'unknown' end"
        ),
        "priority": (
            "case when o_orderkey % 7 >= 2 then (case when o_orderkey % 2 = 0 then '' else ' ' end)"
            " else o_orderpriority end"
        ),
        "status": "case when o_orderkey % 3 = 0 then ' ' || o_orderstatus else o_orderstatus end",
        "code": "o_orderstatus || '-' || cast(o_custkey % 7 as string)",
        "note": "case when o_orderkey % 2 = 0 then '' else '  ' end",
    },
)

# Digits up to 10^36, of either sign.
LARGE = View(
    "orders",
    "o_orderkey",
    {
        "id": "o_orderkey",
        "price": (
            "case when o_orderkey % 3 = 0 then '-' else '' end || replace(cast(o_totalprice as string), '.', '')"
            " || repeat('7', cast(o_orderkey % 26 as int)) || case when o_orderkey % 2 = 0 then '.25' else '' end"
        ),
    },
)

# Digits up to 10^38, and the powers of two where the way of printing changes.
BOUND = View(
    "orders",
    "o_orderkey",
    {
        "id": "o_orderkey",
        "price": (
            "case when o_orderkey % 3 = 0 then '-' else '' end || case o_orderkey % 5"
            " when 0 then '42535295865117307932921825928971026432' when 1 then '4611686018427387904'"
            " else cast(1 + o_orderkey % 977 as string) || repeat('3', cast(o_orderkey % 35 as int)) end"
        ),
    },
)

EVENTS = View(
    "events",
    "event_id",
    {
        "id": "event_id",
        "kind": (
            "case event_id % 4 when 0 then ' ' || event_type when 1 then upper(event_type)"
            " else event_type end"
        ),
        "user": "case when event_id % 13 = 0 then null else cast(user_id % 40 as string) end",
        "reading": (
            "case when cast(floor(event_id / 700) as bigint) % 3 = 1 then ''"
            " when event_id % 11 < 4 then '' when event_id % 11 = 4 then '  '"
            " else cast(value as string) end"
        ),
        "sparse": (
            "case when event_id % 1777 = 900 then 's' || cast(event_id as string) else null end"
        ),
    },
)

LINEITEM = View(
    "lineitem",
    "l_orderkey",
    {
        "part": "l_partkey",
        "price": (
            "case l_linenumber % 4 when 0 then '$' || cast(l_extendedprice as string)"
            " when 1 then 'RMB ' || cast(l_extendedprice as string)"
            " when 2 then ' ' || cast(l_extendedprice as string) else 'n/a' end"
        ),
        "flag": "'  ' || l_returnflag || '  ' || l_linestatus",
        "quantity": "case when l_linenumber % 5 = 0 then '' else cast(l_quantity as string) end",
    },
)

DOCUMENTS = View(
    "documents",
    "doc_id",
    {"id": "doc_id", "text": "text", "lang": "upper(lang)", "source": "source"},
)
