"""One query per operator, each over a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyloom.names import drop_hidden, refs
from tidyloom.operators.order import attach_key_order
from tidyloom.plans.clean import CleanResult, clean
from tidyloom.plans.preview import clip, preview
from tidyloom.plans.stats import nothing_matched, shrink_rate
from tidyloom.sources.batch import by_source, clean_many
from tidyloom.sources.generator import dirty_table
from tidyloom.session import checkpoint_dir
from tidyloom.sources.readers import load
from tidyloom.sources.writers import write
from workload import file_queries
from workload.fixtures import CUSTOMER, DOCUMENTS, EVENTS, BOUND, LARGE, LINEITEM, ORDERS, View

Query = Callable[[SparkSession, str], DataFrame]


def _on(flag: dict[str, Any]) -> dict[str, Any]:
    return {"enabled": True, **flag}


def cleaned(
    view: View, rules: dict[str, Any], ordered: bool = False
) -> Callable[[SparkSession, str], CleanResult]:
    """Apply a rule document to a dirty view. The view's key only gives the order."""

    fills = "fillForwardBackward" in rules.get("missing", {})

    def run(spark: SparkSession, sf_dir: str) -> CleanResult:
        df = view.frame(spark, sf_dir)
        if ordered:
            df = attach_key_order(df, "rk", chunked=fills)
        return clean(df.drop("rk"), rules)

    return run


def _query(
    view: View, rules: dict[str, Any], only: list[str] | None = None, ordered: bool = False
) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = cleaned(view, rules, ordered)(spark, sf_dir).df
        return df.select([F.col(f"`{c}`") for c in only]) if only else df

    return run


def _columns(**rule: dict[str, Any]) -> dict[str, Any]:
    return {"columns": {k: _on(v) for k, v in rule.items()}}


def _format(**rule: dict[str, Any]) -> dict[str, Any]:
    return {"format": {k: _on(v) for k, v in rule.items()}}


def _missing(trim: bool = True, **rule: dict[str, Any]) -> dict[str, Any]:
    return {
        "missing": {"trimWhitespaceForEmptyCheck": trim, **{k: _on(v) for k, v in rule.items()}}
    }


def _date(output: str, on_invalid: str = "keep", timezone: str = "local") -> Query:
    rule = {
        "columns": ["odate"], "outputFormat": output, "onInvalid": on_invalid, "timezone": timezone,
    }
    return _query(ORDERS, _format(date=rule), ["id", "odate"])


def _split(into: list[str], separator: str = ",", keep: bool = True) -> dict[str, Any]:
    return _columns(
        split={
            "column": "address,code", "separator": separator, "into": into, "keepOriginal": keep,
        }
    )


def _merge(into: str, drop: bool = False) -> dict[str, Any]:
    return _columns(
        merge={
            "columns": ["segment", "nation", "empty"],
            "separator": "-",
            "into": into,
            "dropSources": drop,
        }
    )


def _fill(directions: dict[str, str], limit: int | None = None) -> Query:
    rule = {"columns": list(directions), "directions": directions, "limit": limit}
    return _query(EVENTS, _missing(fillForwardBackward=rule), ["id", *directions], ordered=True)


def _dedup(columns: list[str], keep: str, normalize: bool = False, view: View = EVENTS) -> Query:
    rule = {"mode": "byColumns", "columns": columns, "keep": keep, "normalizeText": normalize}
    return _query(view, {"dedup": _on(rule)}, ordered=keep in ("first", "last"))


def _trim_all() -> dict[str, Any]:
    return _format(text={"trim": True})


CELL_RULES = {
    "format": {
        "text": _on({"trim": True}),
        "email": _on({"columns": ["email"]}),
        "phone": _on({"columns": ["phone"], "countryCode": "86"}),
        "currency": _on({"columns": ["balance"]}),
    },
    "missing": {
        "fillDefault": _on({"columns": ["segment"], "values": {"segment": "NONE"}}),
    },
}
ROW_RULES = {
    "dedup": _on({"mode": "byColumns", "columns": ["kind", "user", "reading"], "keep": "first"}),
    "missing": {
        "fillForwardBackward": _on({"columns": ["reading"], "limit": 2}),
        "removeEmptyRows": _on(
            {"condition": "any", "columnsMode": "custom", "columns": ["reading", "user"]}
        ),
    },
}
SHAPE_RULES = {
    "columns": {
        "drop": _on({"columns": ["phone", "email", "no such column"]}),
        "split": _on(
            {"column": "address,code", "separator": ",", "into": ["place", "code", "none", "id"]}
        ),
        "merge": _on(
            {
                "columns": ["segment", "nation"],
                "separator": "/",
                "into": "group",
                "dropSources": True,
            }
        ),
        "removeEmptyCols": _on({"condition": "all"}),
        "rename": _on({"mappings": [{"from": "group", "to": "segment and nation"}]}),
    },
    # The third part of an address is 'x' or blank; blanked here to become an empty column.
    "missing": {
        "fillDefault": _on({"columns": ["none"], "values": {}, "onlyWhenEmpty": False}),
    },
}
FULL_RULES = {
    "columns": {
        "split": _on(
            {
                "column": "code",
                "separator": "-",
                "into": ["grade", "bucket"],
                "keepOriginal": False,
            }
        ),
        "merge": _on({"columns": ["status", "customer"], "separator": "/", "into": "owner"}),
        "drop": _on({"columns": ["nothing"]}),
        "removeEmptyCols": _on({"condition": "all"}),
        "rename": _on({"mappings": [{"from": "priority", "to": "urgency"}]}),
    },
    "format": {
        "text": _on({"trim": True}),
        "email": _on({"columns": ["owner"], "lowercase": False}),
        "phone": _on({"columns": []}),
        "date": _on({"columns": ["odate"], "outputFormat": "YYYY/MM/DD", "onInvalid": "empty"}),
        "currency": _on({"columns": ["price"], "symbol": "$", "decimalPlaces": 1}),
    },
    "dedup": _on({"mode": "byColumns", "columns": ["customer", "grade"], "keep": "first"}),
    "missing": {
        "fillDefault": _on({"columns": ["price"], "values": {"price": "-"}}),
        "fillForwardBackward": _on({"columns": ["priority"], "limit": 3}),
        "removeEmptyRows": _on(
            {"condition": "any", "columnsMode": "custom", "columns": ["odate"]}
        ),
    },
}


def _through_csv(view: View, columns: list[str], rules: dict[str, Any]) -> Query:
    """Write columns of a view as CSV in the shared folder, load the files and clean them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4()}"
        write(clean(view.frame(spark, sf_dir).select(refs(columns)), {}).df, path, "csv")
        return clean(load(spark, path, "csv"), rules).df

    return run


def _dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates after the removal of empty rows."""
    rules = _missing(removeEmptyRows={"condition": "any", "columnsMode": "custom", "columns": ["reading"]})
    rules |= {"dedup": _on({"mode": "byColumns", "columns": ["kind", "user"], "keep": "first"})}
    df = attach_key_order(EVENTS.frame(spark, sf_dir), "rk", chunked=False)
    return clean(df.drop("rk"), rules, dedup_stage="last").df


def _nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _format(text={"trim": True, "columnsMode": "selected", "columns": ["nation"]})
    return cleaned(CUSTOMER, rules)(spark, sf_dir).stats.select(nothing_matched().alias("nothing_matched"))


def _to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_hidden(load(spark, f"{sf_dir}/customer.parquet"))


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(cleaned(CUSTOMER, _trim_all(), ordered=True)(spark, sf_dir))


def _clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clip(_preview(spark, sf_dir), rows=50, columns=3)


def _stats(view: View, rules: dict[str, Any], only: list[str], ordered: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cleaned(view, rules, ordered)(spark, sf_dir).stats.select(only)

    return run


def _shrink(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cleaned(EVENTS, ROW_RULES, ordered=True)(spark, sf_dir).stats
    return stats.select(
        shrink_rate().alias("shrink_rate"), nothing_matched().alias("nothing_matched")
    )


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rules(prefix: str, currency: dict[str, Any]) -> dict[str, Any]:
        name, balance = f"{prefix}_name", f"{prefix}_acctbal"
        renames = [{"from": name, "to": "name"}, {"from": balance, "to": "balance"}]
        return {
            "format": {
                "text": _on({"trim": True, "columnsMode": "selected", "columns": [name]}),
                "currency": _on({"columns": [balance], **currency}),
            },
            "columns": {"rename": _on({"mappings": renames})},
        }

    other = {"symbol": "$", "decimalPlaces": 0, "thousandsSeparator": False}
    batches = clean_many(
        spark,
        {
            f"{sf_dir}/customer.parquet": rules("c", {}),
            f"{sf_dir}/supplier.parquet": rules("s", other),
        },
    )
    label = F.regexp_extract("source", r"(\w+)\.parquet$", 1).alias("source")
    parts = [by_source(b).select(label, "name", "balance") for b in batches]
    return reduce(DataFrame.unionByName, parts)


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_table(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey")


def queries() -> dict[str, Query]:
    blank_rows = {"columnsMode": "custom", "columns": ["name", "segment", "phone"]}
    three = ["name", "segment", "phone"]
    return {
        "to_text_table": _to_text,
        "preview_first_100": _preview,
        "preview_clip": _clip,
        "drop_columns": _query(CUSTOMER, _columns(drop={"columns": ["nation", "empty", "unknown"]})),
        "rename_columns": _query(
            CUSTOMER,
            _columns(
                rename={
                    "mappings": [
                        {"from": "name", "to": " full_name "},
                        {"from": "address,code", "to": "address"},
                        {"from": "unknown", "to": "x"},
                        {"from": "phone", "to": " "},
                    ]
                }
            ),
        ),
        "rename_swap": _query(
            CUSTOMER,
            _columns(
                rename={
                    "mappings": [{"from": "name", "to": "email"}, {"from": "email", "to": "name"}]
                }
            ),
        ),
        "split_literal": _query(
            CUSTOMER,
            _split(["place", " code ", "", "extra"]),
            ["id", "address,code", "place", "code", "extra"],
        ),
        "split_whitespace": _query(
            CUSTOMER, _split(["w1", "w2", "w3"], " "), ["id", "address,code", "w1", "w2", "w3"]
        ),
        "split_drop_original": _query(
            CUSTOMER, _split(["place", "code"], keep=False), ["id", "place", "code"]
        ),
        "split_existing_target": _query(
            CUSTOMER, _split(["place", "name", "extra"]), ["id", "name", "address,code", "place", "extra"]
        ),
        "merge_columns": _query(
            CUSTOMER, _merge(" merged "), ["id", "segment", "nation", "empty", "merged"]
        ),
        "merge_into_existing": _query(
            CUSTOMER, _merge("segment"), ["id", "nation", "empty", "segment"]
        ),
        "merge_drop_sources": _query(CUSTOMER, _merge("segment", drop=True), ["id", "segment"]),
        "remove_empty_cols_all": _query(ORDERS, _columns(removeEmptyCols={})),
        "remove_empty_cols_any": _query(ORDERS, _columns(removeEmptyCols={"condition": "any"})),
        "text_trim": _query(CUSTOMER, _trim_all()),
        "text_collapse": _query(CUSTOMER, _format(text={"collapseSpaces": True})),
        "text_remove_all": _query(
            CUSTOMER, _format(text={"removeAllWhitespace": True, "collapseSpaces": True})
        ),
        "text_selected": _query(
            CUSTOMER,
            _format(
                text={
                    "columnsMode": "selected",
                    "columns": ["name", "phone", "unknown"],
                    "trim": True,
                    "collapseSpaces": True,
                }
            ),
        ),
        "text_documents": _query(
            DOCUMENTS,
            _format(
                text={
                    "columnsMode": "selected",
                    "columns": ["text"],
                    "trim": True,
                    "collapseSpaces": True,
                }
            ),
        ),
        "email_normalize": _query(
            CUSTOMER, _format(email={"columns": ["email"]}), ["id", "email"]
        ),
        "phone_digits": _query(CUSTOMER, _format(phone={"columns": ["phone"]}), ["id", "phone"]),
        "phone_cc_digits": _query(
            CUSTOMER, _format(phone={"columns": ["phone"], "countryCode": "+86"}), ["id", "phone"]
        ),
        "phone_e164": _query(
            CUSTOMER,
            _format(phone={"columns": ["phone"], "countryCode": "86", "output": "E164"}),
            ["id", "phone"],
        ),
        "date_iso_day": _date("YYYY-MM-DD"),
        "date_slash": _date("YYYY/MM/DD"),
        "date_minutes": _date("YYYY-MM-DD HH:mm"),
        "date_seconds": _date("YYYY-MM-DD HH:mm:ss"),
        "date_slash_minutes": _date("YYYY/MM/DD HH:mm"),
        "date_slash_seconds": _date("YYYY/MM/DD HH:mm:ss"),
        "date_chinese": _date("YYYY年MM月DD日"),
        "date_chinese_minutes": _date("YYYY年MM月DD日 HH时mm分"),
        "date_chinese_seconds": _date("YYYY年MM月DD日 HH时mm分ss秒"),
        "date_iso": _date("ISO"),
        "date_invalid_empty": _date("YYYY-MM-DD HH:mm:ss", "empty"),
        "date_invalid_keep": _date("YYYY/MM/DD", "keep"),
        "date_utc": _date("YYYY-MM-DD HH:mm:ss", "keep", "utc"),
        "currency_default": _query(
            CUSTOMER, _format(currency={"columns": ["balance"]}), ["id", "balance"]
        ),
        "currency_no_thousands": _query(
            ORDERS,
            _format(currency={"columns": ["price"], "thousandsSeparator": False}),
            ["id", "price"],
        ),
        "currency_0dp": _query(
            ORDERS, _format(currency={"columns": ["price"], "decimalPlaces": 0}), ["id", "price"]
        ),
        "currency_unparsed": _query(
            CUSTOMER,
            _format(currency={"columns": ["balance"], "symbol": "$", "decimalPlaces": 1}),
            ["id", "balance"],
        ),
        "currency_lineitem": _query(
            LINEITEM,
            _format(
                currency={"columns": ["price"], "decimalPlaces": 1},
                text={
                    "columnsMode": "selected",
                    "columns": ["flag"],
                    "trim": True,
                    "collapseSpaces": True,
                },
            ),
        ),
        "fill_default": _query(
            CUSTOMER,
            _missing(
                fillDefault={
                    "columns": ["segment", "email", "phone", "unknown"],
                    "values": {"segment": "NONE", "phone": "0"},
                }
            ),
        ),
        "fill_overwrite": _query(
            CUSTOMER,
            _missing(
                fillDefault={
                    "columns": ["segment", "email"],
                    "values": {"segment": "X"},
                    "onlyWhenEmpty": False,
                }
            ),
        ),
        "fill_untrimmed": _query(
            CUSTOMER,
            _missing(
                trim=False, fillDefault={"columns": ["segment"], "values": {"segment": "NONE"}}
            ),
            ["id", "segment"],
        ),
        "ffill": _fill({"reading": "forward", "sparse": "forward"}),
        "bfill": _fill({"reading": "backward", "sparse": "backward"}),
        "fill_both": _fill({"reading": "both", "sparse": "both"}),
        "ffill_limit": _fill({"reading": "forward", "sparse": "forward"}, 2),
        "fill_both_limit": _fill({"reading": "both", "sparse": "both"}, 600),
        "fill_directions": _fill({"reading": "backward", "sparse": "both"}, 3),
        "remove_empty_rows_all": _query(
            CUSTOMER,
            _columns(drop={"columns": [c for c in CUSTOMER.columns if c not in three]})
            | _missing(removeEmptyRows={}),
        ),
        "remove_empty_rows_any": _query(
            CUSTOMER,
            _columns(drop={"columns": ["empty"]}) | _missing(removeEmptyRows={"condition": "any"}),
        ),
        "remove_empty_rows_custom": _query(
            CUSTOMER, _missing(removeEmptyRows={"condition": "any", **blank_rows})
        ),
        "dedup_row_first": _query(
            EVENTS,
            _columns(drop={"columns": ["id"]}) | {"dedup": _on({"mode": "wholeRow"})},
            ordered=True,
        ),
        "dedup_cols_first": _dedup(["kind", "user"], "first"),
        "dedup_cols_last": _dedup(["kind", "user"], "last"),
        "dedup_none": _dedup(["reading"], "none"),
        "dedup_any": _dedup(["kind", "user"], "any"),
        "dedup_normalized": _dedup(["kind", "user"], "first", normalize=True),
        "dedup_documents": _dedup(["text"], "first", normalize=True, view=DOCUMENTS),
        "stats_cells": _stats(
            CUSTOMER,
            CELL_RULES,
            [
                "cleanedTextCells",
                "normalizedEmailCells",
                "normalizedPhoneCells",
                "formattedCurrencyCells",
                "filledDefaultCells",
            ],
        ),
        "stats_rows": _stats(
            EVENTS,
            ROW_RULES,
            [
                "rowsBefore",
                "rowsAfter",
                "removedEmptyRows",
                "removedDuplicates",
                "filledForwardBackwardCells",
            ],
            ordered=True,
        ),
        "stats_columns": _stats(
            CUSTOMER,
            SHAPE_RULES,
            [
                "colsBefore",
                "colsAfter",
                "removedEmptyCols",
                "renamedColumns",
                "droppedColumns",
                "splitColumnsAdded",
                "mergedColumnsAdded",
            ],
        ),
        "shrink_rate": _shrink,
        "stats_dates": _stats(
            ORDERS, _format(date={"columns": ["odate"], "outputFormat": "YYYY/MM/DD"}), ["formattedDateCells"]
        ),
        "nothing_matched": _nothing,
        "currency_large": _query(LARGE, _format(currency={"columns": ["price"]})),
        "csv_round_trip": _through_csv(CUSTOMER, list(CUSTOMER.columns), _trim_all()),
        "dedup_csv_row_first": _through_csv(
            EVENTS, [c for c in EVENTS.columns if c != "id"], {"dedup": _on({"mode": "wholeRow"})}
        ),
        "dedup_row_normalized": _query(
            EVENTS,
            _columns(drop={"columns": ["id"]}) | {"dedup": _on({"mode": "wholeRow", "normalizeText": True})},
            ordered=True,
        ),
        "dedup_stage_last": _dedup_last,
        "clean_full": _query(ORDERS, FULL_RULES, ordered=True),
        "clean_many": _many,
        "generated_dirty_table": _generated,
        "currency_9dp": _query(ORDERS, _format(currency={"columns": ["price"], "decimalPlaces": 9}), ["id", "price"]),
        "currency_bound": _query(BOUND, _format(currency={"columns": ["price"]})),
        **file_queries.queries(),
    }
