"""Time the headline queries and print one JSON line.

Each query is planned and run to the end into the ``noop`` sink, so all rows and
columns are computed, twice in a row; the faster run counts. The first query of a session
also pays for starting it; a small warm-up run takes that out of the figures. ``calibration``
is the time of a fixed computation on made-up numbers, which tells machines of
different speed apart; it is no part of the total.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidyloom.session import build_session  # noqa: E402
from workload.queries import queries  # noqa: E402

HEADLINE = [
    "to_text_table",
    "preview_first_100",
    "split_literal",
    "merge_columns",
    "remove_empty_cols_all",
    "text_trim",
    "text_collapse",
    "text_documents",
    "email_normalize",
    "phone_e164",
    "date_seconds",
    "date_chinese_seconds",
    "currency_default",
    "currency_lineitem",
    "fill_default",
    "ffill",
    "fill_both_limit",
    "remove_empty_rows_any",
    "dedup_row_first",
    "dedup_cols_first",
    "dedup_normalized",
    "dedup_documents",
    "stats_cells",
    "stats_rows",
    "clean_full",
    "clean_many",
    "csv_round_trip",
    "dedup_csv_row_first",
    "fill_files",
    "clean_many_shared",
]
#: Numbers that the calibration sorts and hashes.
CALIBRATION_ROWS = 8_000_000


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = queries()
    names = sys.argv[1:] or HEADLINE
    _finish(run["text_trim"](spark, sf_dir))

    calibration = _seconds(lambda: _calibrate(spark))
    seconds = {name: _seconds(lambda name=name: _finish(run[name](spark, sf_dir))) for name in names}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "calibration": calibration,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


def _seconds(work) -> float:
    """The faster of two runs."""
    found = []
    for _ in range(2):
        start = time.perf_counter()
        work()
        found.append(time.perf_counter() - start)
    return round(min(found), 3)


def _calibrate(spark) -> None:
    numbers = spark.range(CALIBRATION_ROWS).selectExpr("xxhash64(id) as h", "cast(id as string) as t")
    _finish(numbers.groupBy((numbers.h % 1000).alias("k")).agg({"h": "max", "t": "max"}))


def _finish(df) -> None:
    df.write.format("noop").mode("overwrite").save()


if __name__ == "__main__":
    main()
