"""Deterministic dirty tables of any size, for tests and benchmarks.

Every cell is picked from a value list by arithmetic on the row id, so a lost task
is recomputed to the same rows and no data passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyloom.names import HIDDEN, ref

# The value lists of the volume fixture.
VALUES: dict[str, tuple[str | None, ...]] = {
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
# One row in 200 is repeated, and there is one empty row per 500.
DUPLICATE_EVERY, EMPTY_EVERY = 200, 500

# Multiplier and modulus of the "minimal standard" generator.
_FACTOR, _MODULUS = 48271, 2147483647

_ID, _COPY = HIDDEN + "id", HIDDEN + "copy"


def mixed(row_id: Column, salt: int) -> Column:
    """A well-spread number below 2^31 - 1 from a row id, safe from overflow."""
    once = F.pmod(row_id, F.lit(_MODULUS)) * _FACTOR + (salt + 1) * 1009
    return F.pmod(F.pmod(once, F.lit(_MODULUS)) * _FACTOR, F.lit(_MODULUS))


def pick(values: Sequence[str | None], number: Column) -> Column:
    index = F.pmod(F.floor(number / 64), F.lit(len(values))) + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def dirty_table(ids: DataFrame, id_column: str = "id", seed: int = 0) -> DataFrame:
    """A dirty table with one row per id, and repeated and empty rows among them.

    ``ids`` is any table with unique integers, such as ``spark.range(n)``. The
    result has a unique ``row_key``; sorted by it the rows are shuffled.
    """
    number = ref(id_column).cast("bigint")
    salt = seed * 1000
    chance = mixed(number, salt + 901)
    copies = F.array_compact(
        F.array(
            F.lit(0),
            F.when(F.pmod(chance, F.lit(DUPLICATE_EVERY)) == 0, 1),
            F.when(F.pmod(chance, F.lit(EMPTY_EVERY)) == 1, 2),
        )
    )
    # Copy 0 is the row, 1 its repetition and 2 an empty row.
    rows = ids.select(number.alias(_ID), F.explode(copies).alias(_COPY))
    row_id, copy = ref(_ID), ref(_COPY)
    # At least five digits; longer ids are not cut.
    digits = F.greatest(F.lit(5), F.length(row_id.cast("string")))
    label = F.concat(F.lit("U-"), F.lpad(row_id.cast("string"), digits, F.lit("0")))
    cells = {"ID": label} | {
        name: pick(values, mixed(row_id, salt + i)) for i, (name, values) in enumerate(VALUES.items())
    }
    shuffled = mixed(row_id, salt + 900) * F.lit(1 << 32)
    key = shuffled + F.pmod(row_id, F.lit(1 << 30)) * 4 + copy
    return rows.select(
        key.alias("row_key"), *[F.when(copy < 2, e).alias(name) for name, e in cells.items()]
    )
