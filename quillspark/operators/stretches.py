"""Stretches: consecutive parts of a table in some order, of about equal size, found without sorting it.

What needs a whole group in order (row numbers, the last value before a date) is done within
stretches, which are small whatever the size of a group, and carried over their borders by a
table that has a row for each group and stretch. Borders are values of the whole composite key,
so that a group, a key or a null that most rows share is cut by what comes after it. Their number
follows from the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Rows of a stretch, distinct keys looked at for each, and stretches at most (the bounds are part of the plan).
ROWS, LOOKED_AT, MOST = 100_000, 32, 8192


def _bounds(keys: DataFrame, rows: int, parts: int) -> Column | None:
    """Sorted literal bounds from the keys whose hashes are least; equal tables give equal bounds."""
    every = max(1, rows // (parts * LOOKED_AT))
    some = keys.where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).distinct()
    places = F.sequence(F.lit(1), F.lit(parts - 1))
    cut = some.agg(F.array_sort(F.collect_list("k")).alias("a")).select(F.filter(F.array_distinct(F.transform(places, lambda i: F.get("a", F.floor(i * F.size("a") / parts).cast("int")))), lambda x: x.isNotNull()).alias("cut"))
    text = cut.select(F.to_json("cut")).first()[0]
    return F.from_json(F.lit(text), ArrayType(keys.schema["k"].dataType)) if text and text != "[]" else None


def with_stretches(rows: DataFrame, order: list[Column], name: str = "__stretch", per: int | None = None, n: int | None = None) -> DataFrame:
    """``rows`` with the number of the stretch, from 0, rising in ``order`` (ascending, nulls first).

    Rows whose whole key is equal share a stretch. A table of one stretch is not looked at again.
    ``n``: the number of rows, where the caller has counted them.
    """
    per = per or ROWS
    n = rows.count() if n is None else n
    parts = min(math.ceil(n / per), MOST)
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)))
    bounds = _bounds(rows.select(key.alias("k")), n, parts) if parts > 1 else None
    if bounds is None:
        return rows.withColumn(name, F.lit(0))
    # binary search: bounds that are not above the key are counted
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(parts.bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= F.col("__key"), at + step).otherwise(at))
    return rows.withColumn("__key", key).withColumn(name, found).drop("__key")
