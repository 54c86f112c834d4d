"""Row numbers and exact percentiles of groups that no task could hold.

``row_number`` over a whole category sorts the category in one task. Here rows are numbered
within stretches of the order (:mod:`quillspark.operators.stretches`), and the counts of a
group's stretches before are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stretches import with_stretches

#: Rows up to which percentiles are one aggregate, which holds a group's distinct values.
ONE_AGGREGATE = 1_000_000
#: Ranks on either side of an approximate percentile that are looked at, as a share of the group.
_NEAR = 1e-3


def numbered(rows: DataFrame, by: list[str], key: Column, rest: list[Column], name: str = "n", per: int | None = None) -> DataFrame:
    """``rows`` with ``name``: 1, 2, ... within each group ``by``, by ``key``, then ``rest`` (nulls first).

    ``per``: rows of a stretch, for tests.
    """
    cols = [F.col(f"`{c}`") for c in rows.columns]
    # a struct: groups with nulls are groups, too
    own = rows.select(F.struct(*cols).alias("__row"), F.struct(F.lit(0).alias("g"), *(F.col(f"`{c}`").alias(f"g{k}") for k, c in enumerate(by))).alias("__by"), key.alias("__k0"), *(c.alias(f"__k{k + 1}") for k, c in enumerate(rest)))
    order = [F.col(f"__k{k}") for k in range(len(rest) + 1)]
    own = with_stretches(own, [F.col("__by"), *order], per=per)
    own = own.withColumn("__n", F.row_number().over(Window.partitionBy("__by", "__stretch").orderBy(*order)))
    counts = own.groupBy("__by", "__stretch").agg(F.count("*").alias("__count"))
    before = F.sum("__count").over(Window.partitionBy("__by").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("__by", "__stretch", F.coalesce(before, F.lit(0)).alias("__before"))
    return own.join(counts, ["__by", "__stretch"]).select("__row.*", (F.col("__n") + F.col("__before")).cast("long").alias(name))


def percentiles(values: DataFrame, by: list[str], value: str, shares: dict[str, float], most: int | None = None) -> DataFrame:
    """Exact percentiles by linear interpolation, and max_value, of each group; nulls do not count.

    A table of more than ``most`` rows (None: ``ONE_AGGREGATE``) is read twice: approximate
    percentiles enclose each rank between two values, then rows below are counted and
    only those between are put in order, equal ones as one.
    """
    v = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    if v.count() <= (ONE_AGGREGATE if most is None else most):
        return v.groupBy(*by).agg(*(F.percentile("__v", F.lit(p)).alias(n) for n, p in shares.items()), F.max("__v").alias("max_value"))
    names = list(shares)
    # a struct: groups with nulls are groups, too
    v = v.select(F.struct(F.lit(0).alias("g"), *(F.col(c).alias(f"g{k}") for k, c in enumerate(by))).alias("__by"), "__v")
    ends = [min(1.0, max(0.0, p + d)) for p in shares.values() for d in (-_NEAR, _NEAR)]
    facts = v.groupBy("__by").agg(F.percentile_approx("__v", ends, F.lit(int(4 / _NEAR))).alias("e"), F.count("*").alias("total"), F.min("__v").alias("least"), F.max("__v").alias("max_value"))
    # at the ends of a group, and in a small one, the least and the largest value enclose
    asks, few = [], F.col("total") < 4 / _NEAR
    for k, p in enumerate(shares.values()):
        low = F.when(few | F.lit(p - _NEAR <= 0), F.col("least")).otherwise(F.col("e")[2 * k])
        high = F.when(few | F.lit(p + _NEAR >= 1), F.col("max_value")).otherwise(F.col("e")[2 * k + 1])
        asks.append(F.struct(F.lit(k).alias("share"), (F.lit(float(p)) * (F.col("total") - 1)).alias("at"), low.alias("low"), high.alias("high")))
    asked = v.join(facts.select("__by", F.array(*asks).alias("asks"), "max_value"), "__by")
    # equal values of a group are one row with a count; what lies below an enclosure is one row
    near = asked.select("__by", "max_value", "__v", F.explode("asks").alias("a")).where(F.col("__v") <= F.col("a.high"))
    near = near.groupBy("__by", "max_value", "a", F.when(F.col("__v") >= F.col("a.low"), F.col("__v")).alias("__v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("__by", "a").orderBy("__v")
    ranks = near.withColumn("last", F.sum("n").over(w) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    holds = lambda x: (F.col("first") <= x) & (x <= F.col("last"))
    at = F.col("a.at")
    found = ranks.groupBy("__by", "max_value", "a").agg(F.max(F.when(holds(F.floor(at)), F.col("__v"))).alias("lo"), F.max(F.when(holds(F.ceil(at)), F.col("__v"))).alias("hi"))
    # a rank outside of its enclosure would be a null below: the approximation's error is bounded, so there is none
    one = F.when(F.col("lo").isNull() | F.col("hi").isNull(), F.raise_error(F.lit("a percentile lies outside of its enclosure"))).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * (at - F.floor(at)))
    wide = found.groupBy("__by", "max_value").agg(*(F.max(F.when(F.col("a.share") == k, one)).alias(n) for k, n in enumerate(names)))
    return wide.select(*(F.col(f"__by.g{k}").alias(c) for k, c in enumerate(by)), *names, "max_value")
