import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.operators import dedup, lookup, stretches
from quillspark.operators.numbering import numbered, percentiles

from .test_dedup import NOW


def rows(seed=1, n=400):
    rng = random.Random(seed)
    return [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, *range(20)]), rng.random()) for k in range(n)]


def test_numbers_within_groups(spark):
    data = rows()
    df = spark.createDataFrame(data, "id long, g string, k int, v double").repartition(5)
    got = {r["id"]: r["n"] for r in numbered(df, ["g"], F.col("k"), [F.col("id")]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
    assert numbered(df.limit(0), ["g"], F.col("k"), []).count() == 0


def test_percentiles_are_exact(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "id long, g string, k int, v double")
    for r in percentiles(df, ["g"], "v", {"lo": 0.05, "mid": 0.5, "hi": 0.99}).collect():
        own = [x[3] for x in data if x[1] == r["g"]]
        assert np.allclose([r["lo"], r["mid"], r["hi"]], np.percentile(own, [5, 50, 99])) and r["max_value"] == max(own)
    one = spark.createDataFrame([("x", 3.0), ("x", None)], "g string, v double")
    assert [tuple(r) for r in percentiles(one, ["g"], "v", {"p": 0.5}).collect()] == [("x", 3.0, 3.0)]


def test_caps_of_any_size(spark):
    n, cap = 12_000, 11_000
    cats = spark.createDataFrame([("a", 0, 24, 24, cap)], "category string, cat_pos int, age_limit_h int, window_h int, cap int")
    c = spark.range(n).select(F.lit("a").alias("category"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("title"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("norm"), F.lit(NOW).cast("timestamp").alias("pub_dt"), F.col("id").alias("row_id"))
    assert dedup.feed_dedup(c, cats, NOW).count() == cap
    assert dedup.feed_dedup_stats(c, cats, NOW).first()["total_after"] == cap
    assert dedup.feed_dedup(c, cats.withColumn("cap", F.lit(0)), NOW).count() == 9999


@pytest.mark.parametrize("hot", [None, "group", "key", "null", "one"])
def test_stretches_cut_what_most_rows_share(spark, hot):
    rng = random.Random(3)
    n, per = 6000, 250
    group = lambda k: "hot" if hot and rng.random() < 0.9 else rng.choice(["a", "b", None])
    key = lambda k: 7 if hot == "key" else None if hot == "null" else rng.randrange(1000)
    data = [(k, "hot" if hot == "one" else group(k), key(k), rng.random()) for k in range(n)]
    df = spark.createDataFrame(data, "id long, g string, k int, v double").repartition(6)
    got = numbered(df, ["g"], F.col("k"), [F.col("v")], per=per)
    found = {r["id"]: r["n"] for r in got.collect()}
    for g in {r[1] for r in data}:
        own = sorted((r for r in data if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[3]))
        assert [found[r[0]] for r in own] == list(range(1, len(own) + 1))
    cut = stretches.with_stretches(df, [F.col("g"), F.col("k"), F.col("v")], per=per).groupBy("__stretch").count().collect()
    sizes = sorted(r["count"] for r in cut)
    assert len(sizes) > n / per / 2 and sizes[-1] <= 3 * sizes[len(sizes) // 2]


def test_no_task_holds_a_hot_group(spark):
    """All rows have one group: stages that sort or number them get shares of about one size."""
    from pyspark import TaskContext

    def size(frames):
        n = sum(len(f) for f in frames)
        yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n]})

    df = spark.range(40_000).select("id", F.lit("hot").alias("g"), F.lit(None).cast("int").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = numbered(df, ["g"], F.col("k"), [F.col("id")], per=400)
        sizes = sorted(r["n"] for r in got.mapInPandas(size, "part int, n long").collect() if r["n"])
        assert got.where("n <> id + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(sizes) == 16 and sizes[-1] <= 2 * sizes[8]


@pytest.mark.parametrize("shape", ["spread", "ties", "hot", "few"])
def test_large_percentiles_are_exact(spark, shape):
    rng = random.Random(4)
    value = {"spread": lambda: rng.gauss(0, 10), "ties": lambda: float(rng.randrange(4)), "hot": lambda: 5.0 if rng.random() < 0.7 else rng.random() * 9, "few": lambda: rng.random()}[shape]
    n = 9 if shape == "few" else 8000
    data = [(rng.choice(["a", "a", "b", None]), value()) for _ in range(n)] + [("one", 2.5), ("a", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    asked = {"zero": 0.0, "low": 0.0004, "mid": 0.5, "p95": 0.95, "p99": 0.99, "top": 1.0}
    for most in (0, None):
        rows = percentiles(df, ["g"], "v", asked, most=most).collect()
        assert {r["g"] for r in rows} == {g for g, _ in data}
        for r in rows:
            own = [v for g, v in data if g == r["g"] and v is not None]
            assert np.allclose([r[c] for c in asked], np.percentile(own, [100 * p for p in asked.values()])) and r["max_value"] == max(own)
    assert percentiles(df.limit(0), ["g"], "v", asked, most=-1).count() == 0


def series(rng, n, names=("a", "a", "a", "b", None)):
    start = date(2024, 1, 1)
    rows = [(rng.choice(names), start + timedelta(days=rng.randrange(90)) if rng.random() > 0.05 else None, k, float(k)) for k in range(n)]
    return rows + [("late", date(2030, 1, 1), n, -1.0)]


@pytest.mark.parametrize("seed", range(4))
def test_merged_targets_equal_those_looked_up_one_by_one(spark, seed):
    rng = random.Random(seed)
    readings = series(rng, rng.choice([0, 40, 900]))
    days = [date(2023, 12, 20) + timedelta(days=rng.randrange(130)) for _ in range(60)]
    targets = [(rng.choice(["a", "b", None, "late", "none"]), f"t{k}", d) for k, d in enumerate(days)] + [("a", "null", None)]
    r = spark.createDataFrame(readings, "series string, obs_date date, ord long, value double").repartition(4)
    t = spark.createDataFrame(targets, "series string, label string, target date")
    got = {x["label"]: (x["series"], x["target"], x["obs_date"], x["value"]) for x in lookup.asof_merge(r, t, per=37).collect()}
    near = {x["label"]: (x["near"]["obs_date"], x["near"]["value"]) for x in lookup.nearest_merge(r, t, "series", "obs_date", per=37).collect()}
    expected, nearest = {}, {}
    for s, label, d in targets:
        own = [x for x in readings if x[0] == s and x[1] is not None]
        if own and d:
            best = min(own, key=lambda x: (x[1] > d, abs((x[1] - d).days), x[2]))
            expected[label] = (s, d, best[1], best[3])
            best = min(own, key=lambda x: (abs((x[1] - d).days), x[2]))
            nearest[label] = (best[1], best[3])
    assert got == expected and near == nearest


def test_look_ups_of_many_targets_are_merged(spark, monkeypatch):
    rng = random.Random(9)
    r = spark.createDataFrame(series(rng, 300), "series string, obs_date date, ord long, value double")
    t = spark.createDataFrame([(f"t{k}", date(2024, 1, 1) + timedelta(days=3 * k)) for k in range(20)] + [("null", None)], "label string, target date")
    p = r.select(F.coalesce("series", F.lit("x")).alias("slot"), F.col("obs_date").alias("day"), "ord", "value")
    rows = lambda df: sorted(map(str, df.collect()))
    few = [rows(lookup.asof_levels(r, t)), rows(lookup.nearest_day(p, t.select("target")).select("target", "slot", "day", "ord", "value")), rows(lookup.labelled_levels(r.withColumn("reading_label", F.lit("")), t))]
    monkeypatch.setattr(lookup, "MOST_DAYS", 2)
    merged = lookup.asof_merge(r, t.withColumn("series", F.lit("a")))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in merged and "NestedLoop" not in merged
    assert [rows(lookup.asof_levels(r, t)), rows(lookup.nearest_day(p, t.select("target")).select("target", "slot", "day", "ord", "value")), rows(lookup.labelled_levels(r.withColumn("reading_label", F.lit("")), t))] == few


def many_targets(spark, monkeypatch):
    """Readings, 3000 targets on five days, and a list of the numbers of rows that are put into stretches."""
    counted, own = [], lookup.with_stretches
    monkeypatch.setattr(lookup, "with_stretches", lambda rows, *a, **b: counted.append(rows.count()) or own(rows, *a, **b))
    readings = [("a", date(2024, 1, 1) + timedelta(days=k % 40), 200 - k, float(k)) for k in range(200)]
    targets = [("a", k, date(2023, 12, 30) + timedelta(days=11 * (k % 5))) for k in range(3000)]
    r = spark.createDataFrame(readings, "series string, obs_date date, ord long, value double")
    return readings, targets, r, spark.createDataFrame(targets, "series string, label long, target date"), counted


def test_nearest_merge_looks_a_day_up_once(spark, monkeypatch):
    readings, targets, r, t, counted = many_targets(spark, monkeypatch)
    near = lookup.nearest_merge(r, t, "series", "obs_date")
    assert counted == [45] and "SortAggregate" not in near._jdf.queryExecution().executedPlan().toString()
    by_day = {d: min(readings, key=lambda x: (abs((x[1] - d).days), x[2])) for _, _, d in targets}
    for df in (near, lookup.nearest_merge(r, t, "series", "obs_date", per=7)):
        assert {x["label"]: (x["target"], x["near"]["obs_date"], x["near"]["ord"], x["near"]["value"]) for x in df.collect()} == {k: (d, *by_day[d][1:]) for _, k, d in targets}


def test_asof_merge_looks_a_day_up_once(spark, monkeypatch):
    readings, targets, r, t, counted = many_targets(spark, monkeypatch)
    merged = lookup.asof_merge(r, t)
    assert counted == [45] and "SortAggregate" not in merged._jdf.queryExecution().executedPlan().toString()
    by_day = {d: min(readings, key=lambda x: (x[1] > d, abs((x[1] - d).days), x[2])) for _, _, d in targets}
    for df in (merged, lookup.asof_merge(r, t, per=7)):
        assert {x["label"]: (x["target"], x["obs_date"], x["value"]) for x in df.collect()} == {k: (d, by_day[d][1], by_day[d][3]) for _, k, d in targets}


def test_asof_merge_does_not_grow_with_copies(spark, monkeypatch):
    """Copies of both tables with shifted keys fall on the same days: as many rows are put into stretches, no target is shuffled."""
    readings, targets, r, t, counted = many_targets(spark, monkeypatch)
    copies = spark.range(4).select(F.col("id").alias("copy"))
    r = r.crossJoin(copies).select("series", "obs_date", (F.col("ord") + 1000 * F.col("copy")).alias("ord"), (F.col("value") + 1000 * F.col("copy")).alias("value"))
    t = t.crossJoin(copies).select("series", (F.col("label") + 3000 * F.col("copy")).alias("label"), "target")
    merged = lookup.asof_merge(r, t)
    assert counted == [45] and "SortMergeJoin" not in merged._jdf.queryExecution().executedPlan().toString()
    by_day = {d: min(readings, key=lambda x: (x[1] > d, abs((x[1] - d).days), x[2])) for _, _, d in targets}
    assert {x["label"]: (x["target"], x["obs_date"], x["value"]) for x in merged.collect()} == {k + 3000 * c: (d, by_day[d][1], by_day[d][3]) for _, k, d in targets for c in range(4)}
