"""Feed deduplication against a sequential model on random inputs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import dedup

NOW = datetime(2026, 7, 30, 14)


def model(cands, cats, now):
    """The same rules as a loop: kept row ids in order, and the counters."""
    stats = dict(total_before=len(cands), age_filtered=0, dup_filtered=0, cross_dup_filtered=0)
    bad = lambda t: "obituary" in t.lower() or "$" in t
    kept = []
    for cat, _, age, window, cap in sorted(cats, key=lambda c: c[1]):
        rows = sorted((c for c in cands if c[1] == cat), key=lambda c: (c[3] is None, -(c[3] or now).timestamp(), c[0]))
        seen, own = set(), []
        hours = lambda c: None if c[3] is None else (now - c[3]).total_seconds() / 3600
        for c in rows:
            if hours(c) is not None and hours(c) > age:
                stats["age_filtered"] += 1
                continue
            key = c[2].strip().lower()
            if key in seen:
                stats["dup_filtered"] += 1
                continue
            seen.add(key)
            if not bad(c[2]):
                own.append(c)
        low, day = age, 2
        while len(own) < 3 and day <= min(window // 24, 7):
            for c in rows:
                if hours(c) is None or not low < hours(c) <= day * 24:
                    continue
                key = c[2].strip().lower()
                if key in seen:
                    stats["dup_filtered"] += 1
                elif not bad(c[2]):
                    seen.add(key)
                    own.append(c)
            low, day = day * 24, day + 1
        kept += own[: cap if cap > 0 else 9999]
    out, seen = [], set()
    for c in kept:
        key = c[2].strip().lower()
        if key in seen:
            stats["cross_dup_filtered"] += 1
        else:
            seen.add(key)
            out.append(c[0])
    stats["total_after"] = len(out)
    return out, stats


def frames(spark, cands, cats):
    c = spark.createDataFrame(cands, "row_id long, category string, title string, pub_dt timestamp").withColumn("norm", T.title_key(F.col("title")))
    return c, spark.createDataFrame(cats, "category string, cat_pos int, age_limit_h int, window_h int, cap int")


def test_random_feeds(spark):
    rng = random.Random(7)
    for _ in range(6):
        cats = [(f"c{k}", k, rng.choice([8, 24, 48]), rng.choice([24, 72, 168]), rng.choice([0, 2, 5])) for k in range(3)]
        titles = ["Alpha", " alpha", "Beta", "Gamma", "Delta $5", "Old obituary", "Epsilon", "Zeta", "Eta"]
        cands = []
        for i in range(rng.randint(0, 60)):
            when = None if rng.random() < 0.1 else NOW - timedelta(minutes=rng.randint(-60, 200 * 60))
            cands.append((i, f"c{rng.randint(0, 2)}", rng.choice(titles), when))
        expected, stats = model(cands, cats, NOW)
        c, k = frames(spark, cands, cats)
        got = [r["row_id"] for r in dedup.feed_dedup(c, k, NOW).collect()]
        assert sorted(got) == sorted(expected)
        assert dedup.feed_dedup_stats(c, k, NOW).first().asDict() == stats
        rows, counters = dedup.feed_dedup_observed(c, k, NOW)
        assert sorted(r["row_id"] for r in rows.collect()) == sorted(expected)
        assert counters.get() == stats


def test_many_categories_are_not_broadcast(spark, monkeypatch):
    cats = [(f"c{k}", k, 24, 72, 2) for k in range(6)]
    cands = [(i, f"c{i % 6}", f"title {i % 11}", NOW - timedelta(hours=i)) for i in range(80)]
    expected, stats = model(cands, cats, NOW)
    monkeypatch.setattr(dedup, "FEW", 3)
    c, k = frames(spark, cands, cats)
    assert "BroadcastHint" not in dedup.small(k)._jdf.queryExecution().toString() and dedup.small(k.limit(2)) is not k
    assert sorted(r["row_id"] for r in dedup.feed_dedup(c, k, NOW).collect()) == sorted(expected)
    assert dedup.feed_dedup_stats(c, k, NOW).first().asDict() == stats


def test_limits(spark):
    cats = [("news", 0, 24, 168, 0)]
    rows = [(1, "news", "exactly", NOW - timedelta(hours=24)), (2, "news", "future", NOW + timedelta(hours=3)), (3, "news", "undated", None), (4, "news", "old", NOW - timedelta(days=10))]
    c, k = frames(spark, rows, cats)
    assert sorted(r["row_id"] for r in dedup.feed_dedup(c, k, NOW).collect()) == [1, 2, 3]


def test_cap_is_not_refilled_across_categories(spark):
    cats = [("a", 0, 24, 24, 1), ("b", 1, 24, 24, 1)]
    rows = [(1, "a", "Same", NOW), (2, "b", "same", NOW), (3, "b", "Other", NOW - timedelta(hours=1))]
    c, k = frames(spark, rows, cats)
    assert [r["row_id"] for r in dedup.feed_dedup(c, k, NOW).collect()] == [1]
