"""Nearest-date look-ups, pivots and provider merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import numbered
from .stretches import ROWS, with_stretches

#: Target dates or days that a look-up may broadcast; more are merged with the readings.
MOST_DAYS = 10_000


def _are_few(df: DataFrame) -> bool:
    """Whether each reading may meet every row of a table, which is then broadcast."""
    return df.limit(MOST_DAYS + 1).count() <= MOST_DAYS


def neighbours(points: DataFrame, asks: DataFrame, per: int | None = None) -> DataFrame:
    """``asks`` (g, day, ask) with the points around them: before (the last one up to its day) and after (the next one).

    ``points``: g, day, row (a struct), one for each day of a group g. Each day of a group is looked
    up once, however many asks it has: points and distinct days are put into one order, in stretches
    of bounded size; the last and next points of other stretches are carried over the borders
    by a table that has a row for each group and stretch. No group is gathered in one task. The
    days found are broadcast when they are counted to be few, else joined with the asks by a
    shuffle. Null days have no row.
    """
    kind = points.schema["row"].dataType
    days = asks.where("day IS NOT NULL").select("g", "day").distinct()
    both = points.select("g", "day", F.lit(0).alias("kind"), "row").unionByName(days.select("g", "day", F.lit(1).alias("kind"), F.lit(None).cast(kind).alias("row")))
    n = both.count()
    both = with_stretches(both, [F.col("g"), F.col("day"), F.col("kind")], per=per, n=n)
    near = lambda *order: F.last("row", ignorenulls=True).over(Window.partitionBy("g", "__stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    inside = both.withColumn("before", near("day", "kind")).withColumn("after", near(F.desc("day"), F.desc("kind"))).where("kind = 1")
    if n <= (per or ROWS):
        return asks.join(F.broadcast(inside.select("g", "day", "before", "after")), ["g", "day"])
    own = F.when(F.col("kind") == 0, F.col("day"))
    ends = both.groupBy("g", "__stretch").agg(F.max_by("row", own).alias("last"), F.min_by("row", own).alias("first"))
    to = lambda c, *order: F.last(c, ignorenulls=True).over(Window.partitionBy("g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("g", "__stretch", to("last", "__stretch").alias("__come"), to("first", F.desc("__stretch")).alias("__next"))
    found = inside.join(ends, ["g", "__stretch"]).select("g", "day", F.coalesce("before", "__come").alias("before"), F.coalesce("after", "__next").alias("after"))
    return asks.join(found, ["g", "day"])


def _points(rows: DataFrame, g: Column, day: str, ord: str, kept: list[str]) -> DataFrame:
    """One point for each day of a group: that with the least ``ord``; its row has the columns ``kept``.

    Columns are aggregated one by one, which hashing can do where all have a fixed width; a struct would have all rows sorted.
    """
    least = [F.min_by(c, ord).alias(f"c{k}") for k, c in enumerate(kept)]
    own = rows.where(F.col(day).isNotNull()).groupBy(g.alias("g"), F.col(day).alias("day")).agg(F.min(ord).alias("least"), *least)
    return own.select("g", "day", F.when(F.col("least").isNotNull(), F.struct(*(F.col("day" if c == day else f"c{k}").alias(c) for k, c in enumerate(kept)))).alias("row"))


def asof_merge(readings: DataFrame, targets: DataFrame, key: str = "series", per: int | None = None) -> DataFrame:
    """:func:`asof_levels` for any number of targets, each of one series: ``targets`` has the column ``key``, too.

    Null dates and targets have no row, nor have targets of a series without readings.
    """
    g = F.struct(F.col(key).alias("key"))
    points = _points(readings, g, "obs_date", "ord", ["obs_date", "value"])
    asks = targets.where("target IS NOT NULL").select(g.alias("g"), F.col("target").alias("day"), F.struct("label").alias("ask"))
    found = neighbours(points, asks, per).withColumn("r", F.coalesce("before", "after")).where("r IS NOT NULL")
    return found.select(F.col("g.key").alias(key), F.col("ask.label").alias("label"), F.col("day").alias("target"), F.col("r.obs_date").alias("obs_date"), F.col("r.value").alias("value"))


def spine(days: list, name: str = "target") -> str:
    return ", ".join(f"DATE'{d}'" for d in days)


def asof_levels(readings: DataFrame, targets: DataFrame, key: str = "series") -> DataFrame:
    """For each series and target date the reading that stands for it.

    ``readings``: series, obs_date, ord, value; ``targets``: label, target. The exact
    date wins; else the nearest earlier one; else the nearest at all; ties by ord. With a few
    targets it is a minimum per (series, label), combined before the shuffle, so a long
    series is never sorted; more of them are merged with the readings (:func:`asof_merge`).
    Null dates and targets have no row.
    """
    targets = targets.where("target IS NOT NULL")
    if not _are_few(targets):
        return asof_merge(readings, readings.where("obs_date IS NOT NULL").select(key).distinct().join(targets), key)
    both = readings.where("obs_date IS NOT NULL").crossJoin(F.broadcast(targets))
    rank = F.struct(
        (F.col("obs_date") > F.col("target")).alias("later"),
        F.abs(F.datediff("obs_date", "target")).alias("away"),
        F.col("ord"),
    )
    row = F.struct("obs_date", "value")
    return both.groupBy(key, "label", "target").agg(F.min_by(row, rank).alias("r")).select(key, "label", "target", F.col("r.obs_date").alias("obs_date"), F.col("r.value").alias("value"))


def labelled_levels(readings: DataFrame, targets: DataFrame, key: str = "series") -> DataFrame:
    """:func:`asof_levels`, but a reading whose label names the target comes first (the last such one)."""
    low = F.lower(F.col("reading_label"))
    named = (
        F.when(low.contains("today") | low.contains("current"), F.lit("today"))
        .when(low.contains("week ago") | low.contains("7 day"), F.lit("one_week_ago"))
        .when(low.contains("30 days ago") | low.contains("thirty days ago") | low.contains("1 month ago") | low.contains("30d"), F.lit("thirty_days_ago"))
    )
    by_label = readings.withColumn("label", named).where("label IS NOT NULL").groupBy(key, "label").agg(F.max_by("value", "ord").alias("named"))
    keys = readings.select(key).distinct().join(F.broadcast(targets) if _are_few(targets) else targets)
    dated = asof_levels(readings, targets, key).select(key, "label", "value")
    out = keys.join(by_label, [key, "label"], "left").join(dated, [key, "label"], "left")
    return out.select(key, "label", "target", F.coalesce("named", "value").alias("value"))


def nearest_day(periods: DataFrame, days: DataFrame) -> DataFrame:
    """For each day and slot the period nearest in either direction, the first on ties.

    ``periods``: slot, day, ord and other columns; ``days``: target. Many days are merged
    with the periods instead of meeting each of them. Null days have no row.
    """
    other = [c for c in periods.columns if c not in ("slot", "day", "ord")]
    days = days.where("target IS NOT NULL")
    row = F.struct("day", "ord", *other)
    if not _are_few(days):
        own = periods.where("day IS NOT NULL")
        return nearest_merge(own, own.select("slot").distinct().join(days), "slot").select("target", "slot", "near.*")
    both = periods.where("day IS NOT NULL").crossJoin(F.broadcast(days))
    near = both.groupBy("target", "slot").agg(F.min_by(row, F.struct(F.abs(F.datediff("day", "target")), F.col("ord"))).alias("r"))
    return near.select("target", "slot", "r.*")


def nearest_merge(rows: DataFrame, targets: DataFrame, key: str, day: str = "day", per: int | None = None) -> DataFrame:
    """``targets`` (key, target and others) with near: the row of their key that is nearest in either direction, the least ``ord`` on ties.

    ``rows``: key, day, ord and other columns. Targets of a key without rows have none.
    """
    g = F.struct(F.col(key).alias("key"))
    points = _points(rows, g, day, "ord", [day, "ord", *(c for c in rows.columns if c not in (key, day, "ord"))])
    asks = targets.where("target IS NOT NULL").select(g.alias("g"), F.col("target").alias("day"), F.struct(*(c for c in targets.columns if c not in (key, "target")), F.lit(0).alias("__")).alias("ask"))
    rank = lambda side: F.struct(F.abs(F.datediff(F.col(f"{side}.{day}"), "day")), F.col(f"{side}.ord"))
    earlier = F.col("after").isNull() | (F.col("before").isNotNull() & (rank("before") <= rank("after")))
    found = neighbours(points, asks, per).withColumn("near", F.when(earlier, F.col("before")).otherwise(F.col("after"))).where("near IS NOT NULL")
    return found.select(F.col("g.key").alias(key), F.col("day").alias("target"), "ask.*", "near").drop("__")


def forecast_rows(periods: DataFrame, days: DataFrame) -> DataFrame:
    """A row for each day with day and night columns.

    ``periods``: start (instant), is_day, ord, short, temperature, unit, wind_speed,
    wind_dir, precip. A day's own period wins (the last written), else the nearest.
    """
    p = periods.select(F.to_date("start").alias("day"), F.when(F.col("is_day"), "day").otherwise("night").alias("slot"), "ord", "short", "temperature", "unit", "wind_speed", "wind_dir", "precip")
    row = F.struct("short", "temperature", "unit", "wind_speed", "wind_dir", "precip")
    own = p.groupBy(F.col("day").alias("target"), "slot").agg(F.max_by(row, "ord").alias("own"))
    near = nearest_day(p, days).select("target", "slot", F.struct("short", "temperature", "unit", "wind_speed", "wind_dir", "precip").alias("near"))
    slots = days.crossJoin(F.broadcast(days.sparkSession.createDataFrame([("day",), ("night",)], "slot string")))
    full = slots.join(own, ["target", "slot"], "left").join(near, ["target", "slot"], "left").withColumn("p", F.coalesce("own", "near"))
    wide = full.groupBy("target").pivot("slot", ["day", "night"]).agg(F.first("p"))
    text = lambda c: T.safe_text(c, "Dynamic")
    degrees = lambda v, u: F.when(text(v) == "Dynamic", F.lit("Dynamic")).otherwise(F.concat(text(v), F.lit("°"), F.coalesce(*u, F.lit("F"))))
    speed = T.safe_text(F.col("day.wind_speed"), "")
    wind = F.when((speed != "") & (F.coalesce(F.col("day.wind_dir"), F.lit("")) != ""), F.concat_ws(" ", speed, F.col("day.wind_dir"))).otherwise(speed)
    precip = text(F.col("day.precip"))
    return wide.select(
        F.col("target").alias("date"),
        T.day_label(F.col("target")).alias("label"),
        text(F.col("day.short")).alias("day"),
        F.when(text(F.col("night.short")) != "Dynamic", text(F.col("night.short"))).otherwise(text(F.col("day.short"))).alias("night"),
        degrees(F.col("day.temperature"), [F.col("day.unit")]).alias("high"),
        degrees(F.col("night.temperature"), [F.col("night.unit"), F.col("day.unit")]).alias("low"),
        F.when(precip == "Dynamic", precip).otherwise(F.concat(precip, F.lit("%"))).alias("precip"),
        F.when(wind == "", F.lit("Dynamic")).otherwise(wind).alias("wind"),
    )


def merge_station(climate: DataFrame, monthly: DataFrame) -> DataFrame:
    """Normal high and rainfall of each station, formatted; equal rainfall is shown once.

    ``climate``: station, high; ``monthly``: station, average, current. Either may miss
    a station; what is missing is "Unavailable".
    """
    both = climate.join(monthly, "station", "full_outer")
    inches = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.col(c).cast("string"), F.lit(" Inches")))
    both = both.select("station", F.when(F.col("high").isNotNull(), F.concat(F.col("high").cast("string"), F.lit("°F"))).alias("t"), inches("average").alias("a"), inches("current").alias("c"))
    current = F.when(F.col("a").eqNullSafe(F.col("c")), F.lit(None)).otherwise(F.col("c"))
    none = F.lit("Unavailable")
    return both.select("station", F.coalesce("t", none).alias("avg_temp_today"), F.coalesce("a", none).alias("avg_monthly_rainfall"), F.coalesce(current, none).alias("current_monthly_rainfall"))


def keep_newest(files: DataFrame, most: int) -> DataFrame:
    """``files`` (kind, name, mtime) with rank and expired: all but the newest ``most`` of each kind; no time is oldest."""
    at = F.unix_micros("mtime") if dict(files.dtypes)["mtime"].startswith("timestamp") else F.col("mtime").cast("double")
    newest = F.coalesce(-at, F.lit((1 << 63) - 1))
    return numbered(files, ["kind"], newest, [F.col("name")], "rank").withColumn("expired", F.col("rank") > most)


def next_version(files: DataFrame, prefix: str) -> DataFrame:
    """One row: the version after the largest one of the files that start with ``prefix``."""
    own = files.where(F.col("name").startswith(prefix) & F.col("name").endswith(".md"))
    v = F.regexp_extract("name", r"_v(\d+)\.md$", 1).try_cast("int")
    return own.agg((F.coalesce(F.max(v), F.lit(0)) + 1).alias("version")).withColumn("label", F.lpad(F.col("version").cast("string"), 2, "0"))
