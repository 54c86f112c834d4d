"""Feed deduplication: age limit, first-wins within and across categories, adaptive widening and caps.

Candidates have category, title, norm (the title's identity), pub_dt (null: undated)
and a unique row_id; within a category they rank newest first, undated last, then by
row_id. Categories have category, cat_pos, age_limit_h, window_h and cap.

A title's first row of each category decides (a minimum per group, combined before the
shuffle). Whether an age band is reached depends on few counts per category and band,
so no window ever spans a whole category; caps keep a few rows of each task first.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .numbering import numbered

#: A category with fewer accepted stories is widened, by at most so many days.
ENOUGH, MOST_DAYS, NO_CAP = 3, 7, 9999
#: Categories that are broadcast at most.
FEW = 100_000


def age_hours(pub_dt: Column, now: datetime) -> Column:
    micros = int((now - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    return (F.lit(micros) - F.unix_micros(pub_dt)) / F.lit(3_600_000_000.0)


def within_age(pub_dt: Column, limit_h: Column | int, now: datetime) -> Column:
    """Undated and future rows stay; exactly the limit stays."""
    return pub_dt.isNull() | (age_hours(pub_dt, now) <= limit_h)


def pool(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` rows of each category, undated last."""
    w = Window.partitionBy("category").orderBy(F.col("pub_dt").desc_nulls_last(), "row_id")
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def small(categories: DataFrame) -> DataFrame:
    """The categories, to be broadcast when they are counted to be few."""
    return F.broadcast(categories) if categories.limit(FEW + 1).count() <= FEW else categories


def with_bands(candidates: DataFrame, categories: DataFrame, now: datetime) -> DataFrame:
    """Adds the category's settings, age_h, bad (filtered titles) and band (0: within the limit, else days, 2 at least)."""
    bad = T.is_obituary(F.col("title")) | T.is_real_estate(F.col("title"))
    c = candidates.join(categories, "category").withColumns({"age_h": age_hours(F.col("pub_dt"), now), "bad": bad})
    return c.withColumn("band", F.expr("CAST(CASE WHEN age_h IS NULL OR age_h <= age_limit_h THEN 0 ELSE greatest(2, ceil(age_h / 24)) END AS INT)"))


def _order() -> list[Column]:
    # newest first; undated rows have the largest key
    return [F.col("band"), F.expr(f"coalesce(-unix_micros(pub_dt), {(1 << 63) - 1}L) AS k"), F.col("row_id")]


def leaders(banded: DataFrame) -> DataFrame:
    """The first row of each title of a category."""
    row = F.struct(*(F.col(c) for c in banded.columns if c not in ("category", "norm")))
    first = banded.groupBy("category", "norm").agg(F.min_by(row, F.struct(*_order())).alias("r"))
    return first.select("category", "norm", "r.*")


#: Bands that can be reached.
_BANDS = (0, *range(2, MOST_DAYS + 1))


def _reach(first: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, reach): of each of ``_BANDS`` whether it counts; one count per category and band decides."""
    ok = first.where("NOT bad").groupBy("category").agg(F.expr(f"array({', '.join(f'count_if(band = {b})' for b in _BANDS)})").alias("ok"))
    # band after band, while fewer than ENOUGH stories came before
    before = "aggregate(slice(ok, 1, i), 0L, (n, x) -> n + x)"
    reach = f"transform(array({', '.join(map(str, _BANDS))}), (b, i) -> b = 0 OR (coalesce({before}, 0) < {ENOUGH} AND b <= least(floor(window_h / 24), {MOST_DAYS}))) AS reach"
    return categories.select("category", "window_h").join(ok, "category", "left").selectExpr("category", reach)


def _reached(band: str) -> str:
    """Whether a band counts, by the array of :func:`_reach`, where its place is one less but for 0."""
    return f"coalesce(get(reach, CASE WHEN {band} = 0 THEN 0 ELSE {band} - 1 END), false)"


def reached_bands(first: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, band) that count: band 0, and day bands while fewer than ENOUGH stories came before."""
    return _reach(first, categories).selectExpr("category", f"explode(filter(array({', '.join(map(str, _BANDS))}), b -> {_reached('b')})) AS band")


def accepted(first: DataFrame, categories: DataFrame) -> DataFrame:
    """Leaders that are not filtered and whose band is reached."""
    return first.where("NOT bad").join(_few(_reach(first, categories), categories), "category").where(_reached("band")).drop("reach")


def _few(reach: DataFrame, categories: DataFrame) -> DataFrame:
    """As many rows as there are categories: broadcast if they are."""
    return F.broadcast(reach) if "ResolvedHint" in categories._jdf.queryExecution().analyzed().nodeName() else reach


def largest_cap(categories: DataFrame) -> int:
    """The largest cap that counts; categories are a small table."""
    return categories.agg(F.max(F.when(F.col("cap") > 0, F.col("cap")).otherwise(F.lit(NO_CAP)))).first()[0] or NO_CAP


def capped(rows: DataFrame, most: int | None = None) -> DataFrame:
    """At most ``cap`` rows of each category (0 or less: NO_CAP), freshest band first.

    ``most`` is an upper bound of all caps, as :func:`largest_cap` finds it: as a literal it
    lets each task keep only its own first rows before the shuffle.
    """
    w = Window.partitionBy("category").orderBy(*_order())
    ranked = rows.withColumn("k", F.row_number().over(w))
    return (ranked if most is None else ranked.where(f"k <= {most}")).where(f"k <= CASE WHEN cap > 0 THEN cap ELSE {NO_CAP} END")


def across_categories(rows: DataFrame) -> DataFrame:
    """Of equal titles the one of the first category stays; its place is not filled again."""
    cols = rows.columns
    row = F.struct(*(F.col(c) for c in cols if c != "norm"))
    first = rows.groupBy("norm").agg(F.min_by(row, F.struct("cat_pos", *_order())).alias("r"))
    return first.select("norm", "r.*").select(*cols)


def feed_dedup(candidates: DataFrame, categories: DataFrame, now: datetime, most: int | None = None) -> DataFrame:
    """The whole operator; result rows keep the candidates' columns, band and k (rank within the category)."""
    most = largest_cap(categories) if most is None else most
    categories = small(categories)
    first = leaders(with_bands(candidates, categories, now))
    return across_categories(capped(accepted(first, categories), most))


def _counted_titles(candidates: DataFrame, categories: DataFrame, now: datetime) -> DataFrame:
    """Each title's first row in its category with the counts of its rows by band, and the bands that are reached."""
    banded = with_bands(candidates, categories, now)
    row = F.struct(*(F.col(c) for c in banded.columns if c not in ("category", "norm")))
    counts = [f"count_if({x}) AS {name}" for x, name in (("true", "__n"), ("age_h > age_limit_h", "__aged"))]
    counts += [f"array({', '.join(f'count_if(band = {b}{also})' for b in _BANDS)}) AS {name}" for also, name in (("", "__ns"), (" AND NOT bad", "__goods"))]
    titles = banded.groupBy("category", "norm").agg(F.min_by(row, F.struct(*_order())).alias("r"), *map(F.expr, counts))
    # always true: both readers of the titles ask for the same columns, so that one exchange serves both
    titles = titles.where("__n + __aged + aggregate(concat(__ns, __goods), 0L, (n, x) -> n + x) > 0")
    return titles.select("category", "norm", "r.*", "__n", "__aged", "__ns", "__goods").join(_few(_reach(titles.select("category", "r.*"), categories), categories), "category")


def _title_counters() -> list[Column]:
    """Aggregates over :func:`_counted_titles`: total_before, age_filtered, dup_filtered.

    A band's copies count but the leader's row; filtered titles only where the title has a fresh row.
    """
    n = "CASE WHEN __ns[0] > 0 OR i = 0 THEN __ns[i] ELSE __goods[i] END"
    lead = f"CASE WHEN i = CASE WHEN band = 0 THEN 0 ELSE band - 1 END AND {n} > 0 THEN 1 ELSE 0 END"
    copies = f"aggregate(sequence(0, {len(_BANDS) - 1}), 0L, (acc, i) -> acc + CASE WHEN reach[i] THEN {n} - {lead} ELSE 0 END)"
    return [F.expr(f"coalesce(sum({c}), 0L) AS {name}") for c, name in (("__n", "total_before"), ("__aged", "age_filtered"), (copies, "dup_filtered"))]


def _kept_of(titles: DataFrame) -> DataFrame:
    return titles.where(f"NOT bad AND {_reached('band')}").drop("reach", "__n", "__aged", "__ns", "__goods")


class Counters:
    """Counters that a plan made while it ran; :meth:`get` after an action of it."""

    def __init__(self):
        self.seen = [Observation() for _ in range(3)]

    def get(self) -> dict[str, int]:
        before, kept, after = (o.get for o in self.seen)
        return {**before, **after, "cross_dup_filtered": kept["kept"] - after["total_after"]}


def feed_dedup_observed(candidates: DataFrame, categories: DataFrame, now: datetime, most: int | None = None) -> tuple[DataFrame, Counters]:
    """:func:`feed_dedup` and the counters of :func:`feed_dedup_stats`, both from one execution of one plan.

    Counters are those of the first action that runs the plan to its end; work that is done twice
    because an executor was lost counts twice in them, but never in the rows.
    """
    most = largest_cap(categories) if most is None else most
    out = Counters()
    titles = _counted_titles(candidates, small(categories), now).observe(out.seen[0], *_title_counters())
    kept = capped(_kept_of(titles), most).observe(out.seen[1], F.count(F.lit(1)).alias("kept"))
    return across_categories(kept).observe(out.seen[2], F.count(F.lit(1)).alias("total_after")), out


def feed_dedup_stats(candidates: DataFrame, categories: DataFrame, now: datetime, most: int | None = None) -> DataFrame:
    """One row: total_before, total_after, age_filtered, dup_filtered, cross_dup_filtered.

    Filtered titles and rows beyond a cap are in no counter; rows that widening
    recovers stay counted as age-filtered. The candidates are read and cleaned once: all
    counters follow from one aggregate for each title of a category, whose exchange
    the plan reuses.
    """
    most = largest_cap(categories) if most is None else most
    titles = _counted_titles(candidates.select("category", "title", "norm", "pub_dt", "row_id"), small(categories), now)
    keep = capped(_kept_of(titles), most)
    after = keep.agg(F.count("*").alias("kept"), F.count_distinct("norm").alias("total_after"))
    part = titles.agg(*_title_counters()).crossJoin(F.broadcast(after))
    return part.select("total_before", "total_after", "age_filtered", "dup_filtered", (F.col("kept") - F.col("total_after")).alias("cross_dup_filtered"))


def with_settings(rows: DataFrame, settings: DataFrame, key: str, defaults: dict) -> DataFrame:
    """``rows`` with the settings of their ``key``, or the defaults; settings are a small table, which is counted."""
    own = small(settings.select(key, *defaults))
    return rows.drop(*defaults).join(own, key, "left").select(*(c for c in rows.columns if c not in defaults), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))


def sections(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` by category: place within it, from 1 by ``order`` (a number or instant), and n, its size. Rows without a category are in none."""
    own = rows.where("category IS NOT NULL")
    placed = numbered(own, ["category"], F.col(order), [], "place")
    return placed.join(small(own.groupBy("category").agg(F.count("*").alias("n"))), "category")


def priority_order(categories: DataFrame, priority: list[str]) -> DataFrame:
    """(category, place): categories of the priority list in its order, the rest by cat_pos."""
    at = F.nullif(F.array_position(F.array(*(F.lit(p) for p in priority)), F.col("category")), F.lit(0))
    w = Window.orderBy(F.coalesce(at, F.lit(1_000_000_000)), "cat_pos")
    return categories.withColumn("place", F.row_number().over(w))
