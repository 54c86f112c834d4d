"""Weather providers as tables: every provider may fail on its own, what it misses has a default.

Pages come from the web source in one read, dealt over a bounded number of tasks; a failed
request is a row with its error, so a lake or a provider that fails costs no other one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookup, report
from . import feeds, http

#: Requests under way at once.
FAN_OUT = 3
LABELS = ("today", "one_week_ago", "thirty_days_ago")
STATION = ("avg_temp_today", "avg_monthly_rainfall", "current_monthly_rainfall")

#: Rows (url, status, body, error) of the given URLs.
Fetch = Callable[[list[str]], DataFrame]


@dataclass(frozen=True)
class Places:
    """Where the data is. Each provider may be None: it then counts as failed.

    ``point`` is asked first where there is one: its answer names the forecast's URL.
    """

    forecast: str | None = None
    climate: str | None = None
    station: str | None = None
    normals: str | None = None
    lakes: dict[str, str] = field(default_factory=dict)
    point: str | None = None


def web_fetch(spark: SparkSession, transport: str | None = None, parallel: int = FAN_OUT, timeout: float = 15.0) -> Fetch:
    """Requests through the web source; ``transport`` names a function as ``module:function``."""
    spark.dataSource.register(http.WebSource)

    def fetch(urls: list[str]) -> DataFrame:
        options = {"urls": json.dumps(urls), "parallel": str(parallel), "timeout": str(timeout)}
        if transport:
            options["transport"] = transport
        return spark.read.format("web").options(**options).load()

    return fetch


def body_text(body: Column) -> Column:
    """A body as text; what is no UTF-8 is replaced."""
    return F.try_validate_utf8(F.decode(body, "UTF-8"))


def month_range_url(url: str, today: date) -> str:
    """A station's page for the month so far, in the place of its single day."""
    return re.sub(r"/graph/[^/]+/[^/]+/monthly$", f"/graph/{today:%Y-%m}-01/{today:%Y-%m-%d}/monthly", url)


def lake_targets(spark: SparkSession, today: date) -> DataFrame:
    rows = [(label, today - timedelta(days=d)) for label, d in zip(LABELS, (0, 7, 30))]
    return spark.createDataFrame(rows, "label string, target date")


def lake_readings(pages: DataFrame) -> DataFrame:
    """(series, obs_date, ord, reading_label, value) of the table rows with a label, a date and a percentage; pages: series, html."""
    cells = feeds.html_tables(pages, "series")
    rows = cells.groupBy("series", "table_no", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]).alias("c"))
    rows = rows.where(F.size("c") >= 3).select(
        "series",
        F.try_to_date(F.element_at("c", 2), "yyyy-MM-dd").alias("obs_date"),
        (F.col("table_no") * 1_000_000 + F.col("row_no")).alias("ord"),
        F.element_at("c", 1).alias("reading_label"),
        T.coerce_percent(F.element_at("c", 3)).alias("value"),
    )
    return rows.where("value IS NOT NULL")


def lake_levels(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """(series, label, value): by label, else by date, else the page's percentages from the top, each for the next label that misses one.

    ``pages``: series, html (null: the lake failed, all its values are null).
    """
    named = lookup.labelled_levels(lake_readings(pages), targets, "series").select("series", "label", "value")
    every = pages.select("series").distinct().crossJoin(F.broadcast(targets.select("label")))
    known = every.join(named, ["series", "label"], "left")
    text = F.regexp_extract_all(F.coalesce(T.html_text(None, 0)(F.col("html")), F.lit("")), F.lit(r"(\d{1,3}(?:\.\d+)?)\s*%"), 1)
    shown = pages.groupBy("series").agg(F.min(text).alias("shown"))
    order = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.col("label"))
    wide = known.groupBy("series").agg(F.array_sort(F.collect_list(F.struct(order.alias("at"), "label", "value"))).alias("all")).join(shown, "series")
    # the k-th label without a value has the k-th percentage
    missing = F.transform(F.filter("all", lambda x: x["value"].isNull()), lambda x: x["at"])
    row = wide.select("series", "shown", missing.alias("missing"), F.explode("all").alias("x"))
    turn = F.array_position("missing", F.col("x.at")).cast("int")
    spare = T.coerce_percent(F.try_element_at("shown", F.greatest(turn, F.lit(1))))
    return row.select("series", F.col("x.label").alias("label"), F.coalesce("x.value", F.when(turn > 0, spare)).alias("value"))


def month_rain(station: DataFrame, climate: DataFrame, today: date) -> DataFrame:
    """(station, average, current): the station's own rain of the month comes before the climate page's.

    ``station``: station, html of its page for the month; ``climate``: station, html of the normals. Either may be null.
    """
    first, last = f"{today:%Y-%m}-01", f"{today:%Y-%m-%d}"
    own = station.select("station", feeds.station_rain(T.html_text(None, 0)(F.col("html")), first, last).alias("own"))
    normals = feeds.monthly_normals(feeds.html_tables(climate, "station"), "station", today.month, today.year)
    out = own.join(normals, "station", "full_outer")
    return out.select("station", "average", F.coalesce("own", "current").alias("current"))


def _one(rows: DataFrame, *cols: str) -> dict:
    found = rows.select(*cols).limit(1).collect()
    return found[0].asDict() if found else dict.fromkeys(cols)


def collect_weather(spark: SparkSession, places: Places, fetch: Fetch, today: date, zone: str = "UTC", store: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """The bundle forecast (rows), station (values), lakes (values by lake, in their order) and errors.

    All pages are requested in one read; ``store`` writes it, so no request is made twice. A
    provider that fails, or whose payload cannot be read, has its default and an error.
    """
    station = month_range_url(places.station, today) if places.station else None
    errors: list[str] = []
    forecast_at = places.forecast
    if places.point:
        answer = fetch([places.point]).select(F.from_json(body_text(F.col("body")), "properties struct<forecast: string>")["properties"]["forecast"].alias("url"), "error").first()
        forecast_at = (answer and answer["url"]) or forecast_at
        if not forecast_at:
            errors.append(f"{places.point}: {(answer and answer['error']) or 'no forecast'}")
    urls = {u for u in (forecast_at, places.climate, station, places.normals, *places.lakes.values()) if u}
    got = fetch(sorted(urls))
    got = (store(got) if store else got).select("url", F.when(F.col("error").isNull(), body_text(F.col("body"))).alias("text"), "error")
    page = lambda url, *cols: got.where(F.col("url") == (url or "")).select(*cols)
    errors += [f"{r['url']}: {r['error'] or 'no text'}" for r in got.where("error IS NOT NULL OR text IS NULL").orderBy("url").collect()]

    def tried(name: str, work: Callable, default):
        try:
            return work()
        except Exception as e:  # one provider's failure is its own
            errors.append(f"{name}: {type(e).__name__}")
            return default

    days = spark.createDataFrame([(today + timedelta(days=k),) for k in range(3)], "target date")
    periods = feeds.forecast_periods(page(forecast_at, F.col("text").alias("payload")), zone=zone)
    forecast = tried("forecast", lambda: [r.asDict() for r in lookup.forecast_rows(periods, days).orderBy("date").collect()] if periods.limit(1).count() else [], [])
    high = page(places.climate, F.lit(1).alias("station"), feeds.climate_high(F.col("text")).alias("high"))
    named = lambda url: page(url, F.lit(1).alias("station"), F.col("text").alias("html"))
    merged = lookup.merge_station(high, month_rain(named(station), named(places.normals), today))
    values = tried("station", lambda: _one(merged, *STATION), dict.fromkeys(STATION))
    lakes = {k: dict.fromkeys(LABELS) for k in places.lakes}
    if places.lakes:
        names = spark.createDataFrame(list(places.lakes.items()), "series string, url string")
        pages = names.join(got, "url", "left").select("series", F.col("text").alias("html"))
        for r in tried("lakes", lambda: lake_levels(pages, lake_targets(spark, today)).collect(), []):
            lakes[r["series"]][r["label"]] = r["value"]
    return {"forecast": forecast, "station": {k: v or "Unavailable" for k, v in values.items()}, "lakes": lakes, "errors": errors}


_ROW = ("date", "day", "night", "high", "low", "precip", "wind")


def normalized(bundle) -> dict:
    """A bundle that can be rendered, whatever came: a missing or foreign part has its default, a missing forecast "N/A"."""
    whole = dict(bundle) if isinstance(bundle, dict) else {}
    rows = whole.get("forecast")
    whole["forecast"] = rows if isinstance(rows, list) else [dict.fromkeys(_ROW, "N/A")] * 3
    for part in ("station", "lakes"):
        whole[part] = whole[part] if isinstance(whole.get(part), dict) else {}
    return whole


def station_flags(bundle) -> dict[str, bool]:
    """Of the three station values: any_missing, all_missing, fallback (the high is a forecast's), and partial."""
    station = normalized(bundle)["station"]
    gone = [not station.get(k) or station[k] == "Unavailable" for k in STATION]
    fallback = "fallback)" in str(station.get(STATION[0]) or "")
    return {"any_missing": any(gone), "all_missing": all(gone), "fallback": fallback, "partial": any(gone) or fallback}


def weather_section(spark: SparkSession, bundle, lakes: list[str], heading: str = "Weather Forecast") -> list[str]:
    """The section's lines: three forecast rows, cut or padded, three station rows, and the lakes in their order."""
    whole = normalized(bundle)
    rows = [*whole["forecast"][:3], *[dict.fromkeys(_ROW, "Dynamic")] * (3 - len(whole["forecast"]))]
    cells = [("forecast", k, [str(r.get("label") or r.get("date") or ""), *(r.get(c) for c in _ROW[1:])]) for k, r in enumerate(rows)]
    cells += [("station", k, [name, whole["station"].get(key)]) for k, (name, key) in enumerate(zip(report.STATION_ROWS, STATION))]
    cells += [("lakes", k, [lake, *((whole["lakes"].get(lake) or {}).get(x) for x in LABELS)]) for k, lake in enumerate(lakes)]
    table = spark.createDataFrame(cells, "part string, at int, cells array<string>")
    named = F.when(F.col("part") == "lakes", F.concat(F.array(T.lake_label(F.element_at("cells", 1))), F.slice("cells", 2, 9))).otherwise(F.col("cells"))
    line = F.concat(F.lit("| "), F.array_join(F.transform(named, lambda x: T.present_value(x)), " | "), F.lit(" |"))
    lines: dict[str, list[str]] = {"forecast": [], "station": [], "lakes": []}
    for r in table.select("part", "at", line.alias("line")).orderBy("part", "at").collect():
        lines[r["part"]].append(r["line"])
    return report.weather_lines(lines["forecast"], lines["station"], lines["lakes"], heading)
