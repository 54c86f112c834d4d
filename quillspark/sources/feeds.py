"""Feeds and providers: URLs, XML and JSON payloads, HTML tables."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T

RSS_BASE = "https://news.google.com/rss/search?q="
RSS_PARAMS = "&hl=en-US&gl=US&ceid=US:en"

_ITEM = "title string, link string, description string, summary string, pubDate string, published string, updated string"


def feed_url(query: Column, base: str = RSS_BASE, params: str = RSS_PARAMS) -> Column:
    return F.concat(F.lit(base), F.url_encode(query), F.lit(params))


def feed_url_with_window(query: Column, hours: Column, base: str = RSS_BASE, params: str = RSS_PARAMS) -> Column:
    """The age window goes to the source: whole days, rounded up."""
    days = F.ceil(hours / 24).cast("string")
    return feed_url(F.concat(F.lit("when:"), days, F.lit("d "), query), base, params)


def read_feed_files(spark: SparkSession, path: str, item: str = "item") -> DataFrame:
    """Items of RSS files, with the file they come from."""
    return spark.read.format("xml").option("rowTag", item).schema(_ITEM).load(path).withColumn("source_file", F.input_file_name())


_DOCUMENT = f"channel struct<item: array<struct<{_ITEM.replace(' string', ': string')}>>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(text, source_file): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("source_file"))


def feed_items(pages: DataFrame, text: str = "text") -> DataFrame:
    """The items of RSS documents that were fetched, with the other columns; what is no such document, or null, has none."""
    keep = [c for c in pages.columns if c != text]
    parsed = F.from_xml(F.col(text), F.lit(_DOCUMENT), {"rowTag": "rss", "mode": "PERMISSIVE"})
    return pages.where(F.col(text).isNotNull()).withColumn("__d", parsed).select(*keep, F.inline("__d.channel.item"))


def feed_entries(items: DataFrame, category: Column, zone: str = "UTC", limit: int = 50) -> DataFrame:
    """Entries (category, title, link, snippet, pub_dt, pos) of raw items: no blank titles, newest first, at most ``limit``.

    A missing link is "#"; undated entries come last; ``pos`` counts from 0 within the category.
    """
    raw = items.withColumn("row", F.monotonically_increasing_id())
    e = raw.select(
        category.alias("category"),
        T.strip_html(F.col("title")).alias("title"),
        F.coalesce(F.nullif(T.strip(F.col("link")), F.lit("")), F.lit("#")).alias("link"),
        T.strip_html(F.coalesce("summary", "description")).alias("snippet"),
        T.parse_feed_date(F.coalesce("published", "pubDate"), F.col("updated"), zone).alias("pub_dt"),
        "row",
    ).where("title <> ''")
    w = Window.partitionBy("category").orderBy(F.col("pub_dt").desc_nulls_last(), "row")
    return e.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).withColumn("pos", F.col("n") - 1).drop("n", "row")


_PERIODS = (
    "struct<properties:struct<periods:array<struct<startTime:string,isDaytime:boolean,temperature:string,temperatureUnit:string,"
    "shortForecast:string,windSpeed:string,windDirection:string,probabilityOfPrecipitation:struct<value:string>>>>>"
)


def forecast_periods(payloads: DataFrame, json: str = "payload", zone: str = "UTC") -> DataFrame:
    """One row for each period of JSON forecasts; what is no such JSON gives none.

    A period whose precipitation object is null empties its whole forecast.
    """
    p = payloads.withColumn("__p", F.from_json(json, _PERIODS)["properties"]["periods"])
    p = p.where(F.coalesce(F.forall("__p", lambda x: x["probabilityOfPrecipitation"].isNotNull()), F.lit(False)))
    keep = [c for c in payloads.columns if c != json]
    p = p.select(*keep, F.posexplode("__p").alias("ord", "x"))
    return p.select(
        *keep,
        "ord",
        T.parse_period_time(F.col("x.startTime"), zone).alias("start"),
        F.coalesce("x.isDaytime", F.lit(False)).alias("is_day"),
        F.col("x.shortForecast").alias("short"),
        F.col("x.temperature").alias("temperature"),
        F.col("x.temperatureUnit").alias("unit"),
        F.col("x.windSpeed").alias("wind_speed"),
        F.col("x.windDirection").alias("wind_dir"),
        F.col("x.probabilityOfPrecipitation.value").alias("precip"),
    ).where("start IS NOT NULL")


def climate_high(json: Column) -> Column:
    """The first daily maximum, rounded half to even."""
    return F.bround(F.try_element_at(F.from_json(json, "struct<daily:struct<temperature_2m_max:array<double>>>")["daily"]["temperature_2m_max"], F.lit(1))).cast("int")


def json_or_null(c: Column) -> Column:
    """The text if it is JSON of any type, else null."""
    return F.when(F.try_parse_json(c).isNotNull(), c)


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[int, int, int, str]] = []
        self.table, self.row, self.col, self.cell = -1, -1, -1, None

    def _close(self):
        if self.cell is not None:
            self.rows.append((self.table, self.row, self.col, " ".join(" ".join(self.cell).split())))
            self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._close()
            self.table, self.row = self.table + 1, -1
        elif tag == "tr":
            self._close()
            self.row, self.col = self.row + 1, -1
        elif tag in ("td", "th"):
            self._close()
            self.col, self.cell = self.col + 1, []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()

    def handle_data(self, data):
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())


def table_cells(html: str | None) -> list[tuple[int, int, int, str]]:
    p = _Tables()
    p.feed(html or "")
    p.close()
    p._close()
    return p.rows


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table_no, row_no, col_no, text) of all cells of all tables."""

    @F.pandas_udf("array<struct<table_no:int,row_no:int,col_no:int,text:string>>")
    def cells(h: pd.Series) -> pd.Series:
        return h.map(lambda x: [{"table_no": a, "row_no": b, "col_no": c, "text": t} for a, b, c, t in table_cells(x)])

    return pages.select(key, F.inline(cells(F.col(html))))


def monthly_normals(cells: DataFrame, key: str, month: int, year: int) -> DataFrame:
    """(key, average, current) rainfall from flattened climate tables, within 0 to 40.

    Average: the month's column of a "rain totals" row within three rows below a row of
    twelve cells or more with a month's name. Current: the same column in a table that
    has a row of the given year. The first in document order counts.
    """
    rows = cells.groupBy(key, "table_no", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]).alias("c"))
    col = F.try_element_at("c", F.lit(month + 1))
    rows = rows.withColumn("rain", F.lower(F.try_element_at("c", F.lit(1))).contains("rain totals"))
    months = F.array(*(F.lit(m.lower()) for m in lexicon.MONTHS))
    rows = rows.withColumn("head", (F.size("c") >= 12) & F.arrays_overlap(F.transform("c", F.lower), months))
    near = Window.partitionBy(key, "table_no").orderBy("row_no").rangeBetween(-3, -1)
    rows = rows.withColumn("headed", F.coalesce(F.max("head").over(near), F.lit(False)))
    own = (F.try_element_at("c", F.lit(1)) == str(year)) & (F.size("c") > month)
    rows = rows.withColumn("dated", F.max(F.coalesce(own, F.lit(False))).over(Window.partitionBy(key, "table_no")))
    place = F.struct("table_no", "row_no")
    avg, cur = T.first_number(F.when(F.col("headed"), col)), T.first_number(F.element_at(F.split(F.when(F.col("dated"), col), r"\("), 1))
    out = rows.where("rain").groupBy(key).agg(F.min_by(avg, F.when(avg.isNotNull(), place)).alias("a"), F.min_by(cur, F.when(cur.isNotNull(), place)).alias("b"))
    return out.select(key, T.clamp(F.col("a")).alias("average"), T.clamp(F.col("b")).alias("current"))


def station_rain(text: Column, start_label: str | None = None, end_label: str | None = None) -> Column:
    """Monthly precipitation from a station page's visible text; a dated summary wins where the first is another range's."""
    number = r"Precipitation\s+([0-9]+(?:\.[0-9]+)?)\s*°?\s*in"
    part = F.regexp_extract(text, r"(?s)(Summary.*?)(?:graph|$)", 1)
    plain = F.nullif(F.regexp_extract(part, rf"(?is)Summary.*?{number}", 1), F.lit(""))
    if not (start_label and end_label):
        return T.clamp(plain)
    here = part.contains(start_label) & part.contains(end_label)
    dated = F.nullif(F.regexp_extract(text, rf"(?is)\Q{start_label} - {end_label}\E.*?{number}", 1), F.lit(""))
    return T.clamp(F.when(plain.isNotNull(), F.when(here, plain).otherwise(F.coalesce(dated, plain))))


def host(url: Column) -> Column:
    """Host and port of a URL."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)


def skip_article(title: Column, category: Column, link: Column, local: tuple[str, ...] = ("Conroe TX News", "Houston TX News")) -> Column:
    """Stories whose page is not fetched."""
    url = T.strip(F.coalesce(link, F.lit("")))
    return (T.is_obituary(title) & category.isin(*local)) | (url == "") | url.startswith("#") | url.contains("news.google.com")


def extract_articles(stories: DataFrame, pages: DataFrame, chars: int = 600) -> DataFrame:
    """``stories`` with context (visible page text of 50 characters or more) and extract_bytes, by link = url."""
    page = pages.groupBy("url").agg(F.min("html").alias("html"))
    out = stories.withColumn("__go", F.when(~skip_article(F.col("title"), F.col("category"), F.col("link")), T.strip(F.col("link"))))
    out = out.join(page, F.col("__go") == page["url"], "left")
    return out.withColumn("context", T.html_text(chars)(F.col("html"))).withColumn("extract_bytes", F.length("html").cast("long")).drop("__go", "url", "html")
