"""The Markdown report: rows of lines, its writer, and its validation."""

from __future__ import annotations

import os
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import gate

STATION_ROWS = ("Climate normal high for today", "Average monthly rainfall", "Current monthly rainfall")
FORECAST_HEAD = ("Date", "Day Condition", "Night Condition", "High Temp", "Low Temp", "Precip. Chance", "Wind")
REQUIRED = ("title", "date", "time_generated", "story_count_total", "categories", "tags")


def table_line(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(T.present_value(c) for c in cells)), F.lit(" |"))


def forecast_lines(forecast: DataFrame, order: str = "date") -> DataFrame:
    """(line_pos, line) of exactly three forecast rows: cut, or padded with "Dynamic"."""
    spark = forecast.sparkSession
    w = Window.orderBy(order)
    cols = ["label", "day", "night", "high", "low", "precip", "wind"]
    rows = forecast.withColumn("n", F.row_number().over(w)).where("n <= 3").select("n", *cols)
    full = spark.range(1, 4).select(F.col("id").cast("int").alias("n")).join(rows, "n", "left")
    missing = F.coalesce(*(F.col(c) for c in cols)).isNull()
    cells = [F.when(missing, F.lit("Dynamic")).otherwise(F.col(c)) for c in cols]
    return full.select(F.col("n").alias("line_pos"), table_line(*cells).alias("line"))


def lake_lines(levels: DataFrame, lakes: list[str]) -> DataFrame:
    """(line_pos, line) of lakes in the order of ``lakes``; levels: series, label, value."""
    wide = levels.groupBy("series").pivot("label", ["today", "one_week_ago", "thirty_days_ago"]).agg(F.first("value"))
    dim = levels.sparkSession.createDataFrame(list(enumerate(lakes)), "line_pos int, series string")
    return dim.join(wide, "series", "left").select("line_pos", table_line(T.lake_label(F.col("series")), F.col("today"), F.col("one_week_ago"), F.col("thirty_days_ago")).alias("line"))


def section_lines(stories: DataFrame, skip: tuple[str, ...] = ("Weather Forecast",)) -> DataFrame:
    """(place, category, line_pos, line): a heading for each category, four lines a story.

    ``stories``: place (of the category), category, n (within it), title, link, summary,
    pub_date, tags. A category with a null title has no stories.
    """
    s = stories.where(~F.col("category").isin(*skip))
    flat = lambda c: F.translate(F.coalesce(c, F.lit("")), "\n\r", "  ")
    title = flat(F.col("title"))
    linked = F.when(F.coalesce(F.col("link"), F.lit("#")).isin("", "#"), title).otherwise(F.concat(F.lit("["), title, F.lit("]("), F.col("link"), F.lit(")")))
    summary = flat(F.coalesce(F.nullif("summary", F.lit("")), F.lit("[Summary unavailable]")))
    pub = F.when(F.coalesce(F.col("pub_date"), F.lit("")) != "", F.concat(F.lit("*Originally published on:* "), F.col("pub_date")))
    lines = F.array_compact(F.array(F.lit(""), F.concat(F.col("n").cast("string"), F.lit(". "), linked), summary, pub, F.coalesce("tags", F.lit(""))))
    body = s.where("title IS NOT NULL").select("place", "category", F.posexplode(lines).alias("i", "line"), (F.col("n") * 10).alias("b")).select("place", "category", (F.col("b") + F.col("i")).alias("line_pos"), "line")
    count = s.groupBy("place", "category").agg(F.count("title").alias("k"))
    head = count.select("place", "category", F.lit(0).alias("line_pos"), F.when(F.col("k") > 0, F.concat(F.lit("## "), F.col("category"), F.lit(" ("), F.col("k").cast("string"), F.lit(" stories)"))).otherwise(F.concat(F.lit("## "), F.col("category"), F.lit("\n_No stories found._"))).alias("line"))
    return body.union(head)


def rendered_categories(places: DataFrame, skip: tuple[str, ...] = ("Weather Forecast",)) -> int:
    """Categories that the report shows, empty ones too; the weather's titles are none."""
    return places.where(~F.col("category").isin(*skip)).count()


def front_matter(now: datetime, stories: int, categories: int, tags: list[str], age_window: int = 24, title: str = "Digest") -> list[str]:
    """Lines between the two rules at the report's top; times are UTC."""
    return ["---", f"title: {title}", f"date: {now:%Y-%m-%d}", f"time_generated: {now:%Y-%m-%dT%H:%M:%SZ}", "status: active", f"content_age_window: {age_window}", f"story_count_total: {stories}", f"categories: {categories}", "tags:", *(f"  - {t}" for t in tags), "---"]


def weather_lines(forecast: list[str], station: list[str], lakes: list[str], heading: str = "Weather Forecast") -> list[str]:
    bold = "| " + " | ".join(f"**{h}**" for h in FORECAST_HEAD) + " |"
    return ["", "---", f"## {heading}", "", "**3 Day forecast:**", "", bold, "|" + " --- |" * 7, *forecast, "", station[0], "| --- | --- |", *station[1:], "", "| Where | Today | 1 Week Ago | 30 Days ago |", "|" + " --- |" * 4, *lakes]


def report_path(folder: str, now: datetime, version: int | None = None, prefix: str = "Digest") -> tuple[str, int]:
    """Path and version; without one, the one after the largest of this day's files."""
    day = f"{prefix}-{now:%Y-%m-%d}"
    if version is None:
        os.makedirs(folder, exist_ok=True)
        found = [int(m.group(1)) for f in os.listdir(folder) if f.startswith(day) and (m := re.search(r"_v(\d+)\.md$", f))]
        version = max(found, default=0) + 1
    return os.path.join(folder, f"{day}_v{version:02d}.md"), version


def reserve(folder: str, now: datetime, prefix: str = "Digest", tries: int = 1000) -> tuple[str, int]:
    """Claims the next version by creating its file, which only one process can."""
    path, version = report_path(folder, now, None, prefix)
    for _ in range(tries):
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
            return path, version
        except FileExistsError:
            version += 1
            path, _ = report_path(folder, now, version, prefix)
    raise RuntimeError("no free version")


def write_lines(path: str, lines: list[str]) -> None:
    """All or nothing: a temporary file is written, synced, read back and then takes the name."""
    content, tmp = "\n".join(lines) + "\n", path + ".tmp"
    try:
        with open(tmp, "w", encoding="utf-8") as fh:
            fh.write(content)
            fh.flush()
            os.fsync(fh.fileno())
        with open(tmp, encoding="utf-8") as fh:
            if fh.read() != content:
                raise OSError(f"{path}: what was written differs")
        os.replace(tmp, path)
    except BaseException:
        if os.path.exists(tmp):
            os.unlink(tmp)
        raise


def remove_expired(folder: str, prefix: str, most: int, suffix: str = ".md") -> list[str]:
    """Deletes all but the newest ``most`` reports (or files of another suffix); other files stay."""
    own = [f for f in os.listdir(folder) if f.startswith(prefix) and f.endswith(suffix)]
    own.sort(key=lambda f: (-os.path.getmtime(os.path.join(folder, f)), f))
    for f in own[most:]:
        os.remove(os.path.join(folder, f))
    return own[most:]


def parse_front_matter(content: str) -> tuple[dict, str]:
    parts = content.split("---", 2)
    if not content.startswith("---") or len(parts) < 3:
        return {}, content
    import yaml

    try:
        meta = yaml.safe_load(parts[1].strip()) or {}
    except yaml.YAMLError:
        meta = {}
    return meta if isinstance(meta, dict) else {}, parts[2].strip()


def forecast_row_count(section: str) -> int:
    """Lines of a table with three cells or more; rules of dashes count, as lone dashes do not."""
    cells = [[c.strip() for c in x.strip().split("|") if c.strip()] for x in section.split("\n") if x.strip().startswith("|")]
    return sum(len(c) >= 3 and any(v != "-" for v in c) for c in cells)


def stories_of(content: Column) -> Column:
    """Array of (title, summary) of the numbered, linked stories of a report."""
    sections = F.split(content, r"(?m)^##\s+")
    blocks = F.flatten(F.transform(sections, lambda s: F.split(T.strip(s), r"\n(?=\d+\.\s+\[)")))
    title = lambda b: F.regexp_extract(b, r"^\d+\.\s+\[(.+?)\]\((.+?)\)", 1)

    def told(b: Column) -> Column:
        rest = F.transform(F.slice(F.split(b, "\n"), 2, 1_000_000), T.strip)
        kept = F.filter(rest, lambda x: (x != "") & ~x.startswith("*Originally published") & ~x.startswith("[[") & ~x.startswith("---") & ~x.startswith("##"))
        return F.array_join(kept, " ")

    found = F.filter(blocks, lambda b: (title(b) != "") & F.contains(b, F.lit("\n")))
    return F.transform(found, lambda b: F.struct(T.strip(title(b)).alias("title"), told(b).alias("summary")))


def report_stories(spark: SparkSession, content: str) -> DataFrame:
    """(title, summary) of the numbered, linked stories of a report."""
    report = spark.createDataFrame([(content,)], "content string")
    return report.select(F.inline(stories_of(F.col("content"))))


def _front_matter_facts(content: Column) -> Column:
    """What is asked of the front matter, (missing, count, body): YAML is read in Python, from the reports' tops only."""

    @F.pandas_udf("missing array<string>, count string, body string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            meta, body = parse_front_matter(text)
            count = meta.get("story_count_total")
            rows.append(([k for k in REQUIRED if meta.get(k) is None], None if count is None else str(count), body))
        return pd.DataFrame(rows, columns=["missing", "count", "body"])

    return of(content)


def _table_rows(section: Column) -> Column:
    """:func:`forecast_row_count` as an expression."""
    lines = F.filter(F.transform(F.split(section, "\n"), T.strip), lambda x: x.startswith("|"))
    cells = F.transform(lines, lambda x: F.filter(F.transform(F.split(x, r"\|"), T.strip), lambda c: c != ""))
    return F.size(F.filter(cells, lambda c: (F.size(c) >= 3) & F.exists(c, lambda v: v != "-")))


def validate_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, passed, issues) of every report that ``path`` names: a folder, a pattern or a file.

    The rules of :func:`validate_report` as one projection over whole files: no shuffle, no
    loop at the driver, as many reports as there are. An empty folder gives no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.regexp_replace("value", "\r\n?", "\n").alias("content"))
    files = files.withColumn("front", _front_matter_facts(F.col("content"))).select("path", "size", "content", "front.*")
    sections = F.filter(F.transform(F.split("body", r"(?m)^##\s+"), T.strip), lambda s: F.lower(F.element_at(F.split(s, "\n"), 1)).rlike("weather|forecast"))
    urls = F.regexp_extract_all("body", F.lit(r"\[[^\]]+\]\((https?://[^)]+)\)"), F.lit(1))
    facts = files.withColumns({"weather": F.get(sections, F.lit(0)), "urls": urls, "stories": stories_of(F.col("content"))})
    again = F.size(F.filter(F.array_distinct("urls"), lambda u: F.size(F.filter("urls", lambda v: v == u)) > 1))
    issue = lambda when, text: F.when(when, text)
    whole = F.array(
        F.when(F.col("weather").isNull(), "weather: no section").when(_table_rows(F.col("weather")) < 3, "weather: fewer than 3 rows"),
        *(issue(F.contains("body", F.lit(w)), F.lit(f"placeholder: {w}")) for w in ("Dynamic", "Unavailable")),
        issue(F.col("count").isNotNull() & ~F.coalesce(F.col("count").rlike("^[0-9]+$") & F.col("count").try_cast("long").between(5, 200), F.lit(False)), F.concat(F.lit("story count: "), F.col("count"))),
        issue(F.col("again") > 0, F.concat(F.lit("duplicate URLs: "), F.col("again"))),
        issue(~F.col("size").between(5 * 1024, 10 * 1024 * 1024), F.concat(F.lit("size: "), F.col("size"), F.lit(" bytes"))),
    )
    missing = F.transform("missing", lambda k: F.concat(F.lit("front matter: "), k, F.lit(" missing")))
    own = F.transform("stories", lambda s: F.struct(s["title"].alias("title"), gate.story_issue(s["title"], s["summary"]).alias("issue")))
    bad = F.filter("own", lambda s: s["issue"].isNotNull())
    told = F.transform("bad", lambda s: F.concat(s["issue"], F.lit(": "), F.substring(s["title"], 1, 80)))
    none = F.when(F.size("stories") == 0, F.array(F.lit("no stories"))).otherwise(F.array().cast("array<string>"))
    out = facts.withColumn("again", again).withColumn("own", own).withColumn("bad", bad)
    passed = (F.size("stories") > 0) & (F.size("bad") <= F.size("stories") * F.lit(0.10))
    return out.select("path", passed.alias("passed"), F.concat(missing, F.array_compact(whole), told, none).alias("issues"))


def validate_report(spark: SparkSession, path: str) -> tuple[bool, list[str]]:
    """(passed, issues). Checks of the report as a whole are reported but do not fail it; stories do."""
    try:
        size = os.path.getsize(path)
        with open(path, encoding="utf-8") as fh:
            content = fh.read()
    except OSError as e:
        return False, [f"cannot read: {e}"]
    meta, body = parse_front_matter(content)
    issues = [f"front matter: {k} missing" for k in REQUIRED if meta.get(k) is None]
    weather = next((s.strip() for s in re.split(r"^##\s+", body, flags=re.M) if s.strip() and re.search("weather|forecast", s.strip().split("\n")[0].lower())), None)
    if weather is None:
        issues.append("weather: no section")
    elif forecast_row_count(weather) < 3:
        issues.append("weather: fewer than 3 rows")
    issues += [f"placeholder: {w}" for w in ("Dynamic", "Unavailable") if w in body]
    count = meta.get("story_count_total")
    if count is not None and not (str(count).isdigit() and 5 <= int(count) <= 200):
        issues.append(f"story count: {count}")
    urls = re.findall(r"\[[^\]]+\]\((https?://[^)]+)\)", body)
    if len(urls) != len(set(urls)):
        issues.append(f"duplicate URLs: {sum(urls.count(u) > 1 for u in set(urls))}")
    if not 5 * 1024 <= size <= 10 * 1024 * 1024:
        issues.append(f"size: {size} bytes")
    stories = report_stories(spark, content)
    v = gate.verdict(stories).first()
    issues += [f"{r['issue']}: {r['title'][:80]}" for r in stories.select("title", gate.story_issue(F.col("title"), F.col("summary")).alias("issue")).where("issue IS NOT NULL").collect()]
    if not v["total"]:
        issues.append("no stories")
    return bool(v["passed"]), issues
