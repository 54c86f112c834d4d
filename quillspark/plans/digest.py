"""One run from stories to a validated report; phases are DataFrame plans, control stays at the driver."""

from __future__ import annotations

import logging
import os
import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, gate, report, summaries, tagging
from ..sources import config, feeds, report_sink, weather
from . import probes

OK, BAD_CONFIG, BAD_REPORT = 0, 1, 2


@dataclass
class Run:
    """What a run needs: the time, places, rules and clients. Nothing is read from globals."""

    now: datetime
    folder: str
    rules: tagging.TagRules
    priority: list[str] = field(default_factory=list)
    seeds: list[str] = field(default_factory=list)
    batch_size: int = 3
    parallel: int | None = None
    keep: int = 10
    prompts: summaries.Prompts = summaries.Prompts()
    recovery_parallel: int = 2
    recovery_deadline_s: float = 0.0
    log: logging.Logger = logging.getLogger("quillspark.run")
    counters: dict = field(default_factory=dict)


@contextmanager
def _phase(run: Run, name: str):
    """Tells how long a phase took."""
    began = time.monotonic()
    yield
    took = time.monotonic() - began
    run.counters[f"{name}_s"] = round(took, 3)
    run.log.info("%s: %.1f s", name, took)


def _told(run: Run, what: str, counters: dict) -> None:
    run.counters.update(counters)
    run.log.info("%s: %s", what, ", ".join(f"{k} {v}" for k, v in counters.items()))


def run_digest(spark: SparkSession, run: Run, candidates: DataFrame, categories: DataFrame, client, weather: list[str], store, articles: Callable[[DataFrame], DataFrame] | None = None) -> tuple[int, str, list[str]]:
    """Deduplicates, fetches articles, enriches, tags, renders, writes and validates; (exit code, path, issues).

    ``store`` writes a frame once and reads it back. ``articles`` gets the stories that
    deduplication kept, and returns them with their context. The report is written by tasks
    and joined in order; the check reads the finished file. The counters of
    deduplication, extraction and summaries come from the plans that make the stories, while
    they run; they are in ``run.counters`` and in the log.
    """
    with _phase(run, "dedup"):
        kept, seen = dedup.feed_dedup_observed(candidates, categories, run.now)
        stories = store(kept)
    stories.count()  # a store may be lazy
    _told(run, "stories", seen.get())
    if articles:
        with _phase(run, "articles"):
            read = Observation()
            stories = store(articles(stories).observe(read, *gate.extraction_aggregates()))
        stories.count()
        _told(run, "articles", read.get | {"per_second": round(read.get["stories"] / max(run.counters["articles_s"], 1e-3), 1)})
    with _phase(run, "summaries"):
        made = Observation()
        done = summaries.summarize(stories, client, run.batch_size, run.parallel, run.prompts, store=store, recovery_parallel=run.recovery_parallel, deadline_s=run.recovery_deadline_s)
        done = store(done.observe(made, *gate.outcome_aggregates(F.col("summary")), *summaries.call_counts()))
        total = done.count()
    _told(run, "summaries", made.get)
    with _phase(run, "report"):
        places = dedup.priority_order(categories, run.priority).select("category", "place")
        tags = tagging.tag_array(F.col("title"), F.col("category"), run.rules)
        w = Window.partitionBy("category").orderBy("k")
        shown = places.join(done, "category", "left").select("place", "category", F.row_number().over(w).alias("n"), "title", "link", "summary", T.format_pub_date(F.col("pub_dt")).alias("pub_date"), tags.alias("tag_list"), tagging.tag_markup(F.col("title"), F.col("category"), run.rules).alias("tags"))
        names = done.agg(tagging.tag_union(tags, run.seeds)).first()[0]
        head = report.front_matter(run.now, total, report.rendered_categories(places), names or list(run.seeds))
        top = spark.createDataFrame([(k, line) for k, line in enumerate([*head, "", f"# Digest -- {run.now:%B %d, %Y}", *weather])], "line_pos long, line string")
        lines = report.section_lines(shown).select("place", "line_pos", "line").unionByName(top.withColumn("place", F.lit(-1)))
        path, _ = report.reserve(run.folder, run.now)
        report_sink.save_report(lines, ["place", "line_pos"], path)
        report.remove_expired(run.folder, "Digest-", run.keep)
    with _phase(run, "validation"):
        passed, issues = report.validate_report(spark, path)
    run.log.info("%s %s", path, "passed" if passed else "; ".join(issues))
    return (OK if passed else BAD_REPORT), path, issues


def feed_candidates(categories: DataFrame, pages: DataFrame, zone: str = "UTC") -> DataFrame:
    """Candidates of all feeds: category, title, link, snippet, pub_dt, norm, row_id, context.

    ``pages``: category, text (null: the feed failed). A feed that fails has no candidates and
    keeps its category's place in the categories table; at most its pool_limit entries count.
    """
    items = feeds.feed_items(pages.select("category", "text"))
    limit = categories.agg(F.max("pool_limit")).first()[0] or 50
    entries = feeds.feed_entries(items, F.col("category"), zone, limit).join(dedup.small(categories.select("category", "cat_pos", "pool_limit")), "category").where(F.col("pos") < F.col("pool_limit"))
    row = (F.col("cat_pos") * 1_000_000 + F.col("pos")).cast("long").alias("row_id")
    return entries.select("category", "title", "link", "snippet", "pub_dt", T.normalize_title(F.col("title")).alias("norm"), row, F.lit(None).cast("string").alias("context"))


def read_articles(stories: DataFrame, fetch: weather.Fetch, store) -> DataFrame:
    """Stories with the text of their pages as context; only pages of these stories are asked for, each once."""
    wanted = stories.where(~feeds.skip_article(F.col("title"), F.col("category"), F.col("link"))).select(T.strip(F.col("link")).alias("link")).distinct()
    links = [r["link"] for r in wanted.collect()]
    if not links:
        return stories.withColumn("extract_bytes", F.lit(None).cast("long"))
    pages = store(fetch(links)).select("url", weather.body_text(F.col("body")).alias("html"))
    return feeds.extract_articles(stories.drop("context"), pages)


def settings(tree: dict, now: datetime, log: logging.Logger) -> Run:
    """What a run needs, from a configuration."""
    llm = lambda key, default: config.lookup(tree, f"llm.{key}", default)
    told = {k: v for k in ("batch", "single", "strict") if (v := config.lookup(tree, f"prompts.{k}"))}
    return Run(
        now,
        tree["output_dir"],
        config.tag_rules(tree),
        tree.get("category_priority") or [],
        tree.get("tags") or [],
        int(llm("batch_size", 3)),
        llm("concurrency", None),
        int(tree.get("keep_reports", 10)),
        summaries.Prompts(**told),
        int(llm("recovery_concurrency", 2)),
        float(llm("recovery_deadline_s", 0.0)),
        log,
    )


def run_config(spark: SparkSession, tree: dict, now: datetime, client, fetch: weather.Fetch, store) -> tuple[int, str, list[str]]:
    """A whole run from a configuration: feeds, weather, articles, summaries, report; (exit code, path, issues).

    Every request is a row: a feed, lake, page or provider that fails leaves its place empty. Pages
    are asked for after deduplication, those of kept stories only. The run's log is in
    ``logs`` beside the reports, of which as many are kept.
    """
    passed, issues = config.validate_config(tree)
    if not passed:
        return BAD_CONFIG, "", issues
    logs = os.path.join(tree["output_dir"], "logs")
    os.makedirs(logs, exist_ok=True)
    log = probes.run_log(os.path.join(logs, f"run-{now:%Y%m%dT%H%M%S}-{os.getpid()}.log"))
    try:
        return _logged_run(spark, tree, settings(tree, now, log), client, fetch, store)
    except Exception:
        log.exception("the run failed")
        raise
    finally:
        probes.close_log(log)
        report.remove_expired(logs, "run-", int(tree.get("keep_reports", 10)), ".log")


def _logged_run(spark: SparkSession, tree: dict, run: Run, client, fetch: weather.Fetch, store) -> tuple[int, str, list[str]]:
    zone = tree["timezone"]
    with _phase(run, "sources"):
        table = config.category_table(spark, tree)
        rss = config.lookup(tree, "rss", {}) or {}
        url = feeds.feed_url_with_window(F.col("query"), F.greatest("age_limit_h", "window_h"), rss.get("base", feeds.RSS_BASE), rss.get("params", feeds.RSS_PARAMS))
        table = table.withColumn("url", url)
        urls = [r["url"] for r in table.select("url").collect()]
        got = store(fetch(urls)).select("url", weather.body_text(F.col("body")).alias("text"))
        candidates = store(feed_candidates(table, table.select("category", "url").join(got, "url", "left").select("category", "text"), zone))
        places = tree.get("weather") or {}
        lakes = places.get("lakes") or {}
        bundle = weather.collect_weather(spark, weather.Places(places.get("forecast"), places.get("climate"), places.get("station"), places.get("normals"), lakes, places.get("point")), fetch, run.now.date(), zone, store)
    articles = (lambda stories: read_articles(stories, fetch, store)) if config.lookup(tree, "extract", True) else None
    return run_digest(spark, run, candidates, table, client, weather.weather_section(spark, bundle, list(lakes)), store, articles)
