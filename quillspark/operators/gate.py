"""Quality gates for summaries and reports, and the metrics over their outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from .numbering import percentiles


def is_refusal(c: Column) -> Column:
    return T.contains_any(c, lexicon.REFUSAL)


def is_boilerplate(c: Column) -> Column:
    return T.contains_any(c, lexicon.BOILERPLATE)


def topic_overlap(summary: Column, headline: Column) -> Column:
    return F.coalesce(F.arrays_overlap(T.significant_words(headline), T.significant_words(summary)), F.lit(False))


def gate_reason(summary: Column, headline: Column) -> Column:
    """The first check that a summary fails; null for a valid one. Each form of the texts is made once."""

    def first(x: Column) -> Column:
        s, flat, norm, head = x["s"], x["flat"], F.lower(x["flat"]), x["head"]
        return (
            F.when(s.isNull() | (s == ""), "empty")
            .when(F.coalesce(T.holds_any(x["low"], lexicon.REFUSAL), F.lit(False)), "refusal")
            .when(F.coalesce(T.holds_any(x["low"], lexicon.BOILERPLATE), F.lit(False)), "boilerplate")
            .when(s.startswith(lexicon.AUTO_MARK) | s.startswith(lexicon.UNAVAILABLE_MARK), "marker")
            .when((norm == head) | F.startswith(norm, F.concat(head, F.lit("."))), "echo")
            .when(T.sentences_of_flat(flat) < 2, "short")
            .when(~topic_overlap(s, x["title"]), "off_topic")
        )

    s = T.strip(summary)
    title = F.coalesce(headline, F.lit(""))
    return T.let(F.struct(s.alias("s"), F.lower(s).alias("low"), T.collapse(summary).alias("flat"), F.lower(T.collapse(title)).alias("head"), headline.alias("title")), first)


def is_valid_summary(summary: Column, headline: Column) -> Column:
    return gate_reason(summary, headline).isNull()


def story_issue(title: Column, summary: Column) -> Column:
    """The first per-story problem in a finished report; null for none. ``[Auto]`` summaries are accepted."""
    low_t, low_s = F.lower(title), F.lower(summary)
    norm_t, norm_s = F.regexp_replace(low_t, r"(?U)\s+", " "), F.regexp_replace(low_s, r"(?U)\s+", " ")
    words = F.filter(T.word_list(title), lambda w: ~w.isin(*lexicon.HEADLINE_STOP))
    found = F.size(F.filter(words, lambda w: F.contains(low_s, w)))
    return (
        F.when(summary.isNull() | (T.strip(summary) == ""), "empty")
        .when(summary.startswith(lexicon.AUTO_MARK), F.lit(None).cast("string"))
        .when((norm_s == norm_t) | F.startswith(norm_s, F.concat(norm_t, F.lit("."))), "echo")
        .when(T.sentence_count(summary) < 2, "short")
        .when(summary.startswith("[Headline]") | low_s.contains("[summary unavailable]"), "marker")
        .when((F.size(words) > 0) & (found < F.size(words) * F.lit(0.25)), "off_topic")
    )


def verdict(stories: DataFrame, most_bad: float = 0.10) -> DataFrame:
    """One row over (title, summary): total, bad, auto, passed. No story at all does not pass."""
    s = stories.select(story_issue(F.col("title"), F.col("summary")).alias("issue"), F.coalesce(F.col("summary").startswith(lexicon.AUTO_MARK), F.lit(False)).alias("auto"))
    out = s.agg(F.count("*").alias("total"), F.count_if(F.col("issue").isNotNull()).alias("bad"), F.count_if(F.col("auto")).alias("auto"))
    return out.withColumn("passed", (F.col("total") > 0) & (F.col("bad") <= F.col("total") * F.lit(most_bad)))


def outcome(summary: Column) -> Column:
    """invalid (nothing), unavailable, auto, else valid: only summaries that passed the gate get this far."""
    s = T.strip(F.coalesce(summary, F.lit("")))
    return F.when(s == "", "invalid").when(s.startswith(lexicon.UNAVAILABLE_MARK), "unavailable").when(s.startswith(lexicon.AUTO_MARK), "auto").otherwise("valid")


def outcome_aggregates(summary: Column) -> list[Column]:
    """Aggregates of the outcomes, which add up to total_stories."""
    of = lambda o, name: F.count_if(outcome(summary) == o).alias(name)
    return [F.count(F.lit(1)).alias("total_stories"), of("valid", "final_valid"), of("auto", "auto_fallbacks"), of("unavailable", "unavailable_summaries"), of("invalid", "final_invalid")]


def outcome_counts(stories: DataFrame) -> DataFrame:
    """One row over (title, summary): the counts of outcomes."""
    return stories.agg(*outcome_aggregates(F.col("summary")))


def lag_percentiles(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """p50, p95, p99 by linear interpolation, and the maximum; exact, whatever a group's size."""
    return percentiles(values, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def extraction_aggregates(bytes_column: bool = True) -> list[Column]:
    """Aggregates over (context, extract_bytes): stories, extracted (with a context) and bytes."""
    size = F.coalesce(F.sum("extract_bytes"), F.lit(0)) if bytes_column else F.lit(0)
    return [F.count(F.lit(1)).alias("stories"), F.count_if(F.coalesce(F.col("context"), F.lit("")) != "").alias("extracted"), size.cast("long").alias("bytes")]


def extraction_metrics(stories: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row over (context, and extract_bytes where there): stories, extracted (with a context), bytes, per_second."""
    rate = F.count("*") / F.lit(float(seconds)) if seconds and seconds > 0 else F.lit(0.0)
    return stories.agg(*extraction_aggregates("extract_bytes" in stories.columns), rate.cast("double").alias("per_second"))


def duplicate_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """(url, n) of those that occur more than once."""
    return urls.where(F.col(url).isNotNull()).groupBy(url).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Keys of ``child`` that ``parent`` does not have."""
    keys = child.select(F.col(child_key).alias("key")).where("key IS NOT NULL").distinct()
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def probe_tally(probes: DataFrame) -> DataFrame:
    """One row over (name, ok, message, duration_ms): passed, failed, all_ok."""
    return probes.agg(F.count_if("ok").alias("passed"), F.count_if(~F.coalesce(F.col("ok"), F.lit(False))).alias("failed"), F.coalesce(F.every(F.coalesce(F.col("ok"), F.lit(False))), F.lit(True)).alias("all_ok"))
