"""Streaming forms of the feed operators; an addition to the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_stream(stories: DataFrame, keep_for: str = "7 days") -> DataFrame:
    """The first arrival of each title of a category; a title is remembered for ``keep_for``.

    ``stories`` is a streaming frame with category, norm and pub_dt. State grows with
    the titles of that time, not with the stream.
    """
    return stories.withWatermark("pub_dt", keep_for).dropDuplicatesWithinWatermark(["category", "norm"])


def counts_by_window(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Stories of each category in tumbling windows, once they can no longer change."""
    w = events.withWatermark("pub_dt", late).groupBy(F.window("pub_dt", length).alias("w"), "category").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "category", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", key: str = "category") -> DataFrame:
    """Runs of stories without a pause of ``gap``."""
    s = events.withWatermark("pub_dt", late).groupBy(F.session_window("pub_dt", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
