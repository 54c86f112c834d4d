"""First-wins deduplication from run to run: a keyed state for each title, with timers that end it.

What deduplication needs of a title's rows is little and does not depend on the time at which
it is asked: the newest dated row and the first undated one of each category. These merge,
so a stream cut in any way keeps what the whole table would give, and the batch operator
(:mod:`quillspark.operators.dedup`) over the kept rows is the batch operator over all rows:
age bands, widening, caps and the order across categories are decided when a digest is asked for.

A dated row is forgotten when the watermark is ``keep_days`` past its time, when no band can
reach it any more. An undated row has no time: it is forgotten ``keep_days`` after the
watermark at which it came; one that came before there was a watermark stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import dedup

#: Columns of a candidate that the state keeps; others are joined by row_id where they are needed.
ROW = "row_id long, title string, pub_dt timestamp"
#: An update: the row that stands for (category, norm, dated) now; gone: none does any more.
UPDATE = f"category string, norm string, dated boolean, {ROW}, gone boolean"
_DAY_MS = 86_400_000


class _FirstWins(StatefulProcessor):
    """The newest dated and the first undated row of a title of a category."""

    def __init__(self, keep_days: int):
        self.keep_ms = keep_days * _DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = {d: handle.getValueState("dated" if d else "undated", f"{ROW}, ends long") for d in (True, False)}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[bool, tuple] = {}
        for pdf in rows:
            for row_id, title, at in zip(pdf["row_id"], pdf["title"], pdf["pub_dt"]):
                dated = not pd.isna(at)
                new = (int(row_id), title, at.to_pydatetime() if dated else None)
                if dated not in best or self._before(new, best[dated]):
                    best[dated] = new
        out = []
        for dated, new in best.items():
            state = self.kept[dated]
            old = state.get() if state.exists() else None
            if old is not None and not self._before(new, old):
                continue
            ends = self._ends(new, timerValues)
            if ends is not None:
                if ends <= timerValues.getCurrentWatermarkInMs():
                    continue  # came after its end: no band can reach it
                self.handle.registerTimer(ends)
            if old is not None and old[3] is not None and old[3] != ends:
                self.handle.deleteTimer(old[3])
                other = self.kept[not dated]
                if other.exists() and other.get()[3] == old[3]:
                    self.handle.registerTimer(old[3])
            state.update((*new, ends))
            out.append((*key, dated, *new, False))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for dated, state in self.kept.items():
            if state.exists() and (old := state.get())[3] is not None and old[3] <= now:
                state.clear()
                out.append((*key, dated, *old[:3], True))
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass

    @staticmethod
    def _before(a: tuple, b: tuple) -> bool:
        """Newest first, then the smaller id."""
        return (a[2] is not None and a[2] > b[2]) or (a[2] == b[2] and a[0] < b[0])

    def _ends(self, row: tuple, timerValues) -> int | None:
        if row[2] is not None:
            return int(row[2].timestamp() * 1000) + self.keep_ms
        mark = timerValues.getCurrentWatermarkInMs()
        return mark + self.keep_ms if mark > 0 else None

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["category", "norm", "dated", "row_id", "title", "pub_dt", "gone"])
        out["pub_dt"] = pd.to_datetime(out["pub_dt"])
        return out


def first_wins(candidates: DataFrame, late: str = f"{dedup.MOST_DAYS + 1} days", keep_days: int = dedup.MOST_DAYS + 1) -> DataFrame:
    """Updates (``UPDATE``) of a stream of candidates (category, norm, row_id, title, pub_dt).

    Needs the RocksDB state store. ``late``: how far behind the newest row the watermark is;
    dated rows behind it are dropped, so it should be no less than the days that bands reach.
    Undated rows are never late.
    """
    return candidates.withWatermark("pub_dt", late).groupBy("category", "norm").transformWithStateInPandas(_FirstWins(keep_days), outputStructType=UPDATE, outputMode="Update", timeMode="EventTime")


def standing(updates: DataFrame, turn: str = "batch") -> DataFrame:
    """Of all updates written so far the rows that stand: of each (category, norm, dated) the last one, if it is not gone."""
    last = updates.groupBy("category", "norm", "dated").agg(F.max_by(F.struct("row_id", "title", "pub_dt", "gone"), turn).alias("r"))
    return last.where("NOT r.gone").select("category", "norm", "r.row_id", "r.title", "r.pub_dt")


def digest_at(updates: DataFrame, categories: DataFrame, now: datetime, turn: str = "batch") -> DataFrame:
    """What :func:`quillspark.operators.dedup.feed_dedup` gives at ``now`` for all rows that have come."""
    return dedup.feed_dedup(standing(updates, turn), categories, now)
