"""Batched enrichment through a model client: batches, answers, gate, recovery and metrics.

A client is any picklable object with ``complete(system, user) -> str``. Calls are
made in two waves, each of a width of its own: batches of stories first, then the
stories that no batch answered, those of all batches together, with a deadline. What a
wave returns is written once (:func:`summarize` takes a ``store`` for that), because a
call must not be repeated by a second action.
"""

from __future__ import annotations

import hashlib
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from . import gate
from .numbering import numbered
from .responses import read_batch_answer


class StubClient:
    """Deterministic answers made of the request itself; for tests and dry runs. Silent for some titles of a batch."""

    def complete(self, system: str, user: str) -> str:
        told = "{} was reported today. It follows earlier events.".format
        if not re.match(r"\d+\. ", user):
            # one story: its title comes before its category, an article speaks for itself
            parts = user.split("\n---\n")
            return told(parts[-2] if len(parts) > 1 else " ".join(user.split()[:12]))
        out = []
        for k, entry in enumerate(user.split("\n---\n\n")):
            lines = entry.split("\n")
            title = lines[1] if len(lines) > 1 else lines[0]
            if int(hashlib.md5(title.encode()).hexdigest()[:4], 16) % 7:
                out.append(f"STORY_{k} | {title}={told(title)}")
        return "\n".join(out)


@dataclass(frozen=True)
class Prompts:
    batch: str = "Summarize each numbered story in two or three sentences, one line a story: STORY_n | headline=summary"
    single: str = "Summarize the story in two or three sentences."
    strict: str = "Summarize the story in two or three sentences with concrete facts only."


def assign_batches(stories: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Adds place (from 0) and batch within its category, by ``order``, whose first column is a number or an instant."""
    key, *rest = (F.col(c) for c in order)
    out = numbered(stories.drop("place", "batch"), ["category"], key, rest, "place").withColumn("place", F.col("place") - 1)
    return out.withColumn("batch", F.floor(F.col("place") / size).cast("int"))


def stub_summary(title: Column) -> Column:
    """What :class:`StubClient` answers for a title, as an expression; null where it stays silent."""
    n = F.conv(F.substring(F.md5(title.cast("binary")), 1, 4), 16, 10).cast("int") % 7
    return F.when(n != 0, F.concat(title, F.lit(" was reported today. It follows earlier events.")))


_SINGLE = 2


def _refused(text: str, phrases) -> bool:
    low = text.strip().lower()
    return any(p in low for p in phrases)


def _sentences(text: str) -> int:
    return len([p for p in re.split(r"(?<=[.!?])\s+(?=[A-Z0-9\"'])", " ".join(text.split())) if p.strip()])


def _topic(text: str) -> set[str]:
    return {w for w in re.findall(r"[a-zA-Z']+", text.lower()) if len(w) > 3 and w not in lexicon.TOPIC_STOP}


def valid_summary(summary: str | None, headline: str) -> bool:
    """The gate of :mod:`quillspark.operators.gate` for one text, for decisions within a task."""
    s = (summary or "").strip()
    if not s or _refused(s, lexicon.REFUSAL) or _refused(s, lexicon.BOILERPLATE) or s.startswith((lexicon.AUTO_MARK, lexicon.UNAVAILABLE_MARK)):
        return False
    norm, head = " ".join(s.split()).lower(), " ".join(headline.split()).lower()
    return not (norm == head or norm.startswith(head + ".")) and _sentences(s) >= 2 and bool(_topic(headline) & _topic(s))


def _single(client, prompts: Prompts, context: str, least: int, made: list) -> str | None:
    """One story on its own; the second attempt is strict. ``made`` gets an entry for each call."""
    if len(context.strip()) < least:
        return None
    prompt = prompts.single
    for turn in range(_SINGLE):
        made.append(prompt)
        try:
            text = " ".join(x.strip() for x in str(client.complete(prompt, context) or "").splitlines() if x.strip())
        except Exception:  # a failing call is one outcome among others, as in the batch
            text = ""
        if text and (turn or not _refused(text, lexicon.BOILERPLATE)):
            return text
        prompt = prompts.strict
    return None


def _batches(client, prompts: Prompts):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        titles = [t or "" for t in pdf["title"]]
        entries = [f"{k + 1}. {c}\n{t}\n{x or ''}" for k, (c, t, x) in enumerate(zip(pdf["category"], titles, pdf["context"]))]
        got, calls = [""] * len(titles), 0
        for _ in range(2):
            calls += 1
            try:
                read = read_batch_answer(client.complete(prompts.batch, "\n---\n\n".join(entries)), len(titles), titles)
            except Exception:  # the batch counts as failed and is retried
                read = [""] * len(titles)
            got = [s if valid_summary(s, t) else "" for s, t in zip(read, titles)]
            if any(got):
                break
        return pd.DataFrame({"row_id": pdf["row_id"], "title": titles, "context": pdf["context"], "answer": got, "batch_place": range(len(titles)), "batch_calls": calls})

    return one


def _until(call: Callable[[], str | None], until: float) -> tuple[str | None, bool]:
    """The answer of a call, and whether it came in time; a late call is left to itself."""
    left, out = until - time.time(), []
    if left <= 0:
        return None, False
    thread = threading.Thread(target=lambda: out.append(call()), daemon=True)
    thread.start()
    thread.join(left)
    return (out[0], True) if out else (None, False)


def _alone(client, prompts: Prompts, least: int, until: float | None):
    def run(frames):
        for pdf in frames:
            answers, how, calls = [], [], []
            for title, context in zip(pdf["title"], pdf["context"]):
                made: list = []
                ask = lambda c=context or "", m=made: _single(client, prompts, c, least, m)
                text, ended = (ask(), True) if until is None else _until(ask, until)
                ok = ended and valid_summary(text, title)
                answers.append(text if ok else "")
                how.append("single" if ok else "none" if ended else "late")
                calls.append(len(made))
            yield pd.DataFrame({"row_id": pdf["row_id"], "answer": answers, "how": how, "single_calls": calls})

    return run


def recover(failed: DataFrame, client, prompts: Prompts = Prompts(), least: int = 100, parallel: int = 2, deadline_s: float = 0.0) -> DataFrame:
    """The recovery wave: stories (row_id, title, context) asked for one by one, from ``parallel`` tasks at once.

    Columns row_id, answer (empty: none), how and single_calls. ``how``: single (answered), none (asked
    in vain, or a context under ``least``) or late. ``deadline_s``: seconds from this
    call on in which stories are asked for, 0 for no end; a call under way then is not
    waited for, and a task that runs again afterwards asks for nothing. The clocks of
    driver and executors are taken to agree.
    """
    until = time.time() + deadline_s if deadline_s > 0 else None
    return failed.select("row_id", "title", "context").repartition(parallel).mapInPandas(_alone(client, prompts, least, until), "row_id long, answer string, how string, single_calls int")


def summarize(
    stories: DataFrame,
    client,
    size: int = 3,
    parallel: int | None = None,
    prompts: Prompts = Prompts(),
    least: int = 100,
    store: Callable[[DataFrame], DataFrame] | None = None,
    recovery_parallel: int = 2,
    deadline_s: float = 0.0,
) -> DataFrame:
    """``stories`` (row_id, category, title, snippet, context) with summary, how and call counts.

    Batches of ``size`` stories of a category; a batch without any valid summary is
    asked once more. Stories still without one go to :func:`recover`, those of all batches
    in one wave of width ``recovery_parallel`` that ends after ``deadline_s`` seconds; what
    remains gets the stand-in made of its title. ``parallel``: tasks that ask for batches;
    None: as many as a shuffle has. ``store`` writes a frame and reads it back: given,
    no call is made twice. Without it answers are kept in the executors' storage, a lost
    part is asked for again, and there can be no deadline.
    """
    if deadline_s > 0 and not store:
        raise ValueError("a deadline needs a store: it counts from the moment at which the wave runs")
    if store:
        stories = store(stories)
    keep = store or (lambda df: df.persist())
    parts = [parallel] if parallel else []
    text = T.build_context(F.coalesce("context", F.lit("")), F.coalesce("snippet", F.lit("")), F.coalesce("title", F.lit("")), F.col("category"))
    work = assign_batches(stories.select("row_id", "category", "title", text.alias("context")), size, ["row_id"])
    answers = work.repartition(*parts, "category", "batch").groupBy("category", "batch").applyInPandas(_batches(client, prompts), "row_id long, title string, context string, answer string, batch_place int, batch_calls int")
    answers = keep(answers)
    alone = keep(recover(answers.where("answer = ''"), client, prompts, least, recovery_parallel, deadline_s))
    alone = alone.select(F.col("row_id").alias("__id"), F.col("answer").alias("__answer"), F.col("how").alias("__how"), F.col("single_calls").alias("__calls"))
    both = answers.join(alone, F.col("row_id") == F.col("__id"), "left")
    said = both.select("row_id", F.coalesce(F.nullif("answer", F.lit("")), F.nullif("__answer", F.lit(""))).alias("__said"), F.coalesce("__how", F.lit("batch")).alias("how"), "batch_place", "batch_calls", F.coalesce("__calls", F.lit(0)).alias("single_calls"))
    return stories.join(said, "row_id", "left").withColumn("summary", F.coalesce("__said", T.auto_summary(F.col("title")))).drop("__said")


def call_counts() -> list[Column]:
    """Aggregates over what :func:`summarize` returns: batches, calls, and how the recovery went."""
    first = F.col("batch_place") == 0
    late = F.col("how") == "late"
    return [
        F.count_if(first).alias("sub_batches"),
        F.coalesce(F.sum(F.when(first, F.col("batch_calls"))), F.lit(0)).alias("batch_calls"),
        F.count_if(first & (F.col("batch_calls") > 1)).alias("batch_retries"),
        F.count_if((F.col("how") != "batch") & (~late | (F.col("single_calls") > 0))).alias("individual_recovery_attempts"),
        F.count_if(F.col("how") == "single").alias("individual_recovered"),
        F.count_if(late).alias("past_deadline"),
    ]


def metrics(summarized: DataFrame) -> DataFrame:
    """One row: outcome counts and calls."""
    return summarized.agg(*gate.outcome_aggregates(F.col("summary")), *call_counts())


def match_headlines(rows: DataFrame, answer: str, headlines: str, count: str | None = None, out: str = "summaries") -> DataFrame:
    """Adds the array of summaries that :func:`read_batch_answer` finds in each answer."""

    @F.pandas_udf("array<string>")
    def of(a: pd.Series, h: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([read_batch_answer(x, int(k), None if y is None else [t or "" for t in y]) for x, y, k in zip(a, h, n)])

    n = F.col(count) if count else F.size(headlines)
    return rows.withColumn(out, of(F.col(answer), F.col(headlines), n))


def likeness(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts, lower-cased and with single spaces.

    Pairs come to Python a hundred at a time: matching takes far longer than their transport, and
    a worker holds neither thousands of texts nor the libraries of Arrow batches.
    """

    def of(x: str | None, y: str | None) -> float:
        from difflib import SequenceMatcher

        flat = lambda t: " ".join((t or "").lower().split())
        return SequenceMatcher(None, flat(x), flat(y)).ratio()

    return F.udf(of, "double", useArrow=False)(a, b)


def _flat(text: Column) -> Column:
    """As :func:`likeness` compares texts: in lower case, with single spaces."""
    return F.lower(T.collapse(F.coalesce(text, F.lit(""))))


def likeness_bound(a: Column, b: Column) -> Column:
    """What :func:`likeness` cannot exceed, for texts made by ``_flat``: twice the characters that both have over all characters."""
    times = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    shared = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * shared / total)


def closest_headlines(lines: DataFrame, heads: DataFrame, by: list[str], least: float = 0.7) -> DataFrame:
    """(by, line_id, head_id, ratio): for each line the headline of its batch that is most like it, from ``least`` on.

    ``lines``: by, line_id, line; ``heads``: by, head_id, head. Batches are small (a call's stories);
    lines and headlines of one batch meet. Pairs whose lengths, or whose characters, cannot
    reach ``least`` are left out by expressions; sequences are matched for the others only. Of
    equal ratios the smallest head_id counts. A null text is empty.
    """
    a = lines.select(*by, "line_id", _flat(F.col("line")).alias("__a"))
    b = heads.select(*by, "head_id", _flat(F.col("head")).alias("__b"))
    x, y = F.length("__a"), F.length("__b")
    near = a.join(b, by).where(2.0 * F.least(x, y) >= F.lit(least) * (x + y))
    near = near.where(likeness_bound(F.col("__a"), F.col("__b")) >= least - 1e-9)
    found = near.withColumn("ratio", likeness(F.col("__a"), F.col("__b")))
    best = found.groupBy(*by, "line_id").agg(F.max_by(F.struct("head_id", "ratio"), F.struct("ratio", -F.col("head_id"))).alias("r"))
    # the best ones are compared: a filter of all ratios moves below their projection, and each pair is matched twice
    return best.where(F.col("r.ratio") >= least).select(*by, "line_id", "r.head_id", "r.ratio")
