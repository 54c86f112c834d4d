"""The two waves of model calls against a plain sequential counterpart, and the deadline of the second."""

import itertools
import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators import summaries
from quillspark.operators.responses import read_batch_answer


class Slow(summaries.StubClient):
    """Silent for batches; each single answer takes a while, one of them very long."""

    def __init__(self, seconds, stuck=None):
        self.seconds, self.stuck = seconds, stuck

    def complete(self, system, user):
        if user[:2] == "1.":
            return ""
        time.sleep(self.seconds if self.stuck is None or self.stuck not in user else 60)
        return super().complete(system, user)


class Odd(summaries.StubClient):
    """Fails in every way: raises, refuses, answers with boilerplate first, or not at all."""

    def complete(self, system, user):
        if "number 4 " in user and user[:2] != "1.":
            raise OSError("gone")
        if "number 5 " in user and user[:2] != "1.":
            return "I cannot summarize this."
        if user[:2] == "1." and "number 9 " in user:
            raise OSError("gone")
        if "strict" not in system and user[:2] != "1." and "number 7 " in user:
            return "According to the article, it was said. More follows."
        return super().complete(system, user)


def stories(spark, n=23):
    rows = [(k, ("Local", "World", "Sports")[k % 3], f"Harbour story number {k} about ships", "a long snippet of words " * 8 if k != 8 else "x", None) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, category string, title string, snippet string, context string")


@pytest.fixture
def store(spark, tmp_path):
    n = itertools.count()

    def write(df):
        path = str(tmp_path / f"t{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return write


def plain(rows, client, size, prompts, least):
    """One batch after the other, then one story after the other."""
    out = {}
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r["category"], r["row_id"])), key=lambda r: r["category"]):
        own = list(group)
        for lo in range(0, len(own), size):
            batch = own[lo : lo + size]
            titles = [r["title"] for r in batch]
            ask = "\n---\n\n".join(f"{k + 1}. {r['category']}\n{r['title']}\n{r['text']}" for k, r in enumerate(batch))
            for calls in (1, 2):
                try:
                    got = read_batch_answer(client.complete(prompts.batch, ask), len(batch), titles)
                except OSError:
                    got = [""] * len(batch)
                got = [g if summaries.valid_summary(g, t) else "" for g, t in zip(got, titles)]
                if any(got):
                    break
            for k, (r, g) in enumerate(zip(batch, got)):
                out[r["row_id"]] = [g, "batch", k, calls, 0]
    for r in rows:
        o = out[r["row_id"]]
        if o[0]:
            continue
        o[1] = "none"
        for prompt in (prompts.single, prompts.strict) if len(r["text"].strip()) >= least else ():
            o[4] += 1
            try:
                text = " ".join(client.complete(prompt, r["text"]).split())
            except OSError:
                text = ""
            if text and (prompt == prompts.strict or not summaries._refused(text, summaries.lexicon.BOILERPLATE)):
                if summaries.valid_summary(text, r["title"]):
                    o[0], o[1] = text, "single"
                break
        o[0] = o[0] or "[Auto] " + r["title"]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("client", [summaries.StubClient(), Odd(), Slow(0.0)])
def test_waves_equal_plain_calls(spark, store, client):
    s = stories(spark)
    prompts = summaries.Prompts(strict="strict")
    done = summaries.summarize(s, client, 3, 2, prompts, store=store, recovery_parallel=3)
    got = {r["row_id"]: (r["summary"], r["how"], r["batch_place"], r["batch_calls"], r["single_calls"]) for r in done.collect()}
    text = summaries.T.build_context(F.lit(""), F.col("snippet"), F.col("title"), F.col("category"))
    rows = s.select("row_id", "category", "title", text.alias("text")).collect()
    expected = plain(rows, client, 3, prompts, 100)
    assert got == expected
    m = summaries.metrics(done).first()
    assert m["total_stories"] == len(rows) and m["past_deadline"] == 0
    assert m["individual_recovered"] == sum(v[1] == "single" for v in expected.values())
    assert m["individual_recovery_attempts"] == sum(v[1] != "batch" for v in expected.values())
    assert m["sub_batches"] == 9 and m["batch_calls"] == sum(v[3] for v in expected.values() if v[2] == 0)


def test_the_wave_ends_at_its_deadline(spark, store):
    s = stories(spark, 30)
    began = time.time()
    done = summaries.summarize(s, Slow(0.4, "number 3 "), store=store, recovery_parallel=2, deadline_s=4.0)
    rows = done.collect()
    assert time.time() - began < 30
    late = [r for r in rows if r["how"] == "late"]
    assert 0 < len(late) < 30 and any(r["how"] == "single" for r in rows)
    assert all(r["summary"] == "[Auto] " + r["title"] for r in late)
    assert sum(r["single_calls"] for r in late) <= 2
    m = summaries.metrics(done).first()
    vain = sum(r["how"] == "none" for r in rows)
    assert m["past_deadline"] == len(late) and m["auto_fallbacks"] == len(late) + vain and vain <= 1
    assert m["final_valid"] == m["individual_recovered"] == 30 - len(late) - vain
    # the attempts are those that began in time
    assert m["individual_recovery_attempts"] == 30 - sum(r["single_calls"] == 0 for r in late)


def test_width_of_the_wave(spark, store, tmp_path):
    done = summaries.recover(store(stories(spark, 12).select("row_id", "title", F.lit("long context " * 20).alias("context"))), summaries.StubClient(), parallel=4)
    assert done.rdd.getNumPartitions() == 4 and {r["how"] for r in done.collect()} <= {"single", "none"}
    assert summaries.recover(stories(spark, 0), summaries.StubClient()).count() == 0


def test_a_deadline_needs_a_store(spark):
    with pytest.raises(ValueError):
        summaries.summarize(stories(spark), summaries.StubClient(), deadline_s=1.0)
