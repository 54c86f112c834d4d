"""Closest headlines against matching every pair."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillspark.operators import summaries


def test_closest_headlines_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["harbour", "Ships", "cargo", "  the", "é", "FIRE", "of", "new\n", "story", "x"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))
    heads, lines = [], []
    for batch in range(40):
        own = [text() for _ in range(3)] + [None]
        heads += [(batch, k, h) for k, h in enumerate(own)]
        for k in range(5):
            near = (rng.choice(own) or "").split(" ")
            if near and rng.random() < 0.6:
                near[rng.randrange(len(near))] = rng.choice(words)
            lines.append((batch, k, rng.choice([" ".join(near), text(), None, "a" * 300])))
    df = summaries.closest_headlines(spark.createDataFrame(lines, "b int, line_id int, line string"), spark.createDataFrame(heads, "b int, head_id int, head string"), ["b"], 0.6)
    got = {(r["b"], r["line_id"]): (r["head_id"], round(r["ratio"], 9)) for r in df.collect()}
    flat = lambda t: " ".join((t or "").lower().split())
    expected = {}
    for b, i, line in lines:
        scored = [(SequenceMatcher(None, flat(line), flat(h)).ratio(), -k) for c, k, h in heads if c == b]
        ratio, k = max(scored)
        if ratio >= 0.6:
            expected[b, i] = (-k, round(ratio, 9))
    assert got == expected and 60 < len(got) < 200


def test_the_bound_is_one(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("aab é漢.") for _ in range(rng.randint(0, 30))), "".join(rng.choice("abb é漢(") for _ in range(rng.randint(0, 30)))) for _ in range(300)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", summaries.likeness_bound(F.col("a"), F.col("b")).alias("x")).collect()
    for r in got:
        m = SequenceMatcher(None, r["a"], r["b"])
        assert abs(r["x"] - m.quick_ratio()) < 1e-12 and r["x"] >= m.ratio() - 1e-12


def test_each_pair_is_matched_once_in_small_batches(spark):
    df = spark.createDataFrame([(1, 1, "a b c")], "b int, id int, text string")
    own = summaries.closest_headlines(df.select("b", F.col("id").alias("line_id"), F.col("text").alias("line")), df.select("b", F.col("id").alias("head_id"), F.col("text").alias("head")), ["b"])
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == plan.count("BatchEvalPython") == 1
    assert [tuple(r) for r in own.collect()] == [(1, 1, 1, 1.0)]
