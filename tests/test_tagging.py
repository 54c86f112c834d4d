"""Tags by the dictionary's index against a plain reading of the rules, on odd dictionaries and a large one."""

import random
import re
import time

from quillspark.functions import lexicon
from quillspark.operators import tagging
from quillspark.operators.tagging import TagRules


def plain_scores(title, category, rules):
    """(score, tag) above the threshold, best first: every keyword is searched for on its own."""
    low = title.lower()

    def stands(kw):
        return bool(re.search(r"(?<![a-zA-Z])" + re.escape(kw.lower()) + r"(s|es|ed|ing)?(?![a-zA-Z])", low))

    def silent(kw):
        return all(w in lexicon.TAG_STOP for w in re.findall(r"\b[a-z]+\b", kw.lower()))

    out = []
    for n, (tag, keywords) in enumerate(rules.mappings.items()):
        score = 0.0
        for kw in keywords or []:
            if kw and not silent(kw) and kw in low and stands(kw):
                score += (2.0 if low.find(kw) < 100 else 1.0) * max(sum(w not in lexicon.TAG_STOP for w in kw.split()), 1)
        if category in rules.boosts:
            boosted = rules.boosts[category]
            score += 3.0 if tag in boosted else sum(2.0 for b in boosted if not silent(b) and b.lower() in low and stands(b))
        if score > rules.score_threshold:
            out.append((-min(score, rules.score_cap), n, tag))
    return [(-s, t) for s, _, t in sorted(out)]


def check(spark, rules, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "title string, category string")
    for category in (F.col("category"), None):
        got = df.select("title", "category", tagging.scored_tags(F.col("title"), category, rules).alias("s")).collect()
        for r in got:
            expected = plain_scores(r["title"] or "", r["category"] if category is not None else None, rules)
            assert [(x["score"], x["tag"]) for x in r["s"]] == expected, (r["title"], r["category"])


def test_odd_dictionaries(spark):
    rng = random.Random(6)
    words = ["ship", "ships", "boat", "c++", "3d print", "at&t", "u.s.", "the sea", "ai", "new york", "o'brien", "gas", "gases", "$5 bill", "naïve", "x", "4x4", "re-open", "of the", "Upper", "passed", "pass", "box", "boxing", "the", "é", "5g", "gas gas", "(red)"]
    for seed in range(4):
        rng = random.Random(seed)
        tags = {f"t{k}": [rng.choice(words) for _ in range(rng.randint(0, 6))] for k in range(7)} | {"ai": ["ai"], "none": None}
        rules = TagRules(tags, {"A": ["t1", "ai", "Ship"], "B": ["gas", "unknown", "c++"], "C": []}, score_cap=rng.choice([5.0, 2.0]))
        rows = [(None, "A"), ("", None), ("the of", "B")]
        for _ in range(250):
            parts = [rng.choice([*words, *(w + e for w in words for e in ("s", "es", "ed", "ing", "x")), "pad" * 12]) for _ in range(rng.randint(1, 9))]
            rows.append((rng.choice([" ", "-", ", ", ""]).join(parts), rng.choice(["A", "B", "C", "D", None])))
        check(spark, rules, [(t if t is None or rng.random() < 0.5 else t.title(), c) for t, c in rows])


def test_a_large_dictionary_is_planned_at_once(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    tags = {f"tag{k}": [" ".join(word() for _ in range(rng.choice([1, 1, 2]))) for _ in range(14)] for k in range(36)}
    every = [kw for own in tags.values() for kw in own]
    rules = TagRules(tags, {f"cat{k}": rng.sample(list(tags), 4) + rng.sample(every, 6) for k in range(16)}, [("tag1", "tag2"), ("tag3", "tag4")])
    rows = [(" ".join(rng.choice([rng.choice(every), word()]) for _ in range(8)), f"cat{rng.randrange(18)}") for _ in range(300)]
    df = spark.createDataFrame(rows, "title string, category string")
    df.select(tagging.tag_markup(F.col("title"), F.col("category"), TagRules({"a": ["b"]}))).collect()
    began = time.process_time(), time.time()
    planned = df.select(tagging.tag_markup(F.col("title"), F.col("category"), rules).alias("tags"))
    plan = planned._jdf.queryExecution().executedPlan()
    assert time.time() - began[1] < 5 and time.process_time() - began[0] < 1
    assert plan is not None and planned.where("tags <> ''").count() == 300
    check(spark, rules, rows)
