"""A folder of reports in one plan against the check of each file."""

import os
import random

from quillspark.operators import report


def random_report(rng):
    """A report with anything amiss."""
    meta = {"title": "Digest", "date": "2026-07-30", "time_generated": "x", "status": "active", "content_age_window": "24", "story_count_total": rng.choice(["7", "3", "201", "none", "5", "x1", "[1]"]), "categories": "2", "tags": "[a]"}
    for k in rng.sample(list(meta), rng.choice([0, 0, 1, 3])):
        del meta[k]
    head = rng.choice(["---\n" + "\n".join(f"{k}: {v}" for k, v in meta.items()) + "\n---\n", "", "---\n: [\n---\n", "no matter\n"])
    rows = ["| a | b | c |", "| --- | --- | --- |", "| - | - | - |", "| x | y |", "text"]
    weather = rng.choice(["## Weather Forecast\n", "## Other\n", "## The FORECAST\n"]) + "\n".join(rng.choice(rows) for _ in range(rng.randint(0, 6)))
    stories = []
    for k in range(rng.randint(0, 14)):
        title = rng.choice([f"Harbour story {k} about ships", "Short", "Fire [downtown] now", "A of the"])
        summary = rng.choice([f"{title}. More on it follows. It ended.", f"{title}.", "", "One sentence about harbour ships", "[Auto] " + title, "[Headline] x. Yes it is.", "Nothing in common. At all here.", "Harbour Dynamic data. Unavailable words. Story ships."])
        link = rng.choice([f"http://x/{k}", "http://x/same", "#"])
        stories.append(f"{k + 1}. [{title}]({link})\n{summary}\n*Originally published on:* today\n[[tag]]" if rng.random() < 0.9 else f"{k + 1}. {title}\n{summary}")
    body = f"{head}\n# Digest\n{weather}\n\n## Local (3 stories)\n\n" + "\n\n".join(stories) + "\n" + rng.choice(["", "pad " * 2000])
    return body.replace("\n", rng.choice(["\n", "\n", "\r\n"]))


def test_a_folder_equals_its_files(spark, tmp_path):
    rng = random.Random(3)
    for k in range(60):
        with open(tmp_path / f"r{k}.md", "w", encoding="utf-8", newline="") as fh:
            fh.write(random_report(rng))
    got = {os.path.basename(r["path"]): (r["passed"], r["issues"]) for r in report.validate_reports(spark, str(tmp_path)).collect()}
    assert len(got) == 60
    seen = set()
    for k in range(60):
        passed, issues = report.validate_report(spark, str(tmp_path / f"r{k}.md"))
        assert got[f"r{k}.md"] == (passed, issues)
        seen |= {i.split(":")[0] for i in issues}
    assert {"front matter", "weather", "placeholder", "story count", "duplicate URLs", "size", "empty", "echo", "short", "marker", "off_topic", "no stories"} <= seen


def test_reports_are_one_projection(spark, tmp_path):
    for k in range(1000):
        (tmp_path / f"r{k}.md").write_text(f"## Weather\n1. [Story {k}](http://x/{k})\nText on story {k}. And more.\n")
    checked = report.validate_reports(spark, str(tmp_path))
    assert "Exchange" not in checked._jdf.queryExecution().executedPlan().toString()
    assert checked.where("passed").count() == 1000
