import os
from datetime import date, datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quillspark.operators import gate, lookup, report, summaries, tagging
from quillspark.operators.responses import read_batch_answer

RULES = tagging.TagRules(
    mappings={"weather": ["storm", "flood warning"], "city": ["houston", "arrest"], "world": ["world news"], "tech": ["3m", "chip"]},
    boosts={"Tech News": ["tech", "chip"]},
    conflicts=[("weather", "city")],
)


def tags(spark, title, category=None):
    df = spark.createDataFrame([(title, category)], "t string, c string")
    return df.select(tagging.tag_markup(F.col("t"), F.col("c") if category else None, RULES)).first()[0]


@pytest.mark.parametrize(
    "title, category, expected",
    [
        ("Storms near town", None, "[[weather]]"),
        ("Stormy weather", None, "#news"),
        ("Houston's arrests", None, "[[city]]"),
        ("World news today", None, "#news"),
        ("3m grows", None, "#news"),
        ("Storm hits Houston", None, "[[city]]"),
        ("New chip", "Tech News", "[[tech]] [[city]] [[world]]"),
        ("Nothing", "Big Tech", "[[big-tech]] [[big]] [[tech]]"),
    ],
)
def test_tags(spark, title, category, expected):
    assert tags(spark, title, category) == expected


HEADS = ["Flood hits harbour town", "Council approves transit plan", "Heat wave expected soon"]
TEXTS = ["The flood closed three harbour roads. Crews worked overnight.", "The council approved a transit plan. It adds two lines.", "A heat wave is expected. People should drink water."]


@pytest.mark.parametrize(
    "answer, heads, count, expected",
    [
        ("\n".join(f"STORY_{k} | {h}={t}" for k, (h, t) in enumerate(zip(HEADS, TEXTS))), HEADS, 3, TEXTS),
        ("\n".join(f"STORY_{k} | {HEADS[j]}={TEXTS[j]}" for k, j in enumerate((2, 0, 1))), HEADS, 3, TEXTS),
        ("1. One a. One b.\n\n2) Two a. Two b.\n\n### 3. Three a. Three b.", None, 3, ["One a. One b.", "Two a. Two b.", "Three a. Three b."]),
        ("1. Head\n   Body one. Body two.\n\n2. Head two\n   More one. More two.", None, 2, ["Body one. Body two.", "More one. More two."]),
        ("Summary of A:\nText one. More.\n\nSummary of B:\nText two. More.", None, 2, ["Summary of A: Text one. More.", "Summary of B: Text two. More."]),
        ("Here are the summaries:\n\nOne paragraph. Two sentences.", None, 1, ["One paragraph. Two sentences."]),
        ("STORY_0 | Some head=It was so. Really.\nSTORY_9 | Out=Nothing.\n1. Alpha. It grows.\n3. Gamma. It rains.", None, 3, ["Alpha. It grows.", "", "Gamma. It rains."]),
        ("STORY_0 | Unknown matter entirely=Zzz qqq.", HEADS, 3, ["", "", ""]),
        ("1. One. Two. Three. Four. Five.", None, 1, ["One. Two. Three."]),
        ("", HEADS, 3, ["", "", ""]),
        (None, None, 2, ["", ""]),
    ],
)
def test_answers(answer, heads, count, expected):
    assert read_batch_answer(answer, count, heads) == expected


GOALS = ["Bridge closes for repairs", "School board elects chair", "Rain delays harvest"]
ABOUT = ["The bridge closes on Monday for repairs. Detours are posted. Work lasts a week.", "The school board elects a chair tonight. Two members ran. Turnout was low.", "Rain delays the harvest again. Farmers wait. Prices may rise."]


def story(n, head, text):
    return f"STORY_{n} | {head}={text}"


@pytest.mark.parametrize(
    "answer, heads, count, expected",
    [
        # quoted headlines, in order and out of order, paraphrased
        ("\n".join(story(k, GOALS[k], ABOUT[k]) for k in range(3)), GOALS, 3, ABOUT),
        ("\n".join(story(n, h, ABOUT[j]) for n, (h, j) in enumerate((("New leader named", 1), ("Crossing shut", 0), ("Wet fields", 2)))), GOALS, 3, ABOUT),
        ("\n".join(f"STORY_{k} | {ABOUT[k]}" for k in range(3)), GOALS, 3, ABOUT),
        # numbers in several notations, headings with lines below
        ("1. One is here. It stays.\n2) Two is here.\n\n### 3. Three came. It left.", None, 3, ["One is here. It stays.", "Two is here.", "Three came. It left."]),
        ("1. Bridge report\n   The bridge closed. Cars wait.\n\n2. Board report\n   A chair was named.", None, 2, ["The bridge closed. Cars wait.", "A chair was named."]),
        ("**1. Bridge**\nIt closed. Cars wait.", None, 1, ["It closed. Cars wait."]),
        ("### **2. Board**\nA chair was named. Done.", None, 3, ["", "A chair was named. Done.", ""]),
        ("Summary of Bridge:\nIt closed.\n\nSummary of Board:\nA chair was named.", None, 2, ["Summary of Bridge: It closed.", "Summary of Board: A chair was named."]),
        # items come before stories where only numbers count; numbers out of range go nowhere
        ("STORY_0 | A head=Nothing much. Really.\nSTORY_7 | Far=Out of range.\n1. First of all. It counts.\n3. Third. It counts too.", None, 3, ["First of all. It counts.", "", "Third. It counts too."]),
        ("1. A. B. C. D. E.\n2. Only one here.", None, 2, ["A. B. C.", "Only one here."]),
        # items that fit other headlines than their numbers say
        ("1. The school board elects a chair. Two ran.\n2. Rain delays the harvest. Farmers wait.\n3. The bridge closes for repairs. Cars wait.", GOALS, 3, ["The bridge closes for repairs. Cars wait.", "The school board elects a chair. Two ran.", "Rain delays the harvest. Farmers wait."]),
        (story(0, GOALS[0], ABOUT[0]) + "\n1. The school board elects a chair. Two ran.\n2. Rain delays the harvest. Farmers wait.", GOALS, 3, [ABOUT[0], "The school board elects a chair. Two ran.", "Rain delays the harvest. Farmers wait."]),
        # the first claim counts; the second's own slot stays empty, and who would have it goes to its number
        (story(0, GOALS[0], ABOUT[0]) + "\n" + story(1, "Repairs close bridge", "The bridge closes for long repairs. Boats pass.") + "\n" + story(2, GOALS[2], ABOUT[2]), GOALS, 3, [ABOUT[0], "", ABOUT[2]]),
        (story(0, GOALS[0], ABOUT[0]) + "\n" + story(1, GOALS[0], "Other words of it. More.") + "\n" + story(2, GOALS[1], ABOUT[1]), GOALS, 3, [ABOUT[0], "", ABOUT[1]]),
        (story(0, GOALS[0], ABOUT[0]) + "\n1. Bridge closes for repairs. Again.\n2. School board elects chair. Low turnout.", GOALS[:2], 2, [ABOUT[0], "School board elects chair. Low turnout."]),
        # nothing fits; numbers that are none; more than fits
        (story(0, "Of cats", "Cats sat on mats. Birds sang.") + "\n" + story(1, "Of fish", "Fish swim far. Reefs grow."), GOALS[:2], 2, ["", ""]),
        (story(0, GOALS[0], ABOUT[0]) + "\nSTORY_abc | Bad=Skipped words. All.\n" + story(1, GOALS[1], ABOUT[1]) + "\n" + story(42, "Ghost", "Zzz qqq. Xxx."), GOALS[:2], 2, ABOUT[:2]),
        ("STORY_0 | h=a sum x = y stays. Done.", None, 1, ["a sum x = y stays. Done."]),
        ("No structure here\nat all.", None, 2, ["", ""]),
        ("1. One\n2. Two", None, 4, ["One", "Two", "", ""]),
        ("text", None, 0, []),
        (story(0, "words", "Some text here. More."), ["", ""], 2, ["", ""]),
    ],
)
def test_answers_of_every_shape(answer, heads, count, expected):
    assert read_batch_answer(answer, count, heads) == expected


def test_a_missing_headline_is_an_error():
    with pytest.raises(Exception):
        read_batch_answer("STORY_0 | h=Text here. More.", 1, [None])


@pytest.mark.parametrize(
    "summary, headline, reason",
    [
        (None, "Fire downtown", "empty"),
        ("I cannot summarize this. Fire.", "Fire downtown", "refusal"),
        ("According to sources, fire. It burned.", "Fire downtown", "boilerplate"),
        ("[Auto] Fire downtown", "Fire downtown", "marker"),
        ("Fire downtown", "fire  Downtown", "echo"),
        ("Fire downtown burned.", "Fire downtown", "short"),
        ("Mayor speaks. Budget grows.", "Fire downtown", "off_topic"),
        ("The fire burned. Crews came.", "Fire downtown", None),
    ],
)
def test_gate(spark, summary, headline, reason):
    df = spark.createDataFrame([(summary, headline)], "s string, h string")
    assert df.select(gate.gate_reason(F.col("s"), F.col("h"))).first()[0] == reason
    assert summaries.valid_summary(summary, headline) == (reason is None)


def test_nearest_dates(spark):
    rows = [("x", date(2026, 7, 1), 0, "a"), ("x", date(2026, 7, 20), 1, "b"), ("x", date(2026, 7, 30), 2, "c"), ("x", date(2026, 7, 30), 3, "d"), ("y", date(2026, 8, 5), 0, "e")]
    r = spark.createDataFrame(rows, "series string, obs_date date, ord int, value string")
    t = spark.createDataFrame([("today", date(2026, 7, 30)), ("one_week_ago", date(2026, 7, 23)), ("thirty_days_ago", date(2026, 6, 30))], "label string, target date")
    got = {(x["series"], x["label"]): x["value"] for x in lookup.asof_levels(r, t).collect()}
    assert got == {("x", "today"): "c", ("x", "one_week_ago"): "b", ("x", "thirty_days_ago"): "a", ("y", "today"): "e", ("y", "one_week_ago"): "e", ("y", "thirty_days_ago"): "e"}
    named = r.withColumn("reading_label", F.when(F.col("value") == "a", "Today"))
    got = {(x["series"], x["label"]): x["value"] for x in lookup.labelled_levels(named, t).collect()}
    assert got["x", "today"] == "a" and got["x", "one_week_ago"] == "b"


def test_station_merge(spark):
    c = spark.createDataFrame([("a", 95)], "station string, high int")
    m = spark.createDataFrame([("a", "3.1", "3.1"), ("b", None, "2.0")], "station string, average string, current string")
    got = {r["station"]: tuple(r)[1:] for r in lookup.merge_station(c, m).collect()}
    assert got == {"a": ("95°F", "3.1 Inches", "Unavailable"), "b": ("Unavailable", "Unavailable", "2.0 Inches")}


class Silent:
    def complete(self, system, user):
        return ""


def test_batches_and_recovery(spark):
    s = spark.createDataFrame([(k, "news", f"Story number {k} about harbours", "snippet " * 30, "") for k in range(7)], "row_id long, category string, title string, snippet string, context string")
    done = summaries.summarize(s, Silent(), size=3).collect()
    assert {r["how"] for r in done} == {"none"} and all(r["summary"].startswith("[Auto] Story number") for r in done)
    assert {r["batch_calls"] for r in done} == {2} and {r["single_calls"] for r in done} == {2}
    told = summaries.summarize(s, summaries.StubClient(), size=3)
    m = gate.outcome_counts(told).first()
    assert m["total_stories"] == 7 == m["final_valid"] + m["auto_fallbacks"] + m["unavailable_summaries"] + m["final_invalid"]
    assert m["final_valid"] > 0


def test_headline_ratios_are_of_whole_texts(spark, tmp_path):
    from quillspark.catalogue import queries

    head = "Harbour  roads " * 20
    turns = [("same start " * 30 + "A quick ending", "same start " * 30 + "another close"), (head + "closed after the flood", head.upper() + "reopened on Monday"), ("short", "Short"), ("x" * 150 + " abc" * 40, "y" * 150 + " abc" * 40)]
    rows = [(k, n, role, text) for k, pair in enumerate(turns) for n, (role, text) in enumerate(zip(("user", "assistant"), pair))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    flat = [[" ".join(t.lower().split()) for t in pair] for pair in turns]
    got = {r["conv_id"]: r["ratio"] for r in queries()["fuzzy_headline_match"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({k: SequenceMatcher(None, a, b).ratio() for k, (a, b) in enumerate(flat)}, abs=1e-6)


def test_report_round_trip(spark, tmp_path):
    now = datetime(2026, 7, 30, 14)
    rows = [(1, "News", n, f"Harbour story {n}", f"http://x/{n}", "The harbour story was told. It is long." + " Pad." * 300, "2026-07-30", "[[a]]") for n in range(1, 6)]
    s = spark.createDataFrame(rows + [(2, "Empty", None, None, None, None, None, None)], "place int, category string, n int, title string, link string, summary string, pub_date string, tags string")
    body = [r["line"] for r in report.section_lines(s).orderBy("place", "line_pos").collect()]
    f = spark.createDataFrame([(date(2026, 7, 30), "Thu", "Sunny", "Clear", "95°F", "75°F", "10%", "5 mph")], "date date, label string, day string, night string, high string, low string, precip string, wind string")
    lines = [r["line"] for r in report.forecast_lines(f).orderBy("line_pos").collect()]
    assert len(lines) == 3 and lines[1].count("Dynamic") == 7
    head = report.front_matter(now, 5, 2, ["a", "b"])
    path, version = report.reserve(str(tmp_path), now)
    assert version == 1 and report.reserve(str(tmp_path), now)[1] == 2
    report.write_lines(path, [*head, *report.weather_lines(lines, ["| a | b |"], []), *body])
    passed, issues = report.validate_report(spark, path)
    assert passed and issues == ["placeholder: Dynamic"]
    assert report.remove_expired(str(tmp_path), "Digest-", 1) and len(os.listdir(tmp_path)) == 1


def test_missing_report(spark, tmp_path):
    assert report.validate_report(spark, str(tmp_path / "no.md"))[0] is False


def test_versions_and_retention(spark):
    f = spark.createDataFrame([("r", "Digest-2026-07-30_v01.md", 1), ("r", "Digest-2026-07-30_v09.md", 2), ("l", "run.md", 3)], "kind string, name string, mtime long")
    assert lookup.next_version(f, "Digest-2026-07-30").first().asDict() == {"version": 10, "label": "10"}
    assert {r["name"] for r in lookup.keep_newest(f, 1).where("expired").collect()} == {"Digest-2026-07-30_v01.md"}
