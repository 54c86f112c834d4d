import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.operators import gate, report
from quillspark.operators.summaries import StubClient
from quillspark.plans import digest
from quillspark.sources import chat, feeds, weather

TODAY = date(2026, 7, 30)
ROW = "<table><tbody>" + "".join("<tr><td>{}</td><td>{}</td><td>{}</td></tr>".format(*r) for r in (("Today", "2026-07-30", "88.1%"), ("1 week ago", "2026-07-23", "87 %"), ("other", "2026-06-30", "80.25%"))) + "</tbody></table>"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def table_row(cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


NORMALS = "<table>" + table_row(["", *MONTHS]) + table_row(["Rain Totals (in)", *[f"{k}.5" for k in range(12)]]) + "</table>"


def forecast_payload():
    def period(day, is_day, temp):
        return {"startTime": f"2026-07-{day}T{'06' if is_day else '18'}:00:00-05:00", "isDaytime": is_day, "temperature": temp, "temperatureUnit": "F", "shortForecast": "Sunny", "windSpeed": "5 mph", "windDirection": "S", "probabilityOfPrecipitation": {"value": 10}}

    return json.dumps({"properties": {"periods": [period(30, True, 95), period(30, False, 75), period(31, True, 96)]}})


PAGES = {
    "http://w/forecast": forecast_payload(),
    "http://w/climate": '{"daily":{"temperature_2m_max":[91.4]}}',
    "http://w/graph/2026-07-01/2026-07-30/monthly": "<p>Summary 2026-07-01 2026-07-30 Precipitation 2.25 in</p> graph",
    "http://w/normals": NORMALS,
    "http://w/north": ROW,
    "http://w/south": "<p>Levels: 71.5 % and 70% then 69.04%</p>",
}
PLACES = weather.Places("http://w/forecast", "http://w/climate", "http://w/graph/x/y/monthly", "http://w/normals", {"north_fork": "http://w/north", "lake-south": "http://w/south", "east": "http://w/gone"})


def fetch(spark, pages):
    def get(urls):
        return spark.createDataFrame([(u, 200 if u in pages else 404, pages[u].encode() if u in pages else None, None if u in pages else "status 404") for u in urls], "url string, status int, body binary, error string")

    return get


def test_all_providers(spark):
    got = weather.collect_weather(spark, PLACES, fetch(spark, PAGES), TODAY)
    assert [r["high"] for r in got["forecast"]] == ["95°F", "96°F", "96°F"]
    assert got["station"] == {"avg_temp_today": "91°F", "avg_monthly_rainfall": "6.5 Inches", "current_monthly_rainfall": "2.25 Inches"}
    assert list(got["lakes"]) == ["north_fork", "lake-south", "east"]
    assert got["lakes"]["north_fork"] == {"today": "88.1%", "one_week_ago": "87.0%", "thirty_days_ago": "80.2%"}
    assert got["lakes"]["lake-south"] == {"today": "71.5%", "one_week_ago": "70.0%", "thirty_days_ago": "69.0%"}
    assert got["lakes"]["east"] == dict.fromkeys(weather.LABELS) and got["errors"] == ["http://w/gone: status 404"]
    assert not weather.station_flags(got)["any_missing"]


@pytest.mark.parametrize("gone", sorted(PAGES))
def test_a_provider_that_fails_costs_no_other(spark, gone):
    whole = weather.collect_weather(spark, PLACES, fetch(spark, PAGES), TODAY)
    got = weather.collect_weather(spark, PLACES, fetch(spark, {u: p for u, p in PAGES.items() if u != gone}), TODAY)
    assert f"{gone}: status 404" in got["errors"]
    differ = [k for k in ("forecast", "station") if got[k] != whole[k]] + [k for k in PLACES.lakes if got["lakes"][k] != whole["lakes"][k]]
    assert len(differ) == 1
    flags = weather.station_flags(got)
    assert flags["any_missing"] == (gone in ("http://w/climate", "http://w/normals") or "graph" in gone) and not flags["all_missing"]


def test_a_point_names_its_forecast(spark):
    import dataclasses

    pages = PAGES | {"http://w/points/1,2": '{"properties":{"forecast":"http://w/forecast"}}', "http://w/points/0,0": "{}"}
    asked = dataclasses.replace(PLACES, forecast=None, point="http://w/points/1,2")
    assert len(weather.collect_weather(spark, asked, fetch(spark, pages), TODAY)["forecast"]) == 3
    got = weather.collect_weather(spark, dataclasses.replace(asked, point="http://w/points/0,0"), fetch(spark, pages), TODAY)
    assert got["forecast"] == [] and "http://w/points/0,0: no forecast" in got["errors"]


def test_no_provider_at_all(spark):
    got = weather.collect_weather(spark, weather.Places(lakes={"a": "http://w/a"}), fetch(spark, {}), TODAY)
    assert got["forecast"] == [] and set(got["station"].values()) == {"Unavailable"} and got["lakes"] == {"a": dict.fromkeys(weather.LABELS)}
    assert weather.station_flags(got) == {"any_missing": True, "all_missing": True, "fallback": False, "partial": True}
    assert weather.station_flags({"station": dict.fromkeys(weather.STATION, "x (forecast fallback)")})["partial"]


@pytest.mark.parametrize("bundle", [None, 7, {"forecast": "x"}, {"station": 3, "lakes": []}])
def test_degraded_bundles(spark, bundle):
    safe = weather.normalized(bundle)
    assert len(safe["forecast"]) == 3 and safe["station"] == {} and safe["lakes"] == {} and safe["forecast"][0]["wind"] == "N/A"
    assert sum(x.startswith("| ") for x in weather.weather_section(spark, bundle, ["a"])) >= 8


def test_section(spark):
    bundle = {"forecast": [{"label": "Thu", "day": "Sunny|dry", "high": "9°F"}], "station": {"avg_temp_today": "91°F"}, "lakes": {"north_fork": {"today": "88.1%"}}}
    lines = weather.weather_section(spark, bundle, ["lost", "north_fork"])
    assert "| Thu | Sunny&#124;dry | Unavailable | 9°F | Unavailable | Unavailable | Unavailable |" in lines
    assert lines.count("| Dynamic | Dynamic | Dynamic | Dynamic | Dynamic | Dynamic | Dynamic |") == 2
    assert lines[-2:] == ["| Lake Lost | Unavailable | Unavailable | Unavailable |", "| Lake North Fork | 88.1% | Unavailable | Unavailable |"]
    assert f"| {report.STATION_ROWS[0]} | 91°F |" in lines
    many = {"forecast": [{"label": str(k)} for k in range(5)]}
    assert sum(x.startswith(("| 0", "| 1", "| 2", "| 3")) for x in weather.weather_section(spark, many, [])) == 3


def test_station_comes_before_climate(spark):
    own = spark.createDataFrame([("a", "Summary 2026-07-01 2026-07-30 Precipitation 1.5 in"), ("b", "nothing"), ("c", None)], "station string, html string")
    climate = spark.createDataFrame([("a", NORMALS), ("b", NORMALS + "<table>" + table_row(["2026", *["9"] * 12]) + table_row(["Rain totals", *["7.1"] * 12]) + "</table>"), ("d", None)], "station string, html string")
    got = {r["station"]: (r["average"], r["current"]) for r in weather.month_rain(own, climate, TODAY).collect()}
    assert got["a"] == (6.5, 1.5) and got["b"] == (6.5, 7.1) and got["c"] == (None, None)


def test_texts_and_metrics(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert [r["text"] for r in feeds.read_texts(spark, str(tmp_path)).collect()] == ["one\ntwo"]
    s = spark.createDataFrame([("x", 5), ("", None), (None, None)], "context string, extract_bytes long")
    assert tuple(gate.extraction_metrics(s, 2.0).first()) == (3, 1, 5, 1.5)
    assert tuple(gate.extraction_metrics(s.drop("extract_bytes")).first()) == (3, 1, 0, 0.0)
    places = spark.createDataFrame([("A",), ("Weather Forecast",), ("B",)], "category string")
    assert report.rendered_categories(places) == 2


def test_items_of_fetched_feeds(spark):
    rss = "<?xml version='1.0'?><rss><channel><title>c</title><item><title>One</title><link>http://a/1</link><pubDate>Thu, 30 Jul 2026 10:00:00 +0000</pubDate></item><item><title>Two</title></item></channel></rss>"
    one = rss.replace("<item><title>Two</title></item>", "")
    pages = spark.createDataFrame([("a", rss), ("b", one), ("c", "no feed"), ("d", None), ("e", "<rss><channel/></rss>")], "category string, text string")
    assert sorted((r["category"], r["title"]) for r in feeds.feed_items(pages).collect()) == [("a", "One"), ("a", "Two"), ("b", "One")]


def fake_post(url, headers, body, timeout):
    asked = json.loads(body)
    return (200, json.dumps({"choices": [{"message": {"content": f" {asked['model']} {headers.get('Authorization')} {asked['messages'][1]['content']} {url} "}}]}).encode()) if asked["messages"][0]["content"] != "bad" else (500, b"")


def test_chat_client(monkeypatch):
    monkeypatch.setenv("QUILL_TEST_KEY", "k1")
    client = chat.ChatClient("http://m/v1/", "small", "QUILL_TEST_KEY", post="tests.test_weather:fake_post")
    assert client.complete("s", "hello") == "small Bearer k1 hello http://m/v1/chat/completions"
    with pytest.raises(OSError):
        client.complete("bad", "x")


def run_transport(url, timeout):
    if url in PAGES:
        return 200, {}, PAGES[url].encode()
    if "q=" in url and "broken" not in url:
        n = 6
        items = "".join(f"<item><title>Harbour story {url[-1]} number {k} about ships</title><link>http://page/{url[-1]}/{k}</link><description>{'long words here ' * 20}</description><pubDate>Thu, 30 Jul 2026 {k:02}:00:00 +0000</pubDate></item>" for k in range(n))
        return 200, {}, f"<rss><channel>{items}</channel></rss>".encode()
    if url.startswith("http://page/") and not url.endswith("3"):
        return 200, {}, ("<html><body><p>" + "An article about a harbour and its ships and cargo. " * 20 + "</p></body></html>").encode()
    return 404, {}, b""


def test_a_run_from_a_configuration(spark, tmp_path, capsys):
    import yaml

    tree = {
        "timezone": "UTC", "output_dir": str(tmp_path / "out"), "tags": ["news"], "category_priority": ["World"],
        "categories": {"Local": {"query": "l", "max_stories": 4}, "Lost": {"query": "broken"}, "World": {"query": "w", "max_stories": 5}},
        "rss": {"base": "http://feed/?q=", "params": ""}, "tagging_mappings": {"sea": ["harbour", "ships"]},
        "weather": {"forecast": "http://w/forecast", "climate": "http://w/climate", "station": "http://w/graph/x/y/monthly", "normals": "http://w/normals", "lakes": PLACES.lakes},
    }
    path = tmp_path / "c.yaml"
    path.write_text(yaml.safe_dump(tree))
    code = main(["--config", str(path), "run", "--stub", "--transport", "tests.test_weather:run_transport", "--now", "2026-07-30T14:00:00", "--work", f"file://{tmp_path}/work"])
    said = capsys.readouterr().out
    out = os.path.join(str(tmp_path / "out"), "Digest-2026-07-30_v01.md")
    text = open(out).read()
    assert code == 0, said
    (log,) = os.listdir(tmp_path / "out" / "logs")
    told = open(tmp_path / "out" / "logs" / log).read()
    for part in ("sources: ", "stories: total_before 12, age_filtered 0, dup_filtered 0, total_after 9, cross_dup_filtered 0", "articles: stories 9, extracted 7,", "summaries: total_stories 9,", "report: ", "validation: ", "passed"):
        assert part in told, told
    assert text.index("## World (5 stories)") < text.index("## Local (4 stories)") < text.index("## Lost")
    assert "story_count_total: 9" in text and "categories: 3" in text and "| Lake North Fork | 88.1% |" in text and "[[sea]]" in text
    tree["timezone"] = "No/Where"
    path.write_text(yaml.safe_dump(tree))
    assert main(["--config", str(path), "run", "--stub"]) == 1
    assert datetime(2026, 7, 30)


class Told:
    """A client that says which prompts it got."""

    def complete(self, system, user):
        assert system in ("B!", "S!", "T!")
        return StubClient().complete(system, user) if system != "B!" else ""


def test_pages_of_kept_stories_only(spark, tmp_path):
    asked = []

    def fetch(urls):
        asked.append(list(urls))
        rows = [(u, *(run_transport(u, 1.0)[k] for k in (0, 2))) for u in urls]
        return spark.createDataFrame([(u, s, bytearray(b) if s == 200 else None, None, 1) for u, s, b in rows], "url string, status int, body binary, error string, attempts int")

    n = iter(range(100))

    def store(df):
        path = str(tmp_path / f"t{next(n)}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    tree = {
        "timezone": "UTC", "output_dir": str(tmp_path / "out"), "categories": {"Local": {"query": "l", "max_stories": 2}, "World": {"query": "w", "max_stories": 3}},
        "rss": {"base": "http://feed/?q=", "params": ""}, "prompts": {"batch": "B!", "single": "S!", "strict": "T!"}, "llm": {"recovery_concurrency": 3, "recovery_deadline_s": 600, "batch_size": 2},
    }
    code, path, issues = digest.run_config(spark, tree, datetime(2026, 7, 30, 14), Told(), fetch, store)
    assert code == 0, issues
    pages = sorted(u for urls in asked for u in urls if u.startswith("http://page/"))
    # the newest of each feed, not the whole pools of six
    assert pages == ["http://page/l/4", "http://page/l/5", "http://page/w/3", "http://page/w/4", "http://page/w/5"]
    run = digest.settings(tree, datetime(2026, 7, 30, 14), digest.logging.getLogger("t"))
    assert run.prompts.strict == "T!" and run.recovery_parallel == 3 and run.recovery_deadline_s == 600.0 and run.batch_size == 2
    # all batches stay silent: every story with a page is recovered alone
    assert "individual_recovered 5" in open(tmp_path / "out" / "logs" / os.listdir(tmp_path / "out" / "logs")[0]).read()
