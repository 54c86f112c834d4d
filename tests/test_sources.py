import json
from datetime import date

from pyspark.sql import functions as F

from quillspark.operators import lookup
from quillspark.sources import config, feeds, http

RSS = """<?xml version="1.0"?><rss><channel>
<item><title>Old &lt;b&gt;one&lt;/b&gt;</title><link>http://a/1</link><description>d</description><pubDate>Thu, 30 Jul 2026 10:00:00 +0000</pubDate></item>
<item><title>New</title><pubDate>Thu, 30 Jul 2026 12:00:00 +0000</pubDate></item>
<item><title> </title><link>http://a/3</link></item>
<item><title>Undated</title><link>http://a/4</link></item>
</channel></rss>"""


def test_feed_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text(RSS)
    items = feeds.read_feed_files(spark, str(tmp_path / "f.xml"))
    got = feeds.feed_entries(items, F.lit("news")).orderBy("pos").collect()
    assert [(r["title"], r["link"], r["pos"]) for r in got] == [("New", "#", 0), ("Old one", "http://a/1", 1), ("Undated", "http://a/4", 2)]
    assert feeds.feed_entries(items, F.lit("news"), limit=1).count() == 1


def test_urls(spark):
    r = spark.createDataFrame([("a b&c", 50)], "q string, h int").select(feeds.feed_url_with_window(F.col("q"), F.col("h"), "B?q=", "&z").alias("u")).first()
    assert r["u"] == "B?q=when%3A3d+a+b%26c&z"


def test_forecast(spark):
    def period(day, night, temp, short):
        return {"startTime": f"2026-07-{day}T{'18' if night else '06'}:00:00-05:00", "isDaytime": not night, "temperature": temp, "temperatureUnit": "F", "shortForecast": short, "windSpeed": "5 mph", "windDirection": "S", "probabilityOfPrecipitation": {"value": 10}}

    good = {"properties": {"periods": [period(30, False, 95, "Sunny"), period(30, True, 75, "Clear"), period(31, False, 96, "Hot")]}}
    broken = {"properties": {"periods": [dict(period(30, False, 1, "x"), probabilityOfPrecipitation=None)]}}
    raw = spark.createDataFrame([("a", json.dumps(good)), ("b", json.dumps(broken)), ("c", "no json"), ("d", None)], "station string, payload string")
    p = feeds.forecast_periods(raw)
    assert {r["station"] for r in p.collect()} == {"a"}
    days = spark.createDataFrame([(date(2026, 7, 30),), (date(2026, 7, 31),), (date(2026, 8, 1),)], "target date")
    rows = lookup.forecast_rows(p.drop("station"), days).orderBy("date").collect()
    assert [(r["day"], r["night"], r["high"], r["low"], r["precip"], r["wind"]) for r in rows] == [("Sunny", "Clear", "95°F", "75°F", "10%", "5 mph S"), ("Hot", "Clear", "96°F", "75°F", "10%", "5 mph S"), ("Hot", "Clear", "96°F", "75°F", "10%", "5 mph S")]


def test_climate_rounding(spark):
    rows = [("91.4", 91), ("88.5", 88), ("95.6", 96)]
    df = spark.createDataFrame([(f'{{"daily":{{"temperature_2m_max":[{v}]}}}}',) for v, _ in rows] + [("x",)], "j string")
    assert [r[0] for r in df.select(feeds.climate_high(F.col("j"))).collect()] == [91, 88, 96, None]


def test_normals_table(spark):
    months = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
    row = lambda cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    html = "<table>" + row(["", *months]) + row(["Rain Totals (in)", *[f"{k}.4" for k in range(12)]]) + "</table>"
    html += "<table>" + row(["2026", *["9"] * 12]) + row(["Rain totals", *[f"{k}.1 (+2)" for k in range(12)]]) + "</table>"
    cells = feeds.html_tables(spark.createDataFrame([("s", html), ("t", "")], "k string, html string"), "k")
    got = feeds.monthly_normals(cells, "k", 7, 2026).collect()
    assert [(r["k"], r["average"], r["current"]) for r in got] == [("s", 6.4, 6.1)]


def test_station_rain(spark):
    df = spark.createDataFrame([("x Summary July Precipitation 3.25 ° in more graph Precipitation 9 in",), ("Summary Precipitation 99 in",), ("none",)], "t string")
    assert [r[0] for r in df.select(feeds.station_rain(F.col("t"))).collect()] == [3.25, None, None]


def test_retries():
    calls = []

    def flaky(url, timeout):
        calls.append(url)
        return (503, {}, b"") if len(calls) < 3 else (200, {"Content-Length": "2"}, b"ok")

    r = http.get("u", flaky, sleep=lambda s: None)
    assert (r["status"], r["body"], r["attempts"]) == (200, b"ok", 3)
    assert http.get("u", lambda *a: (404, {}, b""), sleep=lambda s: None)["attempts"] == 1
    assert http.get("u", lambda *a: (200, {"content-length": "99"}, b""), limit=5)["error"] == "too large"
    assert http.get("u", lambda *a: 1 / 0, sleep=lambda s: None)["error"] == "ZeroDivisionError"


def fake_transport(url, timeout):
    return (200, {}, url.encode()) if url != "bad" else (500, {}, b"")


def test_web_source(spark):
    spark.dataSource.register(http.WebSource)
    df = spark.read.format("web").option("urls", json.dumps(["a", "bad", "c"])).option("transport", "tests.test_sources:fake_transport").load()
    got = {r["url"]: (r["status"], r["body"]) for r in df.collect()}
    assert got == {"a": (200, bytearray(b"a")), "bad": (500, None), "c": (200, bytearray(b"c"))}


def test_config(spark, tmp_path):
    tree = {"timezone": "UTC", "output_dir": "x", "categories": {"A": {"query": "a", "max_stories": 3}, "B": {"query": ""}}, "category_priority": ["A"], "tagging_mappings": {"t": ["k"]}}
    assert config.validate_config(tree) == (True, [])
    assert [r["category"] for r in config.category_table(spark, tree).collect()] == ["A"]
    assert config.tag_rules(tree).mappings == {"t": ["k"]}
    bad = dict(tree, timezone="Nowhere/Land", category_priority=["Z"], categories={"A": {"query": 1, "max_stories": True}})
    assert len(config.validate_config(bad)[1]) == 4
    (tmp_path / "config.yaml").write_text("a: {b: 1}")
    p = config.find_config(cwd=str(tmp_path))
    assert config.lookup(config.load_config(p), "a.b") == 1 and config.lookup({}, "a.b", 7) == 7


def test_filters_choose_the_requests():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    reader = http.WebSource({"urls": json.dumps(["a", "b", "c", "d"]), "parallel": "2", "pushdown": "true"}).reader(None)
    filters = [In(("url",), ("a", "b", "x")), GreaterThan(("status",), 1), EqualTo(("url",), "b")]
    assert list(reader.pushFilters(filters)) == filters
    assert [u for p in reader.partitions() for u in p.urls] == ["b"]


def test_pushed_filters(spark):
    spark.dataSource.register(http.WebSource)
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        df = spark.read.format("web").option("urls", json.dumps(["a", "bad", "c"])).option("transport", "tests.test_sources:fake_transport").option("pushdown", "true").load()
        assert [r["url"] for r in df.where("url = 'c'").collect()] == ["c"]
    finally:
        spark.conf.unset(key)


class _Pages:
    """A server on this machine: /n gives n bytes, /told/n says so in its header, /lie/n says less."""

    def __enter__(self):
        import threading
        from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

        sent = self.sent = []

        class Page(BaseHTTPRequestHandler):
            def do_GET(self):
                n = int(self.path.rsplit("/", 1)[-1])
                self.send_response(200)
                if self.path.startswith("/told"):
                    self.send_header("Content-Length", str(n))
                self.end_headers()
                try:
                    for k in range(0, n, 1 << 16):
                        self.wfile.write(b"x" * min(1 << 16, n - k))
                        sent.append(min(1 << 16, n - k))
                except OSError:
                    pass

            def log_message(self, *a):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Page)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"
        return self

    def __exit__(self, *a):
        self.server.shutdown()
        self.server.server_close()


def test_bodies_up_to_any_limit():
    mib = 1 << 20
    with _Pages() as pages:
        for path in ("", "/told"):
            r = http.get(f"{pages.base}{path}/{8 * mib}", http._urllib, limit=10 * mib)
            assert len(r["body"]) == 8 * mib and r["error"] is None
            assert http.get(f"{pages.base}{path}/{8 * mib}", http._urllib)["error"] == "too large"
            assert len(http.get(f"{pages.base}{path}/{5 * mib}", http._urllib)["body"]) == 5 * mib
        del pages.sent[:]
        # without a header no more is read than the limit and what buffers hold
        assert http.get(f"{pages.base}/{512 * mib}", http._urllib, limit=mib)["body"] is None
        assert sum(pages.sent) < 64 * mib


def test_a_length_above_the_limit_is_not_read():
    read = []

    class Pieces:
        def __iter__(self):
            read.append("begun")
            yield b"x"

        def close(self):
            read.append("closed")

    r = http.get("u", lambda u, t: (200, {"Content-Length": "11"}, Pieces()), limit=10)
    assert r["error"] == "too large" and r["body"] is None and read == ["closed"]
    r = http.get("u", lambda u, t: (404, {}, Pieces()), limit=10)
    assert r["error"] == "status 404" and read == ["closed", "closed"]

    def broken():
        yield b"x"
        raise OSError("gone")

    assert http.get("u", lambda u, t: (200, {}, broken()), sleep=lambda s: None) == {"status": None, "body": None, "error": "OSError", "attempts": 3}
    assert http.get("u", lambda u, t: (200, {}, iter([b"ab", b"c"])), limit=3)["body"] == b"abc"
