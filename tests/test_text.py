import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "function, value, expected",
    [
        (T.strip, "\u2003 a b \n", "a b"),
        (T.strip_html, "<p class='x'>Hi</p> <b>you</b>", "Hi you"),
        (T.strip_html, None, ""),
        (T.safe_text, "  ", "N/A"),
        (T.safe_text, " x ", "x"),
        (T.present_value, "n/a", "Unavailable"),
        (T.present_value, "a|b", "a&#124;b"),
        (T.clean_number, "about -12.50 in", "-12.5"),
        (T.clean_number, "1234", "123"),
        (T.clean_number, "none", "0"),
        (T.first_number, "1,234 5 in", 12345.0),
        (T.sentence_count, "One. Two! three? Four.", 3),
        (T.sentence_count, "  ", 0),
        (T.sentence_trim, "One. Two. Three. Four.", "One. Two. Three."),
        (T.sentence_trim, "A..  B", "A. B"),
        (T.coerce_percent, "65.25% full", "65.2%"),
        (T.coerce_percent, "0.35", "0.3%"),
        (T.coerce_percent, "full", None),
        (T.coerce_temperature, "-5 F", 5.0),
        (T.coerce_temperature, "900", None),
        (T.normalize_title, " Ｃafe\u0301 ", "cafe\u0301"),
        (T.auto_summary, "Fire downtown: ", "[Auto] Fire downtown"),
        (T.auto_summary, "", "[Summary Unavailable]"),
        (T.lake_label, "big-sandy", "Lake Big Sandy"),
        (T.lake_label, "lake_fork", "Lake Fork"),
        (T.is_obituary, "John Obituary", True),
        (T.is_real_estate, "Costs $5", True),
        (T.is_real_estate, None, False),
    ],
)
def test_scalars(spark, function, value, expected):
    assert one(spark, function(F.col("v")), v=value) == expected


@pytest.mark.parametrize(
    "published, updated, expected",
    [
        ("Thu, 30 Jul 2026 14:00:00 -0500", None, "2026-07-30 19:00:00"),
        ("30 Jul 2026 14:00:00 GMT", "2020-01-01", "2026-07-30 14:00:00"),
        (" ", "2026-07-30T14:00:00Z", "2026-07-30 14:00:00"),
        ("2026-07-30", None, "2026-07-30 00:00:00"),
        ("soon", None, None),
        (None, None, None),
    ],
)
def test_feed_dates(spark, published, updated, expected):
    got = one(spark, T.parse_feed_date(F.col("p"), F.col("u")).cast("string"), p=published, u=updated)
    assert got == expected


def test_zone_of_local_times(spark):
    assert one(spark, T.parse_feed_date(F.col("p"), F.col("p"), "America/Chicago").cast("string"), p="2026-07-30 14:00:00") == "2026-07-30 19:00:00"
    assert one(spark, T.parse_period_time(F.col("p"), "America/Chicago").cast("string"), p="2026-07-18T20:00:00-05:00[America/Chicago]") == "2026-07-19 01:00:00"


def test_context_prefers_long_text(spark):
    c = T.build_context(F.col("c"), F.col("s"), F.col("t"), F.col("k"))
    assert one(spark, c, c="x" * 60, s="s", t="t", k="K") == "x" * 60
    assert one(spark, c, c="short", s="s", t="t", k="K") == "s\n---\nt\n---\nCategory: K"
    assert one(spark, c, c=None, s="", t="", k="K") == "K: "


def test_visible_text():
    page = "<html><style>p{}</style><body><nav>menu</nav><p>One &amp; <b>two</b></p><script>x</script><footer>f</footer></body></html>"
    assert T.visible_text(page) == "One & two"
    assert T.visible_text(None) == ""


def odd_page(rng):
    """Markup of every kind, well formed or not."""
    pieces = ["plain words ", "a &amp; b ", "&lt;", "&#8217;", "&copy", "&notit; ", "AT&T ", "<b>", "</b>", "<p class=\"x y\">", "<p class='x'>", "<p class=x>", "</p >", "<br/>", "<br />", "<img src=\"a>b\">", "<a href='x&amp;y'>", "</a>", "<!-- c -->", "<!-- a - b -->", "<!-- a -- b -->", "<!--->", "<!-- <b> -->", "<!DOCTYPE html>", "<!doctype x [y]>", "<?php x ?>", "<![CDATA[ z ]]>", "<script>", "</script>", "<script src='a'>", "let a = 1 < 2;", "<style>", "</style>", "<nav>", "</nav>", "<NAV id=\"n\">", "</Nav>", "<header>", "</header>", "<footer>", "</footer>", "<aside>", "</aside>", "<navy>", "</navy>", "<title>", "t &amp; u", "</title>", "<textarea>", "</textarea>", "<iframe>", "</iframe>", "<plaintext>", "<svg>", "</svg>", "<", ">", "< b", "<3", "</>", "</ b>", "<a\nb=\"c\"\n>", "\n", " ", "<nav/>", "<script/>", "<x y z=\"1\">", "<a b=c/>", "<a b='c'd='e'>", "'", "\"", "--", "-->", "<noscript>", "</noscript>", "<a b =\"c\">"]
    usual = [p for p in pieces if p not in ("<", "< b", "<3", "</>", "</ b>", "let a = 1 < 2;", "<!-- a -- b -->", "<!-- <b> -->", "<img src=\"a>b\">", "<plaintext>", "<iframe>", "<svg>", "<![CDATA[ z ]]>", "<?php x ?>", "<!--->", "<!doctype x [y]>")]
    return "".join(rng.choice(usual if rng.random() < 0.9 else pieces) for _ in range(rng.randint(1, 30)))


def test_quick_text_is_what_the_parser_reads():
    import random

    rng = random.Random(12)
    quick = 0
    for _ in range(60_000):
        page = odd_page(rng)
        got = T.quick_text(page)
        if got is not None:
            quick += 1
            assert got == T.parsed_text(page), page
    assert quick > 1500
    for page in ("<nav><header>a</nav>b</header>c", "<nav>a<nav>b</nav>c</nav>d", "x<header>y<nav>z</nav></header>w", "a</nav>b", "<nav>open to the end", "<script>if (a < b) x</script>y", "<p>1 < 2</p>"):
        assert T.visible_text(page) == T.parsed_text(page)


def test_pages_are_read_quickly():
    import glob
    import time

    import pyarrow.parquet as pq
    import pytest

    files = glob.glob("/root/testdata/sf0.1/pages.parquet")
    if not files:
        pytest.skip("no tables")
    pages = [h or "" for h in pq.read_table(files[0], columns=["html"])["html"].to_pylist()]
    began = time.process_time()
    quick = [T.visible_text(h) for h in pages]
    middle = time.process_time()
    slow = [T.parsed_text(h) for h in pages]
    assert quick == slow
    assert 2 * (middle - began) < time.process_time() - middle
