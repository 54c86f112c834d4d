"""All queries of the engine proper over the shared tables, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicon
from .functions import text as T
from .operators import dedup, gate, lookup, report, summaries, tagging
from .sources import feeds

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2024, 1, 31)
AGE, WINDOW, CAP, POOL = 24, 168, 5, 50

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; times without a zone are UTC, which is what the session's zone is set to."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


# ---------------------------------------------------------------- shared shapes
def _stories(spark: SparkSession, d: str) -> DataFrame:
    """Documents as stories; their times are those of events."""
    events = _read(spark, d, "events")
    docs = _read(spark, d, "documents").crossJoin(F.broadcast(events.agg(F.count("*").alias("n_events"))))
    title = F.substring_index("text", "\n", 1)
    s = docs.select(F.col("doc_id").alias("row_id"), F.col("source").alias("category"), "lang", title.alias("title"), F.col("text").alias("snippet"), ((F.col("doc_id") * 10) % F.col("n_events")).alias("event_id"))
    return s.join(events.select("event_id", F.col("ts").alias("pub_dt")), "event_id").drop("event_id").withColumn("norm", T.title_key(F.col("title")))


def _titles(spark: SparkSession, d: str) -> DataFrame:
    """Stories without their texts: what deduplication carries through its shuffles."""
    return _stories(spark, d).drop("snippet", "lang")


def _categories(spark: SparkSession, d: str) -> DataFrame:
    src = _read(spark, d, "documents").select(F.col("source").alias("category")).where("category IS NOT NULL").distinct()
    return src.select("category", F.substring("category", 4, 9).cast("int").alias("cat_pos"), F.lit(AGE).alias("age_limit_h"), F.lit(WINDOW).alias("window_h"), F.lit(CAP).alias("cap"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """What a user said as headline, the answer as summary."""
    c = _read(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("title"))
    answer = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("summary"))
    return user.join(answer, ["conv_id", "turn"])


_S = """stories AS (
  SELECT d.doc_id AS row_id, d.source AS category, d.lang, split_part(d.text, chr(10), 1) AS title, d.text AS snippet, e.ts AS pub_dt,
    lower(regexp_replace(split_part(d.text, chr(10), 1), '^\\s+|\\s+$', '', 'g')) AS norm,
    (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(e.ts)) / 3600000000.0 AS age_h
  FROM documents d JOIN events e ON e.event_id = (d.doc_id * 10) % (SELECT count(*) FROM events))"""
_C = "cats AS (SELECT DISTINCT source AS category, CAST(substr(source, 4) AS INT) AS cat_pos FROM documents WHERE source IS NOT NULL)"
_P = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS title, a.text AS summary
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join("contains(lower({}), '{}')".format(column, p.replace("'", "''")) for p in phrases) + ")"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def _sentences(x: str) -> str:
    """Number of sentences of a text."""
    return f"CASE WHEN {x} IS NULL OR {_strip(x)} = '' THEN 0 ELSE 1 + len(regexp_extract_all({_collapse(x)}, '[.!?]\\s+[A-Z0-9\"'']')) END"


def _list(words) -> str:
    return "[" + ", ".join("'{}'".format(w.replace("'", "''")) for w in words) + "]"


def _significant(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-zA-Z'']+'), lambda w: len(w) > 3 AND NOT list_contains({_list(lexicon.TOPIC_STOP)}, w)))"


_BAD = f"({_any('title', lexicon.OBITUARY)} OR {_any('title', lexicon.REAL_ESTATE)})"
_DEDUP = f"""{_S}, {_C},
c AS (SELECT s.*, k.cat_pos, CASE WHEN age_h IS NULL OR age_h <= {AGE} THEN 0 ELSE greatest(2, ceil(age_h / 24))::INT END AS band, {_BAD} AS bad
  FROM stories s JOIN cats k USING (category)),
r AS (SELECT *, row_number() OVER (PARTITION BY category, norm ORDER BY band, pub_dt DESC, row_id) AS rn,
    bool_or(band = 0) OVER (PARTITION BY category, norm) AS in0 FROM c),
e AS (SELECT *, (rn = 1 AND NOT bad) AS ok,
    coalesce(sum(CASE WHEN rn = 1 AND NOT bad THEN 1 ELSE 0 END) OVER (PARTITION BY category ORDER BY band RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM r),
q AS (SELECT *, (band = 0 OR (below < 3 AND band <= least({WINDOW // 24}, 7))) AS reached FROM e),
acc AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY band, pub_dt DESC, row_id) AS k FROM q WHERE ok AND reached),
capped AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY cat_pos, band, pub_dt DESC, row_id) AS x FROM acc WHERE k <= {CAP})"""


# ---------------------------------------------------------------- deduplication
@_query("feed_dedup", f"WITH {_DEDUP} SELECT category, row_id, title, band, k::INT AS k FROM capped WHERE x = 1")
def _feed_dedup(spark, d):
    out = dedup.feed_dedup(_titles(spark, d), _categories(spark, d), NOW, CAP)
    return out.select("category", "row_id", "title", "band", "k")


@_query(
    "feed_dedup_stats",
    f"""WITH {_DEDUP} SELECT (SELECT count(*) FROM c) AS total_before, (SELECT count(*) FROM capped WHERE x = 1) AS total_after,
  (SELECT count(*) FROM c WHERE age_h > {AGE}) AS age_filtered,
  (SELECT count(*) FROM q WHERE reached AND rn > 1 AND (band = 0 OR in0 OR NOT bad)) AS dup_filtered,
  (SELECT count(*) FROM capped WHERE x > 1) AS cross_dup_filtered""",
)
def _feed_dedup_stats(spark, d):
    return dedup.feed_dedup_stats(_titles(spark, d), _categories(spark, d), NOW, CAP)


@_query("age_filter", f"WITH {_S} SELECT row_id, round(age_h, 6) AS age_h FROM stories WHERE age_h IS NULL OR age_h <= 72")
def _age_filter(spark, d):
    s = _stories(spark, d).where(dedup.within_age(F.col("pub_dt"), 72, NOW))
    return s.select("row_id", F.round(dedup.age_hours(F.col("pub_dt"), NOW), 6).alias("age_h"))


@_query("title_dedup_per_category", f"WITH {_S} SELECT category, norm, min_by(row_id, {{'a': -epoch_us(pub_dt), 'b': row_id}}) AS row_id FROM stories GROUP BY ALL")
def _title_dedup_per_category(spark, d):
    return dedup.leaders(_titles(spark, d).withColumn("band", F.lit(0))).select("category", "norm", "row_id")


@_query("title_dedup_cross_category", f"WITH {_S}, {_C} SELECT norm, min_by(row_id, {{'a': cat_pos, 'b': -epoch_us(pub_dt), 'c': row_id}}) AS row_id FROM stories JOIN cats USING (category) GROUP BY norm")
def _title_dedup_cross_category(spark, d):
    s = _titles(spark, d).join(_categories(spark, d).select("category", "cat_pos"), "category")
    return dedup.across_categories(s.withColumn("band", F.lit(0))).select("norm", "row_id")


@_query("category_cap", f"WITH {_S} SELECT category, row_id, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pub_dt DESC, row_id) AS k FROM stories) WHERE k <= {CAP}")
def _category_cap(spark, d):
    s = _titles(spark, d).withColumn("band", F.lit(0)).withColumn("cap", F.lit(CAP))
    return dedup.capped(s, CAP).select("category", "row_id", "k")


@_query(
    "widen_category",
    f"""WITH {_DEDUP}, n AS (SELECT category, band, count(*) AS n FROM e WHERE ok AND band <= 7 GROUP BY ALL),
b AS (SELECT category, unnest([0, 2, 3, 4, 5, 6, 7]) AS band FROM cats),
w AS (SELECT b.*, coalesce(sum(n) OVER (PARTITION BY category ORDER BY band ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b LEFT JOIN n USING (category, band))
SELECT category, band FROM w WHERE band = 0 OR below < 3""",
)
def _widen_category(spark, d):
    cats = _categories(spark, d)
    return dedup.reached_bands(dedup.leaders(dedup.with_bands(_titles(spark, d), cats, NOW)), cats)


@_query("candidate_pool_topk", f"SELECT event_type AS category, event_id AS row_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank <= {POOL}")
def _candidate_pool(spark, d):
    e = _read(spark, d, "events").select(F.col("event_type").alias("category"), F.col("event_id").alias("row_id"), F.col("ts").alias("pub_dt"))
    return dedup.pool(e, POOL).select("category", "row_id", "rank")


_PRIORITY = ["src7", "src2", "nowhere", "src11"]


@_query("category_priority_order", f"WITH {_C} SELECT category, row_number() OVER (ORDER BY coalesce(list_position({_list(_PRIORITY)}, category), 1000000000), cat_pos)::INT AS place FROM cats")
def _priority(spark, d):
    return dedup.priority_order(_categories(spark, d), _PRIORITY).select("category", "place")


@_query("category_counts", f"WITH {_DEDUP} SELECT category, count(*) AS n FROM capped WHERE x = 1 GROUP BY category")
def _category_counts(spark, d):
    return dedup.feed_dedup(_titles(spark, d), _categories(spark, d), NOW, CAP).groupBy("category").agg(F.count("*").alias("n"))


@_query(
    "category_config_enrich",
    """SELECT doc_id, source, coalesce(age, 24) AS age_limit_h, coalesce(w, 24) AS window_h FROM documents
LEFT JOIN (VALUES ('src3', 8, 72), ('src4', 48, 168)) v(s, age, w) ON s = source""",
)
def _enrich(spark, d):
    dim = spark.createDataFrame([("src3", 8, 72), ("src4", 48, 168)], "source string, age_limit_h int, window_h int")
    return dedup.with_settings(_read(spark, d, "documents").select("doc_id", "source"), dim, "source", {"age_limit_h": AGE, "window_h": 24})


@_query("category_sections", "SELECT source AS category, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE source IS NOT NULL")
def _sections(spark, d):
    return dedup.sections(_read(spark, d, "documents").select(F.col("source").alias("category"), "doc_id"), "doc_id")


# ---------------------------------------------------------------- filters and text
@_query("obituary_realestate_filter", f"WITH {_S} SELECT row_id, {_any('title', lexicon.OBITUARY)} AS obituary, {_any('title', lexicon.REAL_ESTATE)} AS real_estate FROM stories")
def _obituary(spark, d):
    return _stories(spark, d).select("row_id", T.is_obituary(F.col("title")).alias("obituary"), T.is_real_estate(F.col("title")).alias("real_estate"))


_TAGLESS = _strip("regexp_replace(html, '<[^\\n]*?>', '', 'g')")


@_query("strip_html_text", f"SELECT page_id, length(x) AS n, md5(x) AS digest FROM (SELECT page_id, {_TAGLESS} AS x FROM pages)")
def _strip_html(spark, d):
    x = _read(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("x"))
    return x.select("page_id", F.length("x").cast("long").alias("n"), F.md5(F.col("x").cast("binary")).alias("digest"))


@_query("html_extract")
def _html_extract(spark, d):
    return _read(spark, d, "pages").select("page_id", T.html_text()(F.col("html")).alias("context"))


@_query(
    "html_plain_text",
    """WITH t AS (SELECT doc_id, trim(regexp_replace(translate(text, '<>&', '   '), '[\\s\\p{Z}\\x0B\\x1C-\\x1F\\x{0085}]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) >= 50 THEN substr(t, 1, 600) END AS context FROM t""",
)
def _html_plain(spark, d):
    # each text as a page whose menu and script are not shown
    body = F.translate(F.coalesce("text", F.lit("")), "<>&", "   ")
    html = F.concat(F.lit("<!DOCTYPE html><html><nav class='top'>Home <b>page</b></nav><body><p id=\"x\">"), body, F.lit("</p><script>let a = 1;</script></body></html>"))
    return _read(spark, d, "documents").select("doc_id", T.html_text()(html).alias("context"))


#: Rows of a made-up page.
_PAGE = 100


@_query(
    "html_table_cells",
    f"""WITH r AS (SELECT s_nationkey, s_suppkey // {_PAGE} AS page, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey, s_suppkey // {_PAGE} ORDER BY s_suppkey) - 1 AS row_no FROM supplier),
c AS (SELECT s_nationkey, page, 0 AS table_no, row_no::INT AS row_no, 0 AS col_no, s_name AS text FROM r UNION ALL SELECT s_nationkey, page, 0, row_no::INT, 1, s_suppkey::VARCHAR FROM r
UNION ALL SELECT DISTINCT s_nationkey, page, 1, 0, 0, 'end & out' FROM r)
SELECT s_nationkey || '-' || page AS page, table_no, row_no, col_no, text FROM c""",
)
def _html_cells(spark, d):
    # pages of the suppliers of each nation: a table of up to a hundred, and another one
    rows = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: F.concat(F.lit("<tr><td> "), x["s_name"], F.lit("</td><th>"), x["s_suppkey"].cast("string"), F.lit("</th></tr>")))
    html = F.concat(F.lit("<h1>Suppliers</h1><table>"), F.array_join(rows, "\n"), F.lit("</table><table><tr><td>end &amp; <b>out</b></td></tr></table>"))
    page = F.concat_ws("-", "s_nationkey", F.floor(F.col("s_suppkey") / _PAGE)).alias("page")
    return feeds.html_tables(_read(spark, d, "supplier").groupBy(page).agg(html.alias("html")), "page")


@_query(
    "article_extract_skip",
    """WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '' WHEN 1 THEN '#top' WHEN 2 THEN 'https://news.google.com/x' ELSE url END AS url,
  CASE page_id % 3 WHEN 0 THEN 'Obituary: somebody' WHEN 1 THEN 'Found dead at home' ELSE 'Plain news' END AS title, CASE page_id % 2 WHEN 0 THEN 'Conroe TX News' ELSE 'World' END AS category FROM pages)
SELECT page_id, (trim(url) = '' OR starts_with(trim(url), '#') OR contains(url, 'news.google.com') OR (category = 'Conroe TX News' AND """
    + _any("title", lexicon.OBITUARY)
    + """)) AS skipped FROM p""",
)
def _skip(spark, d):
    k = F.col("page_id")
    url = F.when(k % 7 == 0, "").when(k % 7 == 1, "#top").when(k % 7 == 2, "https://news.google.com/x").otherwise(F.col("url"))
    title = F.when(k % 3 == 0, "Obituary: somebody").when(k % 3 == 1, "Found dead at home").otherwise("Plain news")
    category = F.when(k % 2 == 0, "Conroe TX News").otherwise("World")
    return _read(spark, d, "pages").select("page_id", feeds.skip_article(title, category, url).alias("skipped"))


@_query("sentence_count", f"SELECT doc_id, ({_sentences('text')})::INT AS n FROM documents")
def _sentence_count(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.sentence_count(F.col("text")).alias("n"))


_TRIM = f"""WITH s AS (SELECT doc_id, {_strip("replace(" + _collapse("text") + ", '..', '.')")} AS s FROM documents),
p AS (SELECT doc_id, s, list_filter(list_transform(string_split(regexp_replace(s, '([.!?])\\s+([A-Z0-9"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: len(x) > 0) AS p FROM s)
SELECT doc_id, CASE WHEN len(p) >= 3 THEN array_to_string(p[1:3], ' ') ELSE s END AS summary FROM p"""


@_query("sentence_trim", _TRIM)
def _sentence_trim(spark, d):
    return _read(spark, d, "documents").select("doc_id", T.sentence_trim(F.col("text")).alias("summary"))


@_query(
    "build_context",
    f"""WITH {_S}, x AS (SELECT *, CASE WHEN lang = 'en' THEN NULL ELSE {_strip('snippet')} END AS c FROM stories)
SELECT row_id, CASE WHEN len(c) >= 50 THEN substr(c, 1, 600) WHEN {_strip('snippet')} = '' AND {_strip('title')} = '' THEN category || ': ' || title
  ELSE substr(array_to_string(list_filter([{_strip('snippet')}, {_strip('title')}], lambda v: len(v) > 0) || ['Category: ' || category], chr(10) || '---' || chr(10)), 1, 600) END AS context FROM x""",
)
def _context(spark, d):
    s = _stories(spark, d)
    own = F.when(F.col("lang") != "en", F.col("snippet"))
    return s.select("row_id", T.build_context(own, F.col("snippet"), F.col("title"), F.col("category")).alias("context"))


@_query(
    "text_scalars",
    f"""SELECT o_orderkey, CASE WHEN {_strip('o_orderpriority')} = '' OR o_orderpriority IS NULL THEN 'N/A' ELSE {_strip('o_orderpriority')} END AS safe,
  CASE WHEN lower(o_orderstatus) IN ('none', 'n/a', 'na') THEN 'Unavailable' ELSE replace(o_orderstatus, '|', '&#124;') END AS present,
  TRY_CAST(regexp_extract(replace(o_orderpriority, ' ', ''), '\\d+(\\.\\d+)?') AS DOUBLE) AS first_number,
  TRY_CAST(regexp_extract(o_orderpriority, '^(\\d+(\\.\\d+)?)', 1) AS DOUBLE) AS percent,
  CASE WHEN TRY_CAST(regexp_replace(o_orderpriority, '[^0-9.]', '', 'g') AS DOUBLE) BETWEEN -50 AND 140 THEN TRY_CAST(regexp_replace(o_orderpriority, '[^0-9.]', '', 'g') AS DOUBLE) END AS temperature,
  strftime(o_orderdate, '%a') AS day FROM orders""",
)
def _scalars(spark, d):
    p, o = F.col("o_orderpriority"), _read(spark, d, "orders")
    return o.select("o_orderkey", T.safe_text(p).alias("safe"), T.present_value(F.col("o_orderstatus")).alias("present"), T.first_number(p).alias("first_number"), T.percent_value(p).alias("percent"), T.coerce_temperature(p).alias("temperature"), T.day_label(F.col("o_orderdate")).alias("day"))


@_query("feed_dates", "SELECT event_id, date_trunc('second', ts) AS parsed, strftime(ts, '%Y-%m-%d %H:%M:%S UTC') AS shown FROM events")
def _dates(spark, d):
    # written as mail dates and read again; every third has an ISO form
    e = _read(spark, d, "events").select("event_id", "ts")
    mail = F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss Z")
    raw = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(mail)
    parsed = T.parse_feed_date(F.when(F.col("event_id") % 2 == 0, raw), raw)
    return e.select("event_id", parsed.alias("parsed"), T.format_pub_date(F.date_trunc("second", "ts")).alias("shown"))


@_query("significant_words_overlap", f"WITH {_P} SELECT conv_id, turn, len({_significant('title')})::INT AS n, coalesce(list_has_any({_significant('title')}, {_significant('summary')}), false) AS overlap FROM pairs")
def _overlap(spark, d):
    p = _pairs(spark, d)
    return p.select("conv_id", "turn", F.size(T.significant_words(F.col("title"))).alias("n"), gate.topic_overlap(F.col("summary"), F.col("title")).alias("overlap"))


@_query(
    "word_containment",
    f"""WITH {_P}, w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{Nd}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$'))) AS a,
  list_distinct(list_filter(regexp_extract_all(lower(summary), '[\\p{{L}}\\p{{Nd}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$'))) AS b FROM pairs)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / nullif(len(a), 0), 6) AS share FROM w""",
)
def _containment(spark, d):
    p = _pairs(spark, d)
    a, b = T.keyword_tokens(F.col("title"), 3), T.keyword_tokens(F.col("summary"), 3)
    return p.select("conv_id", "turn", F.round(T.containment(a, b), 6).alias("share"))


# ---------------------------------------------------------------- gates
_REASON = f"""CASE WHEN summary IS NULL OR {_strip('summary')} = '' THEN 'empty' WHEN {_any('summary', lexicon.REFUSAL)} THEN 'refusal' WHEN {_any('summary', lexicon.BOILERPLATE)} THEN 'boilerplate'
  WHEN starts_with({_strip('summary')}, '[Auto]') OR starts_with({_strip('summary')}, '[Summary Unavailable]') THEN 'marker'
  WHEN lower({_collapse('summary')}) = lower({_collapse("coalesce(title, '')")}) OR starts_with(lower({_collapse('summary')}), lower({_collapse("coalesce(title, '')")}) || '.') THEN 'echo'
  WHEN ({_sentences('summary')}) < 2 THEN 'short' WHEN NOT coalesce(list_has_any({_significant('title')}, {_significant('summary')}), false) THEN 'off_topic' END"""


@_query("summary_gate", f"WITH {_P} SELECT conv_id, turn, {_REASON} AS reason FROM pairs")
def _gate(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", gate.gate_reason(F.col("summary"), F.col("title")).alias("reason"))


@_query("refusal_boilerplate_flags", f"SELECT doc_id, {_any('text', lexicon.REFUSAL)} AS refusal, {_any('text', lexicon.BOILERPLATE)} AS boilerplate FROM documents")
def _flags(spark, d):
    return _read(spark, d, "documents").select("doc_id", gate.is_refusal(F.col("text")).alias("refusal"), gate.is_boilerplate(F.col("text")).alias("boilerplate"))


_STUB = """CASE WHEN ('0x' || substr(md5(title), 1, 4))::INT % 7 <> 0 THEN title || ' was reported today. It follows earlier events.' END"""
_AUTO = f"""CASE WHEN title IS NULL OR title = '' THEN '[Summary Unavailable]' ELSE '[Auto] ' || {_strip("regexp_replace(" + _collapse("title") + ", '[:—-]\\s*$', '')")} END"""


@_query(
    "stub_summaries",
    f"""WITH {_S}, a AS (SELECT row_id, title, {_STUB} AS summary FROM stories), g AS (SELECT *, {_REASON} AS reason FROM a)
SELECT row_id, CASE WHEN reason IS NULL THEN summary ELSE {_AUTO} END AS summary FROM g""",
)
def _stub(spark, d):
    s = _stories(spark, d).select("row_id", "title", summaries.stub_summary(F.col("title")).alias("answer"))
    ok = gate.is_valid_summary(F.col("answer"), F.col("title"))
    return s.select("row_id", F.when(ok, F.col("answer")).otherwise(T.auto_summary(F.col("title"))).alias("summary"))


@_query(
    "summary_outcomes",
    f"""WITH {_P}, o AS (SELECT CASE WHEN summary IS NULL OR {_strip('summary')} = '' THEN 'invalid' WHEN starts_with({_strip('summary')}, '[Summary Unavailable]') THEN 'unavailable' WHEN starts_with({_strip('summary')}, '[Auto]') THEN 'auto' ELSE 'valid' END AS o FROM pairs)
SELECT count(*) AS total_stories, count(*) FILTER (o = 'valid') AS final_valid, count(*) FILTER (o = 'auto') AS auto_fallbacks, count(*) FILTER (o = 'unavailable') AS unavailable_summaries, count(*) FILTER (o = 'invalid') AS final_invalid FROM o""",
)
def _outcomes(spark, d):
    return gate.outcome_counts(_pairs(spark, d))


_ISSUE = f"""CASE WHEN summary IS NULL OR {_strip('summary')} = '' THEN 'empty' WHEN starts_with(summary, '[Auto]') THEN NULL
  WHEN regexp_replace(lower(summary), '\\s+', ' ', 'g') = regexp_replace(lower(title), '\\s+', ' ', 'g') OR starts_with(regexp_replace(lower(summary), '\\s+', ' ', 'g'), regexp_replace(lower(title), '\\s+', ' ', 'g') || '.') THEN 'echo'
  WHEN ({_sentences('summary')}) < 2 THEN 'short' WHEN starts_with(summary, '[Headline]') OR contains(lower(summary), '[summary unavailable]') THEN 'marker'
  WHEN len(w) > 0 AND len(list_filter(w, lambda x: contains(lower(summary), x))) < 0.25 * len(w) THEN 'off_topic' END"""
_W = f"""w AS (SELECT *, list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{Nd}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{4,}}$') AND NOT list_contains({_list(lexicon.HEADLINE_STOP)}, x)) AS w FROM pairs)"""


@_query("story_issues", f"WITH {_P}, {_W} SELECT conv_id, turn, {_ISSUE} AS issue FROM w")
def _issues(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", gate.story_issue(F.col("title"), F.col("summary")).alias("issue"))


@_query(
    "validation_verdict",
    f"""WITH {_P}, {_W}, i AS (SELECT {_ISSUE} AS issue, starts_with(summary, '[Auto]') AS auto FROM w)
SELECT count(*) AS total, count(issue) AS bad, count(*) FILTER (auto) AS auto, count(*) > 0 AND count(issue) <= 0.1 * count(*) AS passed FROM i""",
)
def _verdict(spark, d):
    return gate.verdict(_pairs(spark, d))


@_query("duplicate_urls", "SELECT regexp_replace(url, '[0-9]+', 'N', 'g') AS url, count(*) AS n FROM pages WHERE url IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def _duplicate_urls(spark, d):
    # page numbers are left out, so there are duplicates
    return gate.duplicate_urls(_read(spark, d, "pages").withColumn("url", F.regexp_replace("url", "[0-9]+", "N")))


@_query("lag_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS max_value FROM events GROUP BY event_type")
def _lag(spark, d):
    p = gate.lag_percentiles(_read(spark, d, "events"), ["event_type"])
    return p.select("event_type", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "max_value")


@_query("missing_references", "SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _missing(spark, d):
    return gate.missing_references(_read(spark, d, "documents"), "doc_id", _read(spark, d, "labels").where("doc_id IS NOT NULL"), "doc_id")


@_query("probe_tally", "SELECT count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed, bool_and(ok) AS all_ok FROM (SELECT event_type <> 'error' AS ok FROM events)")
def _probes(spark, d):
    return gate.probe_tally(_read(spark, d, "events").select((F.col("event_type") != "error").alias("ok")))


# ---------------------------------------------------------------- tags
TAGS = tagging.TagRules(
    mappings={"function": ["that", "with the"], "marker": ["threlyes", "edoution", "ouble"], "romance": ["que", "les", "de la"], "german": ["und", "der die", "einen"], "secret": ["password", "token"], "fresh": ["new", "first report"]},
    boosts={"src0": ["function", "that"], "src3": ["marker", "ouble"], "src5": ["romance", "the"]},
    conflicts=[("romance", "german"), ("function", "marker")],
)


def _score_sql(tag: str) -> str:
    """The score of a tag for t (a lower-cased title), as SQL."""
    match = lambda kw: "regexp_matches(t, '(^|[^a-zA-Z]){}(s|es|ed|ing)?([^a-zA-Z]|$)')".format(kw)
    parts = ["0.0"]
    for kw in TAGS.mappings[tag]:
        if not tagging.only_stop_words(kw):
            parts.append(f"CASE WHEN {match(kw)} AND strpos(t, '{kw}') > 0 THEN (CASE WHEN strpos(t, '{kw}') <= 100 THEN 2.0 ELSE 1.0 END) * {tagging.keyword_weight(kw)} ELSE 0.0 END")
    for cat, boosted in TAGS.boosts.items():
        gain = "3.0" if tag in boosted else " + ".join(["0.0", *(f"CASE WHEN {match(b)} THEN 2.0 ELSE 0.0 END" for b in boosted if not tagging.only_stop_words(b))])
        parts.append(f"CASE WHEN category = '{cat}' THEN {gain} ELSE 0.0 END")
    return " + ".join(parts)


_TAGGED = f"""{_S}, t AS (SELECT row_id, category, lower(title) AS t FROM stories),
scored AS ({" UNION ALL ".join(f"SELECT row_id, '{tag}' AS tag, {n} AS tpos, {_score_sql(tag)} AS raw FROM t" for n, tag in enumerate(TAGS.mappings))}),
kept AS (SELECT row_id, tag, tpos, least(raw, 5.0) AS score, row_number() OVER (PARTITION BY row_id ORDER BY least(raw, 5.0) DESC, tpos) AS rn FROM scored WHERE raw > 0.3),
losers AS ({" UNION ALL ".join(f"SELECT a.row_id, CASE WHEN a.score <= b.score THEN '{x}' ELSE '{y}' END AS tag FROM kept a JOIN kept b ON a.row_id = b.row_id WHERE a.tag = '{x}' AND b.tag = '{y}'" for x, y in TAGS.conflicts)}),
own AS (SELECT k.row_id, k.tag, k.rn, CASE WHEN k.rn <= 5 THEN 0 ELSE 1 END AS grp FROM kept k WHERE NOT EXISTS (SELECT 1 FROM losers l WHERE l.row_id = k.row_id AND l.tag = k.tag)),
allt AS (SELECT * FROM own UNION ALL SELECT row_id, lower(category), 0, 2 FROM t),
placed AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY grp, rn) AS p FROM allt),
tags AS (SELECT row_id, tag, p FROM placed WHERE grp = 0 OR p <= 3)"""


@_query("keyword_tags", f"WITH {_TAGGED} SELECT row_id, string_agg('[[' || tag || ']]', ' ' ORDER BY p) AS tags FROM tags GROUP BY row_id")
def _tags(spark, d):
    return _stories(spark, d).select("row_id", tagging.tag_markup(F.col("title"), F.col("category"), TAGS).alias("tags"))


@_query("tag_frequency", f"WITH {_TAGGED} SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def _tag_frequency(spark, d):
    t = _stories(spark, d).select(F.explode(tagging.tag_array(F.col("title"), F.col("category"), TAGS)).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n"))


@_query("tag_conflicts", f"WITH {_TAGGED} SELECT tag, count(*) AS n FROM (SELECT DISTINCT row_id, tag FROM losers) GROUP BY tag")
def _tag_conflicts(spark, d):
    s = _stories(spark, d)
    lost = tagging.conflict_losers(F.col("scored"), TAGS)
    scored = s.select(tagging.scored_tags(F.col("title"), F.col("category"), TAGS).alias("scored"))
    return scored.select(F.explode(F.array_distinct(lost)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@_query("tag_union", f"WITH {_TAGGED} SELECT array_to_string(list_sort(list_distinct(list(lower(tag)) || ['digest', 'news'])), ',') AS tags FROM tags")
def _tag_union(spark, d):
    t = _stories(spark, d).select(tagging.tag_array(F.col("title"), F.col("category"), TAGS).alias("t"))
    return t.agg(F.array_join(tagging.tag_union(F.col("t"), ["digest", "news"]), ",").alias("tags"))


# ---------------------------------------------------------------- look-ups
_TARGETS = "(VALUES ('today', DATE '2001-03-04'), ('one_week_ago', DATE '2001-02-25'), ('thirty_days_ago', DATE '2001-02-02')) v(label, target)"


def _targets(spark: SparkSession) -> DataFrame:
    rows = [("today", "2001-03-04"), ("one_week_ago", "2001-02-25"), ("thirty_days_ago", "2001-02-02")]
    return spark.createDataFrame(rows, "label string, t string").select("label", F.to_date("t").alias("target"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "orders").select((F.col("o_custkey") % 50).alias("series"), F.to_date("o_orderdate").alias("obs_date"), F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("value"))


@_query(
    "asof_levels",
    f"""WITH r AS (SELECT o_custkey % 50 AS series, o_orderdate::DATE AS obs_date, o_orderkey AS ord, o_totalprice AS value FROM orders),
x AS (SELECT series, label, target, obs_date, value, row_number() OVER (PARTITION BY series, label ORDER BY obs_date > target, abs(obs_date - target), ord) AS k FROM r CROSS JOIN {_TARGETS})
SELECT series, label, target, obs_date, value FROM x WHERE k = 1""",
)
def _asof(spark, d):
    return lookup.asof_levels(_readings(spark, d), _targets(spark))


@_query(
    "nearest_day",
    f"""WITH p AS (SELECT event_type AS slot, ts::DATE AS day, event_id AS ord, value FROM events), t AS (SELECT DATE '2024-01-30' + CAST(unnest(range(0, 3)) AS INT) AS target),
x AS (SELECT target, slot, day, ord, value, row_number() OVER (PARTITION BY target, slot ORDER BY abs(day - target), ord) AS k FROM p CROSS JOIN t)
SELECT target, slot, day, ord, value FROM x WHERE k = 1""",
)
def _nearest(spark, d):
    p = _read(spark, d, "events").select(F.col("event_type").alias("slot"), F.to_date("ts").alias("day"), F.col("event_id").alias("ord"), "value")
    days = spark.range(3).select(F.date_add(F.lit("2024-01-30").cast("date"), F.col("id").cast("int")).alias("target"))
    return lookup.nearest_day(p, days)


_MERGE = """WITH r AS (SELECT l_suppkey % 10 AS series, l_shipdate::DATE AS obs_date, l_orderkey * 10 + l_linenumber AS ord, l_quantity AS value FROM lineitem),
p AS (SELECT series, obs_date, min(ord) AS ord, arg_min(value, ord) AS value FROM r GROUP BY series, obs_date),
f AS (SELECT series, min(obs_date) AS obs_date, arg_min(value, obs_date) AS value FROM p GROUP BY series),
t AS (SELECT o_custkey % 10 AS series, o_orderkey AS label, o_orderdate::DATE AS target FROM orders)"""


def _shipments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Quantities by shipping date, and every order's date as a target."""
    r = _read(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("series"), F.to_date("l_shipdate").alias("obs_date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").alias("value"))
    t = _read(spark, d, "orders").select((F.col("o_custkey") % 10).alias("series"), F.col("o_orderkey").alias("label"), F.to_date("o_orderdate").alias("target"))
    return r, t


@_query(
    "asof_merge",
    f"""{_MERGE} SELECT t.series, t.label, t.target, coalesce(b.obs_date, f.obs_date) AS obs_date, coalesce(b.value, f.value) AS value
FROM t ASOF LEFT JOIN p b ON t.series = b.series AND t.target >= b.obs_date JOIN f ON t.series = f.series""",
)
def _asof_merge(spark, d):
    return lookup.asof_merge(*_shipments(spark, d))


@_query(
    "nearest_merge",
    f"""{_MERGE}, x AS (SELECT t.*, b.obs_date AS b_date, b.ord AS b_ord, b.value AS b_value, a.obs_date AS a_date, a.ord AS a_ord, a.value AS a_value
FROM t ASOF LEFT JOIN p b ON t.series = b.series AND t.target >= b.obs_date ASOF LEFT JOIN p a ON t.series = a.series AND t.target < a.obs_date),
y AS (SELECT *, a_date IS NULL OR (b_date IS NOT NULL AND (target - b_date < a_date - target OR (target - b_date = a_date - target AND b_ord < a_ord))) AS earlier FROM x)
SELECT series, label, target, CASE WHEN earlier THEN b_date ELSE a_date END AS obs_date, CASE WHEN earlier THEN b_value ELSE a_value END AS value FROM y WHERE a_date IS NOT NULL OR b_date IS NOT NULL""",
)
def _nearest_merge(spark, d):
    near = lookup.nearest_merge(*_shipments(spark, d), "series", "obs_date")
    return near.select("series", "label", "target", "near.obs_date", "near.value")


@_query(
    "forecast_pivot",
    """WITH p AS (SELECT ts::DATE AS day, hour(ts) BETWEEN 6 AND 17 AS is_day, event_id AS ord, event_type AS short, user_id AS temperature, value FROM events),
o AS (SELECT day AS target, is_day, max_by(short, ord) AS short, max_by(temperature, ord) AS temperature, max_by(round(value)::INT, ord) AS precip FROM p GROUP BY ALL),
n AS (SELECT * FROM (SELECT target, is_day, short, temperature, round(value)::INT AS precip, row_number() OVER (PARTITION BY target, is_day ORDER BY abs(day - target), ord) AS k FROM p CROSS JOIN (SELECT DATE '2024-01-29' + CAST(unnest(range(0, 3)) AS INT) AS target)) WHERE k = 1),
s AS (SELECT n.target, n.is_day, coalesce(o.short, n.short) AS short, coalesce(o.temperature, n.temperature) AS temperature, coalesce(o.precip, n.precip) AS precip FROM n LEFT JOIN o USING (target, is_day))
SELECT a.target AS date, strftime(a.target, '%a') AS label, a.short AS day, b.short AS night, a.temperature || '°F' AS high, b.temperature || '°F' AS low, a.precip || '%' AS precip, 'Dynamic' AS wind
FROM s a JOIN s b ON a.target = b.target AND a.is_day AND NOT b.is_day""",
)
def _forecast(spark, d):
    e = _read(spark, d, "events")
    p = e.select(F.col("ts").alias("start"), F.hour("ts").between(6, 17).alias("is_day"), F.col("event_id").alias("ord"), F.col("event_type").alias("short"), F.col("user_id").cast("string").alias("temperature"), F.lit("F").alias("unit"), F.lit(None).cast("string").alias("wind_speed"), F.lit(None).cast("string").alias("wind_dir"), F.round("value").cast("int").cast("string").alias("precip"))
    days = spark.range(3).select(F.date_add(F.lit("2024-01-29").cast("date"), F.col("id").cast("int")).alias("target"))
    return lookup.forecast_rows(p, days)


@_query(
    "provider_merge",
    """WITH c AS (SELECT s_suppkey AS station, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey END AS high FROM supplier), m AS (SELECT s_suppkey AS station, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey % 4 END AS average, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey % 3 END AS current FROM supplier),
f AS (SELECT station, high || '°F' AS t, average || ' Inches' AS a, current || ' Inches' AS b FROM c FULL JOIN m USING (station))
SELECT station, coalesce(t, 'Unavailable') AS avg_temp_today, coalesce(a, 'Unavailable') AS avg_monthly_rainfall, coalesce(CASE WHEN a IS NOT DISTINCT FROM b THEN NULL ELSE b END, 'Unavailable') AS current_monthly_rainfall FROM f""",
)
def _merge(spark, d):
    s = _read(spark, d, "supplier")
    known = lambda k, c: F.when(F.col("s_suppkey") % k != 0, c)
    climate = s.select(F.col("s_suppkey").alias("station"), known(3, F.col("s_nationkey")).alias("high"))
    monthly = s.select(F.col("s_suppkey").alias("station"), known(4, F.col("s_nationkey") % 4).alias("average"), known(4, F.col("s_nationkey") % 3).alias("current"))
    return lookup.merge_station(climate, monthly)


@_query("retention_rank", "SELECT event_type AS kind, event_id AS name, rank::INT AS rank, rank > 100 AS expired FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rank FROM events)")
def _retention(spark, d):
    f = _read(spark, d, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("name"), F.col("ts").alias("mtime"))
    return lookup.keep_newest(f, 100).select("kind", "name", "rank", "expired")


@_query("next_version", "SELECT (max(doc_id % 97) + 1)::INT AS version, lpad((max(doc_id % 97) + 1)::VARCHAR, 2, '0') AS label FROM documents")
def _version(spark, d):
    f = _read(spark, d, "documents").select(F.format_string("Digest-2024-01-31_v%02d.md", F.col("doc_id") % 97).alias("name"))
    return lookup.next_version(f, "Digest-2024-01-31")


# ---------------------------------------------------------------- sources and rendering
@_query("url_host", "SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages")
def _host(spark, d):
    return _read(spark, d, "pages").select("page_id", feeds.host(F.col("url")).alias("host"))


@_query("source_url", f"SELECT p_partkey, '{feeds.RSS_BASE}when%3A' || ceil(p_size / 24.0)::INT || 'd+' || replace(p_name, ' ', '+') || '{feeds.RSS_PARAMS}' AS url FROM part")
def _source_url(spark, d):
    return _read(spark, d, "part").select("p_partkey", feeds.feed_url_with_window(F.col("p_name"), F.col("p_size")).alias("url"))


@_query("json_field", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def _json(spark, d):
    return _read(spark, d, "events").select("event_id", F.from_json(feeds.json_or_null(F.col("props")), "k int")["k"].alias("k"))


@_query("http_status_classes", "SELECT event_id, s, s = 200 AS accepted, s BETWEEN 200 AND 299 AS accepted_2xx, s IN (429, 502, 503, 504) AS retry FROM (SELECT event_id, (200 + event_id % 320)::INT AS s FROM events)")
def _status(spark, d):
    from .sources import http

    e = _read(spark, d, "events").select("event_id", (F.lit(200) + F.col("event_id") % 320).cast("int").alias("s"))
    return e.select("event_id", "s", http.is_accepted(F.col("s")).alias("accepted"), http.is_accepted(F.col("s"), True).alias("accepted_2xx"), http.should_retry(F.col("s")).alias("retry"))


@_query("batch_assign", "SELECT row_id, category, (n // 3)::INT AS batch, n::INT AS place FROM (SELECT conv_id * 1000 + turn AS row_id, role AS category, row_number() OVER (PARTITION BY role ORDER BY conv_id * 1000 + turn) - 1 AS n FROM conversations)")
def _batches(spark, d):
    c = _read(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("role").alias("category"))
    return summaries.assign_batches(c, 3, ["row_id"])


@_query("batch_summaries")
def _batch_summaries(spark, d):
    # at most CAP stories of each category: they are kept while batches are numbered, asked and joined
    s = dedup.feed_dedup(_stories(spark, d), _categories(spark, d), NOW, CAP).withColumn("context", F.col("snippet"))
    return summaries.summarize(s, summaries.StubClient(), store=lambda df: df.persist()).select("row_id", "category", "title", "summary", "how")


@_query("fuzzy_headline_match")
def _fuzzy(spark, d):
    p = _pairs(spark, d)
    return p.select("conv_id", "turn", F.round(summaries.likeness(F.col("title"), F.col("summary")), 6).alias("ratio"))


@_query("closest_headlines")
def _closest(spark, d):
    # what was said in six turns of a conversation, and the same in other words, word order or case
    c = _read(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 6).alias("batch"), "turn", "text")
    said = F.when(F.col("turn") % 3 == 0, F.upper("text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("Re: "), F.col("text"))).otherwise(F.array_join(F.reverse(F.split("text", " ")), " "))
    lines = c.select("conv_id", "batch", F.col("turn").alias("line_id"), said.alias("line"))
    return summaries.closest_headlines(lines, c.select("conv_id", "batch", F.col("turn").alias("head_id"), F.col("text").alias("head")), ["conv_id", "batch"]).withColumn("ratio", F.round("ratio", 6))


@_query("parse_batch_response")
def _parse(spark, d):
    p = _pairs(spark, d).select("conv_id", "turn", F.array(F.col("title")).alias("heads"), F.concat(F.lit("STORY_0 | "), F.col("title"), F.lit("="), F.col("summary")).alias("answer"))
    return summaries.match_headlines(p, "answer", "heads").select("conv_id", "turn", F.col("summaries")[0].alias("summary"))


@_query(
    "report_lines",
    f"""WITH {_DEDUP}, s AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY k) AS n FROM capped WHERE x = 1),
l AS (SELECT category, n, unnest(list_filter(['', n || '. [' || replace(replace(title, chr(10), ' '), chr(13), ' ') || '](http://x/' || row_id || ')', CASE WHEN row_id % 3 = 0 THEN '[Summary unavailable]' ELSE 'About ' || row_id END,
    CASE WHEN row_id % 4 <> 0 THEN '*Originally published on:* ' || strftime(pub_dt, '%Y-%m-%d %H:%M:%S UTC') END, '[[' || lower(category) || ']]'], lambda v: v IS NOT NULL)) AS line, generate_subscripts(list_filter([1, 1, 1, CASE WHEN row_id % 4 <> 0 THEN 1 END, 1], lambda v: v IS NOT NULL), 1) - 1 AS i FROM s)
SELECT category, n * 10 + i AS line_pos, line FROM l
UNION ALL SELECT category, 0, '## ' || category || ' (' || count(*) || ' stories)' FROM s GROUP BY category""",
)
def _lines(spark, d):
    from pyspark.sql import Window

    s = dedup.feed_dedup(_titles(spark, d), _categories(spark, d), NOW, CAP)
    w = Window.partitionBy("category").orderBy("k")
    key = F.col("row_id")
    summary = F.when(key % 3 != 0, F.concat(F.lit("About "), key.cast("string")))
    pub = F.when(key % 4 != 0, T.format_pub_date(F.col("pub_dt")))
    s = s.select(F.lit(1).alias("place"), "category", F.row_number().over(w).alias("n"), "title", F.concat(F.lit("http://x/"), key.cast("string")).alias("link"), summary.alias("summary"), pub.alias("pub_date"), F.concat(F.lit("[["), F.lower("category"), F.lit("]]")).alias("tags"))
    return report.section_lines(s).select("category", F.col("line_pos").cast("long").alias("line_pos"), "line")


@_query("markdown_urls", "SELECT page_id, url AS link FROM pages WHERE regexp_matches(url, '^https?://[^)]+$')")
def _urls(spark, d):
    md = F.concat(F.lit("1. [Title]("), F.col("url"), F.lit(") and [no](mailto:x)"))
    return _read(spark, d, "pages").select("page_id", F.explode(T.extract_urls(md)).alias("link"))


@_query("feed_url", f"SELECT p_partkey, '{feeds.RSS_BASE}' || replace(p_name, ' ', '+') || '{feeds.RSS_PARAMS}' AS url FROM part")
def _feed_url(spark, d):
    return _read(spark, d, "part").select("p_partkey", feeds.feed_url(F.col("p_name")).alias("url"))


@_query(
    "feed_items",
    f"""WITH i AS (SELECT p_brand || '-' || p_partkey // {_PAGE} AS category, p_name AS title, 'http://x/' || p_partkey AS link, p_partkey,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes((p_retailprice * 10)::BIGINT) AS pub_dt FROM part)
SELECT category, title, link, pub_dt FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY pub_dt DESC, p_partkey) AS n FROM i) WHERE n <= {POOL}""",
)
def _feed_items(spark, d):
    # feeds of up to a hundred parts of a brand, written as RSS and read again
    p = _read(spark, d, "part")
    at = F.timestamp_micros(F.lit(1704067200000000) + (F.col("p_retailprice") * 10).cast("decimal(18,0)").cast("long") * 60_000_000)
    item = F.concat(F.lit("<item><title>"), F.col("p_name"), F.lit("</title><link>http://x/"), F.col("p_partkey").cast("string"), F.lit("</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss Z"), F.lit("</pubDate></item>"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("x")))), lambda v: v["x"])
    feed = F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / _PAGE)).alias("category")
    pages = p.groupBy(feed).agg(F.concat(F.lit("<rss><channel><title>t</title>"), F.array_join(items, ""), F.lit("</channel></rss>")).alias("text"))
    return feeds.feed_entries(feeds.feed_items(pages), F.col("category"), limit=POOL).select("category", "title", "link", "pub_dt")


@_query(
    "forecast_periods",
    """SELECT event_id, 0 AS ord, date_trunc('second', ts) + INTERVAL 5 HOUR AS start, event_id % 2 = 0 AS is_day, event_type AS short, user_id::VARCHAR AS temperature, '10' AS precip FROM events WHERE event_id % 5 <> 0
UNION ALL SELECT event_id, 1, date_trunc('second', ts), false, 'night', NULL, NULL FROM events WHERE event_id % 5 <> 0""",
)
def _periods(spark, d):
    # a payload for each event; where a precipitation object is null the whole forecast is empty
    e = _read(spark, d, "events")
    kind = "struct<startTime:string,isDaytime:boolean,temperature:string,shortForecast:string,probabilityOfPrecipitation:struct<value:string>>"
    time = lambda zone: F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(zone))
    rain = F.when(F.col("event_id") % 5 != 0, F.struct(F.lit("10").alias("value")))
    one = F.struct(time("-05:00").alias("startTime"), (F.col("event_id") % 2 == 0).alias("isDaytime"), F.col("user_id").cast("string").alias("temperature"), F.col("event_type").alias("shortForecast"), rain.alias("probabilityOfPrecipitation")).cast(kind)
    two = F.struct(time("+00:00").alias("startTime"), F.lit(False).alias("isDaytime"), F.lit(None).cast("string").alias("temperature"), F.lit("night").alias("shortForecast"), F.struct(F.lit(None).cast("string").alias("value")).alias("probabilityOfPrecipitation")).cast(kind)
    payload = F.to_json(F.struct(F.struct(F.array(one, two).alias("periods")).alias("properties")), {"ignoreNullFields": "false"})
    return feeds.forecast_periods(e.select("event_id", payload.alias("payload"))).select("event_id", "ord", "start", "is_day", "short", "temperature", "precip")


@_query("climate_high", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN round_even(floor(value * 2) / 2, 0)::INT END AS high FROM events")
def _high(spark, d):
    halves = (F.floor(F.col("value") * 2) / 2).cast("string")
    json = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit('{"daily":{"temperature_2m_max":['), halves, F.lit("]}}"))).otherwise("no json")
    return _read(spark, d, "events").select("event_id", feeds.climate_high(json).alias("high"))


_MM = "(o_orderkey % 60) || '.' || (o_custkey % 10)"


@_query("station_rain", f"SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 AND ({_MM})::DOUBLE <= 40 THEN ({_MM})::DOUBLE END AS inches FROM orders")
def _rain(spark, d):
    mm = F.concat((F.col("o_orderkey") % 60).cast("string"), F.lit("."), (F.col("o_custkey") % 10).cast("string"))
    text = F.when(F.col("o_orderkey") % 9 != 0, F.concat(F.lit("Station Summary High 9 Precipitation "), mm, F.lit(" ° in more graph Precipitation 39 in"))).otherwise("Nothing of it")
    return _read(spark, d, "orders").select("o_orderkey", feeds.station_rain(text).alias("inches"))


@_query(
    "number_texts",
    r"""WITH o AS (SELECT o_orderkey, (o_orderkey % 1200) || '.' || (o_custkey % 100) AS x FROM orders)
SELECT o_orderkey, printf('%.1f%%', x::DOUBLE) AS percent, CASE WHEN regexp_extract('v ' || x, '(-?\d{1,3}(\.\d+)?)', 1)::DOUBLE = floor(regexp_extract('v ' || x, '(-?\d{1,3}(\.\d+)?)', 1)::DOUBLE) THEN floor(regexp_extract('v ' || x, '(-?\d{1,3}(\.\d+)?)', 1)::DOUBLE)::BIGINT::VARCHAR ELSE regexp_extract('v ' || x, '(-?\d{1,3}(\.\d+)?)', 1)::DOUBLE::VARCHAR END AS clean,
  CASE WHEN x::DOUBLE <= 40 THEN x::DOUBLE END AS clamped FROM o""",
)
def _numbers(spark, d):
    x = F.concat((F.col("o_orderkey") % 1200).cast("string"), F.lit("."), (F.col("o_custkey") % 100).cast("string"))
    return _read(spark, d, "orders").select("o_orderkey", T.coerce_percent(F.concat(x, F.lit(" %"))).alias("percent"), T.clean_number(F.concat(F.lit("v "), x)).alias("clean"), T.clamp(x).alias("clamped"))


@_query("first_match", "SELECT page_id, coalesce(nullif(regexp_extract(url, '/([0-9]+)', 1), ''), nullif(regexp_extract(url, '://([a-z]+)', 1), '')) AS found FROM pages")
def _first_match(spark, d):
    return _read(spark, d, "pages").select("page_id", T.first_match(F.col("url"), ["/([0-9]+)", "://([a-z]+)"]).alias("found"))


@_query("period_times", "SELECT event_id, date_trunc('second', ts) + (CASE event_id % 3 WHEN 0 THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END) AS start FROM events")
def _period_times(spark, d):
    t = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(t, F.lit("-05:00"))).when(F.col("event_id") % 3 == 1, F.concat(t, F.lit("Z[UTC]"))).otherwise(t)
    return _read(spark, d, "events").select("event_id", T.parse_period_time(raw).alias("start"))


@_query("lake_labels", "SELECT s_suppkey, CASE WHEN starts_with(k, 'lake') THEN 'Lake ' ELSE 'Lake North ' END || s_suppkey AS label FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'lake_' ELSE 'north-' END || s_suppkey AS k FROM supplier)")
def _lake_labels(spark, d):
    key = F.concat(F.when(F.col("s_suppkey") % 2 == 0, "lake_").otherwise("north-"), F.col("s_suppkey").cast("string"))
    return _read(spark, d, "supplier").select("s_suppkey", T.lake_label(key).alias("label"))


@_query(
    "lake_table",
    f"""WITH r AS (SELECT o_custkey % 50 AS series, o_orderdate::DATE AS obs_date, o_orderkey AS ord, CASE WHEN o_custkey % 50 <> 7 THEN o_orderkey % 97 END AS value FROM orders),
x AS (SELECT series, label, value, row_number() OVER (PARTITION BY series, label ORDER BY obs_date > target, abs(obs_date - target), ord) AS k FROM r CROSS JOIN {_TARGETS}),
w AS (SELECT series, max(value) FILTER (label = 'today') AS a, max(value) FILTER (label = 'one_week_ago') AS b, max(value) FILTER (label = 'thirty_days_ago') AS c FROM x WHERE k = 1 GROUP BY series)
SELECT (l.i)::INT AS line_pos, '| Lake ' || l.i || ' | ' || coalesce(a || '%', 'Unavailable') || ' | ' || coalesce(b || '%', 'Unavailable') || ' | ' || coalesce(c || '%', 'Unavailable') || ' |' AS line
FROM (SELECT unnest(range(0, 50)) AS i) l LEFT JOIN w ON w.series = l.i""",
)
def _lake_table(spark, d):
    # a lake without values
    readings = _readings(spark, d).withColumn("value", F.when(F.col("series") != 7, F.col("ord") % 97))
    levels = lookup.asof_levels(readings, _targets(spark)).select(F.col("series").cast("string").alias("series"), "label", F.concat(F.col("value").cast("string"), F.lit("%")).alias("value"))
    return report.lake_lines(levels, [str(k) for k in range(50)])


@_query(
    "forecast_table",
    """WITH t AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n, o_orderkey, o_orderstatus FROM orders)
SELECT n::INT AS line_pos, coalesce('| ' || o_orderkey || ' | ' || o_orderstatus || ' | Unavailable | a&#124;b | Unavailable | Unavailable | Unavailable |', '| Dynamic | Dynamic | Dynamic | Dynamic | Dynamic | Dynamic | Dynamic |') AS line FROM (SELECT unnest(range(1, 4)) AS n) LEFT JOIN t USING (n)""",
)
def _forecast_table(spark, d):
    none = F.lit(None).cast("string")
    rows = _read(spark, d, "orders").select(F.struct("o_orderdate", "o_orderkey").alias("date"), F.col("o_orderkey").cast("string").alias("label"), F.col("o_orderstatus").alias("day"), F.lit(" ").alias("night"), F.lit("a|b").alias("high"), F.lit("N/A").alias("low"), none.alias("precip"), none.alias("wind"))
    return report.forecast_lines(rows)


@_query("extraction_metrics", "SELECT count(*) AS stories, count(*) FILTER (lang <> 'en') AS extracted, coalesce(sum(n_chars), 0)::BIGINT AS bytes, count(*) / 4.0::DOUBLE AS per_second FROM documents")
def _extraction(spark, d):
    s = _read(spark, d, "documents").select(F.when(F.col("lang") != "en", F.col("text")).alias("context"), F.col("n_chars").alias("extract_bytes"))
    return gate.extraction_metrics(s, 4.0)
