"""Text functions as Spark column expressions; Arrow UDFs only where Unicode or HTML needs Python."""

from __future__ import annotations

import unicodedata
import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import lexicon

#: A sentence ends at . ! or ? before white space and a capital, digit or quote.
_SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"

#: Code points with the property White_Space (fixed values).
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space of any script at both ends; only the ends are looked at."""
    return F.btrim(c, F.lit(_WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space become one space; stripped."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def _nfkd_key(titles: pd.Series) -> pd.Series:
    return titles.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).strip().lower())


def normalize_title(c: Column) -> Column:
    """Identity of a title: compatibility decomposition, stripped, lower case."""
    return _nfkd_key(c)


def title_key(c: Column) -> Column:
    """The same identity for text that is already in composed form, without leaving the JVM."""
    return F.lower(strip(c))


def strip_html(c: Column) -> Column:
    """Without tags; a tag does not span lines. Null gives the empty string."""
    return F.coalesce(strip(F.regexp_replace(c, r"<[^\n]*?>", "")), F.lit(""))


def safe_text(c: Column, fallback: str = "N/A") -> Column:
    s = strip(c.cast("string"))
    return F.when(F.length(s) > 0, s).otherwise(F.lit(fallback))


def present_value(c: Column, fallback: str = "Unavailable") -> Column:
    """For a table cell: placeholders become the fallback, pipes are escaped."""
    s = strip(c.cast("string"))
    missing = s.isNull() | (s == "") | F.lower(s).isin("none", "n/a", "na")
    return F.when(missing, F.lit(fallback)).otherwise(F.replace(s, F.lit("|"), F.lit("&#124;")))


def clean_number(c: Column, fallback: str = "0") -> Column:
    """The first number of up to three digits before the point, whole ones without a point."""
    n = F.regexp_extract(c.cast("string"), r"(-?\d{1,3}(?:\.\d+)?)", 1)
    v = n.try_cast("double")
    return F.when(v.isNull(), F.lit(fallback)).when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))


def first_number(c: Column) -> Column:
    """The first unsigned number once commas and spaces are gone, as double."""
    return F.regexp_extract(F.regexp_replace(c.cast("string"), "[, ]", ""), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def sentences(c: Column) -> Column:
    return F.filter(F.split(collapse(c), _SENTENCE_GAP), lambda p: F.length(p) > 0)


def sentences_of_flat(flat: Column) -> Column:
    """The number of sentences of a text whose white space is single spaces."""
    return F.size(F.filter(F.split(flat, _SENTENCE_GAP), lambda p: F.length(p) > 0))


def sentence_count(c: Column) -> Column:
    return F.coalesce(F.size(sentences(c)), F.lit(0))


def sentence_trim(c: Column, most: int = 3) -> Column:
    """At most ``most`` sentences; doubled points are joined first."""
    whole = strip(F.replace(collapse(c), F.lit(".."), F.lit(".")))
    split = lambda s: F.filter(F.split(s, _SENTENCE_GAP), lambda p: F.length(p) > 0)
    short = lambda s: let(split(s), lambda p: F.when(F.size(p) >= most, F.array_join(F.slice(p, 1, most), " ")).otherwise(s))
    return F.when(c.isNull(), F.lit("")).otherwise(let(whole, short))


def percent_value(c: Column) -> Column:
    """The number a text starts with, as double."""
    return F.regexp_extract(strip(c.cast("string")), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")


@F.pandas_udf(StringType())
def _one_decimal(v: pd.Series) -> pd.Series:
    # exact halves of the double decide, as C's printf does; Spark's format_string rounds the decimal text
    return v.map(lambda x: None if pd.isna(x) else f"{x:.1f}%")


def coerce_percent(c: Column) -> Column:
    return _one_decimal(percent_value(c))


def first_match(c: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches, across lines and case; null without one."""
    return F.coalesce(*(F.when(c.rlike(f"(?is){p}"), F.regexp_extract(c, f"(?is){p}", 1)) for p in patterns), F.lit(None).cast("string"))


def coerce_temperature(c: Column, signed: bool = False) -> Column:
    """Degrees within -50 to 140. ``signed`` keeps a minus sign; by default it is lost with all other signs."""
    v = F.regexp_replace(c.cast("string"), "[^0-9.-]" if signed else "[^0-9.]", "").try_cast("double")
    return F.when(v.between(-50, 140), v)


def contains_any(c: Column, phrases) -> Column:
    """Whether the lower-cased text contains one of the phrases; false for null. The text is lower-cased once."""
    return F.coalesce(let(F.lower(c), lambda low: holds_any(low, phrases)), F.lit(False))


def holds_any(low: Column, phrases) -> Column:
    """:func:`contains_any` of a text that is in lower case already; null for null."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(low, F.lit(p))
    return found


def is_obituary(c: Column) -> Column:
    return contains_any(c, lexicon.OBITUARY)


def is_real_estate(c: Column) -> Column:
    return contains_any(c, lexicon.REAL_ESTATE)


def build_context(context: Column, snippet: Column, title: Column, category: Column, chars: int = 600) -> Column:
    """Text to summarize: the context if it has 50 characters, else snippet, title and category."""
    own = strip(context)
    parts = F.filter(F.array(strip(snippet), strip(title)), lambda p: F.length(p) > 0)
    head = F.concat_ws("\n---\n", parts, F.array(F.concat(F.lit("Category: "), category)))
    bare = F.concat(category, F.lit(": "), F.coalesce(title, F.lit("")))
    return F.when(F.length(own) >= 50, F.substring(own, 1, chars)).when(F.size(parts) == 0, bare).otherwise(F.substring(head, 1, chars))


def parse_feed_date(published: Column, updated: Column, zone: str = "UTC") -> Column:
    """Publication time: RFC 2822 first, then ISO forms taken as local time of ``zone``; null if none fits.

    A time without an offset is UTC.
    """
    raw = F.coalesce(*(F.when(strip(x) != "", strip(x)) for x in (published, updated)))
    mail = F.regexp_replace(raw, r"^[A-Za-z]{3,9},\s*", "")
    mail = F.regexp_replace(F.regexp_replace(mail, r"\s+\([^)]*\)$", ""), r"\s(?:GMT|UTC|UT|Z)$", " +0000")
    mail = F.when(mail.rlike(r"\d:\d\d$"), F.concat(mail, F.lit(" +0000"))).otherwise(mail)
    local = [F.to_utc_timestamp(F.try_to_timestamp(raw, F.lit(p)), zone) for p in ("yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")]
    return F.coalesce(*(F.try_to_timestamp(mail, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")), *local)


def format_pub_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss z")


def parse_period_time(c: Column, zone: str = "UTC") -> Column:
    """ISO time with an offset, with a zone in brackets, or local; as an instant."""
    s = F.element_at(F.split(strip(c), r"\["), 1)
    with_offset = F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")), F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ssZ")))
    return F.coalesce(with_offset, F.to_utc_timestamp(F.try_to_timestamp(s, F.lit("yyyy-MM-dd'T'HH:mm:ss")), zone))


def day_label(d: Column) -> Column:
    return F.date_format(d, "E")


def significant_words(c: Column) -> Column:
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-zA-Z']+)"), 1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*lexicon.TOPIC_STOP)))


def word_list(c: Column, least: int = 4) -> Column:
    """Words of ASCII letters only, ``least`` or more, in order; letters of any script bound a word."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{Nd}_]+)"), 1)
    return F.filter(words, lambda w: w.rlike(rf"^[a-z]{{{least},}}$"))


def keyword_tokens(c: Column, least: int = 4) -> Column:
    return F.array_distinct(word_list(c, least))


def containment(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that ``b`` has; null if ``a`` has none."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.nullif(F.size(a), F.lit(0)).cast("double"))


def auto_summary(title: Column) -> Column:
    """The deterministic stand-in for a summary."""
    t = strip(F.regexp_replace(collapse(title), "[:\\-\u2014]\\s*$", ""))
    return F.when(title.isNull() | (title == ""), F.lit(lexicon.UNAVAILABLE_MARK)).otherwise(F.concat(F.lit(lexicon.AUTO_MARK + " "), t))


def lake_label(key: Column) -> Column:
    base = F.initcap(F.translate(key, "_-", "  "))
    return F.when(base.startswith("Lake"), base).otherwise(F.concat(F.lit("Lake "), base))


def extract_urls(c: Column) -> Column:
    """Targets of Markdown links with http or https."""
    return F.regexp_extract_all(c, F.lit(r"\[[^\]]+\]\((https?://[^)]+)\)"), 1)


def clamp(c: Column, low: float = 0.0, high: float = 40.0) -> Column:
    v = c.try_cast("double")
    return F.when(v.between(low, high), v)


class _Visible(HTMLParser):
    """Collects text outside of elements that carry none."""

    _HIDDEN = {"script", "style", "nav", "header", "footer", "aside"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth: list[str] = []
        self.parts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self._HIDDEN:
            self.depth.append(tag)

    def handle_endtag(self, tag):
        if tag in self.depth:
            del self.depth[self.depth.index(tag) :]

    def handle_data(self, data):
        if not self.depth and data.strip():
            self.parts.append(data)


def parsed_text(html: str) -> str:
    p = _Visible()
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.parts).split())


_HIDES = "|".join(sorted(_Visible._HIDDEN))
#: Markup whose reading leaves no choice: plain tags with quoted attributes, plain comments, a document type.
_MARK = re.compile(r"""<(?:/?[a-zA-Z][^<>"'=]*+|[a-zA-Z][a-zA-Z0-9]*+(?:\s++[a-zA-Z][a-zA-Z0-9-]*+(?:="[^"<>]*+"|='[^'<>]*+')?)*+\s*+|!--(?:[^<>-]|-(?!-))*+--|!(?i:doctype)\s[^<>\["']*+)>""")
#: Elements whose text is not read as other text is; a title or a text area may hold nothing but text.
_RAW = re.compile(r"(?i)<(?:iframe|noembed|noframes|noscript|plaintext|xmp|svg|math)\b|<(title|textarea)\b(?![^<>]*>[^<]*</\1\s*>)")
_HIDDEN = re.compile(rf"(?i)<(/?)({_HIDES})(?=[\s/>])[^<>]*>")
_ENDS = {tag: re.compile(rf"(?i)</{tag}(\s*>)?") for tag in ("script", "style")}


def quick_text(html: str) -> str | None:
    """The visible text of a page of plain markup, as :func:`parsed_text` gives it; None for any other page."""
    if _RAW.search(html):
        return None
    shown, hidden, open_, at, pos = [], [], [], 0, 0
    while m := _HIDDEN.search(html, pos):
        pos, tag = m.end(), m.group(2).lower()
        if m.group(1):
            if tag in open_:
                del open_[open_.index(tag) :]
                if not open_:
                    hidden.append(html[at:pos])
                    at = pos
            continue
        if m.group().endswith("/>"):
            return None
        if not open_:
            shown.append(html[at : m.start()])
            at = pos
        open_.append(tag)
        if tag in _ENDS:
            # a script's text is not markup; it ends at its own end tag
            end = _ENDS[tag].search(html, pos)
            if not end or not end.group(1) or "<!--" in html[pos : end.start()]:
                return None
            if len(open_) > 1:
                return None
            open_.clear()
            at = pos = end.end()
    if open_:
        return None
    shown.append(html[at:])
    if any("<" in _MARK.sub("", h) or "<!--" in h for h in hidden):
        return None
    text = _MARK.sub(" ", " ".join(shown))
    return None if "<" in text else " ".join((unescape(text) if "&" in text else text).split())


def visible_text(html: str | None) -> str:
    """Text outside of elements that carry none, in single spaces. Plain markup is read by patterns, all other by a parser."""
    if not html:
        return ""
    text = quick_text(html)
    return parsed_text(html) if text is None else text


def html_text(chars: int = 600, least: int = 50):
    """A column function: visible text of a page, its first ``chars`` characters; null under ``least``."""

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        def one(h):
            t = visible_text(h)[:chars]
            return t if len(t) >= least else None

        return pages.map(one)

    return of
