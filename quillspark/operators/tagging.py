"""Keyword tagging: weighted matches, category boosts, conflicts and a minimum of tags, in array expressions.

The dictionary is configuration (tag -> keywords, in order) and bounded; it becomes an
inverted index that is one constant of the plan, so a story is tagged where it is,
without join or shuffle.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lexicon


@dataclass(frozen=True)
class TagRules:
    mappings: dict[str, list[str]]
    boosts: dict[str, list[str]] = field(default_factory=dict)
    conflicts: list[tuple[str, str]] = field(default_factory=list)
    max_tags: int = 5
    min_tags: int = 3
    score_cap: float = 5.0
    score_threshold: float = 0.3
    fallback: str = "#news"


def only_stop_words(keyword: str) -> bool:
    """Also true for keywords without any word of letters."""
    return all(w in lexicon.TAG_STOP for w in re.findall(r"\b[a-z]+\b", keyword.lower()))


def keyword_pattern(keyword: str) -> str:
    """A whole word, also in plural, -ed or -ing; neighbours are no letters."""
    return r"(?i)(^|[^a-zA-Z])" + re.escape(keyword.lower()).replace(r"\ ", " ") + r"(s|es|ed|ing)?([^a-zA-Z]|$)"


def keyword_weight(keyword: str) -> int:
    return max(sum(w not in lexicon.TAG_STOP for w in keyword.split()), 1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


_RUN = re.compile("[a-z]+")
#: Endings that a keyword's last word may have in a title.
_ENDINGS = ("s", "es", "ed", "ing")


def index_entry(keyword: str) -> dict | None:
    """What finds a keyword in a lower-cased title; None for one that never counts.

    ``word``: the keyword's first run of letters, which must be a run of the title, with an ending
    where ``open``. ``pattern``: null where that says it all, else what must match as well.
    """
    if not keyword or only_stop_words(keyword):
        return None
    low = keyword.lower()
    run = _RUN.search(low)
    alone = run.span() == (0, len(low))
    return {"kw": keyword, "word": run.group(), "open": run.end() == len(low), "pattern": None if alone else keyword_pattern(keyword), "weight": keyword_weight(keyword)}


def dictionary_index(rules: TagRules) -> tuple[list[dict], dict[str, list[dict]]]:
    """Entries of all tags (tag: its place), and those of the boosts of each category."""
    tags = [e | {"tag": n} for n, keywords in enumerate(rules.mappings.values()) for kw in keywords or [] if (e := index_entry(kw)) and kw == kw.lower()]
    boosts = {cat: [e | {"kw": b.lower()} for b in boosted if (e := index_entry(b))] for cat, boosted in rules.boosts.items()}
    return tags, boosts


_ENTRY = "struct<kw:string,word:string,open:boolean,pattern:string,weight:int,tag:int>"


def _place(word: Column, low: Column) -> Column:
    """Where a word begins in a title, from 1; 0 for nowhere."""
    return F.call_function("locate", word, low)


def _constant(value, ddl: str) -> Column:
    """A value of any size as one literal: the plan holds a constant, not an expression for each part."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def _words_met(low: Column, words: list[str]) -> Column:
    """Of a title's runs of letters those that the index has: exact (as they stand) and stems (or without an ending)."""
    runs = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-zA-Z]+"), F.lit(0)))
    cut = lambda r: F.array(r, *(F.when(F.endswith(r, F.lit(e)), F.substr(r, F.lit(1), F.length(r) - len(e))) for e in _ENDINGS))
    # a set of literals: one hash for each run, however many words there are
    known = lambda xs: F.filter(xs, lambda x: x.isin(words)) if words else F.array().cast("array<string>")
    return F.struct(known(runs).alias("exact"), F.array_distinct(known(F.flatten(F.transform(runs, cut)))).alias("stems"))


def _stands(e: Column, low: Column, met: Column) -> Column:
    """Whether an entry's keyword is in the title: its word first, the pattern only for those that pass."""
    word = F.when(e["open"], F.array_contains(met["stems"], e["word"])).otherwise(F.array_contains(met["exact"], e["word"]))
    return word & (e["pattern"].isNull() | ((_place(e["kw"], low) > 0) & F.rlike(low, e["pattern"])))


def scored_tags(title: Column, category: Column | None, rules: TagRules) -> Column:
    """Array of (score, turn, tag) above the threshold, capped, best first, ties in dictionary order.

    An inverted index of the dictionary is one constant of the plan: a title's words are looked up in
    the set of the keywords' first words, and only entries of words that it has are tried.
    The plan does not grow with keywords, tags or boosts.
    """
    if not rules.mappings:
        return F.array().cast("array<struct<score:double,turn:int,tag:string>>")
    names = _constant(list(rules.mappings), "array<string>")
    tags, boosts = dictionary_index(rules)
    words = sorted({e["word"] for e in [*tags, *(e for own in boosts.values() for e in own)]})
    index, extra = _constant(tags, f"array<{_ENTRY}>"), _constant(boosts, f"map<string,array<{_ENTRY}>>")
    place = {t: n for n, t in enumerate(rules.mappings)}
    raised = _constant({cat: [place[t] for t in boosted if t in place] for cat, boosted in rules.boosts.items()}, "map<string,array<int>>")

    def scores(x: Column) -> Column:
        low, met = x["low"], x["met"]
        none = F.size(met["stems"]) == 0
        points = lambda e: F.when(_place(e["kw"], low) <= 100, F.lit(2.0)).otherwise(F.lit(1.0)) * e["weight"]
        found = F.when(none, F.array().cast("array<struct<tag:int,points:double>>")).otherwise(F.transform(F.filter(index, lambda e: _stands(e, low, met)), lambda e: F.struct(e["tag"].alias("tag"), points(e).alias("points"))))
        more = F.lit(0) if category is None else F.when(none, 0).otherwise(F.coalesce(F.size(F.filter(F.try_element_at(extra, category), lambda e: _stands(e, low, met))), F.lit(0)))
        mine = F.lit(None).cast("array<int>") if category is None else F.try_element_at(raised, category)
        return _let(F.struct(found.alias("found"), F.greatest(more, F.lit(0)).alias("more"), mine.alias("mine")), ranked)

    def ranked(y: Column) -> Column:
        def raw(tag: Column, n: Column) -> Column:
            own = F.aggregate(F.filter(y["found"], lambda f: f["tag"] == n), F.lit(0.0), lambda acc, f: acc + f["points"])
            gain = F.when(y["mine"].isNull(), 0.0).when(F.array_contains(y["mine"], n), 3.0).otherwise(2.0 * y["more"])
            # equal scores: the earlier tag has the larger second key
            return F.struct((own + gain).alias("raw"), (-n).alias("turn"), tag.alias("tag"))

        kept = F.filter(F.transform(names, raw), lambda s: s["raw"] > rules.score_threshold)
        return F.sort_array(F.transform(kept, lambda s: F.struct(F.least(s["raw"], F.lit(rules.score_cap)).alias("score"), s["turn"].alias("turn"), s["tag"].alias("tag"))), asc=False)

    whole = _let(F.lower(F.coalesce(title, F.lit(""))), lambda low: F.struct(low.alias("low"), _words_met(low, words).alias("met")))
    return _let(whole, scores)


def conflict_losers(scored: Column, rules: TagRules) -> Column:
    """Tags that lose a conflict; the first of a pair loses a tie."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rules.conflicts))
    if not rules.conflicts:
        return F.array().cast("array<string>")
    of = F.map_from_entries(F.transform(scored, lambda x: F.struct(x["tag"], x["score"])))

    def losers(score: Column) -> Column:
        met = F.filter(pairs, lambda p: F.map_contains_key(score, p["a"]) & F.map_contains_key(score, p["b"]))
        return F.transform(met, lambda p: F.when(F.try_element_at(score, p["a"]) <= F.try_element_at(score, p["b"]), p["a"]).otherwise(p["b"]))

    return _let(of, losers)


def tag_array(title: Column, category: Column | None, rules: TagRules) -> Column:
    """The tags of a story as an array: top tags, conflicts resolved, filled up to the minimum.

    Filled from the other scored tags, then from the category as a whole and its words.
    """
    if category is None:
        more = F.array().cast("array<string>")
    else:
        slug = lambda c: F.translate(F.lower(c), " /", "--")
        words = F.filter(F.split(F.lower(category), r"\s+"), lambda w: F.length(w) > 0)
        more = F.coalesce(F.concat(F.array(slug(category)), F.transform(words, slug)), F.array().cast("array<string>"))

    def resolve(s: Column) -> Column:
        all_tags = F.transform(s["scored"], lambda x: x["tag"])
        top = F.array_except(F.slice(all_tags, 1, rules.max_tags), s["lost"])
        # each candidate once, those of the top first
        order = F.array_distinct(F.concat(top, F.array_except(all_tags, s["lost"]), F.array_except(more, s["lost"])))
        return F.slice(order, 1, F.greatest(F.size(top), F.lit(rules.min_tags)))

    both = _let(scored_tags(title, category, rules), lambda x: F.struct(x.alias("scored"), conflict_losers(x, rules).alias("lost")))
    tags = _let(both, resolve)
    return tags if category is None else _let(tags, lambda t: F.when((F.size(t) == 0) & category.isNotNull(), F.slice(more, 1, 1)).otherwise(t))


def tag_markup(title: Column, category: Column | None, rules: TagRules) -> Column:
    """``[[tag]] [[tag]]``, or the fallback without any tag."""
    shown = lambda tags: F.array_join(F.transform(tags, lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), " ")
    return _let(tag_array(title, category, rules), lambda tags: F.when(F.size(tags) > 0, shown(tags)).otherwise(F.lit(rules.fallback)))


def tag_union(tags: Column, seeds: list[str]) -> Column:
    """Aggregate: all tags in lower case together with the seeds, sorted."""
    own = F.array_distinct(F.flatten(F.collect_set(F.transform(tags, F.lower))))
    return F.array_sort(F.array_union(F.array(*(F.lit(s) for s in seeds)).cast("array<string>"), own))
