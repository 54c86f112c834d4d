"""Configuration: a YAML tree, found by a chain of places, checked by rules, turned into small tables."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators.tagging import TagRules

ENV = "QUILLSPARK_CONFIG"


def find_config(explicit: str | None = None, cwd: str | None = None, home: str | None = None, default: str | None = None) -> Path | None:
    """The first that exists: the argument, the environment's, ./config.yaml, ~/.config/quillspark, the default."""
    places = [explicit, os.environ.get(ENV), os.path.join(cwd or os.getcwd(), "config.yaml"), os.path.join(home or os.path.expanduser("~"), ".config", "quillspark", "config.yaml"), default]
    return next((Path(p) for p in places if p and os.path.isfile(p)), None)


def load_config(path: str | Path) -> dict:
    import yaml

    with open(path, encoding="utf-8") as fh:
        tree = yaml.safe_load(fh)
    if not isinstance(tree, dict):
        raise ValueError(f"{path}: a mapping is expected at the top")
    return tree


def lookup(tree: Any, dotted: str, default: Any = None) -> Any:
    for key in dotted.split("."):
        if not isinstance(tree, dict) or key not in tree:
            return default
        tree = tree[key]
    return tree


@dataclass(frozen=True)
class Rule:
    """A key's kind (str, int, float, bool, list, dict), whether it must be there, and its range."""

    key: str
    kind: type
    required: bool = True
    low: float | None = None
    high: float | None = None
    filled: bool = False


def _fits(v: Any, kind: type) -> bool:
    if kind in (int, float) and isinstance(v, bool):
        return False
    return isinstance(v, (int, float)) if kind is float else isinstance(v, kind)


RULES = (
    Rule("timezone", str, filled=True),
    Rule("output_dir", str, filled=True),
    Rule("categories", dict, filled=True),
    Rule("category_priority", list, required=False),
    Rule("category_boosts", dict, required=False),
    Rule("tagging_config.max_tags", int, required=False, low=1, high=50),
    Rule("tagging_config.score_cap", float, required=False, low=0),
    Rule("tagging_config.score_threshold", float, required=False, low=0),
    Rule("prompts.batch", str, required=False, filled=True),
    Rule("prompts.single", str, required=False, filled=True),
    Rule("prompts.strict", str, required=False, filled=True),
    Rule("llm.endpoint", str, required=False, filled=True),
    Rule("llm.model", str, required=False, filled=True),
    Rule("llm.batch_size", int, required=False, low=1),
    Rule("llm.concurrency", int, required=False, low=1),
    Rule("llm.recovery_concurrency", int, required=False, low=1),
    Rule("llm.recovery_deadline_s", float, required=False, low=0),
    Rule("llm.temperature", float, required=False, low=0, high=2),
    Rule("llm.max_tokens", int, required=False, low=1),
    Rule("llm.timeout", float, required=False, low=0),
    Rule("keep_reports", int, required=False, low=1),
    Rule("extract", bool, required=False),
    Rule("weather.lakes", dict, required=False),
)


def validate_config(tree: dict, rules: tuple[Rule, ...] = RULES) -> tuple[bool, list[str]]:
    """(passed, issues): keys, kinds and ranges, then categories, references, lakes and the zone."""
    issues = []
    missing = object()
    for r in rules:
        v = lookup(tree, r.key, missing)
        if v is missing or v is None:
            if r.required:
                issues.append(f"{r.key}: missing")
        elif not _fits(v, r.kind):
            issues.append(f"{r.key}: {r.kind.__name__} expected")
        elif r.filled and not (v.strip() if isinstance(v, str) else v):
            issues.append(f"{r.key}: empty")
        elif (r.low is not None and v < r.low) or (r.high is not None and v > r.high):
            issues.append(f"{r.key}: out of range")
    cats = lookup(tree, "categories", {})
    cats = cats if isinstance(cats, dict) else {}
    for name, c in cats.items():
        if not isinstance(c, dict):
            issues.append(f"categories.{name}: dict expected")
            continue
        if not isinstance(c.get("query", ""), str):
            issues.append(f"categories.{name}.query: str expected")
        for key, low in (("max_stories", 0), ("min_age_hours", 1), ("source_window_hours", 1), ("candidate_pool_limit", 1)):
            if key in c and (not _fits(c[key], int) or c[key] < low):
                issues.append(f"categories.{name}.{key}: int of {low} or more expected")
    for key in ("category_priority", "category_boosts"):
        issues += [f"{key}: unknown category {n}" for n in lookup(tree, key, []) or [] if n not in cats]
    for name, url in (lookup(tree, "weather.lakes", {}) or {}).items() if isinstance(lookup(tree, "weather.lakes", {}), dict) else ():
        if not isinstance(url, str) or not url.startswith(("http://", "https://")):
            issues.append(f"weather.lakes.{name}: URL expected")
    zone = lookup(tree, "timezone")
    if isinstance(zone, str) and zone:
        from zoneinfo import ZoneInfo

        try:
            ZoneInfo(zone)
        except Exception:
            issues.append("timezone: unknown")
    return not issues, issues


def category_table(spark: SparkSession, tree: dict, age_limit_h: int = 24, window_h: int = 24, pool_limit: int = 50) -> DataFrame:
    """Categories with a query: category, cat_pos, query, age_limit_h, window_h, pool_limit, cap."""
    rows = [
        (name, k, c.get("query") or "", int(c.get("min_age_hours", age_limit_h)), int(c.get("source_window_hours", window_h)), int(c.get("candidate_pool_limit", pool_limit)), int(c.get("max_stories", 0)))
        for k, (name, c) in enumerate((tree.get("categories") or {}).items())
        if c.get("query")
    ]
    return spark.createDataFrame(rows, "category string, cat_pos int, query string, age_limit_h int, window_h int, pool_limit int, cap int")


def tag_rules(tree: dict) -> TagRules:
    t = tree.get("tagging_config") or {}
    return TagRules(
        mappings={k: list(v or []) for k, v in (tree.get("tagging_mappings") or {}).items()},
        boosts={k: list(v or []) for k, v in (tree.get("category_boosts") or {}).items()},
        conflicts=[(p[0], p[1]) for p in tree.get("tag_conflicts") or [] if len(p) == 2],
        max_tags=int(t.get("max_tags", 5)),
        score_cap=float(t.get("score_cap", 5.0)),
        score_threshold=float(t.get("score_threshold", 0.3)),
    )
