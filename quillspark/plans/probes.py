"""Connectivity probes: named checks with a time limit, as rows; and the run's log."""

from __future__ import annotations

import logging
import sys
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late

from pyspark.sql import DataFrame, SparkSession

from ..sources import http

Probe = Callable[[], str]


def url_probe(url: str, transport: http.Transport, any_2xx: bool = True, timeout: float = 5.0) -> Probe:
    """Asks for a URL once and tells its status; raises where it is not accepted."""

    def run() -> str:
        status, _, body = transport(url, timeout)
        if hasattr(body, "close"):
            body.close()
        if not ((200 <= status < 300) if any_2xx else status == 200):
            raise ValueError(f"status {status}")
        return f"status {status}"

    return run


def run_probes(probes: dict[str, Probe], limit_s: float = 10.0) -> list[dict]:
    """Runs all at once; one that fails or is late is a row that says so. Order is that of ``probes``."""
    out = []
    pool = ThreadPoolExecutor(max_workers=max(1, len(probes)))
    try:
        began = time.monotonic()
        waiting = {name: pool.submit(p) for name, p in probes.items()}
        for name, f in waiting.items():
            try:
                ok, message = True, f.result(max(0.0, limit_s - (time.monotonic() - began)))
            except Late:
                ok, message = False, f"no answer within {limit_s:g} s"
            except Exception as e:  # any failure of a probe is its result
                ok, message = False, f"{type(e).__name__}: {e}"
            out.append({"name": name, "ok": ok, "message": message, "duration_ms": int((time.monotonic() - began) * 1000)})
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return out


def as_table(spark: SparkSession, results: list[dict]) -> DataFrame:
    rows = [(r["name"], r["ok"], r["message"], r["duration_ms"]) for r in results]
    return spark.createDataFrame(rows, "name string, ok boolean, message string, duration_ms int")


def shown(results: list[dict]) -> str:
    """A block of lines for a terminal, with the tally."""
    lines = []
    for r in results:
        ms = "N/A" if r["duration_ms"] is None else f"{r['duration_ms']} ms"
        lines.append(f"{'ok  ' if r['ok'] else 'fail'} {r['name']:<20} {ms}" + ("" if r["ok"] else f"  {r['message']}"))
    good = sum(r["ok"] for r in results)
    return "\n".join([*lines, f"{good} of {len(results)} passed"])


def run_log(path: str, name: str = "quillspark.run") -> logging.Logger:
    """A logger to a file and to stderr; :func:`close_log` ends it."""
    log = logging.getLogger(name)
    close_log(log)
    log.setLevel(logging.INFO)
    for h in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler(sys.stderr)):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log


def close_log(log: logging.Logger) -> None:
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
