"""An HTTP source with an injectable transport: bounded retries, a body limit, one row a request.

``spark.read.format("web")`` after ``spark.dataSource.register(WebSource)``; the
requests come from option ``urls`` (JSON list) or ``path`` (a text file of URLs). A
transport is named by option ``transport`` as ``module:function``, called as
``f(url, timeout) -> (status, headers, body)``, the body bytes or an iterable of pieces,
which is read only as far as the limit; without one, urllib is used.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

ATTEMPTS, BACKOFF, BODY_LIMIT = 3, (0.25, 0.5), 5 * 1024 * 1024
RETRY = (429, 502, 503, 504)

Body = bytes | Iterable[bytes]
Transport = Callable[[str, float], tuple[int, dict, Body]]
#: Bytes of a piece of a body.
PIECE = 64 * 1024


def is_accepted(status: Column, any_2xx: bool = False) -> Column:
    return status.between(200, 299) if any_2xx else status == 200


def should_retry(status: Column) -> Column:
    return status.isin(*RETRY)


def _pieces(response) -> Iterator[bytes]:
    with response:
        while piece := response.read(PIECE):
            yield piece


def _urllib(url: str, timeout: float) -> tuple[int, dict, Body]:
    try:
        r = urllib.request.urlopen(url, timeout=timeout)
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), b""
    return r.status, dict(r.headers), _pieces(r)


def _close(body: Body) -> None:
    if hasattr(body, "close"):
        body.close()


def _bounded(headers: dict, body: Body, limit: int) -> bytes | None:
    """The whole body, or None when it is over the limit: by its length header without reading, else as soon as it is."""
    size = str({k.lower(): v for k, v in headers.items()}.get("content-length") or "")
    try:
        if size.isdigit() and int(size) > limit:
            return None
        if isinstance(body, bytes):
            return body if len(body) <= limit else None
        out = bytearray()
        for piece in body:
            out += piece
            if len(out) > limit:
                return None
        return bytes(out)
    finally:
        _close(body)


def get(url: str, transport: Transport, timeout: float = 10.0, limit: int = BODY_LIMIT, any_2xx: bool = False, sleep=time.sleep) -> dict:
    """One request: (status, body, error, attempts). A body over the limit or a refused status has no body."""
    out = {"status": None, "body": None, "error": None, "attempts": 0}
    for turn in range(ATTEMPTS):
        out["attempts"] = turn + 1
        try:
            status, headers, body = transport(url, timeout)
            good = (200 <= status < 300) if any_2xx else status == 200
            whole = _bounded(headers, body, limit) if good else _close(body)
        except Exception as e:  # a failed request is a row with its error, not a failed task
            out.update(status=None, error=type(e).__name__)
        else:
            out.update(status=status, error=None)
            if good:
                out.update(body=whole, error="too large" if whole is None else None)
                return out
            if status not in RETRY:
                out["error"] = f"status {status}"
                return out
            out["error"] = f"status {status}"
        if turn + 1 < ATTEMPTS:
            sleep(BACKOFF[turn])
    return out


class _Urls(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.only: set | None = None

    def partitions(self):
        urls = [u for u in json.loads(self.options.get("urls", "[]")) if self.only is None or u in self.only]
        n = max(1, int(self.options.get("parallel", "4")))
        return [_Urls(urls[k::n]) for k in range(min(n, len(urls)))] or [_Urls([])]

    def read(self, partition) -> Iterator[tuple]:
        name = self.options.get("transport")
        transport = _urllib
        if name:
            module, _, attr = name.partition(":")
            transport = getattr(importlib.import_module(module), attr)
        for url in partition.urls:
            r = get(url, transport, float(self.options.get("timeout", "10")), int(self.options.get("limit", str(BODY_LIMIT))), self.options.get("accept") == "2xx")
            yield (url, r["status"], r["body"], r["error"], r["attempts"])


class _ChoosingReader(_Reader):
    def pushFilters(self, filters):
        """Equality and IN on ``url`` choose the requests; Spark still applies every filter.

        Spark refuses a reader that has this unless ``spark.sql.python.filterPushdown.enabled``
        is set, so option ``pushdown`` asks for it.
        """
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("url",):
                self.only = values if self.only is None else self.only & values
            yield f


class WebSource(DataSource):
    """Rows (url, status, body, error, attempts); requests are dealt over ``parallel`` tasks."""

    @classmethod
    def name(cls) -> str:
        return "web"

    def schema(self) -> str:
        return "url string, status int, body binary, error string, attempts int"

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (_ChoosingReader if options.get("pushdown") == "true" else _Reader)(options)
