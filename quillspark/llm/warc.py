"""WARC archives with a two-level capture index.

Writing: every task writes its rows as gzipped WARC/1.1 records, one gzip member
a record, into files of its own under a shared folder, and returns where each
record lies. A retried task writes new files; only the files that a committed
row names are ever read.

Index: captures are sorted by (reversed-host URL key, time, id). Each range
becomes one shard file: gzipped blocks of ``BLOCK_LINES`` lines, then the
shard's sparse directory (first capture, offset and length of each block), then
the directory's length. The shards' first captures form the top level; there are
at most ``MOST_SHARDS`` of them, so that list is small at any scale.

Look-up: binary search in the top level, in the shard's directory, then in one
block, fetched by a range read. Records are fetched in the order in which they
lie, neighbours in one range read.

All file access goes through pyarrow's file systems by URI (file, hdfs, s3, gs).
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import arrow_map, bounded_broadcast, materialize, shared_path

BLOCK_LINES = 1000
MOST_SHARDS = 1024
ROLL_BYTES = 1 << 30
#: Smaller payloads are never revisits.
LEAST_REVISIT = 100
#: A fixed capture time keeps archives reproducible where a table has none.
NO_TIME = "2024-01-01T00:00:00Z"
_NO_ID = -(1 << 63)

_CAPTURE = "key string, ts string, id long, file string, at long, size long, kind string, digest string"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``http://www.A.com/x?y#z`` is ``com,a,www)/x?y``.

    Scheme, user, default port and fragment are dropped, the host is lower-cased.
    What cannot be parsed is kept after an empty host; null is ``)/``.
    """
    if not url:
        return ")/"
    try:
        p = urlsplit(url.strip())
        host, port = (p.hostname or "").rstrip("."), p.port
    except ValueError:
        return ")/" + url
    if not host:
        return ")/" + url
    at = ",".join(reversed(host.split(".")))
    if port and port not in (80, 443):
        at += f":{port}"
    return f"{at}){p.path or '/'}" + (f"?{p.query}" if p.query else "")


def _record_name(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page_of(name: str) -> int | None:
    tail = name.rpartition(":")[2].rstrip(">")
    return int(tail) if tail else None


def record(page_id: int | None, url: str | None, ts: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, gzipped. A revisit has the digest and the record it refers to, and no payload."""
    body = b"" if revisit else payload
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_name(page_id)}",
        f"WARC-Date: {ts}",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head.insert(6, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.insert(7, f"WARC-Refers-To: {_record_name(refers_to)}")
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def file_info(name: str) -> bytes:
    """The record that each archive file begins with, gzipped."""
    block = b"software: quillspark\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-file:{name}>", f"WARC-Date: {NO_TIME}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the payload of a gzipped record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _write(root: str):
    """Appends records to this task's archive files; yields where each lies."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows: list[list] = [[] for _ in range(8)]
                for page_id, url, ts, html, digest, first, revisit in zip(*(batch.column(k).to_pylist() for k in range(7))):
                    if out is None or at > ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"capture-{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        info = file_info(name)
                        out.write(info)
                        at = len(info)
                    member = record(page_id, url, ts or NO_TIME, (html or "").encode(), digest, first, revisit)
                    out.write(member)
                    for col, v in zip(rows, (url_key(url), ts or NO_TIME, page_id, name, at, len(member), "revisit" if revisit else "response", digest)):
                        col.append(v)
                    at += len(member)
                kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=[x.split()[0] for x in _CAPTURE.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, root: str) -> DataFrame:
    """Writes a record for each row (page_id, url, html, optionally ts as text) and returns the captures.

    Files are named by the attempt that writes them and known by its committed captures only:
    what a lost or repeated attempt leaves is never read, and goes with the folder.

    Payloads are the html in UTF-8, null is empty. Of records with equal payloads of
    at least ``LEAST_REVISIT`` bytes those with the smallest page_id are responses
    (rows that repeat a page_id are each one), the others revisit it; rows without a
    page_id come last. Other columns are ignored.
    """
    ts = F.col("ts").cast("string") if "ts" in pages.columns else F.lit(None).cast("string")
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", ts.alias("ts"), "html", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes"))
    # payloads that repeat: their digests are counted before anything is joined
    again = rows.where(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    again = materialize(again, "warc-repeats")
    rows = rows.join(bounded_broadcast(again, again.count(), 500_000), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.select("page_id", "url", "ts", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return materialize(arrow_map(rows, _write(root), _CAPTURE), "warc-captures")


_SHARD = "key string, ts string, id long, file string, captures long"


def _write_shards(root: str):
    """Sorted captures become one shard file: blocks, directory, and the directory's length."""

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        name, out, at, total, lines, directory, top = f"shard-{uuid.uuid4().hex}.cdx.gz", None, 0, 0, [], [], None

        def flush():
            nonlocal at
            block = gzip.compress(json.dumps(lines).encode(), 4, mtime=0)
            directory.append([*lines[0][:3], at, len(block)])
            out.write(block)
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(8))):
                row = [row[0], row[1], _NO_ID if row[2] is None else row[2], *row[3:]]
                if out is None:
                    out, top = fs.open_output_stream(f"{base}/{name}", compression=None), row[:3]
                lines.append(row)
                total += 1
                if len(lines) >= BLOCK_LINES:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        packed = gzip.compress(json.dumps(directory).encode(), 4, mtime=0)
        out.write(packed + struct.pack("<q", len(packed)))
        out.close()
        cols = [pa.array([top[0]]), pa.array([top[1]]), pa.array([top[2]], pa.int64()), pa.array([name]), pa.array([total], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _SHARD.split(", ")])

    return run


def build_index(captures: DataFrame, root: str) -> list[tuple]:
    """Sorts captures into shard files and returns the top level: (first capture, file), in order."""
    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(n, MOST_SHARDS))
    order = ["key", "ts", "id", "file", "at"]
    ranged = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    shards = materialize(arrow_map(ranged, _write_shards(root), _SHARD), "warc-shards")
    return sorted(((r["key"].encode(), r["ts"], r["id"]), r["file"]) for r in shards.collect())


class Shard:
    """One shard: its directory in memory, blocks by range reads, the last one kept."""

    def __init__(self, fs, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size()
        (size,) = struct.unpack("<q", self.file.read_at(8, end - 8))
        self.blocks = json.loads(gzip.decompress(self.file.read_at(size, end - 8 - size)))
        self.firsts = [(b[0].encode(), b[1], b[2]) for b in self.blocks]
        self.held, self.rows, self.keys = -1, [], []

    def block(self, k: int) -> None:
        if k != self.held:
            self.rows = json.loads(gzip.decompress(self.file.read_at(self.blocks[k][4], self.blocks[k][3])))
            self.keys, self.held = [(r[0].encode(), r[1], r[2]) for r in self.rows], k

    def find(self, low: tuple, high: tuple) -> list[list]:
        """The captures from ``low`` to ``high``, both included."""
        out = []
        k = max(bisect.bisect_left(self.firsts, low) - 1, 0)
        while k < len(self.blocks) and self.firsts[k] <= high:
            self.block(k)
            i = bisect.bisect_left(self.keys, low)
            while i < len(self.keys) and self.keys[i] <= high:
                out.append(self.rows[i])
                i += 1
            k += 1
        return out


class CaptureIndex:
    """Look-ups in the two levels; made on an executor from the root and the top level."""

    def __init__(self, root: str, top: list[tuple]):
        self.fs, self.base = pafs.FileSystem.from_uri(root)
        self.top, self.firsts = top, [t[0] for t in top]
        self.shards: dict[str, Shard] = {}

    def find(self, low: tuple, high: tuple) -> list[list]:
        out = []
        k = max(bisect.bisect_left(self.firsts, low) - 1, 0)
        while k < len(self.top) and self.firsts[k] <= high:
            name = self.top[k][1]
            if name not in self.shards:
                if len(self.shards) >= 4:
                    self.shards.pop(next(iter(self.shards))).file.close()
                self.shards[name] = Shard(self.fs, f"{self.base}/{name}")
            out += self.shards[name].find(low, high)
            k += 1
        return out


def _look_up(root: str, top: list[tuple]):
    def run(batches):
        index = CaptureIndex(root, top)
        for batch in batches:
            rows = []
            for url, ts, page_id, exact in zip(*(batch.column(k).to_pylist() for k in range(4))):
                key = url_key(url).encode()
                if exact:
                    page = _NO_ID if page_id is None else page_id
                    low = high = (key, ts or NO_TIME, page)
                else:
                    low, high = (key, "", _NO_ID), (key, "\U0010ffff", (1 << 63) - 1)
                rows += index.find(low, high)
            cols = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols[2] = [None if i == _NO_ID else i for i in cols[2]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _CAPTURE.split(", ")])

    return run


def look_up(requests: DataFrame, root: str, top: list[tuple]) -> DataFrame:
    """The captures of each request (url, ts, page_id, exact).

    ``exact``: the captures of this url, time and page; else all captures of the url.
    Requests are dealt by url and page so that a task meets few shards, and a url
    with very many requests is dealt to several tasks.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = F.reverse(F.split(F.coalesce(F.try_parse_url(F.col("url"), F.lit("HOST")), F.lit("")), r"\."))
    keyed = requests.select("url", "ts", "page_id", "exact", F.array_join(host, ",").alias("k"))
    dealt = keyed.repartitionByRange(n, "k", "url", "page_id").sortWithinPartitions("k", "url", "page_id")
    return arrow_map(dealt.select("url", "ts", "page_id", "exact"), _look_up(root, top), _CAPTURE)


_PAYLOAD = "page_id long, record_type string, refers_to long, header_digest string, payload_digest string, payload_bytes long, payload binary"


def _read(root: str, with_payload: bool, gap: int = 1 << 16, most: int = 4 << 20):
    def run(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        name, file = None, None

        def emit(group, rows):
            lo = group[0][0]
            data = file.read_at(group[-1][0] + group[-1][1] - lo, lo)
            for at, size in group:
                fields, payload = parse_record(data[at - lo : at - lo + size])
                kind = fields["warc-type"]
                rows.append((_page_of(fields["warc-record-id"]), kind, _page_of(fields["warc-refers-to"]) if kind == "revisit" else None, fields["warc-payload-digest"].partition(":")[2], hashlib.sha256(payload).hexdigest(), len(payload), payload if with_payload else None))

        for batch in batches:
            rows, group = [], []
            for f, at, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if group and (f != name or at > group[-1][0] + group[-1][1] + gap or at + size - group[0][0] > most or at < group[-1][0]):
                    emit(group, rows)
                    group = []
                if f != name:
                    if file is not None:
                        file.close()
                    name, file = f, fs.open_input_file(f"{base}/{f}")
                group.append((at, size))
            if group:
                emit(group, rows)
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _PAYLOAD.split(", ")])

    return run


def read_records(found: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """The records of captures, read by ranges in the order in which they lie.

    A revisit has no payload of its own; its digest is in its header.
    """
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("file", "at", "size").repartitionByRange(n, "file", "at").sortWithinPartitions("file", "at")
    return arrow_map(dealt, _read(root, with_payload), _PAYLOAD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives ``pages``, indexes them, looks up every page and reads its record back.

    (page_id, payload_bytes, payload_digest, record_type, refers_to), a row for each
    row of ``pages``. Digest and length of a revisit are those of the payload that
    was read from the record it refers to. A row that repeats a page and its time is
    found once for each of its records. An empty table gives an empty table.
    """
    spark: SparkSession = pages.sparkSession
    root = shared_path(spark, "warc")
    captures = write_archives(pages, root)
    top = build_index(captures, root)
    ts = F.col("ts").cast("string") if "ts" in pages.columns else F.lit(None).cast("string")
    asked = pages.select("url", ts.alias("ts"), F.col("page_id").cast("long").alias("page_id"), F.lit(True).alias("exact")).distinct()
    read = materialize(read_records(look_up(asked, root, top), root, with_payload=False).drop("payload"), "warc-read")
    own = read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    whole = read.where(f"record_type = 'response' AND payload_bytes >= {LEAST_REVISIT}").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    other = read.where("record_type = 'revisit'").select("page_id", F.col("header_digest").alias("payload_digest"), "record_type", "refers_to")
    other = other.join(whole, "payload_digest").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return own.union(other)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``; a row each, null html is empty. Odd rows as in :func:`round_trip`."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
