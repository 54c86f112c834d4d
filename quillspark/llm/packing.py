"""Packing token ids into rows of one length: best-fit decreasing, in Arrow batches.

Documents longer than a row are split into whole rows and a rest; nothing is cut
off. The pieces of a buffer of about ``BUFFER_TOKENS`` tokens are placed in
decreasing length, each into the open row with the least room that still fits,
found by a search in a segment tree over capacities (the leftmost capacity at or
above the need that has an open row). A packed row has the matrix row of ids
(padded), the cumulative lengths of its segments, the places where positions
start anew, and which part of which document each segment is.

The ids are exchanged once, two bytes each; a task holds one buffer. Which documents are packed
together follows from their ids and texts, not from the table's layout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import text_slices
from .workspace import arrow_map

ROW_TOKENS = 2048
BUFFER_TOKENS = 4_000_000
PAD = 50256
#: Text bytes of the documents that are packed together, about, and parts at most.
PART_BYTES, MOST_PARTS = 32 << 20, 1 << 17

_PACKED = "pack_id string, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_starts array<long>"


class _Rooms:
    """Open rows by their free capacity, under a tree that counts them."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _add(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, row: int, capacity: int) -> None:
        self.rows[capacity].append(row)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A row with the least capacity of at least ``need``, and that capacity."""
        k = need + self.size
        if not self.count[k]:
            # up to the first ancestor with something on its right, then down to the leftmost
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k *= 2
                if not self.count[k]:
                    k += 1
        capacity = k - self.size
        self._add(capacity, -1)
        return self.rows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, row: int) -> list[list[int]]:
    """Rows of piece numbers; lengths are 1 to ``row``. Equal lengths keep their order."""
    rooms, rows = _Rooms(row), []
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        got = rooms.take(n)
        if got is None:
            rows.append([k])
            r, left = len(rows) - 1, row - n
        else:
            r, left = got[0], got[1] - n
            rows[r].append(k)
        if left:
            rooms.put(r, left)
    return rows


def _encoded(path: str | None, pad: int):
    """(part, doc_id, digest, tokens) of texts that have tokens; ids in two bytes as long as all fit, the padding too."""

    def run(batches):
        from .bpe import vocabulary

        voc = vocabulary(path)
        kind = _kind(voc, pad)
        for batch in batches:
            keep, tokens = [], []
            for lo, hi, data, offs in text_slices(batch.column(3)):
                flat, first, _, _ = voc.encode_slice(data, offs)
                flat = flat.astype(kind)
                for d in range(hi - lo):
                    if first[d + 1] > first[d]:
                        keep.append(lo + d)
                        tokens.append(flat[first[d] : first[d + 1]].tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(tokens, pa.binary())], names=["part", "doc_id", "digest", "tokens"])

    return run


def _kind(voc, pad: int) -> np.dtype:
    return np.dtype("<u2") if max(len(voc.lens) - 1, pad) < 1 << 16 else np.dtype("<u4")


def _pack(path: str | None, row: int, buffer: int, pad: int):
    """Packs the documents of each part in the order they come, a buffer at a time."""

    def run(batches):
        from .bpe import vocabulary

        kind = _kind(vocabulary(path), pad)
        part, serial, held = None, 0, 0
        docs: list[int | None] = []
        tokens: list[np.ndarray] = []

        def flush():
            nonlocal held, serial
            lens = np.array([len(t) for t in tokens], np.int64)
            pieces = -(-lens // row)
            doc = np.repeat(np.arange(len(tokens)), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * row
            size = np.minimum(lens[doc] - start, row)
            for some in _by(best_fit_decreasing(size, row), 512):
                cols: list[list] = [[] for _ in range(7)]
                for r in some:
                    ids = np.full(row, pad, kind)
                    cu = np.concatenate([[0], np.cumsum(size[r])])
                    for k, at in zip(r, cu):
                        ids[at : at + size[k]] = tokens[doc[k]][start[k] : start[k] + size[k]]
                    new = (f"{part}-{serial}", int(cu[-1]), ids.tobytes(), cu.tolist(), cu[:-1].tolist(), [docs[doc[k]] for k in r], start[r].tolist())
                    serial += 1
                    for c, v in zip(cols, new):
                        c.append(v)
                kinds = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in _PACKED.split(", ")])
            docs.clear()
            tokens.clear()
            held = 0

        for batch in batches:
            for p, doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if p != part:
                    if tokens:
                        yield from flush()
                    part, serial = p, 0
                docs.append(doc_id)
                # a copy, so that the batch goes when it was read
                tokens.append(np.frombuffer(one.as_buffer(), kind).copy())
                held += len(tokens[-1])
                if held >= buffer:
                    yield from flush()
        if tokens:
            yield from flush()

    return run


def _by(xs: list, n: int):
    for k in range(0, len(xs), n):
        yield xs[k : k + n]


def packed_rows(docs: DataFrame, row: int = ROW_TOKENS, buffer: int = BUFFER_TOKENS, pad: int = PAD, path: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """Packed rows of the byte-level BPE ids of every text.

    ``ids`` are ``row`` little-endian ids of 16 bits (32 where the vocabulary or the padding
    needs them); after ``n_tokens`` of them come ``pad``. Segment k of a row lies between
    cu_seqlens[k] and cu_seqlens[k+1] and holds the ids of doc_ids[k] from doc_starts[k] on;
    positions start anew at position_resets.

    Documents are dealt into parts of about ``part_bytes`` of text by a hash of id and text and
    packed in order of id within them, a buffer of ``buffer`` tokens at a time: equal tables
    give equal rows, however they are laid out. A part streams through its task, so its size
    bounds no memory. Null and empty texts have no tokens and no segment; an empty table gives
    an empty table; rows with a null doc_id are packed under null. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), F.col("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # parts follow from ids and texts alone, so ids that many rows share are spread as well
    parts = int(min(max(-(-size // part_bytes), 1), MOST_PARTS))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)).cast("int").alias("part"), "doc_id", "digest", "text")
    ids = arrow_map(rows, _encoded(path, pad), "part int, doc_id long, digest long, tokens binary")
    dealt = ids.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "digest").select("part", "doc_id", "tokens")
    return arrow_map(dealt, _pack(path, row, buffer, pad), _PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the matrix and its lengths as Parquet, which commits whole tasks only."""
    packed.write.mode("errorifexists").parquet(path)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in rows of 2048 ids. Odd rows as in :func:`packed_rows`."""
    return packed_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
