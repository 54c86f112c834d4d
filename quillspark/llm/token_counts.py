"""Token counts without token ids: distinct pre-tokens are counted once and joined to their uses.

Two passes over the texts. The first cuts them into pre-tokens (code-point classes
and a scanned automaton, no regex) and sends each task's distinct ones; every
distinct pre-token of the corpus is then counted once by the tokenizer's library.
The second makes (document, pre-token, uses), joins the counts and sums. No list of ids
is made anywhere.

Pre-tokens are named by 64-bit hashes. Where two of one hash have unequal counts,
both passes name them by another hash, so sums are exact.

The join: all counts are broadcast up to a counted bound. Beyond it only the pre-tokens
that the most tasks met are broadcast; what is left of a document is one sum and its
rare pre-tokens, which are joined by a shuffle in which no key is frequent.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import piece_starts
from .vector import Kept, mix, prefix_hash, ragged_index, span_hash, text_slices
from .workspace import BROADCAST_ROWS, arrow_map, bounded_broadcast, discard, materialize

#: Hashes that a task remembers as sent before it starts anew: 8 MB.
SEEN = 1 << 20
#: Hashes of unequal counts that are handled, beyond which the hash is at fault.
MOST_CLASHES = 10_000
#: A bijection of bytes, for the other hash of the same text.
_OTHER = ((np.arange(256) * 167 + 13) & 255).astype(np.uint8)


class _Library:
    """The tokenizer of a JSON file and the strings that it takes out of a text first."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        cutter, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        if cutter.get("type") != "ByteLevel" or not cutter.get("use_regex") or cutter.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: pre-tokens are those of a byte-level tokenizer without a prefix or a normalizer")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path}: added tokens are plain strings")
        names = sorted((t["content"].encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def counts(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token: alone it is cut as it was in its text."""
        out = []
        for lo in range(0, len(pieces), 4096):
            out += map(len, self.tok.encode_batch_fast(pieces[lo : lo + 4096], add_special_tokens=False))
        return out


_loaded = Kept(_Library)


def _file(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def _cut(lib: _Library, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of a slice, the text of each, and the added tokens of each text."""
    n = len(offs) - 1
    added = np.zeros(n, np.int64)
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, added
    raw = data.tobytes()
    begins, ends_at = [], []
    if lib.special and lib.special.search(raw):
        for d in range(n):
            # an added token is found within a text only
            for m in lib.special.finditer(raw[offs[d] : offs[d + 1]]):
                begins.append(offs[d] + m.start())
                ends_at.append(offs[d] + m.end())
                added[d] += 1
    first_byte = np.flatnonzero((data & 0xC0) != 0x80)
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    edge[begins] = True
    edge[ends_at] = True
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = first_byte[piece_starts(cps, edge[:-1][first_byte])]
    ends = np.append(starts[1:], len(data))
    if begins:
        inside = np.searchsorted(begins, starts, "right") > np.searchsorted(ends_at, starts, "right")
        starts, ends = starts[~inside], ends[~inside]
    return starts, ends, np.searchsorted(offs, starts, "right") - 1, added


def _names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, clashes: np.ndarray | None = None) -> np.ndarray:
    """The hash of each span, or its other hash where the first is one of ``clashes`` (sorted)."""
    drop = np.uint64(64 - bits)
    keys = (span_hash(prefix_hash(data), starts, ends) >> drop).view(np.int64)
    if clashes is not None and len(clashes):
        at = np.minimum(np.searchsorted(clashes, keys), len(clashes) - 1)
        hit = np.flatnonzero(clashes[at] == keys)
        if len(hit):
            keys[hit] = _other(data, starts[hit], ends[hit])
    return keys


def _other(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(_OTHER[data]), starts, ends)).view(np.int64)


def _distinct(path: str, bits: int):
    """Each task's distinct pre-tokens with both hashes; what is forgotten in between is sent again."""

    def run(batches):
        lib, seen = _loaded.get(path), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offs in text_slices(batch.column(0)):
                starts, ends, _, _ = _cut(lib, data, offs)
                keys = (span_hash(prefix_hash(data), starts, ends)).view(np.int64)
                some, at = np.unique(keys, return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, some), len(seen) - 1)] != some
                    some, at = some[new], at[new]
                if not len(some):
                    continue
                seen = some if len(seen) + len(some) > SEEN else np.sort(np.concatenate([seen, some]), kind="stable")
                s, e = starts[at], ends[at]
                cuts = np.concatenate([[0], np.cumsum(e - s)])
                flat = data[ragged_index(s, e - s)]
                text = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(flat)).cast(pa.string())
                key = (some.view(np.uint64) >> np.uint64(64 - bits)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_other(data, s, e)), text], names=["key", "other", "piece"])

    return run


def _counted(path: str):
    def run(batches):
        lib = _loaded.get(path)
        for b in batches:
            n = lib.counts(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int32())], names=["key", "other", "tasks", "n"])

    return run


def _uses(path: str, bits: int, clashes: np.ndarray):
    """(row, doc_id, n_bytes, key, uses): a line for each text, without a key, and one for each of its pre-tokens."""

    def run(batches):
        lib = _loaded.get(path)
        for batch in batches:
            ids, rows = batch.column(1), batch.column(2)
            for lo, hi, data, offs in text_slices(batch.column(0)):
                starts, ends, doc, added = _cut(lib, data, offs)
                keys = _names(data, starts, ends, bits, clashes)
                order = np.lexsort((keys, doc))
                keys, doc = keys[order], doc[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
                at = np.flatnonzero(new)
                uses = np.diff(np.append(at, len(keys)))
                m = hi - lo
                of = np.concatenate([np.arange(m), doc[at]]) + lo
                take = pa.array(of)
                n_bytes = np.concatenate([np.diff(offs), np.zeros(len(at), np.int64)])
                key = pa.array(np.concatenate([np.zeros(m, np.int64), keys[at]]), mask=np.arange(m + len(at)) < m)
                yield pa.RecordBatch.from_arrays([rows.take(take), ids.take(take), pa.array(n_bytes), key, pa.array(np.concatenate([added, uses]))], names=["row", "doc_id", "n_bytes", "key", "uses"])

    return run


def piece_counts(texts: DataFrame, path: str, bits: int = 64) -> tuple[DataFrame, np.ndarray]:
    """(key, n, tasks) for every distinct pre-token of the one column of ``texts``, and the hashes whose place another hash takes.

    The counts are written once; the frame reads them.
    """
    met = arrow_map(texts, _distinct(path, bits), "key long, other long, piece string")
    met = met.groupBy("key", "other", "piece").agg(F.count("*").alias("tasks"))
    table = materialize(arrow_map(met, _counted(path), "key long, other long, tasks long, n int"), "piece-counts")

    def by(name: str) -> DataFrame:
        return table.groupBy(F.col(name).alias("key")).agg(F.max("n").alias("n"), F.min("n").alias("least"), F.sum("tasks").alias("tasks"))

    clashes = [r[0] for r in by("key").where("least < n").select("key").limit(MOST_CLASHES + 1).collect()]
    if len(clashes) > MOST_CLASHES:
        raise ValueError("too many pre-tokens share a hash")
    if clashes:
        renamed = table.join(F.broadcast(table.sparkSession.createDataFrame([(c,) for c in clashes], "key long")), "key", "left_semi").drop("key").withColumnRenamed("other", "key")
        if renamed.groupBy("key").agg(F.min("n").alias("a"), F.max("n").alias("b")).where("a < b").limit(1).count():
            raise ValueError("pre-tokens share both hashes")
        kept = table.join(F.broadcast(table.sparkSession.createDataFrame([(c,) for c in clashes], "key long")), "key", "left_anti")
        whole = kept.select("key", "n", "tasks").unionByName(renamed.select("key", "n", "tasks")).groupBy("key").agg(F.max("n").alias("n"), F.sum("tasks").alias("tasks"))
    else:
        whole = by("key").drop("least")
    whole._quill_path = table._quill_path
    return whole, np.sort(np.array(clashes, np.int64))


def _head(counts: DataFrame, most: int) -> int:
    """The least power of two of tasks for which at most ``most`` pre-tokens were met by as many."""
    level = F.floor(F.log2("tasks")).cast("int")
    at, total = 1 << 62, 0
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        at = 1 << r["level"]
    return at


def count_tokens(docs: DataFrame, text_col: str = "text", path: str | None = None, limit: int = 512, broadcast_rows: int = BROADCAST_ROWS, bits: int = 64) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row, ``over_limit`` where it has more than ``limit`` tokens.

    As the library counts by the JSON file at ``path`` (None: byte_bpe_50k), strings of added
    tokens inside a text included, without begin, end, truncation or padding. A null or empty
    text has no bytes and no tokens; rows stay as they are, repeated or without an id; an empty
    table gives an empty table. Other columns are ignored. ``bits`` of the hashes: for tests.
    """
    path = _file(path)
    text = F.col(text_col)
    counts, clashes = piece_counts(docs.select(text.alias("text")), path, bits)
    # rows are told apart by number: ids can repeat
    src = docs.select(text.alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    uses = arrow_map(src, _uses(path, bits, clashes), "row long, doc_id long, n_bytes long, key long, uses long")
    rows = counts.count()
    if rows <= broadcast_rows:
        known = uses.join(bounded_broadcast(counts.select("key", "n"), rows, broadcast_rows), "key", "left")
        sums = known.withColumn("tokens", F.col("uses") * F.coalesce("n", F.lit(1)))
    else:
        least = _head(counts, broadcast_rows)
        met = uses.join(F.broadcast(counts.where(F.col("tasks") >= least).select("key", "n")), "key", "left")
        rare = F.col("key").isNotNull() & F.col("n").isNull()
        part = met.groupBy("row", "doc_id", F.when(rare, F.col("key")).alias("key")).agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.when(rare, F.col("uses")).otherwise(F.col("uses") * F.coalesce("n", F.lit(1)))).alias("uses"))
        # sums have no key left: they are spread by their rows
        part = part.withColumn("open", F.col("key").isNotNull()).withColumn("key", F.coalesce("key", "row"))
        tail = counts.where(F.col("tasks") < least).select("key", "n", F.lit(True).alias("open"))
        sums = part.join(tail, ["open", "key"], "left").withColumn("tokens", F.col("uses") * F.coalesce("n", F.lit(1)))
    out = sums.groupBy("row", "doc_id").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by byte_bpe_50k.json. Odd rows as in :func:`count_tokens`."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
