"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every shingle of a text is hashed once; the hash's high bits choose one of
``BINS`` bins and its low bits compete for the bin's minimum. An empty bin is
filled by optimal densification: it walks its own fixed pseudo-random sequence
of bins (the same for all documents) to the first bin that is not empty and
takes that bin's value, re-hashed by nothing but the value itself. Of each bin
``BITS`` low-order bits are stored, packed, as lower-case hex. The likeness of
two fingerprints is the share P of equal bins, corrected for the chance
C = 2**-BITS that unequal bins agree: (P - C) / (1 - C), kept within 0 and 1.

A text without words has the empty fingerprint "", equal (1.0) to another empty
one and unlike (0.0) any other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .vector import mix, shingle_hashes, text_slices, word_hashes
from .workspace import arrow_map

BINS = 512
BITS = 4
WORDS = 5
#: Ranges of ids that the driver knows the ends of.
MOST_RANGES = 4096
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _walk(bins: int, start: int, steps: int) -> np.ndarray:
    """Steps start..start+steps of every bin's sequence of bins, as a (bins, steps) array."""
    i = np.arange(bins, dtype=np.uint64)[:, None]
    a = np.arange(start, start + steps, dtype=np.uint64)[None, :]
    return (mix(mix(i + np.uint64(0x51ED2701)) + a * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bins)).astype(np.int64)


def _densify(table: np.ndarray) -> None:
    """Fills the empty bins of every row that has a filled one, in place.

    The steps of all bins are taken 32 at a time, so a row of one shingle, which needs
    about ``bins`` steps a bin, takes as many rounds as a table of many such rows.
    """
    bins = table.shape[1]
    empty = table == _NONE
    rows, cols = np.nonzero(empty & ~empty.all(axis=1, keepdims=True))
    source = table.copy()
    start = 0
    while len(rows):
        walk = _walk(bins, start, 32)
        later_r, later_c = [], []
        for lo in range(0, len(rows), 1 << 15):
            r, c = rows[lo : lo + (1 << 15)], cols[lo : lo + (1 << 15)]
            to = walk[c]
            full = ~empty[r[:, None], to]
            hit = full.any(axis=1)
            at = full.argmax(axis=1)
            table[r[hit], c[hit]] = source[r[hit], to[hit, at[hit]]]
            later_r.append(r[~hit])
            later_c.append(c[~hit])
        rows, cols = np.concatenate(later_r), np.concatenate(later_c)
        start += 32


def codes(column: pa.Array, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The low-order bits of all bins (texts x bins, uint8), and which texts are empty."""
    shift = np.uint64(64 - int(bins).bit_length() + 1)
    out = np.zeros((len(column), bins), np.uint8)
    none = np.zeros(len(column), bool)
    for lo, hi, data, offs in text_slices(column):
        hashes, first = word_hashes(data, offs)
        sh, at = shingle_hashes(hashes, first, words)
        table = np.full((hi - lo) * bins, _NONE, np.uint64)
        if len(sh):
            doc = np.repeat(np.arange(hi - lo), np.diff(at))
            place = doc * bins + (sh >> shift).astype(np.int64)
            np.minimum.at(table, place, mix(sh) & np.uint64(0x7FFFFFFFFFFFFFFF))
        table = table.reshape(hi - lo, bins)
        none[lo:hi] = (table == _NONE).all(axis=1)
        _densify(table)
        out[lo:hi] = (table & np.uint64((1 << bits) - 1)).astype(np.uint8)
    out[none] = 0
    return out, none


def pack(code: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Rows of packed bytes, the first bin in the highest bits."""
    spread = (code[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(spread.reshape(len(code), -1), axis=1)


def likeness(a: np.ndarray, b: np.ndarray, none_a: np.ndarray, none_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Bias-corrected estimates of the Jaccard similarity, row by row."""
    chance = 2.0**-bits
    p = (a == b).mean(axis=1) if len(a) else np.zeros(0)
    j = np.clip((p - chance) / (1 - chance), 0.0, 1.0)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), j)


def _hex(code: np.ndarray, none: np.ndarray) -> list[str]:
    return ["" if e else row.tobytes().hex() for row, e in zip(pack(code), none)]


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", words: int = WORDS) -> DataFrame:
    """``docs`` with a fingerprint of each text; a null text is an empty one.

    Equal texts have equal fingerprints. All columns are kept (one named
    ``out_col`` is replaced).
    """

    @F.pandas_udf("string")
    def of(texts):
        code, none = codes(pa.array(texts, pa.string()), words)
        return pd.Series(_hex(code, none))

    return docs.withColumn(out_col, of(F.col(text_col)))


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(ids, texts, following):
    """Rows of ``texts``; ``following`` are the texts after each of them."""
    n = [len(t) for t in texts]
    edited = [t[: k - k // 3] + f[: k // 3] for t, f, k in zip(texts, following, n)]
    whole = [*texts, following[-1]]
    code, none = codes(pa.array(whole, pa.string()))
    ecode, enone = codes(pa.array(edited, pa.string()))
    own, own_none = code[:-1], none[:-1]
    # each text's next one is the row after it, except where the caller spliced another in
    near_next = likeness(own, code[1:], own_none, none[1:])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(_hex(own, own_none)),
            pa.array(_hex(ecode, enone)),
            pa.array(likeness(own, ecode, own_none, enone)),
            pa.array(near_next),
        ],
        names=[x.split()[0] for x in _EDITED.split(", ")],
    )


def _edited_rows(batches):
    """Walks buckets of rows in order; the last row of a bucket only follows.

    At most a slice of texts and one text more are held.
    """
    bucket, ids, texts, held = None, [], [], 0
    for batch in batches:
        b, i, t = batch.column(0).to_pylist(), batch.column(1).to_pylist(), pc.fill_null(batch.column(2), "").to_pylist()
        for bk, doc, text in zip(b, i, t):
            if bk != bucket:
                if len(texts) > 1:
                    yield _emit(ids[:-1], texts[:-1], texts[1:])
                bucket, ids, texts, held = bk, [], [], 0
            ids.append(doc)
            texts.append(text)
            held += len(text)
            if held > 1 << 20 and len(texts) > 1:
                yield _emit(ids[:-1], texts[:-1], texts[1:])
                ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield _emit(ids[:-1], texts[:-1], texts[1:])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Order: descending id, nulls last, rows of one id by descending 64-bit hash of the
    text; the first row follows the last. The last third of a text (rounded down, code
    points) is replaced by as many first code points of the next one; a null text is
    empty. One row is its own next one; an empty table gives an empty table. Other
    columns are ignored.

    One shuffle of the texts: ids are cut into ranges at quantiles, and the rows of an id
    (or of none) that fills ranges on its own into stretches of the hash. Each range is a
    task and also gets a copy of the row that follows its last one. Rows alike in id and
    text share a stretch; they stream through one task.
    """
    spark = docs.sparkSession
    none = F.lit(-(1 << 63))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", none).alias("at"), "doc_id", F.xxhash64("text").alias("h"), "text")
    parts = min(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), 8), MOST_RANGES)
    total, cuts = rows.agg(F.count("*"), F.percentile_approx("at", [k / parts for k in range(1, parts)], 10000)).first()
    if not total:
        return arrow_map(rows.select("doc_id", "text").limit(0), _edited_rows_of_none, _EDITED)
    # an id with more rows than a range should have is the value of some quantile
    hot = rows.where(F.col("at").isin(sorted(set(cuts)))).groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") * parts > total).collect()
    stretches = {r["at"]: -(-r["n"] * parts // total) for r in hot}
    cuts = sorted(set(cuts), reverse=True)
    # the number of the range, counted from the largest id; an id that is cut heads its range, its stretches by descending hash
    rows = rows.withColumn("bucket", _bucket(cuts))
    if stretches:
        count = F.create_map(*[x for i, k in stretches.items() for x in (F.lit(i), F.lit(k))])[F.col("at")]
        share = (F.lit(2.0**63) - F.col("h").cast("double")) / F.lit(2.0**64) * count
        rows = rows.withColumn("sub", F.coalesce(F.floor(share).cast("int"), F.when(F.col("at").isNotNull(), F.lit(1 << 20))))
    else:
        rows = rows.withColumn("sub", F.lit(0))
    # of each range the first row
    found = rows.groupBy("bucket", "sub").agg(F.max(F.struct("at", "h")).alias("first")).collect()
    order = sorted((r["bucket"], r["sub"], r["first"]["at"], r["first"]["h"]) for r in found)
    ranges = spark.createDataFrame([(b, u, k) for k, (b, u, *_) in enumerate(order)], "bucket int, sub int, part int")
    heads = spark.createDataFrame([(i, h, (k - 1) % len(order)) for k, (*_, i, h) in enumerate(order)], "at long, h long, part int")
    tails = rows.select("at", "doc_id", "h", "text").join(F.broadcast(heads), ["at", "h"]).groupBy("part", "at", "h").agg(F.max("doc_id").alias("doc_id"), F.max("text").alias("text"))
    own = rows.join(F.broadcast(ranges), ["bucket", "sub"]).select("part", "doc_id", "at", "h", "text", F.lit(0).alias("tail"))
    both = own.union(tails.select("part", "doc_id", "at", "h", "text", F.lit(1)))
    dealt = both.repartitionById(len(order), F.col("part")).sortWithinPartitions("part", "tail", F.desc("at"), F.desc("h"), F.desc("text"))
    return arrow_map(dealt.select("part", "doc_id", "text"), _edited_rows, _EDITED)


def _edited_rows_of_none(batches):
    for _ in batches:
        pass
    return iter(())


def _bucket(cuts: list[int]):
    """The number of cuts (descending) that are not below the id, by halving."""

    def among(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("at") <= cuts[mid], among(mid + 1, hi)).otherwise(among(lo, mid))

    return among(0, len(cuts))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, each with its edited text. Odd rows as in :func:`edited_fingerprints`."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
