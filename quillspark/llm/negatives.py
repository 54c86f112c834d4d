"""Hard negatives: blocks of anchors against blocks of all rows, products in float64.

Anchors are written once with numbers and taken in rounds of bounded size. In a round
the anchors' matrix is broadcast; each task multiplies it with its rows, block by
block, and keeps the first few rows of each anchor. These lists merge: their union's
first few are the answer, so what tasks send does not depend on how many rows they
read. A second pass does the same for the negatives, a list for each anchor and
positive, whose window the positive's score sets.

Components are whole numbers after scaling. A product whose bound
(length * largest * largest) stays below 2^53 is exact in float64; rows beyond it are
multiplied as Python integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import arrow_map, discard, materialize, shared_path

#: Bytes of the anchors' matrix of one round, as float64.
ROUND_BYTES = 16 << 20
_ANCHORS, _ROWS = 512, 2048
_EXACT = 1 << 53
_LOW, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class _Anchors:
    """Numbers, ids, labels and scaled vectors of a round's anchors."""

    def __init__(self, table: pa.Table, scale: float):
        self.at = table.column("at").to_numpy().astype(np.int64)
        self.ids = table.column("id").to_numpy().astype(np.int64)
        self.labels = table.column("label").to_numpy().astype(np.int64)
        vec = table.column("vec").combine_chunks()
        self.q = _scaled(np.asarray(vec.values.to_numpy(zero_copy_only=False), np.float64), np.asarray(vec.offsets), scale)
        self.peak = float(np.abs(self.q).max(initial=0))


def _scaled(values: np.ndarray, offs: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each row; shorter rows end with zeros."""
    lens = np.diff(offs)
    wide = int(lens.max(initial=0))
    if len(lens) and (lens == wide).all():
        return np.floor(scale * values[offs[0] : offs[-1]]).reshape(len(lens), wide)
    out = np.zeros((len(lens), wide))
    out[np.arange(wide)[None, :] < lens[:, None]] = np.floor(scale * values[offs[0] : offs[-1]])
    return out


def _rows(batch: pa.RecordBatch, scale: float):
    """ids, labels and scaled vectors of the rows of a batch that take part."""
    ids, labels, vec = batch.columns
    offs = np.asarray(vec.offsets).astype(np.int64)
    flat = np.asarray(vec.values.to_numpy(zero_copy_only=False), np.float64)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])[offs]
    ok = np.asarray(ids.is_valid()) & np.asarray(labels.is_valid()) & np.asarray(vec.is_valid()) & (np.diff(bad) == 0)
    if not ok.all():
        lens = np.diff(offs)
        flat = flat[np.repeat(ok, lens)]
        offs = np.concatenate([[0], np.cumsum(lens[ok])])
    mask = pa.array(ok)
    return ids.filter(mask).to_numpy().astype(np.int64), labels.filter(mask).to_numpy().astype(np.int64), _scaled(flat, offs, scale)


def _products(a: np.ndarray, b: np.ndarray, peak: float) -> np.ndarray:
    """Whole inner products of all rows of ``a`` with all of ``b``; a missing component is 0."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    wide = np.abs(b).max(axis=1, initial=0) * peak * d >= _EXACT
    if not wide.any():
        return (a @ b.T).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    out[:, ~wide] = (a @ b[~wide].T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).dot(whole(b[wide]).T)
    if any(not _LOW < x < _NO_ID for x in exact.ravel()):
        raise ValueError("an inner product of scaled vectors does not fit into a long")
    out[:, wide] = exact.astype(np.int64)
    return out


class _First:
    """The first k (score, id) of each slot: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.score = np.full((slots, k), _LOW, np.int64)
        self.id = np.full((slots, k), _NO_ID, np.int64)

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        last, last_id = self.score[slot, k - 1], self.id[slot, k - 1]
        better = (score > last) | ((score == last) & (ids < last_id))
        slot, score, ids = slot[better], score[better], ids[better]
        if not len(slot):
            return
        some = np.unique(slot)
        slot = np.concatenate([np.repeat(some, k), slot])
        score = np.concatenate([self.score[some].ravel(), score])
        ids = np.concatenate([self.id[some].ravel(), ids])
        order = np.lexsort((ids, ~score, slot))  # ~x falls as x grows, without an overflow
        slot, score, ids = slot[order], score[order], ids[order]
        begin = np.searchsorted(slot, some)
        take = begin[:, None] + np.arange(k)
        self.score[some], self.id[some] = score[take], ids[take]

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, k = np.nonzero(self.id != _NO_ID)
        return slot, self.score[slot, k], self.id[slot, k]


def _blocks(anchors: _Anchors, batches, scale: float):
    """(slice of anchors, products, ids and labels of rows); blocks begin small, so that lists are full early."""
    step = 128
    for batch in batches:
        ids, labels, q = _rows(batch, scale)
        lo = 0
        while lo < len(ids):
            hi = min(len(ids), lo + step)
            for a in range(0, len(anchors.ids), _ANCHORS):
                part = slice(a, min(a + _ANCHORS, len(anchors.ids)))
                yield part, _products(anchors.q[part], q[lo:hi], anchors.peak), ids[lo:hi], labels[lo:hi]
            lo, step = hi, min(2 * step, _ROWS)


def _positives(shared, scale: float, k: int):
    def run(batches):
        anchors = shared.value[0]
        first = _First(len(anchors.ids), k)
        for part, s, ids, labels in _blocks(anchors, batches, scale):
            hit = (s >= first.score[part, -1:]) & (anchors.labels[part, None] == labels) & (anchors.ids[part, None] != ids)
            r, c = np.nonzero(hit)
            first.offer(r + part.start, s[r, c], ids[c])
        slot, score, ids = first.table()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(ids), pa.array(score)], names=["anchor", "id", "score"])

    return run


def _negatives(shared, scale: float, k: int, percent: int):
    def run(batches):
        anchors, positive = shared.value
        per = positive.shape[1]
        has = positive != _LOW
        # percent * p <= 100 * n, in whole numbers of any size
        least = np.array([-((-percent * int(p)) // 100) if h else 0 for p, h in zip(positive.ravel(), has.ravel())], np.int64).reshape(positive.shape)
        first = _First(len(anchors.ids) * per, k)
        for part, s, ids, labels in _blocks(anchors, batches, scale):
            other = anchors.labels[part, None] != labels
            for j in range(per):
                slots = np.arange(part.start, part.stop) * per + j
                low = np.maximum(least[part, j], first.score[slots, -1])
                hit = (s >= low[:, None]) & (s <= positive[part, j : j + 1]) & other & has[part, j : j + 1]
                r, c = np.nonzero(hit)
                first.offer(slots[r], s[r, c], ids[c])
        slot, score, ids = first.table()
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(ids), pa.array(score)], names=["slot", "id", "score"])

    return run


def _firsts(df: DataFrame, slot: str, k: int) -> DataFrame:
    """The first k rows of each slot; each task keeps its own first k before the shuffle."""
    w = Window.partitionBy(slot).orderBy(F.desc("score"), F.asc("id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = 256.0, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """For each anchor and each of its positives the negatives that score almost as high.

    ``anchor``: which rows are anchors. A row's score is the whole inner product of
    ``floor(scale * x)`` with the anchor's; higher first, then smaller ids. An anchor's
    positives are its first rows of the same label and another id; negatives are the first
    rows of another label with ``percent * positive_score <= 100 * score <= 100 *
    positive_score``. Returns (anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score).

    Rows with a null id, label, vector or component, or a component that is not finite,
    take no part. Vectors of unequal lengths are compared as if the shorter ended with
    zeros; an empty vector scores 0. Rows that repeat an id are rows of their own, though
    never positives of an anchor of that id; an anchor that occurs twice is answered
    twice. Without anchors or rows the result is empty. Other columns are ignored.
    """
    spark = rows.sparkSession
    src = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vec"), anchor.alias("anchor"))
    all_rows = src.select("id", "label", "vec")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    mine = src.where(F.col("anchor") & F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)
    mine = materialize(mine.select(F.monotonically_increasing_id().alias("at"), "id", "label", "vec"), "anchors")
    n, wide = mine.agg(F.count("*"), F.max(F.size("vec"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    rounds = math.ceil(n * 8 * max(1, wide) / round_bytes)
    out = shared_path(spark, "negatives")
    for r in range(rounds):
        mined = _round(all_rows, mine.where(F.pmod(F.xxhash64("at"), F.lit(rounds)) == r), positives, negatives, percent, scale)
        if rounds == 1:
            discard(mine)
            return mined
        if mined is not None:
            mined.write.mode("append").parquet(out)
    discard(mine)
    return spark.read.schema(schema).parquet(out)


def _round(rows: DataFrame, mine: DataFrame, positives: int, negatives: int, percent: int, scale: float) -> DataFrame | None:
    spark = rows.sparkSession
    table = mine.toArrow().sort_by("at")
    if not table.num_rows:
        return None
    anchors = _Anchors(table, scale)
    shared = spark.sparkContext.broadcast((anchors,))
    found = _firsts(arrow_map(rows, _positives(shared, scale, positives), "anchor long, id long, score long"), "anchor", positives).toArrow()
    shared.unpersist()
    # a round's positives are as bounded as its anchors
    at, place = found.column("anchor").to_numpy(), found.column("rank").to_numpy() - 1
    ids, scores = np.full((len(anchors.ids), positives), _NO_ID, np.int64), np.full((len(anchors.ids), positives), _LOW, np.int64)
    ids[at, place], scores[at, place] = found.column("id").to_numpy(), found.column("score").to_numpy()
    shared = spark.sparkContext.broadcast((anchors, scores))
    mined = _firsts(arrow_map(rows, _negatives(shared, scale, negatives, percent), "slot long, id long, score long"), "slot", negatives)
    names = spark.sparkContext.broadcast((anchors.ids, ids.ravel(), scores.ravel()))

    def named(batches):
        anchor_ids, positive_ids, positive_scores = names.value
        for b in batches:
            slot = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor_ids[slot // positives]), pa.array(positive_ids[slot]), b.column(3), b.column(1), pa.array(positive_scores[slot]), b.column(2)],
                names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
            )

    return arrow_map(mined.select("slot", "id", "score", "rank"), named, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``; labels of ids divisible by 7 are moved on, ids divisible by 100 are anchors. Odd rows as in :func:`hard_negatives`."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE_OP12 = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM e a, e b WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same AND id <> anchor_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5"""
