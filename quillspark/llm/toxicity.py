"""Toxicity by multiple-instance learning: a text is toxic if at least one of its sentences is.

Sentences end at . ! ? or a line's end. A sentence's score is a logistic function
of its words and of their beginnings (3, 4 and 5 bytes), hashed; a text's is the
noisy-or 1 - prod(1 - sentence). Only labels of whole texts train it: features that
occur in clearly more toxic texts than others are selected by counts made where the texts
are, then their weights and the bias are fitted to the likelihood of the texts' labels. Of
a training text only the sentences that hold a selected feature reach the driver, each
once with its number, so a long text sends no more than what it has of them. The same sentence scores
locate the sentences that offend. Labels, language, source and ids are no inputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import sigmoid
from .vector import lowered, prefix_hash, span_hash, text_slices, word_bounds
from .workspace import arrow_map, discard, materialize

#: Labelled rows that the model is fitted on at most: those with the least hashes of their ids.
TRAIN_ROWS = 10_000
BUCKETS = 1 << 20
FEATURES = 4096
OFFENDS = 0.3
_BEGINNINGS = (3, 4, 5)

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, bool)
_STOP[[10, 13, 33, 46, 63]] = True


def _features(data: np.ndarray, offs: np.ndarray):
    """Hashed features of all words (words x kinds, -1 where a word is no longer than its beginning), the
    sentence of each word counted through the slice, and the first sentence of each text (one more at the end)."""
    starts, ends, first = word_bounds(data, offs, _APART)
    # sentences are numbered by the stops before them; a text's start begins one as well
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    doc_of = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    base = stops[offs] + np.arange(len(offs))
    sentence = stops[starts] + doc_of
    acc = prefix_hash(lowered(data))
    cols = [span_hash(acc, starts, ends)]
    size = ends - starts
    for k in _BEGINNINGS:
        cols.append(span_hash(acc, starts, np.minimum(starts + k, ends)) ^ np.uint64(k))
    out = np.stack([(c % np.uint64(BUCKETS)).astype(np.int32) for c in cols], axis=1)
    for j, k in enumerate(_BEGINNINGS):
        out[size <= k, j + 1] = -1
    return out, sentence, base, starts, ends


class ToxicityModel:
    def __init__(self, bias: float, places: np.ndarray, weights: np.ndarray):
        self.bias = float(bias)
        self.places, self.weights = places, weights
        self._table: np.ndarray | None = None

    def __getstate__(self):
        return (self.bias, self.places, self.weights)

    def __setstate__(self, state):
        self.bias, self.places, self.weights = state
        self._table = None

    def sentences(self, data: np.ndarray, offs: np.ndarray):
        """Scores of a slice's sentences, the first sentence of each text, and which sentences have words."""
        if self._table is None:
            self._table = np.zeros(BUCKETS + 1, np.float32)
            self._table[self.places] = self.weights
        feats, sentence, base, starts, ends = _features(data, offs)
        per_word = self._table[feats].sum(axis=1, dtype=np.float64)
        n = int(base[-1])
        z = np.bincount(sentence, per_word, n)
        has = np.bincount(sentence, minlength=n) > 0
        return np.where(has, sigmoid(z + self.bias), 0.0), base, has

    def documents(self, p: np.ndarray, base: np.ndarray) -> np.ndarray:
        # summed text by text: a score does not depend on the texts around
        owner = np.repeat(np.arange(len(base) - 1), np.diff(base))
        return 1 - np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), len(base) - 1))


def _texts_with(batches):
    """(features, labels, counts of texts) of a task's training texts, packed."""
    df = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        label = batch.column(2).to_numpy().astype(np.int64)
        for lo, hi, data, offs in text_slices(batch.column(1)):
            f, s, base, _, _ = _features(data, offs)
            at = np.searchsorted(s, base)
            for d in range(hi - lo):
                own = np.unique(f[at[d] : at[d + 1]])
                df[label[lo + d], own[own >= 0]] += 1
    place = np.flatnonzero(df.any(axis=0))
    for lo in range(0, len(place), 1 << 16):
        part = place[lo : lo + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(df[1, part], pa.int64()), pa.array(df[0, part], pa.int64())], names=["place", "toxic", "other"])


def _bags(places):
    """(doc_id, label, kinds of sentences with selected features, how often each, number of other sentences)."""

    def run(batches):
        index = np.full(BUCKETS, -1, np.int32)
        index[places.value] = np.arange(len(places.value))
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for lo, hi, data, offs in text_slices(batch.column(1)):
                f, s, base, _, _ = _features(data, offs)
                at = np.searchsorted(s, base)
                for d in range(hi - lo):
                    k = np.where(f[at[d] : at[d + 1]] >= 0, index[f[at[d] : at[d + 1]]], -1)
                    own = s[at[d] : at[d + 1]]
                    row, col = np.nonzero(k >= 0)
                    # a feature counts once a sentence
                    pairs = np.unique(own[row].astype(np.int64) << 32 | k[row, col])
                    cut = np.flatnonzero(np.diff(pairs >> 32, prepend=-1))
                    kinds: dict[tuple, int] = {}
                    for one in np.split(pairs & 0xFFFFFFFF, cut[1:]) if len(pairs) else ():
                        kinds[tuple(one.tolist())] = kinds.get(tuple(one.tolist()), 0) + 1
                    kept = sorted(kinds)
                    cols[0].append([x for one in kept for x in one])
                    cols[1].append([len(one) for one in kept])
                    cols[2].append([kinds[one] for one in kept])
                    cols[3].append(len(np.unique(own)) - len(cut))
            lists = [pa.array(c, pa.list_(pa.int32())) for c in cols[:3]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists, pa.array(cols[3], pa.int64())], names=["doc_id", "label", "feats", "sizes", "times", "plain"])

    return run


def select_features(place: np.ndarray, toxic: np.ndarray, other: np.ndarray, pos: float, neg: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features that occur in clearly more toxic texts, at most ``FEATURES``, and their starting weights."""
    p1, p0 = (toxic + 0.5) / (pos + 1), (other + 0.5) / (neg + 1)
    mid = (toxic + other + 1) / (pos + neg + 2)
    z = (p1 - p0) / np.sqrt(mid * (1 - mid) * (1 / (pos + 1) + 1 / (neg + 1)))
    z[(toxic < 2) | (p1 < 3 * p0)] = 0
    order = np.lexsort([place, -z])[:FEATURES]
    order = order[z[order] > 3.0]
    order = order[np.argsort(place[order])]
    return place[order], np.clip(np.log(p1[order] / p0[order]), 0, 5) * 0.5


def fit_noisy_or(y: np.ndarray, feats: list, sizes: list, times: list, plain: np.ndarray, places: np.ndarray, w: np.ndarray, steps: int = 400) -> ToxicityModel:
    """Fits the weights of selected features, from ``w`` on, to the labels of bags (see :func:`_bags`)."""
    count = np.array([len(x) for x in sizes], np.int64)
    flat = lambda xs: np.concatenate([np.asarray(x, np.int64) for x in xs]) if xs else np.zeros(0, np.int64)
    f_at, size, n = flat(feats), flat(sizes), flat(times).astype(float)
    s_at, d_of, n_sent = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(y)), count), len(size)
    b = -6.0
    m, v = np.zeros(len(places) + 1), np.zeros(len(places) + 1)
    for t in range(1, steps + 1):
        zs = b + np.bincount(s_at, w[f_at], n_sent)
        a = np.bincount(d_of, n * np.logaddexp(0, zs), len(y)) + plain * np.logaddexp(0, b)
        da = np.where(y > 0, -np.exp(-a) / np.maximum(-np.expm1(-a), 1e-9), 1.0) / len(y)
        gz = da[d_of] * n * sigmoid(zs)
        gw = np.bincount(f_at, gz[s_at], len(places)) + 2e-5 * w
        gb = gz.sum() + (da * plain).sum() * sigmoid(np.array(b))
        g = np.append(gw, gb)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], float(b - step[-1])
    return ToxicityModel(b, places, w)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """Fits on labelled rows (doc_id, toxic) that are not held out, at most ``train_rows``.

    Rows without a label or an id do not count; an id with several labels counts by
    its largest, one with several texts with the least. Equal tables give equal models.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("label"))
    known = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    sample = materialize(own.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label"), "toxicity-sample")
    rows, pos = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not pos or pos == rows:
        discard(sample)
        p = (pos + 1) / (rows + 2) if rows else 0.5
        return ToxicityModel(np.log(p / (1 - p)), np.zeros(0, np.int64), np.zeros(0))
    counts = arrow_map(sample, _texts_with, "place long, toxic long, other long").groupBy("place").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    found = counts.where("toxic > 1").toArrow()
    places, w = select_features(*(found.column(c).to_numpy() for c in ("place", "toxic", "other")), pos, rows - pos)
    shared = docs.sparkSession.sparkContext.broadcast(places)
    bags = arrow_map(sample, _bags(shared), "doc_id long, label double, feats array<int>, sizes array<int>, times array<int>, plain long").toArrow().sort_by("doc_id")
    shared.destroy()
    discard(sample)
    return fit_noisy_or(bags.column("label").to_numpy(), *(bags.column(c).to_pylist() for c in ("feats", "sizes", "times")), bags.column("plain").to_numpy().astype(float), places, w)


def _score(model, threshold: float):
    def run(batches):
        m = model.value
        for batch in batches:
            score, where, worst = [], [], []
            for lo, hi, data, offs in text_slices(batch.column(0)):
                p, base, has = m.sentences(data, offs)
                score.append(m.documents(p, base))
                for d in range(hi - lo):
                    own = p[base[d] : base[d + 1]][has[base[d] : base[d + 1]]]
                    hit = np.flatnonzero(own >= threshold)
                    where.append(",".join(map(str, hit.tolist())))
                    worst.append(int(own.argmax()) if len(own) else -1)
            score = np.concatenate(score) if score else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array(worst, pa.int64()), pa.array(where, pa.string())], names=[*batch.schema.names[1:], "score", "worst_sentence", "offending_sentences"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), threshold: float = OFFENDS) -> DataFrame:
    """Columns ``keep``, score, worst_sentence and offending_sentences of each row.

    Sentences (those with a word) are numbered from 0; offending ones have a score of
    ``threshold`` or more, comma-joined. A null or empty text has score 0, worst -1, none.
    Kept columns named as the new ones give way; others are ignored.
    """
    keep = tuple(c for c in keep if c not in ("score", "worst_sentence", "offending_sentences"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("text").alias("__text"), *keep)
    schema = docs.select(*keep).schema.add("score", "double").add("worst_sentence", "long").add("offending_sentences", "string")
    return arrow_map(rows, _score(shared, threshold), schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, by ``labels``. Odd rows as in :func:`score_toxicity`; a row without an id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "worst_sentence", "offending_sentences")
