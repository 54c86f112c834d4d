"""Quality classifier: a sparse ensemble of rules over text statistics.

1. One Arrow pass gives each document some twenty statistics of its whole text.
2. Boosted trees are grown on a bounded sample of labelled rows; every path from
   a root becomes a conjunctive rule over the statistics.
3. A lasso logistic regression weighs rules and clipped linear terms; most get 0.
4. The rules that are left are compiled into one Spark column expression, so
   scoring is a projection that whole-stage code generation covers.

Labels, language, source and ids are no inputs of the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import Boosted, boost, sigmoid
from .vector import text_slices, word_hashes
from .workspace import arrow_map, materialize

#: Labelled rows that the model is fitted on at most: those with the least hashes of their ids.
TRAIN_ROWS = 20_000

STATISTICS = (
    "log_bytes",
    "log_words",
    "word_length",
    "upper",
    "digit",
    "space",
    "line",
    "stop",
    "comma",
    "bang",
    "pipe",
    "symbol",
    "brace",
    "quote",
    "high",
    "distinct",
    "repeat",
    "line_length",
    "top_word",
    "longest_word",
)


def _byte_classes() -> np.ndarray:
    """Rows: byte classes that are counted; columns: bytes."""
    groups = [range(65, 91), range(48, 58), (32, 9), (10, 13), (46, 63), (44, 59, 58), (33,), (124,), (35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 92, 94, 95, 126), (40, 41, 91, 93, 123, 125), (34, 39), range(128, 256)]
    out = np.zeros((len(groups), 256), np.float64)
    for k, g in enumerate(groups):
        out[k, list(g)] = 1
    return out


_CLASSES = _byte_classes()


def _statistics(column: pa.Array) -> np.ndarray:
    out = np.zeros((len(column), len(STATISTICS)))
    for lo, hi, data, offs in text_slices(column):
        words, first = word_hashes(data, offs)
        for d in range(hi - lo):
            row = out[lo + d]
            text = data[offs[d] : offs[d + 1]]
            if not len(text):
                continue
            count = np.bincount(text, minlength=256)
            share = _CLASSES @ count / len(text)
            own = words[first[d] : first[d + 1]]
            n = len(own)
            row[0], row[1] = np.log1p(len(text)), np.log1p(n)
            row[2] = (len(text) - count[32] - count[9:14].sum()) / max(n, 1)
            row[3:15] = share
            if n:
                ordered = np.sort(own)
                edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
                row[15] = (len(edge) - 1) / n
                row[18] = np.diff(edge).max() / n
                row[16] = (own[1:] == own[:-1]).mean() if n > 1 else 0.0
            row[17] = np.log1p(len(text) / (count[10] + 1))
            solid = np.flatnonzero((text == 32) | (text == 10))
            row[19] = np.log1p(np.diff(np.concatenate([[-1], solid, [len(text)]])).max() - 1)
    return out


def _free_prefix(cols: list[str]) -> str:
    """A prefix for the statistics' columns that no other column begins with."""
    prefix = "s_"
    while any(c.lower().startswith(prefix) for c in cols):
        prefix = "_" + prefix
    return prefix


def _stat_rows(batches):
    """The other columns, then the statistics of the first one; their names come from the plan."""
    for batch in batches:
        x = _statistics(batch.column(0))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=[str(k) for k in range(batch.num_columns - 1 + x.shape[1])])


def statistics(docs: DataFrame, text_col: str = "text", prefix: str = "s_", keep_text: bool = False) -> DataFrame:
    """``docs`` with a column <prefix><name> for each statistic, and without its text unless ``keep_text``.

    A null or empty text has zeros. Other columns must not begin with the prefix.
    """
    keep = [c for c in docs.columns if keep_text or c != text_col]
    kept = docs.select(F.col(f"`{text_col}`"), *(F.col(f"`{c}`") for c in keep)).toDF("text", *(f"k{k}" for k in range(len(keep))))
    schema = kept.select(*kept.columns[1:]).schema
    for k in range(len(STATISTICS)):
        schema = schema.add(f"x{k}", "double")
    names = [f.name for f in schema]
    return arrow_map(kept, lambda batches: (pa.RecordBatch.from_arrays(b.columns, names=names) for b in _stat_rows(batches)), schema).toDF(*keep, *(prefix + n for n in STATISTICS))


class RuleEnsemble:
    """Weighted conjunctions and clipped linear terms.

    ``rules``: lists of (statistic, above, threshold); ``linear``: (statistic, low,
    high, mean, scale).
    """

    def __init__(self, bias, rules, rule_weights, linear, linear_weights):
        self.bias, self.rules, self.rule_weights = bias, rules, rule_weights
        self.linear, self.linear_weights = linear, linear_weights

    def column(self, prefix: str = "s_") -> Column:
        """The score as one column expression over the <prefix><name> columns."""
        z = F.lit(float(self.bias))
        for conj, w in zip(self.rules, self.rule_weights):
            c = F.lit(True)
            for f, above, t in conj:
                v = F.col(prefix + STATISTICS[f])
                c = c & ((v > float(t)) if above else (v <= float(t)))
            z = z + F.when(c, F.lit(float(w))).otherwise(F.lit(0.0))
        for (f, lo, hi, mean, scale), w in zip(self.linear, self.linear_weights):
            v = F.greatest(F.least(F.col(prefix + STATISTICS[f]), F.lit(float(hi))), F.lit(float(lo)))
            z = z + (v - float(mean)) / float(scale) * float(w)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))


def _paths(model: Boosted) -> list[tuple]:
    """Every node but the roots as a conjunction; bounds of one statistic are joined."""
    seen, out = set(), []
    for t in model.trees:
        stack = [(0, {})]
        while stack:
            node, conj = stack.pop()
            if conj:
                key = tuple(sorted((f, a, v) for (f, a), v in conj.items()))
                if key not in seen:
                    seen.add(key)
                    out.append(key)
            f = t.feature[node]
            if f >= 0:
                v = float(t.threshold[node])
                left, right = dict(conj), dict(conj)
                left[f, False] = min(v, conj.get((f, False), v))
                right[f, True] = max(v, conj.get((f, True), v))
                stack += [(2 * node + 2, right), (2 * node + 1, left)]
    return out


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an absolute-value penalty, by accelerated proximal steps."""
    n, d = z.shape
    v = np.ones(d) / np.sqrt(max(d, 1))
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    lip = 0.25 * np.linalg.norm(z @ v) ** 2 / n + 0.25
    w, b = np.zeros(d), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    pw, pb, t = w, b, 1.0
    for _ in range(steps):
        r = sigmoid(z @ pw + pb) - y
        nw = pw - z.T @ r / n / lip
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / lip, 0)
        nb = pb - r.mean() / lip
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> RuleEnsemble:
    """Trees, rules and lasso weights; one class alone gives a constant score."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return RuleEnsemble(float(np.log(p / (1 - p))), [], [], [], [])
    rules = _paths(boost(x, y, rounds=30, depth=3, rate=0.3, least=2.0))
    hits = np.stack([np.all([(x[:, f] > t) if a else (x[:, f] <= t) for f, a, t in conj], axis=0) for conj in rules], axis=1).astype(float) if rules else np.zeros((len(x), 0))
    support = hits.mean(axis=0)
    some = (support > 0.002) & (support < 0.998)
    rules, hits, support = [r for r, k in zip(rules, some) if k], hits[:, some], support[some]
    low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
    clipped = np.clip(x, low, high)
    mean, sd = clipped.mean(axis=0), clipped.std(axis=0)
    use = np.flatnonzero(sd > 1e-9)
    lin = (clipped[:, use] - mean[use]) / (sd[use] / 0.4)
    z = np.concatenate([hits - support, lin], axis=1)
    w, b = _lasso(z, y, penalty)
    k = len(rules)
    wr, wl = w[:k], w[k:]
    bias = b - float(support @ wr)
    keep_r, keep_l = np.flatnonzero(wr), np.flatnonzero(wl)
    linear = [(int(use[j]), low[use[j]], high[use[j]], mean[use[j]], sd[use[j]] / 0.4) for j in keep_l]
    return RuleEnsemble(bias, [rules[j] for j in keep_r], wr[keep_r], linear, wl[keep_l])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _known(labels: DataFrame, train_rows: int) -> DataFrame:
    """(doc_id, label) of at most ``train_rows`` ids that are not held out, those with the least hashes."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("label"))
    return known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)


def fit_quality(stats: DataFrame, known: DataFrame) -> RuleEnsemble:
    """Fits on the rows of ``stats`` (doc_id and statistics) with a label in ``known`` (doc_id, label).

    Of rows with one id the least by their statistics counts, so equal tables give equal
    models. Rows without a label or an id do not count; an id with several labels counts
    by its largest.
    """
    own = stats.join(F.broadcast(known), "doc_id")
    least = own.groupBy("doc_id", "label").agg(F.min(F.struct(*(f"s_{n}" for n in STATISTICS))).alias("x"))
    sample = least.orderBy("doc_id").select("label", "x.*").toPandas()
    return fit_rules(sample.iloc[:, 1:].to_numpy(float), sample["label"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Columns ``keep`` and score (0 to 1, higher: label 1 likelier) of each row.

    Null and empty texts are scored by their statistics, all 0; equal texts have equal
    scores. Without labels every score is 0.5. Columns not kept are ignored, a kept one
    named score gives way.
    """
    keep = tuple(c for c in keep if c != "score")
    stats = materialize(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*keep).alias("row"))), "quality-statistics")
    model = fit_quality(stats, _known(labels, train_rows))
    return stats.select("row.*", model.column().alias("score"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, by ``labels``. Odd rows as in :func:`score_quality`; a row without an id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose score is 0.5 or more stay.

    The statistics and the decision are one projection over each row, so rows with
    null or repeated ids are judged by their own texts; nothing is joined or shuffled
    but the training sample. Columns of any name are kept as they are.
    """
    known = _known(spark.read.parquet(f"{sf_dir}/labels.parquet"), TRAIN_ROWS)
    # the sample's statistics are computed for the sampled rows only
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    model = fit_quality(statistics(sample), known)
    prefix = _free_prefix(docs.columns)
    stats = statistics(docs, prefix=prefix, keep_text=True)
    return stats.where(model.column(prefix) >= 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))
