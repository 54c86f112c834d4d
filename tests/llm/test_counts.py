"""Token counts, hard negatives and the filter audit against plain counterparts."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import audit, negatives, token_counts

from .helpers import WORD, empty, frame, odd_rows

TOKENS = ["<|endoftext|>", "it's", "  two\n\n", "naïve", "漢字", "😀", "'re", " ", "12345", "…", " ", "\t\t", "abcabcabc", "<|endof", "text|>", "Ǆ", "١٢", "́", "$$$", "\x00"]


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def token_rows():
    rng = random.Random(5)
    rows = odd_rows()
    for k in range(300):
        rows.append((1000 + k, "".join(rng.choice(TOKENS) for _ in range(rng.randint(1, 40))), "en", "a", 1))
    # an added token split over two texts, and two next to each other
    rows += [(2000, "x<|endof", "en", "a", 1), (2001, "text|>y", "en", "a", 1), (2002, "<|endoftext|>" * 3, "en", "a", 1), (2003, "a" * 50_000, "en", "a", 1)]
    rows += [(2003, "twice", "en", "a", 1), (2003, "twice", "en", "a", 1), (None, "no id", "en", "a", 1), (None, None, "en", "a", 1)]
    return rows


@pytest.mark.parametrize("broadcast_rows, bits", [(300_000, 64), (50, 64), (300_000, 18), (50, 18)])
def test_token_counts_equal_the_library(spark, broadcast_rows, bits):
    rows, tok = token_rows(), library()
    df = frame(spark, rows).withColumn("row", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    got = sorted(map(str, (tuple(r) for r in token_counts.count_tokens(df, broadcast_rows=broadcast_rows, bits=bits).collect())))
    expected = []
    for i, text, *_ in rows:
        n = len(tok.encode(text or "", add_special_tokens=False))
        expected.append(str((i, len((text or "").encode()), n, n > 512)))
    assert got == sorted(expected)


def test_short_hashes_clash(spark):
    docs = frame(spark, token_rows()).select("text")
    counts, clashes = token_counts.piece_counts(docs, token_counts._file(None), 18)
    assert len(clashes) and not counts.where(F.col("key").isin(*map(int, clashes))).count()
    assert counts.count() == counts.select("key").distinct().count()


def test_no_texts_no_counts(spark):
    assert token_counts.count_tokens(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in token_counts.count_tokens(one).collect()] == [(1, 0, 0, False)]


# ---------------------------------------------------------------- hard negatives
def mined(rows, anchors, percent=80, k=5):
    """Plain counterpart, a list of tuples."""
    use = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, y, v in use:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in use)
        for s, j, _ in [x for x in scored if x[2] == y and x[1] != i][:k]:
            low = [x for x in scored if x[2] != y and percent * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(low)]
    return sorted(map(str, out))


def vectors(seed, n, d=6):
    rng = random.Random(seed)
    base = [[rng.gauss(0.2, 1) for _ in range(d)] for _ in range(4)]
    rows = []
    for i in range(n):
        # ties: many rows share a vector, and labels are few
        v = rng.choice(base) if i % 3 == 0 else [rng.gauss(0.3, 1) for _ in range(d)]
        rows.append((i, rng.randrange(3), list(v)))
    nan, inf = float("nan"), float("inf")
    rows += [(n, None, base[0]), (n + 1, 1, None), (n + 2, 1, [1.0, None]), (n + 3, 1, [nan] * d), (n + 4, 1, [inf] * d), (None, 1, base[0])]
    rows += [(n + 5, 1, []), (n + 6, 0, base[0][:3]), (n + 7, 2, base[0] + [9.0]), (n + 20, 1, base[1]), (n + 20, 1, base[1]), (n + 20, 2, base[2])]
    return rows


@pytest.mark.parametrize("round_bytes", [1 << 24, 200])
def test_hard_negatives_match_plain_loops(spark, round_bytes):
    rows = vectors(3, 260)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("anchor", F.lit("clash")).withColumn("score", F.lit(1)).repartition(5)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, round_bytes=round_bytes)
    assert sorted(str(tuple(r)) for r in got.collect()) == mined(rows, lambda i: i % 10 == 0)


def test_products_beyond_float64_are_exact(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [float(rng.randint(1 << 24, 1 << 26)) + 0.5, float(rng.randint(1, 9))]) for i in range(40)]
    rows += [(102, 0, [2.0**36, -3.0]), (101, 1, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 4 == 0, scale=1.0)
    # with a scale of 1 the counterpart's factor is taken out beforehand
    scaled = [(i, y, [x / 256 for x in v]) for i, y, v in rows]
    assert sorted(str(tuple(r)) for r in got.collect()) == mined(scaled, lambda i: i % 4 == 0)
    with pytest.raises(Exception, match="does not fit into a long"):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e12]), (4, 1, [1e12])], df.schema), F.col("vec_id") == 0).collect()


def test_no_anchors_no_negatives(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<float>")
    for rows in (df, df.limit(0)):
        got = negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
        assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    alone = negatives.hard_negatives(df, F.lit(True))
    assert alone.count() == 0


def test_lists_merge_in_any_order():
    rng = np.random.default_rng(0)
    slot, score, ids = rng.integers(0, 4, 500), rng.integers(-5, 5, 500), rng.permutation(500)
    for step in (1, 7, 500):
        first = negatives._First(4, 5)
        for lo in range(0, 500, step):
            first.offer(slot[lo : lo + step], score[lo : lo + step], ids[lo : lo + step])
        got = sorted(zip(*(x.tolist() for x in first.table())))
        expected = [(s, *x) for s in range(4) for x in sorted(((-int(v), int(i)) for z, v, i in zip(slot, score, ids) if z == s))[:5]]
        assert got == sorted((s, -v, i) for s, v, i in expected)


# ---------------------------------------------------------------- filter audit
def audited(rows, labels):
    """Plain counterpart: every order is walked over every document."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    texts = [(i, text or "", source or "") for i, text, _, source, *_ in rows]
    least = {}
    for i, text, _ in texts:
        if i is not None:
            least[text] = min(i, least.get(text, i))
    docs = []
    for i, text, part in texts:
        w = WORD.findall(text)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text), "E": i is not None and i > least[text]}
        docs.append((part, fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        share = dict.fromkeys("ABCDE", 0)
        own = [d for d in docs if d[0] == part]
        lines = []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                share[f] += len(gone)
                lines.append((order, step, len(left), len(gone), sum(d[1][f] for d in own) - len(gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        for order, step, *x, f in lines:
            out[part, order, step] = (*x, share[f])
    return out


def test_filter_audit_matches_walks(spark):
    rng = random.Random(2)
    rows = odd_rows()
    for k in range(120):
        w = [rng.choice(["alpha", "Beta", "GAMMA", "delta#", "100%", "x"]) for _ in range(rng.choice([3, 150, 199, 200, 201, 260]))]
        w += [f"u{j}" for j in range(rng.choice([0, 100, 200, 210]))]
        rows.append((300 + k, " ".join(w), "en", rng.choice(["a", "", None, "hot"]), 1))
    rows += [(300, rows[-1][1], "en", "b", 1), (rng.randrange(10), rows[-3][1], "en", "b", 1), (None, rows[-2][1], "en", "b", 1), (None, "only here", "en", "b", 1)]
    rows += [rows[-5]] * 3
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 420, 2)] + [(None, 1, 1), (10, 1, 0), (10, 0, 1), (300, 1, 1)]
    df = frame(spark, rows).withColumn("part", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("good", F.lit(7))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in audit.audit(df, lab).collect()}
    assert got == audited(rows, labels)


def test_audit_of_no_documents(spark):
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.audit(empty(spark), lab).count() == 0
    some = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    rows = audit.audit(some, lab.limit(0)).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and {r["good_lost"] for r in rows} == {0}


def test_interactions_of_two_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5), ("p", 1, 2), ("p", 2, 3), ("p", 3, 4), ("p", 3, 1)], "part string, fails int, n long")
    got = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["shapley"]) for r in audit.interactions(cells, "XY").collect()}
    assert got == {("XY", 1): (8, 7, 0, 2, 9), ("XY", 2): (5, 3, 5, 3, 11), ("YX", 1): (7, 8, 0, 3, 11), ("YX", 2): (5, 2, 5, 2, 9)}
