import random

import numpy as np
import pytest

from quillspark.llm import components, setjoin
from quillspark.llm.components import connected_components

from .helpers import empty, frame, odd_rows, shingles


def brute(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t, n))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(s and t and 100 * len(s & t) >= percent * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(shingles(t, n)), find(i)) for i, t, *_ in rows if i is not None)


def result(df):
    return sorted(tuple(r) for r in df.where("doc_id IS NOT NULL").collect())


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80), (1, 60)])
def test_components(spark, n, percent):
    rows = odd_rows()
    assert result(setjoin.jaccard_components(frame(spark, rows), n, percent)) == brute(rows, n, percent)


def test_chains_and_many_near_copies(spark):
    """A group of texts that link along chains only, larger than the first rounds' pivots."""
    rng = random.Random(3)
    base = [f"v{k}" for k in range(100)]
    rows, cur = [], list(base)
    for k in range(60):
        cur = list(cur if k % 3 else base)
        for _ in range(rng.randint(1, 3)):
            cur[rng.randrange(100)] = f"x{k}{rng.randint(0, 9)}"
        rows.append((k, " ".join(cur), "en", "s", 1))
    assert result(setjoin.jaccard_components(frame(spark, rows), 3, 80)) == brute(rows, 3, 80)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d", "en", "s", 1), (None, "a b c d", "en", "s", 1), (5, "a b c d", "en", "s", 1), (5, "a b c d", "en", "s", 1), (5, "q r s t", "en", "s", 1), (9, "q r s t", "en", "s", 1)]
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in setjoin.jaccard_components(frame(spark, rows), 3, 90).collect()), key=str)
    assert got == sorted([(True, 0, None)] * 2 + [(False, 5, 5)] * 3 + [(False, 9, 5)], key=str)


def test_near_copies_of_every_text_of_an_id(spark):
    rng = random.Random(8)
    rows, expected = [], {}
    for k in range(30):
        one, two = ([f"{c}{k}x{rng.randint(0, 999)}" for _ in range(60 + 40 * (c == "q"))] for c in "pq")
        near = two[:-1] + ["other"]
        rows += [(100 + k, " ".join(one), "en", "s", 1), (100 + k, " ".join(two), "en", "s", 1), (200 + k, " ".join(near), "en", "s", 1)]
        # a smaller id has one of the texts
        rows.append((k, " ".join(one if k % 2 else near), "en", "s", 1))
        expected |= {i: k for i in (k, 100 + k, 200 + k)}
    alone = [r for r in rows if r[0] >= 100]
    for some, least in ((rows, 0), (alone, 100)):
        got = {(r["doc_id"], r["component_id"]) for r in setjoin.jaccard_components(frame(spark, some), 3, 90).collect()}
        assert got == {(i, c + least) for i, c in expected.items() if i >= least}


def test_links_of_every_text_of_a_repeated_id(spark):
    """The shapes of an id's texts are kept apart: texts of one size that differ in all else, near copies of each elsewhere."""
    rng = random.Random(5)
    rows = []
    for k in range(40):
        a, b = ([f"{c}{k}x{rng.randint(0, 99999)}" for _ in range(80)] for c in "ab")
        rows += [(1000 + k, " ".join(a), "en", "s", 1), (1000 + k, " ".join(b), "en", "s", 1)]
        rows += [(2000 + k, " ".join([*a[:-1], "end"]), "en", "s", 1), (3000 + k, " ".join(["start", *b[1:]]), "en", "s", 1)]
    # and one id with a third of all rows, most of them alike
    rows += [(7, f"hot {k % 5} " + " ".join(f"h{(k % 5) * 100 + j}" for j in range(60)), "en", "s", 1) for k in range(80)]
    rows.append((8, "hot 3 " + " ".join(f"h{300 + j}" for j in range(59)) + " z", "en", "s", 1))
    assert result(setjoin.jaccard_components(frame(spark, rows), 3, 90)) == brute(rows, 3, 90)


@pytest.mark.parametrize("n, percent, seed", [(1, 80, 1), (1, 90, 2), (2, 80, 3)])
def test_random_tables_with_repeated_ids(spark, monkeypatch, n, percent, seed):
    """Small vocabularies: every shingle is in many sets, buckets are large and links chains."""
    monkeypatch.setattr(setjoin, "SMALL", 3)
    rng = random.Random(seed)
    rows = []
    for k in range(240):
        size = rng.choice([1, 2, 3, 5, 8, 12, 20])
        rows.append((rng.randint(0, 150), " ".join(rng.choice("abcdefghijklmnopqrstuvwx") for _ in range(size)), "en", "s", 1))
    assert result(setjoin.jaccard_components(frame(spark, rows), n, percent)) == brute(rows, n, percent)


def test_a_hot_bucket_is_not_paired_whole(spark, monkeypatch):
    """One shingle in the prefix of 2,000 unlike sets: candidates stay far below the 2,000,000 pairs, links are found."""
    made = []
    held = setjoin._Join.verified
    monkeypatch.setattr(setjoin._Join, "verified", lambda self, pairs: made.append(pairs.count()) or held(self, pairs))
    # without an order the hot shingle is in most prefixes
    monkeypatch.setattr(setjoin, "_levels", lambda table, s, bits: np.zeros(len(s), np.uint8))
    rows = [(k, "hot words here " + " ".join(f"u{k}x{j}" for j in range(12)), "en", "s", 1) for k in range(2000)]
    near = [(5000 + k, rows[k][1] + " more", "en", "s", 1) for k in range(0, 2000, 40)]
    got = {i: c for i, _, c in result(setjoin.jaccard_components(frame(spark, rows + near), 3, 90))}
    assert got == {**{k: k for k in range(2000)}, **{5000 + k: k for k in range(0, 2000, 40)}}
    assert sum(made) < 60_000


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_agree_on_a_part(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[rng.random(n) < 0.95], rng.integers(0, 1 << 63, int(rng.integers(0, 6)), dtype=np.uint64)])
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * common >= percent * union and common:
            small, large = min(n, len(b)), max(n, len(b))
            c = setjoin._size_class(small)
            assert setjoin._size_class(-(-large * percent // 100)) <= c <= setjoin._size_class(large)
            assert union - common <= setjoin._most_apart(c, percent)


def test_empty_table(spark):
    assert setjoin.jaccard_components(empty(spark)).count() == 0
    assert setjoin.keep_one_of_each(spark, empty(spark), "").count() == 0


def test_stage_keeps_one_of_each(spark):
    rows = odd_rows()
    kept = setjoin.keep_one_of_each(spark, frame(spark, rows, extra=False), "")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, c in brute(rows, 5, 80) if i == c)
    twice = frame(spark, [(1, "b b", "en", "s", 1), (1, "a a", "en", "s", 1), (None, "z", "en", "s", 1)], extra=False)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in setjoin.keep_one_of_each(spark, twice, "").collect()) == [(0, "z"), (1, "a a")]


def test_packed_counts():
    rng = np.random.default_rng(0)
    for share in (0.0001, 0.01, 0.5, 1.0):
        c = np.zeros(1 << 17, np.uint8)
        k = int(share * len(c))
        c[rng.choice(len(c), k, replace=False)] = rng.integers(1, 255, k)
        total = np.zeros(len(c), np.int64)
        for chunk, packed in setjoin._pack_counts(c):
            setjoin._add_counts(total[chunk << 16 : (chunk + 1) << 16], packed)
        assert np.array_equal(total, c)


@pytest.mark.parametrize("one_task", [0, 10**6])
def test_star_contractions(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 100), (7, 7), (None, 3)] + [(300, 300 + k) for k in range(1, 40)]
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(31), 0), 100: 100, 200: 100, **dict.fromkeys(range(300, 340), 300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
