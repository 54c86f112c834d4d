"""Fingerprints, tokens, media, packing and archives against plain counterparts."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, fingerprint, gif, packing, warc
from quillspark.llm.vector import text_slices
from quillspark.llm.workspace import shared_path

from .helpers import empty, frame, odd_rows, shingles


# ---------------------------------------------------------------- archives
def test_archive_round_trip(spark):
    long = "x" * 70_000
    rows = [(1, "http://b.Example.com:8080/x?q=1#f", "<p>" + "a" * 100), (2, None, "<p>" + "a" * 100), (3, "not a url", None), (4, "http://a.com/", ""), (5, "http://a.com/", "short"), (6, "http://a.com/", "short"), (7, "http://[bad", long + "é"), (8, "http://a.com/\r\nX: y", long + "é"), (9, "http://www.a.com", "e" * 99)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        first.setdefault(hashlib.sha256(b).hexdigest(), i)
    for i, _, h in rows:
        b = (h or "").encode()
        d = hashlib.sha256(b).hexdigest()
        again = len(b) >= 100 and first[d] != i
        assert got[i] == (len(b), d, "revisit" if again else "response", first[d] if again else None)
    assert len(got) == len(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_repeated_and_unnamed_pages(spark):
    rows = [(1, "http://a/", "z" * 200), (1, "http://a/", "z" * 200), (None, "http://a/", "z" * 200)]
    got = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == [("1", "response", None), ("1", "response", None), ("None", "revisit", 1)]


def test_look_up_by_url(spark):
    rows = [(k, f"http://h{k % 7}.org/p{k % 3}", f"page {k}") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = shared_path(spark, "t-warc")
    top = warc.build_index(warc.write_archives(df, root), root)
    ask = spark.createDataFrame([("https://H3.org/p1", None, None, False), ("http://none.org/", None, None, False)], "url string, ts string, page_id long, exact boolean")
    found = warc.look_up(ask, root, top)
    assert sorted(r["id"] for r in found.collect()) == [k for k in range(200) if k % 7 == 3 and k % 3 == 1]
    read = warc.read_records(found, root).collect()
    assert all(bytes(r["payload"]) == f"page {r['page_id']}".encode() for r in read) and len(read) == 10


@pytest.mark.parametrize("url, key", [("http://www.A.com/x?y#z", "com,a,www)/x?y"), ("https://u:p@b.org:443", "org,b)/"), ("http://c.net:81/p", "net,c:81)/p"), (None, ")/"), ("x y", ")/x y")])
def test_url_keys(url, key):
    assert warc.url_key(url) == key


# ---------------------------------------------------------------- fingerprints
def test_edited_fingerprints(spark):
    rows = odd_rows()
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(frame(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    errors = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut]
        g = got[i]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for value, other in ((g["near_edited"], edited), (g["near_next"], nxt)):
            a, b = shingles(t, 5), shingles(other, 5)
            errors.append(value - (len(a & b) / len(a | b) if a | b else 1.0))
            assert 0 <= value <= 1
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.06
    assert got[10]["fingerprint"] == got[11]["fingerprint"] and got[0]["fingerprint"] == got[2]["fingerprint"] == ""
    assert len(got) == len(rows)


def test_hot_ids_follow_each_other(spark):
    """Two thirds of the rows have one id or none: they are several ranges, and every row is edited with its next one."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(rng.choice([7, 7, None, 100 + k]), f"text {k} " * rng.randint(1, 9)) for k in range(300)] + [(7, "same text")] * 5 + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = F.coalesce("text", F.lit(""))
    order = docs.select("doc_id", text.alias("text")).orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64(text))).collect()
    expected = []
    for k, (i, t) in enumerate(order):
        cut = len(t) // 3
        edited = t[: len(t) - cut] + order[(k + 1) % len(order)][1][:cut]
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = fingerprint.edited_fingerprints(docs.repartition(5))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got.collect()) == sorted(expected)


def test_fingerprint_edges(spark):
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    r = fingerprint.edited_fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["n_chars"] == 11
    assert fingerprint.edited_fingerprints(empty(spark)).count() == 0
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, None)], "doc_id long, text string")
    assert fingerprint.edited_fingerprints(ties).count() == 4
    assert fingerprint.fingerprints(frame(spark, odd_rows())).where("fingerprint IS NULL").count() == 0


def test_bias_of_estimates():
    rng = random.Random(5)
    errors = []
    for _ in range(60):
        a = [f"t{rng.randint(0, 10**6)}" for _ in range(400)]
        b = list(a)
        for _ in range(rng.randint(0, 60)):
            b[rng.randrange(400)] = "z" + str(rng.random())
        x, y = " ".join(a), " ".join(b)
        code, none = fingerprint.codes(pa.array([x, y]))
        s, t = shingles(x, 5), shingles(y, 5)
        errors.append(float(fingerprint.likeness(code[:1], code[1:], none[:1], none[1:])[0]) - len(s & t) / len(s | t))
    assert abs(sum(errors) / len(errors)) < 0.01 and max(map(abs, errors)) < 0.1


# ---------------------------------------------------------------- tokens
@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokens_match_the_library(reference):
    rng = random.Random(2)
    letters = list("ab'strevlmd  \n\t\r'’0²٣é漢  \u0085\x1c!?-_𝔘😀ßĦ́​")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["'" * 3000, " " * 5000, "ab" * 3000 + "  ", "x's't 'd", "a" * 9000, "<|endoftext|>", "", "\n"]
    voc = bpe.vocabulary()
    for lo, hi, data, offs in text_slices(pa.array(texts), 1 << 14):
        ids, first, _, _ = voc.encode_slice(data, offs)
        for d in range(lo, hi):
            own = ids[first[d - lo] : first[d - lo + 1]]
            assert own.tolist() == reference.encode_ordinary(texts[d]), repr(texts[d])
            assert voc.decode(own).tobytes() == texts[d].encode()


def test_token_columns(spark, reference):
    rows = odd_rows()
    df = bpe.decode(bpe.encode(frame(spark, rows)))
    for r in df.collect():
        text = next(t for i, t, *_ in rows if i == r["doc_id"]) or ""
        assert r["ids"] == reference.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        # a stretch of pieces decodes on its own
        if len(r["piece_ids"]) > 3:
            part = reference.decode_bytes(r["ids"][r["piece_ids"][1] : r["piece_ids"][3]])
            assert part == text.encode()[r["piece_bytes"][1] : r["piece_bytes"][3]]
    digest = {r["doc_id"]: r for r in bpe.token_digests(frame(spark, rows)).collect()}
    assert digest[0]["n_tokens"] == 0 and digest[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.token_digests(empty(spark)).count() == 0


def test_cache_is_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "CACHE_IDS", 100)
    voc = bpe.Vocabulary(__import__("public_tokenizers").path("byte_bpe_50k.tiktoken"))
    for k in range(30):
        text = " ".join(f"word{k}x{j}" for j in range(50))
        for _, _, data, offs in text_slices(pa.array([text])):
            assert voc.encode_slice(data, offs)[0].tolist() == reference.encode_ordinary(text)
    assert voc.pieces.used < 400


# ---------------------------------------------------------------- media
def plain_lzw(size, data, n):
    clear, out, pos, bits = 1 << size, [], 0, int.from_bytes(data, "little")
    width, table, prev, nxt = size + 1, {k: [k] for k in range(1 << size)}, None, (1 << size) + 2
    while pos + width <= len(data) * 8 and len(out) < n:
        c = bits >> pos & ((1 << width) - 1)
        pos += width
        if c == clear:
            width, table, prev, nxt = size + 1, {k: [k] for k in range(clear)}, None, clear + 2
            continue
        if c == clear + 1 or (prev is None and c not in table):
            break
        entry = table.get(c) or (prev + prev[:1] if c == nxt and prev else None)
        if entry is None:
            break
        if prev is not None and nxt < 4096:
            table[nxt] = prev + entry[:1]
            nxt += 1
            if nxt == 1 << width and width < 12:
                width += 1
        out += entry
        prev = entry
    return (out + [0] * n)[:n]


@pytest.mark.parametrize("size", [2, 5, 8])
@pytest.mark.parametrize("n", [1, 2, 300, 9000])
def test_lzw(size, n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 1 << size, (4, n)).astype(np.uint8)
    x[1], x[2] = 0, np.arange(n) % 3
    data = gif.lzw_encode(x, size)
    assert np.array_equal(np.stack(gif.lzw_decode([(size, d, n) for d in data])), x)
    for d, row in zip(data, x):
        assert plain_lzw(size, d, n) == row.tolist()


def test_cut_and_broken_streams():
    rng = random.Random(4)
    x = np.tile(np.arange(40, dtype=np.uint8), 20)[None, :]
    good = gif.lzw_encode(x, 8)[0]
    for _ in range(40):
        bad = bytearray(good[: rng.randint(0, len(good))])
        for _ in range(rng.randint(0, 3)):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        assert gif.lzw_decode([(8, bytes(bad), 800)])[0].tolist() == plain_lzw(8, bytes(bad), 800)


def test_disposal_transparency_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    def frame_of(rows, **more):
        a = np.array(rows, np.uint8)
        return dict(data=gif.lzw_encode(a.reshape(1, -1), 2)[0], width=a.shape[1], height=a.shape[0], size=2, **more)

    full = frame_of([[1] * 4] * 4, disposal=1, delay=5)
    spot = frame_of([[2, 0], [0, 2]], left=1, top=1, transparent=0, disposal=3, delay=7)
    wipe = frame_of([[3, 3]], left=0, top=0, disposal=2)
    own = frame_of([[1]], left=3, top=3, palette=bytes([9, 9, 9, 7, 8, 9]))
    raw = gif.build_gif(4, 4, palette, [full, spot, wipe, own])
    (movie, s), = gif.decode_gifs([raw])
    red, green, blue = [255, 0, 0], [0, 255, 0], [0, 0, 255]
    assert (s[0] == red).all()
    assert s[1][1, 1].tolist() == green and s[1][1, 2].tolist() == red and s[1][2, 2].tolist() == green
    assert s[2][1, 1].tolist() == red and s[2][0, :2].tolist() == [blue, blue]
    assert s[3][0, 0].tolist() == [0, 0, 0] and s[3][3, 3].tolist() == [7, 8, 9]
    assert [f.delay for f in movie.frames[:2]] == [5, 7]
    rows = np.arange(10, dtype=np.uint8)[:, None].repeat(3, 1)
    grey = bytes(b for k in range(16) for b in (k, k, k))
    lace = gif.build_gif(3, 10, grey, [dict(data=gif.lzw_encode(rows[gif._rows_of(10)].reshape(1, -1), 4)[0], size=4, interlace=True)])
    assert (gif.decode_gifs([lace])[0][1][0, :, :, 0] == rows).all()


def test_frames_as_rows(spark):
    df = gif.texts_as_gifs(frame(spark, odd_rows()).withColumn("pixels", F.lit(1)), keep=("doc_id", "pixels"))
    rows = gif.gif_frames(df).where("doc_id = 10").orderBy("frame_index").collect()
    text = next(t for i, t, *_ in odd_rows() if i == 10).encode()
    assert b"".join(bytes(r["pixels"])[::3] for r in rows).rstrip(b"\xff") == text
    assert [r["start_ms"] for r in rows] == [100 * k for k in range(len(rows))] and sum(rows[0]["hist_r"]) == 576
    odd = spark.createDataFrame([(1, None), (2, b""), (3, b"PNG"), (4, b"GIF89a" + bytes(3))], "doc_id long, media binary")
    assert gif.gif_frames(odd).count() == 0


def test_media_digests(spark):
    rows = odd_rows()
    for r in gif.gif_digests(gif.texts_as_gifs(frame(spark, rows))).collect():
        raw = (next(t for i, t, *_ in rows if i == r["doc_id"]) or "").encode()
        pad = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(pad))
        assert r["payload_sha256"] == hashlib.sha256(pad).hexdigest() and r["tail_crc32"] == zlib.crc32(pad[-32:])
    assert gif.gif_digests(gif.texts_as_gifs(empty(spark))).count() == 0


# ---------------------------------------------------------------- packing
def test_best_fit_decreasing_against_a_scan():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 65, rng.integers(0, 200))
        rows = packing.best_fit_decreasing(lengths, 64)
        assert sorted(k for r in rows for k in r) == list(range(len(lengths)))
        left = []
        for k in np.argsort(-lengths, kind="stable"):
            fits = [x for x in left if x >= lengths[k]]
            if fits:
                left.remove(min(fits))
                left.append(min(fits) - lengths[k])
            else:
                left.append(64 - lengths[k])
        assert sorted(64 - sum(int(lengths[k]) for k in r) for r in rows) == sorted(int(x) for x in left)


def test_packing_is_lossless(spark, reference):
    rows = odd_rows()
    parts = {}
    for r in packing.packed_rows(frame(spark, rows), row=64, buffer=500).collect():
        ids = np.frombuffer(bytes(r["ids"]), np.uint16)
        assert len(ids) == 64 and r["cu_seqlens"][-1] == r["n_tokens"] and (ids[r["n_tokens"] :] == packing.PAD).all()
        assert r["position_resets"] == r["cu_seqlens"][:-1]
        for k, (d, s) in enumerate(zip(r["doc_ids"], r["doc_starts"])):
            parts.setdefault(d, {})[s] = ids[r["cu_seqlens"][k] : r["cu_seqlens"][k + 1]].tolist()
    for i, t, *_ in rows:
        got = [x for s in sorted(parts.get(i, {})) for x in parts[i][s]]
        assert got == reference.encode_ordinary(t or "")
    assert packing.packed_rows(empty(spark)).count() == 0


def test_packs_do_not_depend_on_the_layout(spark):
    rows = odd_rows() + [(None, "no id", "en", "a", 1)] * 3 + [(10, f"text {k} of one id " * 9, "en", "a", 1) for k in range(40)]
    every = [sorted(tuple(map(str, r)) for r in packing.packed_rows(frame(spark, rows).repartition(n), row=64, buffer=500, part_bytes=4000).collect()) for n in (1, 3, 7)]
    assert every[0] == every[1] == every[2] and len(every[0]) > 20
