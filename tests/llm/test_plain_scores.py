"""Statistics of the quality classifier and scores of the toxicity model against plain Python, text by text."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import quality, toxicity
from quillspark.llm.vector import _BASE, text_slices

from .helpers import odd_rows, words


def texts(seed=4):
    rng = random.Random(seed)
    pieces = ["word", "Wörter", "été", "漢字", " ", "  ", "\n", "\r\n", "\t", ". ", "! ", "? ", "A|B", "{x}", '"q"', "'s", "12,5", "UPPER", "same same", "#%&", "x" * 70, "\x0b", "\x00", "..", "\n\n"]
    out = [t or "" for _, t, *_ in odd_rows()]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(200)]


def plain_statistics(text):
    b = text.encode()
    if not b:
        return [0.0] * len(quality.STATISTICS)
    w, n = words(text), len(b)
    share = lambda chars: sum(c in chars for c in b) / n
    of = lambda s: share(s.encode())
    solid = sum(c not in b" \t\n\x0b\x0c\r" for c in b)
    return [
        math.log1p(n),
        math.log1p(len(w)),
        solid / max(len(w), 1),
        share(range(65, 91)),
        share(range(48, 58)),
        of(" \t"),
        of("\n\r"),
        of(".?"),
        of(",;:"),
        of("!"),
        of("|"),
        of("#$%&*+/<=>@\\^_~"),
        of("()[]{}"),
        of("\"'"),
        share(range(128, 256)),
        len(set(w)) / len(w) if w else 0.0,
        sum(x == y for x, y in zip(w, w[1:])) / (len(w) - 1) if len(w) > 1 else 0.0,
        math.log1p(n / (b.count(b"\n") + 1)),
        max(Counter(w).values()) / len(w) if w else 0.0,
        math.log1p(max(map(len, re.split(b"[ \n]", b)))),
    ]


def test_quality_statistics():
    every = texts()
    got = quality._statistics(pa.array(every))
    assert np.allclose(got, [plain_statistics(t) for t in every], rtol=1e-12, atol=1e-12)


_M = (1 << 64) - 1


def plain_hash(b):
    """The hash of a span of bytes, in whole numbers."""
    h = sum((c + 1) * pow(int(_BASE), i, 1 << 64) for i, c in enumerate(b)) & _M
    h = (h + len(b) * 0xA0761D6478BD642F) & _M
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & _M
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & _M
    return h ^ h >> 31


def plain_score(text, model):
    """Noisy-or of the scores of sentences: (score, worst sentence, offending sentences)."""
    weights = dict(zip(model.places.tolist(), model.weights.astype(np.float32).tolist()))
    rest, scores = 1.0, []
    for sentence in re.split(rb"[.!?\n\r]", text.encode()):
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", sentence)
        if not found:
            continue
        z = model.bias
        for w in found:
            low = w.lower()
            z += weights.get(plain_hash(low) % toxicity.BUCKETS, 0.0)
            for k in (3, 4, 5):
                if len(low) > k:
                    z += weights.get((plain_hash(low[:k]) ^ k) % toxicity.BUCKETS, 0.0)
        scores.append(1 / (1 + math.exp(-z)))
        rest *= 1 - min(scores[-1], 1 - 1e-12)
    worst = max(range(len(scores)), key=lambda i: (scores[i], -i)) if scores else -1
    return 1 - rest, worst, ",".join(str(i) for i, p in enumerate(scores) if p >= toxicity.OFFENDS)


@pytest.mark.parametrize("bias", [-6.0, -0.5])
def test_toxicity_scores(bias):
    rng = random.Random(7)
    every = [t for t in texts(9) if len(t) < 5000] + ["Toxic sentence here. And a clean one! toxicly toxic\nclean"]
    vocabulary = sorted({w for t in every for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", t.encode().lower())})
    hashes = {plain_hash(w) for w in vocabulary} | {plain_hash(w[:k]) ^ k for w in vocabulary for k in (3, 4, 5) if len(w) > k}
    places = np.array(sorted({h % toxicity.BUCKETS for h in hashes}), np.int64)
    model = toxicity.ToxicityModel(bias, places, np.array([rng.choice([0.0, 0.0, 2.5, -1.0, 0.3]) for _ in places]))
    got = []
    for lo, hi, data, offs in text_slices(pa.array(every), 4096):
        p, base, has = model.sentences(data, offs)
        score = model.documents(p, base)
        for d in range(hi - lo):
            own = p[base[d] : base[d + 1]][has[base[d] : base[d + 1]]]
            got.append((score[d], int(own.argmax()) if len(own) else -1, ",".join(map(str, np.flatnonzero(own >= toxicity.OFFENDS).tolist()))))
    for text, (score, worst, where) in zip(every, got):
        expected = plain_score(text, model)
        assert abs(score - expected[0]) < 1e-6 and (worst, where) == expected[1:], text
