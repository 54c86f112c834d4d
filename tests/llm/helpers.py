"""Small tables with every odd case, and plain counterparts of the operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1)))


def odd_rows(seed=1, copies=12):
    """Nulls, empty and blank texts, one long text, copies, near copies, ties and accents."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["naïve", "Été", "漢字", "it's", "😀"]
    base = [rng.choice(vocab) for _ in range(120)]
    rows = [(0, None, "en", "a", 0), (1, "", "en", None, 0), (2, " \n\t ", "en", "a", 4), (3, "One", "fr", "b", 3), (4, "one", "fr", "b", 3), (5, "two Words", "fr", None, 9)]
    rows.append((6, " ".join(rng.choice(vocab) for _ in range(6000)), "en", "a", 1))
    for k in range(copies):
        rows.append((10 + k, " ".join(base), "en", "hot", 1))
    for k in range(copies):
        near = list(base)
        for _ in range(rng.randint(1, 5)):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows.append((40 + k, " ".join(near), "en", "hot", 1))
    for k in range(20):
        rows.append((70 + k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 80))), "de", f"s{k % 4}", 1))
    rows.append((7, rows[-1][1], None, None, None))
    return rows


def frame(spark, rows, extra=True):
    """The rows as documents, with columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for c in ("score", "ids", "token", "rep", "size", "__copy_", "fingerprint_", "key"):
            df = df.withColumn(c, F.lit("x"))
    return df.repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
