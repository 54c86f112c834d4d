"""A stream cut at random ends with what the batch operator gives for the whole table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import dedup
from quillspark.streaming import first_wins

NOW = datetime(2026, 7, 30, 14)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def candidates(rng, n, days=9):
    titles = ["Alpha", " alpha", "Beta", "Gamma", "Delta $5", "Old obituary", "Epsilon", "Zeta", "Eta", "Theta"]
    rows = []
    for i in range(n):
        when = None if rng.random() < 0.1 else NOW - timedelta(minutes=rng.randint(0, days * 1440))
        rows.append((i, f"c{rng.randint(0, 2)}", rng.choice(titles), when))
    return rows


def stream(spark, folder, pieces, late, restart_after=None):
    """Pieces as micro-batches, one file each; with a restart from the checkpoint in between."""
    src, out, check = (str(folder / x) for x in ("src", "out", "check"))
    schema = "row_id long, category string, title string, pub_dt timestamp"

    def write(df, k):
        df.withColumn("batch", F.lit(k)).write.mode("append").parquet(out)

    for k, piece in enumerate(pieces):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(src)
        if k == restart_after or k == len(pieces) - 1:
            s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("norm", T.title_key(F.col("title")))
            first_wins.first_wins(s, late).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("seed", range(2))
def test_a_cut_stream_ends_as_the_batch(spark, tmp_path, rocks, seed):
    rng = random.Random(seed)
    rows = candidates(rng, 70)
    cats = spark.createDataFrame([(f"c{k}", k, rng.choice([8, 24]), rng.choice([72, 168]), rng.choice([0, 3])) for k in range(3)], "category string, cat_pos int, age_limit_h int, window_h int, cap int")
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    pieces = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    updates = stream(spark, tmp_path, pieces, "30 days", restart_after=1)
    whole = spark.createDataFrame(rows, "row_id long, category string, title string, pub_dt timestamp").withColumn("norm", T.title_key(F.col("title")))
    for now in (NOW, NOW + timedelta(hours=30)):
        ids = lambda df: sorted((r["category"], r["row_id"], r["band"], r["k"]) for r in df.collect())
        assert ids(first_wins.digest_at(updates, cats, now)) == ids(dedup.feed_dedup(whole, cats, now))


def test_states_end_when_no_band_reaches_them(spark, tmp_path, rocks):
    old, new = NOW - timedelta(days=30), NOW
    pieces = [[(1, "a", "old", old), (2, "a", "undated", None)], [(3, "a", "new", new)], [(4, "a", "late", old), (5, "a", "other", new), (6, "a", "undated", None)]]
    updates = stream(spark, tmp_path, pieces, "1 day")
    seen = sorted((r["batch"], r["row_id"], r["gone"]) for r in updates.collect())
    # the old row ends once the watermark has passed it; one that comes later than that is not kept at all
    assert (0, 1, False) in [s for s in seen] and any(s[1:] == (1, True) for s in seen)
    assert not any(s[1] == 4 for s in seen)
    standing = sorted(r["row_id"] for r in first_wins.standing(updates).collect())
    assert standing == [2, 3, 5]
