from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.streaming import feed


def run(spark, df, tmp_path, f, name):
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = f(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_first_of_each_title(spark, tmp_path):
    t = datetime(2026, 7, 30)
    df = spark.createDataFrame([("a", "x", t), ("a", "x", t + timedelta(hours=1)), ("b", "x", t)], "category string, norm string, pub_dt timestamp")
    assert run(spark, df, tmp_path, feed.dedup_stream, "firsts").count() == 2


def test_windows(spark, tmp_path):
    t = datetime(2026, 7, 30)
    df = spark.createDataFrame([("a", t + timedelta(minutes=m)) for m in (0, 10, 70, 600)], "category string, pub_dt timestamp")
    got = run(spark, df, tmp_path, feed.counts_by_window, "windows").orderBy("start").select("n").collect()
    assert [r["n"] for r in got] == [2, 1]
