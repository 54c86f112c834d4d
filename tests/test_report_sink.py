"""One file of many tasks' lines: in order, whole, or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from quillspark.sources.report_sink import ReportSink, save_report


def test_lines_in_order(spark, tmp_path):
    path = str(tmp_path / "r.md")
    df = spark.range(5000).select((-F.col("id")).alias("k"), F.concat(F.lit("Zeile é "), F.col("id")).alias("line")).repartition(7)
    save_report(df, ["k"], path)
    assert open(path, encoding="utf-8").read() == "".join(f"Zeile é {k}\n" for k in reversed(range(5000)))
    save_report(df.limit(0), ["k"], "file://" + path)
    assert open(path).read() == "" and os.listdir(tmp_path) == ["r.md"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "r.md")
    good = spark.range(100).select("id", F.col("id").cast("string").alias("line"))
    bad = good.withColumn("line", F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="no"):
        save_report(bad, ["id"], path)
    assert os.listdir(tmp_path) == []
    save_report(good, ["id"], path)
    with pytest.raises(Exception, match="no"):
        save_report(bad, ["id"], path)
    assert os.listdir(tmp_path) == ["r.md"] and open(path).read().count("\n") == 100


def test_only_whole_reports_of_lines(spark, tmp_path):
    spark.dataSource.register(ReportSink)
    with pytest.raises(Exception, match="overwrite"):
        spark.range(1).select(F.lit("x").alias("line")).write.format("report").mode("append").save(str(tmp_path / "r"))
    with pytest.raises(Exception, match="named line"):
        spark.range(1).write.format("report").mode("overwrite").save(str(tmp_path / "r"))
