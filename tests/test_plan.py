"""One whole run: stories in, a validated report out."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.summaries import StubClient
from quillspark.operators.tagging import TagRules
from quillspark.plans import digest

NOW = datetime(2026, 7, 30, 14)


def test_run(spark, tmp_path):
    rows = [(k, ("Local", "World")[k % 2], f"Harbour story number {k} about ships and cargo", f"http://x/{k}", "long snippet " * 30, NOW - timedelta(hours=k)) for k in range(20)]
    c = spark.createDataFrame(rows, "row_id long, category string, title string, link string, snippet string, pub_dt timestamp")
    c = c.withColumn("norm", T.title_key(F.col("title"))).withColumn("context", F.lit(None).cast("string"))
    cats = spark.createDataFrame([("World", 0, 24, 72, 5), ("Local", 1, 24, 72, 5)], "category string, cat_pos int, age_limit_h int, window_h int, cap int")
    n = iter(range(100))

    def store(df):
        path = str(tmp_path / f"t{next(n)}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    run = digest.Run(NOW, str(tmp_path / "out"), TagRules({"sea": ["harbour", "ships"]}), ["Local"], ["news"])
    code, path, issues = digest.run_digest(spark, run, c, cats, StubClient(), ["", "## Weather Forecast", *["| a | b | c |"] * 3], store)
    text = open(path).read()
    assert code == digest.OK, issues
    assert text.index("## Local (5 stories)") < text.index("## World (5 stories)")
    assert "story_count_total: 10" in text and "[[sea]]" in text and "  - news" in text
