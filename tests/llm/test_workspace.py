from types import SimpleNamespace

import pyarrow as pa
import pytest

from quillspark.llm import workspace


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError):
        workspace.shared_root(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "file:///shared/x/"), sparkContext=context)
    assert workspace.shared_path(named, "t").startswith("file:///shared/x/t-")


def test_batches_are_bounded_and_the_callers_settings_stay(spark):
    key, rows = workspace._BATCH_KEY, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    texts = spark.range(64, numPartitions=1).selectExpr("id AS `a.b`", "repeat('x', 1000000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32())], names=["n"])

    spark.conf.unset(key)
    got = [r["n"] for r in workspace.arrow_map(texts, sizes, "n int").collect()]
    assert sum(got) == 64 and max(got) <= 10 and spark.conf.get(rows) == before
    spark.conf.set(key, "3000000")
    got = [r["n"] for r in workspace.arrow_map(texts, sizes, "n int").collect()]
    assert spark.conf.get(key) == "3000000" and max(got) <= 4
    spark.conf.unset(key)


def test_discard_and_materialize(spark):
    one = workspace.materialize(spark.range(5), "t")
    assert one.count() == 5
    workspace.discard(one, spark.range(3))
    with pytest.raises(Exception):
        spark.read.parquet(one._quill_path)
