"""Shared scratch tables: lineage is cut by writing to the cluster's shared folder.

The folder is the one named by ``spark.checkpoint.dir``; only where that setting
is absent and the master is local (unit tests on one machine) a temporary folder is
created and set. On a cluster its absence is an error: executors do not share the
driver's folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .vector import tidy


def shared_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        root = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once and returns a frame that reads the written table."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quill_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by :func:`materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_quill_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


#: Bytes of an Arrow batch of whole texts, on the way to Python.
BATCH_BYTES = 2 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches to ``BATCH_BYTES`` where the session does not say otherwise.

    Batches are cut when a plan runs, which for the frames returned here is the
    caller's action; so the bound stays in the session. It changes no result, and
    a session that sets the bound itself keeps its own.
    """
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def _tidied(function):
    def run(batches):
        try:
            yield from function(batches)
        finally:
            tidy()

    return run


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in bytes; a task that ends gives its memory back to the system."""
    bound_batches(df.sparkSession)
    if any("." in c or "`" in c for c in df.columns):
        # mapInArrow looks columns up by name; those that come out have the schema's names
        df = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    return df.mapInArrow(_tidied(function), schema)


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` with the fields of ``ddl`` after its own."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


#: Rows of a relation that is broadcast at most: some 20 MB of ids.
BROADCAST_ROWS = 300_000


def bounded_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast when the counted ``rows`` stay under ``limit``.

    Beyond the limit the frame is returned unhinted and Spark's sort-merge join runs.
    """
    return F.broadcast(df) if rows <= limit else df
