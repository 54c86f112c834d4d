"""A training corpus in five stages, each a whole-table operator.

Every stage gets what the one before kept, written as Parquet and read again; all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.bpe import encode_stage
from quillspark.llm.mixing import mix_stage
from quillspark.llm.pii import redact_stage
from quillspark.llm.quality import quality_stage
from quillspark.llm.setjoin import keep_one_of_each
from quillspark.llm.workspace import discard, materialize

STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", keep_one_of_each),
    ("personal_data", redact_stage),
    ("mixing", mix_stage),
    ("tokens", encode_stage),
]

#: Trees, sketches and merges are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each one's result is written and read again, and goes when the next one stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
