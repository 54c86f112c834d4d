import os

import pytest

import corpus_pipeline

from pyspark.sql import functions as F

from .helpers import empty, frame, odd_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "tokens"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert 0 < out.count() <= 2 * docs.count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_no_documents(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert docs.count() == 0


NAMES = ("s", "d", "z", "h", "row", "copies", "copy", "s_upper", "_s_z", "score", "media", "ids", "label", "text_", "node", "digest", "goes", "rows", "strata", "k", "t", "x.y")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_clashing_columns_nulls_and_repeated_rows(spark):
    """Every stage keeps columns of any name and does not mind rows without an id, text or source."""
    rows = odd_rows() + [(None, None, None, None, None), (None, "no id at all here", None, None, 1), (None, "", "en", "a", 0)]
    rows += [(70, "another text of one id", "en", "a", 1)] * 3
    docs = frame(spark, rows).withColumns({c: F.lit(c) for c in NAMES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name == "tokens":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() == len(rows)
            assert all(r["n_tokens"] == len(r["ids"]) for r in out.collect())
            continue
        got = out.collect()
        assert out.columns == docs.columns and 0 < len(got) <= 2 * len(rows), name
        assert all(r[c] == c for r in got for c in NAMES), name
        if name in ("near_duplicates", "personal_data"):
            assert sum(r["doc_id"] is None for r in got) == 3, name
        if name == "personal_data":
            assert len(got) == len(rows)
