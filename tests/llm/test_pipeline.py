"""The pipeline: each stage's contract on awkward rows, and a run over the smallest test tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from cartulary.llm.common import Work
from cartulary.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@needs_data
def test_stages(spark):
    docs, work = spark.read.parquet(f"{DATA}/documents.parquet"), Work(spark)
    before = docs
    for k, (name, stage) in enumerate(pipe.STAGES):
        after = work.put(name, stage(spark, before, DATA))
        assert after.dtypes == docs.dtypes
        if k < 4:
            assert 0 < after.count() <= before.count() and after.join(before, "doc_id", "left_anti").count() == 0
        before = after
    assert pipe.run(spark, DATA).count() == before.count()


@needs_data
def test_stages_on_awkward_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, None, "en", "s", 0), (3, "plain words", "en", "s", 11), (3, "plain words", "en", "s", 11), (None, "plain words", None, None, 11)]
    docs = spark.createDataFrame(rows, DOC).withColumn("m_id", F.lit(1)).withColumn("shards", F.lit("x"))
    for df in (docs, docs.where("false")):
        for _, stage in pipe.STAGES:
            out = stage(spark, df, DATA)
            assert out.columns == df.columns
            out.collect()


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(map(tuple, got[cols].astype(str).values.tolist())) == sorted(map(tuple, want[cols].astype(str).values.tolist()))
