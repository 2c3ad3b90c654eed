"""Stages take and give document columns; each keeps what it should."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == before, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() > 50
    assert "sequence_id" in docs.columns


def test_run(spark):
    """The stages one after the other, each on what the one before kept: rows of the last, and no scratch folder but its own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = corpus_pipeline.run(spark, SF)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    by = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(by).collect())) == sorted(map(tuple, docs.select(by).collect()))
    folder = got.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://")
    assert sum(x.startswith("stage") for x in os.listdir(folder)) == 1


def test_stages_take_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
