"""Disk that the training order takes for its sequences."""

import os

import public_tokenizers

from gridloom.llm import training_order


def test_table_is_well_compressed(spark, tmp_path, monkeypatch):
    size = lambda p: sum(os.path.getsize(p / x) for x in os.listdir(p) if x.endswith(".parquet"))
    monkeypatch.setattr(training_order, "scratch_dir", lambda spark, name: str(tmp_path / name))
    docs, path = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")
    out = training_order.materialise(docs, path)
    training_order.sequences(docs, path).write.option("compression", "zstd").parquet(str(tmp_path / "plain"))
    assert size(tmp_path / "sequences") < 0.97 * size(tmp_path / "plain")
    assert out.count() == spark.read.parquet(str(tmp_path / "plain")).count()
