"""The pipeline's stages, one by one, on the smallest documents."""

from collections import Counter

import pytest

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, docs := spark.read.parquet(str(tmp_path / name)))
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    before, after = seen["quality"]
    assert 0 < after.count() < before.count() and after.exceptAll(before).isEmpty()
    before, after = seen["line_dedup"]
    assert after.count() == before.count()
    long = {r.doc_id: r.text for r in before.collect()}
    assert all(set(r.text.split("\n")) <= set(long[r.doc_id].split("\n")) | {""} and r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["simhash_near_dedup"]
    texts = Counter(r.text for r in before.collect())
    assert {r.text for r in after.collect()} <= set(texts) and max(Counter(r.text for r in after.collect()).values()) == 1
    before, after = seen["source_mix"]
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= 2
    before, after = seen["byte_bpe"]
    assert after.count() == before.count() and min(len(r.ids) for r in after.collect()) >= 0


def test_run(spark):
    assert pipeline.run(spark, DATA).count() > 0
