"""The stages over a small table, each against what it must keep."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.llm.test_ops import brute_components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        kept.append({r.doc_id: r for r in docs.collect()})
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
    good, single, clean, safe, ids = kept
    want = brute_components([(i, r.text) for i, r in good.items()], 5)
    assert set(single) == {i for i, (_, c) in want.items() if i == c}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, r in single.items() if any(t in r.text for t in items)}
    assert set(clean) == set(single) - leaked
    assert set(safe) == set(clean) == set(ids)
    for i, r in safe.items():
        assert r.n_chars == len(r.text) and (r.text == clean[i].text or "[SECRET]" in r.text)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in ids.values())
    assert {r.doc_id for r in pipeline.run(spark, SF).select("doc_id", F.lit(1)).collect()} == set(ids)
