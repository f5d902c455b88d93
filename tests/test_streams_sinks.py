import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronolith.operators import distill, sketches
from chronolith.sources import sinks
from chronolith.streaming import detectors, rules, sigma


def test_sequence_takes_the_earliest_steps():
    pdf = pd.DataFrame([("k", 0, 0, "a"), ("k", 1, 5, "a"), ("k", 2, 6, "b"), ("k", 3, 8, "c"), ("k", 4, 99, "c")], columns=["key", "lsn", "at", "step"])
    got = rules.sequences(pdf, ["a", "b", "c"], 10)
    assert list(got.itertuples(index=False, name=None)) == [("k", 3, "0>2>3")]


def test_sigma():
    r = sigma.compile_rule({"a1": {"x": 1}, "a2": {"x": 2, "y": "z"}, "b": {"w": [1, 2]}, "condition": "not b and (1 of a* or all of a*)"})
    assert r == ("and", ("not", ("in", "w", [1, 2])), ("or", ("or", ("eq", "x", 1), ("and", ("eq", "x", 2), ("eq", "y", "z"))), ("and", ("eq", "x", 1), ("and", ("eq", "x", 2), ("eq", "y", "z")))))
    for bad in ({"a": {"x|contains": 1}, "condition": "a"}, {"a": {"x": 1}, "condition": "b"}, {"a": {"x": 1}, "condition": "a and"}):
        with pytest.raises(sigma.SigmaError):
            sigma.compile_rule(bad)


def test_missing_fields(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, f string")
    ids = lambda rule: [r.i for r in df.where(rules.predicate(rule)).collect()]
    assert ids(("ne", "f", "a")) == [] and ids(("not", ("eq", "f", "a"))) == [2]


def test_baseline_dispositions():
    xs = [10.0 + (i % 3) for i in range(60)]
    xs[50] = 500.0
    out = detectors.fold_baseline(pd.DataFrame({"entity": "e", "lsn": range(60), "x": xs}))
    assert (out.state[:29] == "warming").all() and out.state[29] == "promoted" and (out.state[30:50] == "updated").all()
    assert out.state[50] == "outlier" and out.score[50] > 4 and (out.state[51:56] == "quarantined").all() and out.state[56] == "updated"
    pdf = pd.DataFrame({"entity": "e", "lsn": [0, 0, 1, 2, 3], "x": [1.0] * 5, "suspicious": [False, False, True, True, False], "feedback": [False, False, False, True, False]})
    assert list(detectors.fold_baseline(pdf, detectors.Baseline(rate=2)).state) == ["warming", "duplicate", "suspicious", "feedback", "rate_limited"]


def test_distill_groups_near_points():
    rows = [("g", i, [0.1 + 0.001 * i, 0.0]) for i in range(4)] + [("g", 9, [-0.9, 0.0])]
    got = distill.greedy(pd.DataFrame(rows, columns=["grp", "lsn", "hyp"]))
    assert list(got.lsns) == [[0, 1, 2, 3]] and abs(got.confidence[0] - 4 / 6) < 1e-12


def test_hll_is_within_its_error(spark):
    n = sketches.merged_distinct(spark.range(20_000).select((F.col("id") % 7).alias("p"), (F.col("id") % 5000).alias("v")), "p", "v").first()[0]
    assert abs(n - 5000) < 250


def test_exports(spark, tmp_path):
    df = spark.range(30).select(F.col("id").alias("lsn"), F.create_map(F.lit("a"), F.col("id").cast("string")).alias("attrs"), F.array(F.lit("p")).alias("parents"), F.struct("id").alias("embedding"))
    for _ in range(2):
        sinks.lake_export(df, str(tmp_path / "lake"), 10)
    back = spark.read.parquet(str(tmp_path / "lake"))
    assert back.count() == 30 and back.select("segment_id").distinct().count() == 3
    sinks.bi_export(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 30
    log = str(tmp_path / "log")
    spark.createDataFrame([("a", 1)], "k string, v int").write.parquet(log)
    for _ in range(2):
        sinks.append_once(spark, spark.createDataFrame([("a", 2), ("b", 3), ("b", 3)], "k string, v int"), log, "k")
    assert spark.read.parquet(log).count() == 2
    for _ in range(2):
        rules.idempotent_append(spark.createDataFrame([("x",), ("y",)], "k string"), str(tmp_path / "sink"), ["k"])
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 2
    with pytest.raises(ValueError):
        sinks.sql(spark, "DROP TABLE x")
    with pytest.raises(ValueError):
        sinks.sql(spark, "SELECT * FROM range(5)", max_rows=4)


def test_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("nome;órgão\nJosé;São Paulo\n".encode("latin-1"))
    assert sinks.read_csv(spark, str(tmp_path / "a.csv")).first()["órgão"] == "São Paulo"
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "id": "b", "objects": [{"id": "i1", "type": "indicator", "pattern": "p", "confidence": 80}]}))
    assert sinks.read_stix(spark, str(tmp_path / "b.json")).first().confidence == 80
    span = {"traceId": "t", "spanId": "s", "name": "n"}
    (tmp_path / "c.json").write_text(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span, span]}]}]}))
    assert sinks.read_otlp(spark, str(tmp_path / "c.json")).count() == 1
