"""Limits that raise, tables that are written twice, and folds against brute force."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.functions import codecs
from chronolith.operators import distill, graph, joins, kernel, sketches
from chronolith.sources import exchange, lake, sinks, tail
from chronolith.sources.adapters import EPISODE
from chronolith.streaming import detectors, normalize


def log(spark, n, **cols):
    rows = [(i, f"e{i}", i << 16, f"a{i % 3}", "s", "Note", f"text {i}", {"k": str(i % 5)}, [f"e{i - 1}"] if i else [], None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, EPISODE).coalesce(2)


def test_bundles_too_large_are_errors(spark, tmp_path):
    objects = [{"type": "indicator", "id": f"i{k}", "pattern": "[x]", "confidence": 1} for k in range(5)]
    (tmp_path / "b.json").write_text(json.dumps({"type": "bundle", "id": "b", "objects": objects}))
    path = str(tmp_path / "b.json")
    assert sinks.read_stix(spark, path, most=5).count() == 5
    with pytest.raises(sinks.TooManyObjects):
        sinks.read_stix(spark, path, most=4)
    with pytest.raises(sinks.TooManyObjects):
        sinks.read_stix(spark, path, most_bytes=20)
    (tmp_path / "c.json").write_text(json.dumps({"type": "report", "objects": []}))
    with pytest.raises(ValueError):
        sinks.read_stix(spark, str(tmp_path / "c.json"))


def test_redacted_evidence(spark):
    rows = [("a", "Authorization: Bearer abc.def next"), ("a", "Authorization: Bearer xyz next"), ("a", "plain"), ("b", None)]
    got = sinks.evidence(spark.createDataFrame(rows, "key string, body string")).collect()
    assert sorted((r.key, r.body) for r in got if r.body) == [("a", "Authorization: [redacted] next"), ("a", "plain")] and len(got) == 3


def test_commits_are_created_once(spark, tmp_path):
    table = lake.CommitLog(spark, f"file://{tmp_path}/t")
    assert table.version() == -1
    table.create(0)
    with pytest.raises(Exception, match="exist"):
        table.commit(0, [])
    table.append([{"path": "x", "size": 1}], [], 1)
    table.append([{"path": "y", "size": 1}], ["x"], 2)
    assert list(table.files()) == ["y"] and list(table.files(1)) == ["x"]
    with pytest.raises(ValueError):
        table.append([], ["x"], 3)
    assert table.version() == 2


def test_export_of_nothing_and_again(spark, tmp_path):
    path, e = f"file://{tmp_path}/lake", log(spark, 30)
    assert lake.export(e.limit(0), path, 10) == {} and lake.CommitLog(spark, path).read().count() == 0
    assert lake.export(e, path, 10) == {0: "exported", 1: "exported", 2: "exported"}
    before = lake.CommitLog(spark, path).version()
    assert set(lake.export(e, path, 10).values()) == {"current"} and lake.CommitLog(spark, path).version() == before
    assert [f.name for f in lake.CommitLog(spark, path).read().schema] == [n for n, _, _ in lake.COLUMNS]
    assert sorted(r.lsn for r in lake.segment(spark, path, 1).collect()) == list(range(10, 20))


def test_exchange_limits(spark):
    e = log(spark, 20)
    with pytest.raises(ValueError):
        exchange.do_get(e, "events", most=10)
    with pytest.raises(ValueError):
        exchange.ticket("rows")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("agent_id", pa.int64()), ("kind", pa.string())])) as w:
        w.write_table(pa.table({"agent_id": [1], "kind": ["x"]}))
    with pytest.raises(ValueError):
        exchange.do_put(spark, [sink.getvalue().to_pybytes()], 0)
    assert exchange.do_put(spark, [], 5).count() == 0 and sum(1 for _ in exchange.stream(e, "events?as_of=7")) >= 1


def test_merges_and_subscriptions(spark):
    e = log(spark, 10).select("id", "lsn", "kind")
    new = e.where("lsn > 7").withColumns({"lsn": F.col("lsn") + 100, "kind": F.lit("late")})
    assert {r.id: r.kind for r in tail.merged(e, new).collect()}["e9"] == "late"
    past, live = tail.subscribe(e, e, 3, 6)
    assert [r.lsn for r in past.unionByName(live).orderBy("lsn").collect()] == list(range(3, 10))


def test_incidents_are_components_of_links(spark):
    rows = [("a", 1, "x", ["p"]), ("b", 500, "x", []), ("c", 5000, "x", ["q"]), ("d", 5100, "y", ["q"]), ("e", 5150, "z", []), ("f", 9000, "z", []), ("g", 9050, "w", [])]
    s = spark.createDataFrame(rows, "signal_id string, lsn long, subject string, evidence array<string>")
    related = spark.createDataFrame([("w", "z"), ("y", "y")], "src string, dst string")
    got = {r.signal_id: r.incident for r in detectors.correlate(s, related).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e", "f": "f", "g": "f"}


def test_facts_of_all_runs(spark, monkeypatch):
    import pandas as pd

    monkeypatch.setattr(distill, "MOST", 2)
    rows = [(f"g{0}", i, [0.9 * ((i % 5) == k) for k in range(5)]) for i in range(15)]
    got = distill.greedy(pd.DataFrame(rows, columns=["grp", "lsn", "hyp"]))
    assert got.run.tolist() == [0, 0, 1, 1, 2] and got.n.tolist() == [3] * 5


def test_nets_of_no_length(spark):
    ips = spark.createDataFrame([(1,)], "ip long")
    assert joins.prefix_match(ips, "ip", spark.createDataFrame([], "net long, bits int")).count() == 0


def test_derived_edges_of_stances(spark):
    e = log(spark, 1)
    attrs = F.create_map(*map(F.lit, ["edge_from", "p", "edge_to", "q", "edge_type", "Pagou", "stance", "AGAINST", "confidence", "0.25", "valid_from", " 7 ", "rule", "r1"]))
    r = graph.derive(e.withColumn("attrs", attrs)).first()
    assert (r.src, r.dst, r.etype, r.op, r.confidence, r.polarity, r.hypothesis, r.world_from, r.world_to) == ("p", "q", "pagou", "assert", 0.25, -1, "r1", 7, None)


def test_codecs_of_edges(spark):
    rows = [([],), ([5],), ([7, 7, 7],), ([1, 2, 1 << 40],)]
    df = spark.createDataFrame(rows, "a array<bigint>")
    for r in df.select("a", codecs.unrle(codecs.rle(F.col("a"))).alias("r"), codecs.undelta(codecs.delta(F.col("a"))).alias("d")).collect():
        assert r.r == r.a == r.d
    f = df.where("size(a) > 0").withColumn("f", codecs.frame(F.col("a")))
    for r in f.select("a", codecs.unframe(F.col("f")).alias("u"), codecs.bit_unpack(codecs.bit_pack(F.col("f.offsets"), F.col("f.width")), F.col("f.width"), F.size("a")).alias("p"), "f.offsets").collect():
        assert r.u == r.a and r.p == r.offsets
    keys = spark.createDataFrame([(x,) for x in (float("-inf"), -2.5, -0.0, 0.0, 1e-300, 3.0, float("inf"), float("nan"), None)], "x double")
    got = [r.k for r in keys.select(codecs.f64_key(F.col("x")).alias("k")).collect()]
    assert got[2] == got[3] and got[:8] == sorted(got[:8]) and got[8] is None


def test_selections_of_nothing(spark):
    e = log(spark, 10)
    none = kernel.filter_eq(e, "kind", "absent")
    assert kernel.cardinality(none).first().n == 0 and kernel.members(none).count() == 0 and kernel.cardinality(kernel.without(e, none)).first().n == 10
    assert sketches.bloom_semi_join(e, e.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        kernel.evaluate([("not", ("%", 3))])


def test_own_events_are_no_telemetry(spark):
    e = log(spark, 2).withColumns({"agent_id": F.lit("detector"), "attrs": F.create_map(F.lit("detector.generated"), F.when(F.col("lsn") == 0, "true").otherwise("no"))})
    got = normalize.normalize(e.withColumn("content", F.lit("not json"))).collect()
    assert [r.lsn for r in got] == [1] and got[0].fidelity == "unmapped" and got[0].category == "unmapped"
