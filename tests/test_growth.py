"""Results and plans that hold at any size: no cap on distinct values, no work that grows faster than rows and results."""

import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.functions import codecs
from chronolith.operators import entity, graph, joins, sketches
from chronolith.plans import catalogue, extended  # noqa: F401
from chronolith.sources import lake
from chronolith.sources.adapters import EPISODE
from chronolith.streaming import detectors, rules
from tests.test_catalogue import rows as table
from tests.test_whole import save


def same(spark, sf, name, *tables):
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = catalogue.QUERIES[name](spark, sf), duck.execute(catalogue.SQL[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), [d[0] for d in want.description])


def event(i, user, value, kind="view"):
    return {"event_id": i, "user_id": user, "event_type": kind, "value": value, "ts": pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), "props": f'{{"k": {i % 7}}}'}


def test_counts_of_more_values_than_counters(spark, tmp_path):
    same(spark, save(tmp_path, events=[event(i, i % 5501, 1.0) for i in range(11_003)]), "heavy_hitters_exact", "events")


def test_the_first_of_equal_values_is_the_cheapest(spark, tmp_path):
    one = [{"x": 1}]
    sf = save(tmp_path, events=[event(i, 1, float(9 - i % 3), "view" if i % 2 else "click") for i in range(60)] + [event(60, 1, None)], **dict.fromkeys(["orders", "lineitem", "customer", "supplier", "nation", "region", "part"], one))
    same(spark, sf, "statistics_aggregates", "events")


@pytest.mark.parametrize("turns", [0, 3, 5])
def test_causes_in_a_short_conversation(spark, tmp_path, turns):
    sf = save(tmp_path, conversations=[{"conv_id": c, "turn": t, "role": "user", "text": "x"} for c, n in ((3, turns), (4, 8)) for t in range(n)])
    same(spark, sf, "why_causes", "conversations")


@pytest.mark.parametrize("turns", [3, 7])
def test_trace_in_a_short_conversation(spark, tmp_path, turns):
    sf = save(tmp_path, conversations=[{"conv_id": 3, "turn": t, "role": "user", "text": "x"} for t in range(turns)])
    same(spark, sf, "why_trace", "conversations")


def test_codecs_of_long_arrays(spark):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: i.cast("long") * i * 5 - 7).alias("a")).withColumn("f", codecs.frame(F.col("a")))
    began = time.time()
    back = codecs.bit_unpack(codecs.bit_pack(F.col("f.offsets"), F.col("f.width")), F.col("f.width"), F.size("a"))
    r = df.select("a", codecs.undelta(codecs.delta(F.col("a"))).alias("d"), codecs.unframe(F.col("f")).alias("u"), back.alias("p"), "f.offsets").first()
    assert r.d == r.u == r.a and r.p == r.offsets and len(r.p) == 3000
    assert time.time() - began < 30


def test_a_filter_keeps_its_rate_and_is_never_copied(spark):
    assert sketches.bloom_shape(54_000_000, 0.02)[0] > 8 * 54_000_000
    keys, shape = spark.range(20_000).toDF("k"), sketches.bloom_shape(20_000, 0.02)
    words = sketches.bloom(keys, "k", shape)
    got = sketches.might_contain(keys.select((-F.col("k") - 1).alias("k")), "k", words, shape)
    assert sketches.might_contain(keys, "k", words, shape).count() == 20_000 and 100 < got.count() < 800
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_many_equal_names(spark, tmp_path):
    parts = [{"p_partkey": i, "p_name": ("red ring", "red bolt", "old ring")[i % 3], "p_brand": f"B{i % 2 + i % 5}", "p_size": i % 2 + i // 40} for i in range(120)]
    sf = save(tmp_path, part=parts + parts[:7])  # keys that occur twice
    same(spark, sf, "join_blocking_jaccard", "part")
    plan = catalogue.QUERIES["join_blocking_jaccard"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    above = plan[: re.search(r"Join", plan).start()]  # what pairs go through
    assert not re.search("Exchange|Aggregate|Window", above)


def test_pairs_of_one_value_are_spread(spark):
    kind = F.when(F.col("id") % 2 == 0, "a").otherwise("b")
    e = spark.range(200).select(F.concat(F.lit("e"), "id").alias("id"), kind.alias("kind"), F.create_map(F.lit("k"), F.floor(F.col("id") / 1000).cast("string")).alias("attrs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.edge_rule(e, "a", "b", "k", "k", "t").withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len({(r.src, r.dst) for r in got}) == len(got) == 10_000 and len({r.at for r in got}) > 1


def test_open_edges_without_their_times(spark):
    rows = [(i, f"n{i % 3}", f"n{i % 5}", "t", ("assert", "retract", "close", "assert")[i * 7 % 11 % 4], i % 10 / 10, 1 if i % 4 else -1, f"h{i % 2}") for i in range(200)]
    e = spark.createDataFrame(rows, "lsn long, src string, dst string, etype string, op string, confidence double, polarity int, hypothesis string")
    for n in (0, 30, 77, 1000):
        ends = lambda df: sorted((r.src, r.dst, r.etype, round(r.belief, 9)) for r in df.collect())
        assert ends(graph.open_edges(e, n)) == ends(graph.edges_at(e, n))
    plan = graph.open_edges(e, 77)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not re.search("Window|Join", plan)


def test_metrics_of_a_node_without_its_community(spark, tmp_path, monkeypatch):
    one = lambda **x: [x]
    li = [{"l_orderkey": i, "l_linenumber": 1, "l_suppkey": 1, "l_partkey": i, "l_returnflag": "A", "l_linestatus": "O", "l_discount": 0.1} for i in range(9)]
    sf = save(tmp_path, lineitem=li, nation=one(n_nationkey=5, n_regionkey=0), supplier=one(s_suppkey=1, s_nationkey=5), customer=one(c_custkey=1, c_nationkey=5), events=[event(0, 0, 1.0)])
    monkeypatch.setattr(graph, "components", None)
    same(spark, sf, "metrics_node_all", "lineitem", "nation", "supplier", "customer")


def test_histories_that_cross_batches():
    rows = [(g, n, op, f"{g}{a}", b and f"{g}{b}") for g in "pqr" for n, (op, a, b) in enumerate([("mention", "a", None), ("merge", "b", "c"), ("merge", "a", "b"), ("split", "c", None)])]
    batch = pa.RecordBatch.from_pylist([dict(zip(("grp", "lsn", "op", "a", "b"), r, strict=True)) for r in rows])
    for size in (1, 3, 5, 12):
        got = [tuple(r.values()) for b in entity.fold(batch.slice(i, size) for i in range(0, 12, size)) for r in b.to_pylist()]
        assert got == [x for i in range(0, 12, 4) for x in entity.history(r[1:] for r in rows[i : i + 4])] and len(got) == 21


def test_profiles_that_cross_batches():
    xs = [float(i * 37 % 61 + (300 if i % 50 == 49 else 0)) for i in range(400)]
    rows = [(name, i, x, i % 90 == 7, i % 70 == 9) for name in (None, "u", "v") for i, x in enumerate(xs)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("entity", "lsn", "x", "suspicious", "feedback"), r, strict=True)) for r in rows])
    alone = list(detectors.judged(r[1:] for r in rows[:400]))
    assert {s for _, _, s in alone} >= {"promoted", "outlier", "quarantined", "suspicious", "feedback"}
    for size in (1, 250, 1200):
        got = [tuple(r.values()) for b in detectors.fold_baselines((batch.slice(i, size) for i in range(0, 1200, size)), detectors.Baseline()) for r in b.to_pylist()]
        assert got == [(name, *r) for name in (None, "u", "v") for r in alone]
    for n in range(1, 129):
        assert detectors.quartiles(sorted(xs[:n])) == tuple(np.quantile(xs[:n], (0.25, 0.5, 0.75)))


def test_an_export_forks_nothing(spark, tmp_path):
    """Checked local files take a forked chmod each and leave a checksum behind; a second generation replaces some segments."""
    e, path = spark.createDataFrame([(i, f"e{i}", i << 16, "a", "s", "Note", "x", {}, [], None, None, None) for i in range(40)], EPISODE), f"file://{tmp_path}/lake"
    lake.export(e, path, 10)
    lake.export(e.where("lsn < 20"), path, 10, generation=1)
    assert lake.export(e, path, 10, generation=1) == {0: "current", 1: "current", 2: "superseded", 3: "superseded"}
    assert sorted((r.lsn, r.generation) for r in lake.CommitLog(spark, path).read().collect()) == [(i, 1) for i in range(40)]
    assert not list((tmp_path / "lake" / "data").rglob("*.crc"))


def test_counts_of_a_busy_key():
    began, n = time.time(), 40_000
    times, hits, counts = rules.counted([5, 7], [(10 + i, i) for i in range(n)], 1000, 3)
    assert hits == list(range(n)) and counts[:2] == [3, 4] and counts[-1] == 1001 == len(times) and time.time() - began < 10


def test_keys_share_calls_and_states(spark):
    """Far fewer calls than keys, over two batches, with keys apart."""
    import tempfile

    root = tempfile.mkdtemp(prefix="chronolith-")
    rows = [(f"k{i % 700}", i, i * 1000, (pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=i)).to_pydatetime()) for i in range(2800)]
    df = spark.createDataFrame(rows, "key string, lsn long, at long, ts timestamp")
    for n, part in enumerate((df.where("lsn < 1400"), df.where("lsn >= 1400"))):
        part.coalesce(1).write.parquet(f"{root}/in/{n}")
    s = rules.stream(spark, f"{root}/in/*", df.schema, files_per_trigger=1)
    rules.run_to_table(rules.count_stream(s, "key", "at", 1_500_000, 2, buckets=3), spark, f"{root}/out", f"{root}/state")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/out").select("lsn", "key", "matches").collect())
    assert got == [(i, f"k{i % 700}", min(i // 700, 2) + 1) for i in range(700, 2800)]
