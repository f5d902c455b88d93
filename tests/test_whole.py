"""Queries over whole tables against brute force on small fixtures."""

import duckdb
import pandas as pd
import pytest

from chronolith.operators import community
from chronolith.plans import catalogue
from tests.test_catalogue import rows as table


def save(path, **tables):
    for name, rows in tables.items():
        pd.DataFrame(rows).to_parquet(path / f"{name}.parquet", index=False, coerce_timestamps="us")
    return str(path)


def partitions(nodes):
    if not nodes:
        yield []
        return
    for p in partitions(nodes[1:]):
        for i in range(len(p)):
            yield [*p[:i], [nodes[0], *p[i]], *p[i + 1 :]]
        yield [[nodes[0]], *p]


LINKS = [[(1, 1), (1, 2), (2, 1), (2, 2), (2, 5), (4, 5), (4, 6), (5, 5), (5, 6)], [(9, 800), (10, 800)]]


@pytest.fixture()
def orders(tmp_path):
    # Order keys of one class modulo 997 differ by a multiple of it.
    rows = [(c, k + 997 * n) for n, (c, k) in enumerate(x for part in LINKS for x in part)]
    return save(tmp_path, orders=[{"o_orderkey": k, "o_custkey": c} for c, k in rows])


def test_leiden_takes_all_orders_and_finds_the_best_partition(spark, orders):
    got = {r.node: r.community for r in catalogue.QUERIES["community_leiden"](spark, orders).collect()}
    want = {}
    for part in LINKS:
        w = pd.DataFrame([(f"c{c}", f"k{k}", 0.5) for c, k in part], columns=["a", "b", "w"])
        of = lambda p: {n: min(g) for g in p for n in g}
        want |= max(map(of, partitions(sorted({*w.a, *w.b}))), key=lambda x, w=w: community.modularity(w, x))
    assert got == want and len(set(want.values())) == 3


def test_components_of_all_orders(spark, orders):
    got = {r.node: r.community for r in catalogue.QUERIES["community_components_all"](spark, orders).collect()}
    assert got == {n: "c1" if i == 0 else "c10" for i, part in enumerate(LINKS) for c, k in part for n in (f"c{c}", f"k{k}")}


EDGE_ALL = ["edge_match_all", "edge_match_typed_all", "neighbors_all", "edge_hypotheses_all", "traverse_bfs_all", "metrics_node_all", "edge_intervals_all", "edge_belief_all", "node_metrics_all", "degree_all", "spreading_activation_all", "edge_decay_all", "decide_actions_all", "join_interval_alive_all"]


@pytest.fixture(scope="module")
def late(tmp_path_factory):
    """A log of which most lies beyond the fixed bounds."""
    li = [{"l_orderkey": 7 * i, "l_linenumber": 1 + i % 3, "l_suppkey": 1 + i % 9, "l_partkey": i % 11, "l_returnflag": "ARN"[i % 5 % 3], "l_linestatus": "FO"[i % 4 > 0], "l_discount": i % 11 / 100} for i in range(1, 6000)]
    return save(
        tmp_path_factory.mktemp("late"), lineitem=li, nation=[{"n_nationkey": i, "n_regionkey": i // 6, "n_name": f"N{i}"} for i in range(25)], supplier=[{"s_suppkey": i, "s_nationkey": i % 25} for i in range(1, 10)],
        customer=[{"c_custkey": i, "c_nationkey": i % 25} for i in range(1, 60)], events=[{"event_id": 0, "user_id": 0, "event_type": "view", "value": 1.0, "ts": pd.Timestamp("2024-01-01"), "props": "{}"}],
    )


@pytest.mark.parametrize("name", EDGE_ALL)
def test_reports_take_the_whole_log(spark, late, name):
    df = catalogue.QUERIES[name](spark, late)
    duck = duckdb.connect()
    for t in ("lineitem", "nation", "supplier", "customer"):
        duck.execute(f"create view {t} as select * from '{late}/{t}.parquet'")
    want = duck.execute(catalogue.SQL[name])
    assert table([tuple(r) for r in df.collect()], df.columns) == table(want.fetchall(), [d[0] for d in want.description])


def test_intervals_of_late_edges(spark, late):
    seen = catalogue.QUERIES["edge_intervals_all"](spark, late).agg({"from_lsn": "max"}).first()[0]
    assert seen > 400_000 > 5 * catalogue.BOUND - 1


def test_joins_and_groups_of_late_events(spark, tmp_path):
    ev = [(i, i % 3, ("click", "purchase", "signup", "view")[i * 7 % 11 % 4], i % 5) for i in range(2900, 3100)]
    rows = [{"event_id": i, "user_id": u, "event_type": t, "value": 1.0, "ts": pd.Timestamp("2024-01-01"), "props": f'{{"k": {k}}}'} for i, u, t, k in ev]
    one = [{"x": 1}]
    sf = save(tmp_path, events=rows, **dict.fromkeys(["orders", "lineitem", "customer", "supplier", "nation", "region", "part"], one))
    got = lambda name: sorted(map(tuple, catalogue.QUERIES[name](spark, sf).collect()))
    pairs = [(a, b) for a in ev for b in ev]
    assert got("join_edge_rule_all") == sorted((f"e{a[0]}", f"e{b[0]}", "custom:same_k") for a, b in pairs if a[2] == "purchase" and b[2] == "signup" and a[3] == b[3])
    assert got("self_join_all") == sorted((a[0], b[0]) for a, b in pairs if a[2] == "click" and b[2] == "purchase" and a[1] == b[1] and a[0] < b[0] <= a[0] + 50)
    groups = {}
    for _, u, t, _ in ev:
        groups.setdefault((f"user-{u}", t), []).append(len(t))
    assert got("group_sum_all") == sorted((*g, len(x), sum(x)) for g, x in groups.items())
