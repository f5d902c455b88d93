"""Every query of the catalogue against its SQL at the smallest scale."""

import os

import duckdb
import pytest

from chronolith.plans import catalogue, extended  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Literals that name nodes of the larger scale.
ABSENT = {"edge_hypotheses", "simulate_remove_then_traverse", "shortest_path", "why_until_chain", "why_trace", "provenance", "entity_cluster", "traverse_bfs"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    """-0.0 and 0.0 are one value."""
    return repr(v + 0.0 if isinstance(v, float) else v)


def rows(data, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - ABSENT))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in catalogue.SQL:
        want = duck.execute(catalogue.SQL[name])
        assert rows(got, df.columns) == rows(want.fetchall(), [d[0] for d in want.description])
    else:
        assert got and all(len(r) == len(df.columns) for r in got)
