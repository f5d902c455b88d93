"""Communities by weighted modularity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.graph import components

SCHEMA = "node string, community string"


def weighted(edges: DataFrame) -> DataFrame:
    """Belief summed per unordered pair, without loops."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "belief")
    return e.groupBy("a", "b").agg(F.sum("belief").alias("w"))


def louvain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Local moves in order of node, then aggregation, until modularity stands; parts that fell apart are split, and a
    partition worse than the connected component is given up for it. Deterministic; a community is named by its least node."""
    total = float(pdf.w.sum())
    nodes = sorted(set(pdf.a) | set(pdf.b))
    whole = {n: nodes[0] for n in nodes}
    if total <= 0:
        return pd.DataFrame(sorted(whole.items()), columns=["node", "community"])
    near: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b, w in zip(pdf.a, pdf.b, pdf.w, strict=True):
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    member = {n: n for n in nodes}
    level = {n: dict(near[n]) for n in nodes}
    while True:
        degree = {n: sum(level[n].values()) for n in level}
        part = {n: n for n in level}
        weight = dict(degree)
        moved = True
        while moved:  # every move raises modularity by more than the margin, so moves end
            moved = False
            for n in sorted(level):
                mine = part[n]
                weight[mine] -= degree[n]
                links: dict[str, float] = {}
                for m, w in level[n].items():
                    if m != n:
                        links[part[m]] = links.get(part[m], 0.0) + w
                gain = lambda c: links.get(c, 0.0) - weight[c] * degree[n] / (2 * total)  # noqa: B023, E731
                best = max(sorted(links) or [mine], key=gain)
                if gain(best) <= gain(mine) + 1e-12:
                    best = mine
                part[n] = best
                weight[best] += degree[n]
                moved |= best != mine
        if len(set(part.values())) == len(level):
            break
        member = {n: part[c] for n, c in member.items()}
        new: dict[str, dict[str, float]] = {}
        for n, links in level.items():
            row = new.setdefault(part[n], {})
            for m, w in links.items():
                row[part[m]] = row.get(part[m], 0.0) + w
        level = new
    # Connected parts of each community.
    name: dict[str, str] = {}
    for n in nodes:
        if n in name:
            continue
        stack = [n]
        name[n] = n
        while stack:
            x = stack.pop()
            for y in near[x]:
                if y not in name and member[y] == member[x]:
                    name[y] = n
                    stack.append(y)
    if modularity(pdf, name) < modularity(pdf, whole):
        name = whole
    return pd.DataFrame(sorted(name.items()), columns=["node", "community"])


def modularity(pdf: pd.DataFrame, of: dict) -> float:
    total = float(pdf.w.sum())
    inside = sum(w for a, b, w in zip(pdf.a, pdf.b, pdf.w, strict=True) if of[a] == of[b])
    deg: dict = {}
    for a, b, w in zip(pdf.a, pdf.b, pdf.w, strict=True):
        deg[of[a]] = deg.get(of[a], 0.0) + w
        deg[of[b]] = deg.get(of[b], 0.0) + w
    return inside / total - sum((d / (2 * total)) ** 2 for d in deg.values())


def modular(edges: DataFrame) -> DataFrame:
    """(node, community), each connected component on its own: modularity never joins two."""
    w = weighted(edges)
    c = components(w.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    run = lambda pdf: louvain(pdf)
    return w.join(c.withColumnRenamed("node", "a"), "a").select("a", "b", "w", "community").groupBy("community").applyInPandas(run, SCHEMA)
