"""Nearest neighbours, exact: distances are columns of a scan over (lsn, embedding), and k rows are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions import manifold as M

DIST = {"DIST_EUC": ("euc", M.euclid), "DIST_HYP": ("hyp", M.poincare), "DIST_SPH": ("sph", M.sphere)}


def distance(kind: str, query: list[float]) -> Column:
    """DIST_* of the row's embedding; null if it has none or the dimensions differ."""
    q = M.vec(query)
    e = F.col("embedding")
    if kind == "DIST_PRODUCT":
        return M.product(e, q)
    part, f = DIST[kind]
    return F.when(F.size(e[part]) == len(query), f(e[part], q))


def nearest(episodes: DataFrame, query: list[float], k: int, kind: str = "DIST_EUC", bound: int | None = None, retired: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """(lsn, distance) of the k nearest rows; retired (lsn of the vector, at): tombstones that the bound sees."""
    e = episodes if bound is None else episodes.where(F.col("lsn") < bound)
    if where is not None:
        e = e.where(where)
    if retired is not None:
        gone = retired if bound is None else retired.where(F.col("at") < bound)
        e = e.join(gone.select("lsn"), "lsn", "left_anti")
    d = e.select("lsn", distance(kind, query).alias("distance")).where("distance is not null")
    return d.orderBy("distance", "lsn").limit(k)


def einstein_centroid(df: DataFrame, by: str, vec: str) -> DataFrame:
    """(by, pos, value): sum(gamma x) / sum(gamma) per coordinate; aggregated before it is shuffled."""
    e = df.select(by, M.gamma(F.col(vec)).alias("g"), F.posexplode(vec).alias("pos", "x"))
    return e.groupBy(by, "pos").agg((F.sum(F.col("g") * F.col("x")) / F.sum("g")).alias("value"))


def signature_fit(pairs: DataFrame, grid: list[tuple[float, float, float]]) -> DataFrame:
    """The weights of a grid with the least mean relative distortion. pairs: (target, dh, ds, de) distances per component.
    The grid is a constant array of the scan, not a join."""
    w = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in grid))
    e = pairs.where("target > 0").select("target", "dh", "ds", "de", F.explode(w).alias("w"))
    got = F.sqrt(F.col("w.a") * F.col("dh") ** 2 + F.col("w.b") * F.col("ds") ** 2 + F.col("w.c") * F.col("de") ** 2)
    m = e.groupBy("w").agg(F.avg(F.abs(got - F.col("target")) / F.col("target")).alias("distortion"))
    return m.select(F.col("w.a").alias("a"), F.col("w.b").alias("b"), F.col("w.c").alias("c"), "distortion").orderBy("distortion", "a", "b", "c").limit(1)
