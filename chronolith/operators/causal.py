"""Ancestry over parents: PROVENANCE, WHY and WHY ... UNTIL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators.graph import cutter


def links(episodes: DataFrame, bound: int | None = None) -> DataFrame:
    """(id, parent, pos) of parents that the snapshot holds."""
    e = episodes if bound is None else episodes.where(F.col("lsn") < bound)
    up = e.select("id", F.posexplode("parents").alias("pos", "parent"))
    return up.join(e.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", "parent", "pos")


def provenance(episodes: DataFrame, ident: str) -> DataFrame:
    return episodes.where(F.col("id") == ident).select(F.explode("parents").alias("parent"))


def why(episodes: DataFrame, ident: str, depth: int = 64, bound: int | None = None, stop_when_empty: bool = True) -> DataFrame:
    """(id, depth, root, causes) of ident and its ancestors at their least depth; a root has no cause within the snapshot. Levels
    are joined one by one; the loop ends where nothing new is found."""
    up = cutter(episodes.sparkSession)(links(episodes, bound).select("id", "parent").distinct())
    here = episodes if bound is None else episodes.where(F.col("lsn") < bound)
    front = here.where(F.col("id") == ident).select("id", F.lit(0).alias("depth"))
    seen = front
    for d in range(1, depth + 1):
        nxt = up.join(front.select("id"), "id", "left_semi").select(F.col("parent").alias("id")).distinct()
        front = nxt.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d))
        if stop_when_empty and not front.take(1):
            break
        seen = seen.unionByName(front)
    causes = up.groupBy("id").agg(F.array_sort(F.collect_list("parent")).alias("causes"))
    return seen.join(causes, "id", "left").select("id", "depth", F.col("causes").isNull().alias("root"), F.coalesce("causes", F.expr("cast(array() as array<string>)")).alias("causes"))


def why_until(episodes: DataFrame, ident: str, cause: str, depth: int = 64, bound: int | None = None) -> DataFrame:
    """The shortest chain from ident to the cause; of equals, the first by the order of parents. No row: not linked."""
    up = cutter(episodes.sparkSession)(links(episodes, bound).groupBy("id", "parent").agg(F.min("pos").alias("pos")))
    here = episodes if bound is None else episodes.where(F.col("lsn") < bound)
    front = here.where(F.col("id") == ident).select("id", F.array("id").alias("chain"), F.expr("cast(array() as array<int>)").alias("turns"))
    seen = front.select("id")
    for _ in range(depth + 1):
        found = front.where(F.col("id") == cause)
        if found.take(1):
            return found.select(F.array_join("chain", ">").alias("chain"), (F.size("chain") - 1).alias("hops"))
        step = up.join(front, "id").select(F.col("parent").alias("id"), F.concat("chain", F.array("parent")).alias("chain"), F.concat("turns", F.array("pos")).alias("turns"))
        front = step.groupBy("id").agg(F.min(F.struct("turns", "chain")).alias("x")).select("id", "x.chain", "x.turns").join(seen, "id", "left_anti")
        if not front.take(1):
            break
        seen = seen.unionByName(front.select("id"))
    return episodes.sparkSession.createDataFrame([], "chain string, hops int")


def broken_parents(episodes: DataFrame) -> DataFrame:
    up = episodes.select("id", F.explode("parents").alias("parent"))
    return up.join(episodes.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent")
