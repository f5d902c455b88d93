"""Connected components by alternating stars, JVM-side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import Workspace


def components(edges: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, component) of every node of edges (a, b); component: the smallest node that can be reached. Each round turns
    stars into stars of smaller centres, with the centres found by pre-aggregation; rounds grow with the logarithm of the
    components' diameter, and each is a table in the shared folder. Edges with a null end and loops are ignored; repeats
    don't matter."""
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, said, i = ws.save(e, f"{name}-0"), None, 0
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        i += 1
        e = ws.save(small, f"{name}-{i}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        ws.drop(f"{name}-{i - 1}")
        if now == said:
            break
        said = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
