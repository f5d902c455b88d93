"""Rules over the graph (DECIDE) and learning their threshold from feedback (ADAPT)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.operators.graph import metrics
from chronolith.sources.shared import through

ANOMALY, FRAUD, DEFAULT, STRIPS = 1.5, 0.7, 1.5, 1024


def propose(edges: DataFrame, anomaly: float = ANOMALY, fraud: float = FRAUD, fraud_type: str = "fraud_partner") -> DataFrame:
    hubs = metrics(edges).where(F.col("anomaly") >= anomaly).select(F.concat(F.lit("flag_anomaly:"), "node").alias("action_id"), F.lit("flag_anomaly").alias("rule"), F.col("node").alias("subject"))
    bad = edges.where((F.col("etype") == fraud_type) & (F.col("belief") >= fraud)).select(F.concat(F.lit("flag_fraud:"), "src", F.lit("->"), "dst").alias("action_id"), F.lit("flag_fraud").alias("rule"), F.col("src").alias("subject"))
    return hubs.unionByName(bad).dropDuplicates(["action_id"])


def decide(edges: DataFrame, done: DataFrame, **limits) -> DataFrame:
    """Proposals whose action_id the whole log doesn't hold yet. done: (action_id). The edges are worked out once, for both rules."""
    return propose(through(edges.select("src", "dst", "etype", "belief"), "edges"), **limits).join(done.select("action_id"), "action_id", "left_anti")


def adapt(feedback: DataFrame) -> DataFrame:
    """The score from which flags would have had the best F1. feedback: (score, confirmed). Samples are grouped by score,
    and the running sums are taken within STRIPS stretches of the scale side by side, onto the totals of the stretches
    above, of which there are few. Ties take the lowest threshold."""
    by = feedback.groupBy("score").agg(F.sum(F.col("confirmed").cast("long")).alias("good"), F.count(F.lit(1)).alias("all"))
    total = feedback.agg(F.sum(F.col("confirmed").cast("long")).alias("positives"), F.min("score").alias("lo"), F.max(F.when(~F.isnan("score"), F.col("score"))).alias("hi"))
    by = by.where(~F.isnan("score")).join(F.broadcast(total))
    by = by.withColumn("strip", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("score") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * STRIPS)).otherwise(0).cast("long"))
    above = by.groupBy("strip").agg(F.sum("good").alias("g"), F.sum("all").alias("a"))
    over = W.orderBy(F.col("strip").desc()).rowsBetween(W.unboundedPreceding, -1)
    above = above.select("strip", F.coalesce(F.sum("g").over(over), F.lit(0)).alias("g"), F.coalesce(F.sum("a").over(over), F.lit(0)).alias("a"))
    down = W.partitionBy("strip").orderBy(F.col("score").desc())
    run = by.withColumn("t", F.sum("good").over(down)).withColumn("m", F.sum("all").over(down)).join(F.broadcast(above), "strip").select("score", (F.col("t") + F.col("g")).alias("tp"), (F.col("m") + F.col("a")).alias("n"), "positives")
    p, r = F.col("tp") / F.col("n"), F.when(F.col("positives") > 0, F.col("tp") / F.when(F.col("positives") > 0, F.col("positives"))).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / F.when(p + r > 0, p + r)).otherwise(0.0)
    best = run.select("score", p.alias("precision"), r.alias("recall"), f1.alias("f1")).withColumn("key", F.struct(F.round("f1", 9).alias("a"), (-F.col("score")).alias("b")))
    one = best.agg(F.max_by(F.struct("score", "precision", "recall", "f1"), "key").alias("x"))
    return one.select(F.coalesce("x.score", F.lit(DEFAULT)).alias("threshold"), "x.precision", "x.recall", "x.f1")
