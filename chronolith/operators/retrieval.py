"""Fusing ranked channels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.sources.shared import through

RRF = 60


def rrf(channels: list[DataFrame], k: int = RRF) -> DataFrame:
    """(lsn, score): sum of 1 / (k + best rank). channels: (lsn, rank), each cut to its own top."""
    rows = reduce(DataFrame.unionByName, (c.select("lsn", "rank", F.lit(i).alias("ch")) for i, c in enumerate(channels)))
    best = rows.groupBy("lsn", "ch").agg(F.min("rank").alias("rank"))
    return best.groupBy("lsn").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranked(df: DataFrame, *order) -> DataFrame:
    """Ranks 1.. of a channel that is cut to its top already."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def rerank(fused: DataFrame, head: int) -> DataFrame:
    """fused (lsn, distance, bm25, activation), any null: 1/(1+d) + .5 b/(1+b) + .3 max(a,-5)/5 + .1 lsn/head."""
    near = F.when(F.col("distance").isNotNull(), 1 / (1 + F.col("distance"))).otherwise(0.0)
    text = F.when(F.col("bm25").isNotNull(), F.col("bm25") / (1 + F.col("bm25"))).otherwise(0.0)
    act = F.when(F.col("activation").isNotNull(), F.greatest(F.col("activation"), F.lit(-5.0)) / 5).otherwise(0.0)
    return fused.select("lsn", (near + 0.5 * text + 0.3 * act + 0.1 * F.col("lsn") / max(1, head)).alias("score"))


def fuse(graph: DataFrame, vector: DataFrame, text: DataFrame, k: int, head: int, weights=(1.0, 1.0, 1.0), decay: float = 0.0005) -> DataFrame:
    """(id, score) of the k best. Channels (id, lsn, score), each over its greatest score; a missing channel counts 0; the
    mean decays with age. A union with one aggregate stands for the full outer join."""
    names = ("g", "v", "t")
    rows = reduce(DataFrame.unionByName, (c.select("id", "lsn", *(F.col("score").alias(n) if n == m else F.lit(None).cast("double").alias(n) for n in names)) for m, c in zip(names, (graph, vector, text), strict=True)))
    one = through(rows.groupBy("id").agg(F.max("lsn").alias("lsn"), *(F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names)), "fused")  # read twice
    top = one.agg(*(F.max(n).alias(f"max_{n}") for n in names))
    part = lambda n: F.when(F.col(f"max_{n}") > 0, F.col(n) / F.when(F.col(f"max_{n}") > 0, F.col(f"max_{n}"))).otherwise(0.0)
    mean = sum(w * part(n) for w, n in zip(weights, names, strict=True)) / sum(weights)
    score = mean * F.exp(-decay * (head - F.col("lsn")))
    return one.join(F.broadcast(top)).select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def channel_mrr(examples: DataFrame) -> DataFrame:
    """Mean reciprocal average rank of the relevant candidate per channel. examples: (example, channel, score, relevant)."""
    gold = examples.where("relevant").select("example", "channel", F.col("score").alias("target"))
    r = examples.join(gold, ["example", "channel"]).groupBy("example", "channel").agg(F.count_if(F.col("score") > F.col("target")).alias("higher"), F.count_if(F.col("score") == F.col("target")).alias("equal"))
    return r.groupBy("channel").agg(F.avg(1 / (F.col("higher") + (F.col("equal") + 1) / 2)).alias("mrr"))


def activation(access: DataFrame, now: int, d: float = 0.5, recent: int = 8) -> DataFrame:
    """(id, score): base-level activation, exact for the last accesses, closed-form for the tail. access: (id, at) in
    seconds. The last times are kept by a bounded window, older ones only counted."""
    by = W.partitionBy("id").orderBy(F.col("at").desc())
    a = access.withColumn("r", F.row_number().over(by)).withColumn("age", F.greatest(F.lit(now) - F.col("at"), F.lit(1)).cast("double"))
    g = a.groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("r") <= recent, F.pow("age", F.lit(-d)))).alias("mass"),
        F.max(F.when(F.col("r") <= recent, F.col("age"))).alias("h"), F.max("age").alias("life"),
    )
    low, high = F.least("h", "life"), F.greatest(F.col("life"), F.col("h") + 1)
    tail = (F.pow(high, F.lit(1 - d)) - F.pow(low, F.lit(1 - d))) / (1 - d) if abs(1 - d) > 1e-12 else F.ln(high) - F.ln(low)
    extra = F.when(F.col("n") > recent, F.greatest((F.col("n") - recent) * tail / (high - low), F.lit(0.0))).otherwise(0.0)
    return g.select("id", F.ln(F.col("mass") + extra).alias("score"))


RECALL_N = 200


def production_recall(bm25: DataFrame, substring: DataFrame, active: DataFrame, k: int, head: int, n: int = RECALL_N) -> DataFrame:
    """(lsn, score) of the k best of three channels: bm25 (lsn, score), substring counts (lsn, tf), activation (lsn, score), each
    cut to its n best and written once, as ranks and signals both ask for it. Ranks fuse to at most n candidates; one that BM25
    has not measured takes its count as a signal below the weakest measured one: floor * tf / (most + 1). Sides are n rows at
    most, so nothing large is ever joined."""
    text = through(ranked(bm25.orderBy(F.col("score").desc(), "lsn").limit(n), F.col("score").desc(), "lsn").select("lsn", "rank", F.col("score").alias("b")), "recall")
    count = through(ranked(substring.orderBy(F.col("tf").desc(), "lsn").limit(n), F.col("tf").desc(), "lsn").select("lsn", "rank", "tf"), "recall")
    act = through(ranked(active.orderBy(F.col("score").desc(), "lsn").limit(n), F.col("score").desc(), "lsn").select("lsn", "rank", F.col("score").alias("a")), "recall")
    fused = rrf([text.select("lsn", "rank"), count.select("lsn", "rank"), act.select("lsn", "rank")]).orderBy(F.col("score").desc(), "lsn").limit(n).select("lsn")
    floor, most = text.agg(F.min("b").alias("floor")), count.agg(F.max("tf").alias("most"))
    j = fused.join(text.select("lsn", "b"), "lsn", "left").join(count.select("lsn", "tf"), "lsn", "left").join(act.select("lsn", "a"), "lsn", "left").join(F.broadcast(floor)).join(F.broadcast(most))
    calm = F.when(F.col("floor") > 0, F.col("floor") * F.col("tf") / (F.col("most") + 1)).otherwise(F.col("tf").cast("double"))
    signals = j.select("lsn", F.lit(None).cast("double").alias("distance"), F.coalesce("b", calm).alias("bm25"), F.col("a").alias("activation"))
    return rerank(signals, head).orderBy(F.col("score").desc(), "lsn").limit(k)


def feedback(spark, query_id: str, chosen: str, outcome: float, lsn: int) -> DataFrame:
    """An episode that records which answer of a query was taken; appended, it trains rerankers later."""
    from chronolith.sources.adapters import episode

    attrs = F.create_map(F.lit("query_id"), F.lit(query_id), F.lit("chosen"), F.lit(chosen), F.lit("outcome"), F.lit(str(outcome)))
    return episode(spark.range(1), lsn=F.lit(lsn), id=F.lit(f"f{lsn}"), agent_id=F.lit("retrieval"), kind=F.lit("RetrievalFeedback"), attrs=attrs)
