"""Behavioural baselines, incidents, fused risk and telemetry health."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FUSION = {"rule": 0.35, "behavioral": 0.25, "graph": 0.25, "threat_intel": 0.15}


@dataclass(frozen=True)
class Baseline:
    """When a profile is trusted, what it may learn from, and how much of it."""

    support: int = 20
    delay: int = 10
    quarantine: int = 5
    rate: int = 100
    rate_window: int = 1024
    outlier: float = 4.0
    feedback_weight: float = 0.25
    kept: int = 128
    shadow_only: bool = False


def quartiles(values: list[float]) -> tuple[float, float, float]:
    """np.quantile(values, (0.25, 0.5, 0.75)) of sorted values, in its own arithmetic."""
    out = []
    for p in (0.25, 0.5, 0.75):
        at = (len(values) - 1) * p
        i = int(at)
        a, b, t = values[i], values[min(i + 1, len(values) - 1)], at - i
        out.append(b - (b - a) * (1 - t) if t >= 0.5 else a + (b - a) * t)
    return tuple(out)


def _score(n: int, w: float, mean: float, m2: float, last: list[float], x: float, policy: Baseline) -> float | None:
    """The greater of the z-score and the distance from the median in robust deviations; nothing below the support."""
    if n < policy.support:
        return None
    sd = math.sqrt(m2 / w) if w > 0 else 0.0
    z = abs(x - mean) / sd if sd > 0 else (0.0 if x == mean else policy.outlier + 1)
    q1, med, q3 = quartiles(last) if last[-1] == last[-1] else (math.nan,) * 3  # NaN stands last
    if q3 - q1 > 1e-12:
        return float(max(z, abs(x - med) / ((q3 - q1) / 1.349)))
    return float(max(z, 0.0 if abs(x - med) <= 1e-12 else policy.outlier + 1))


def fold_baseline(pdf: pd.DataFrame, policy: Baseline = Baseline()) -> pd.DataFrame:
    """judged() of one entity's values, whatever their order: (entity, lsn, score, state)."""
    pdf = pdf.sort_values("lsn", kind="stable")
    flags = [pdf[c].fillna(False).astype(bool) if c in pdf else [False] * len(pdf) for c in ("suspicious", "feedback")]
    out = judged(zip(pdf["lsn"], pdf["x"], *flags, strict=True), policy)
    return pd.DataFrame([(pdf["entity"].iloc[0], *r) for r in out], columns=["entity", "lsn", "score", "state"])


def judged(rows: Iterable[tuple], policy: Baseline = Baseline()) -> Iterator[tuple]:
    """(lsn, x, suspicious, feedback) of one entity in order of lsn: (lsn, score, state). A shadow profile learns until it has support and
    delay observations and is then promoted; a trusted one scores what comes, learns from what isn't an outlier, and after
    an outlier or a suspicious event sits out the quarantine. Trusted feedback learns with less weight and ends quarantine;
    a rate limits what is learned per stretch of the log. Optional columns: suspicious, feedback."""
    n, w, mean, m2 = 0, 0.0, 0.0, 0.0
    ages: deque[float] = deque()
    last: list[float] = []  # the same in order of value
    trusted, wait, seen = False, 0, None
    window, used = None, 0
    for lsn, x, suspicious, feedback in rows:
        score = _score(n, w, mean, m2, last, x, policy) if trusted else None
        learn = False
        if seen == lsn:
            state = "duplicate"
        elif suspicious and not feedback:
            state = "suspicious"
            wait = policy.quarantine if trusted else wait
        else:
            if window is None or lsn - window >= policy.rate_window:
                window, used = lsn, 0
            if used >= policy.rate:
                state = "rate_limited"
            else:
                used += 1
                if trusted and wait > 0 and not feedback:
                    wait, state = wait - 1, "quarantined"
                elif trusted and score is not None and score >= policy.outlier and not feedback:
                    wait, state = policy.quarantine, "outlier"
                else:
                    wait = 0 if feedback else wait
                    learn, state = True, "feedback" if feedback else "updated" if trusted else "warming"
        seen = lsn
        if learn:
            add = policy.feedback_weight if feedback else 1.0
            n, w = n + 1, w + add
            d = x - mean
            mean += add * d / w
            m2 += add * d * (x - mean)
            ages.append(x)
            insort(last, x, key=_place)
            if len(ages) > policy.kept:
                last.pop(bisect_left(last, _place(ages.popleft()), key=_place))
            if not trusted and not policy.shadow_only and n >= policy.support + policy.delay:
                trusted, state = True, "promoted"
        yield int(lsn), score, state


def _place(x: float) -> tuple[bool, float]:
    """Of a value in order, NaN last."""
    return (False, x) if x == x else (True, 0.0)


def fold_baselines(batches: Iterator[pa.RecordBatch], policy: Baseline) -> Iterator[pa.RecordBatch]:
    """judged() of batches (entity, lsn, x, suspicious, feedback) that are sorted by entity and lsn; only the profile of the
    entity that is open outlives a batch."""
    schema = pa.schema([("entity", pa.string()), ("lsn", pa.int64()), ("score", pa.float64()), ("state", pa.string())])
    entity, feed, got = object(), deque(), iter(())
    for batch in batches:
        names = batch.column("entity").to_pylist()
        out = []
        for name, *row in zip(names, *(batch.column(c).to_pylist() for c in ("lsn", "x", "suspicious", "feedback")), strict=True):
            if name != entity:
                entity, feed = name, deque()
                got = judged(iter(feed.popleft, None), policy)
            feed.append(row)
            out.append(next(got))
        lsn, score, state = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((names, lsn, score, state), schema, strict=True)], schema=schema)


def baselines(events: DataFrame, entity: str, value: str, policy: Baseline = Baseline(), suspicious: Column | None = None, feedback: Column | None = None) -> DataFrame:
    run = lambda batches: fold_baselines(batches, policy)
    no = F.lit(False)
    flag = lambda c: no if c is None else F.coalesce(c, no)
    e = events.select(F.col(entity).cast("string").alias("entity"), F.col("lsn").cast("long").alias("lsn"), F.col(value).cast("double").alias("x"), flag(suspicious).alias("suspicious"), flag(feedback).alias("feedback")).where("x is not null")
    return e.repartition("entity").sortWithinPartitions("entity", "lsn").mapInArrow(run, "entity string, lsn long, score double, state string")


def incidents(signals: DataFrame, subject: str, cooldown: int = 1000) -> DataFrame:
    """Signals of a subject with gaps of at most `cooldown` are one incident: a running count of larger gaps."""
    w = W.partitionBy(subject).orderBy("lsn")
    s = signals.withColumn("new", F.coalesce((F.col("lsn") - F.lag("lsn").over(w) > cooldown).cast("int"), F.lit(0)))
    s = s.withColumn("incident", F.sum("new").over(w))
    return s.groupBy(subject, "incident").agg(F.count(F.lit(1)).alias("signals"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def risk(scores: DataFrame, subject: str) -> DataFrame:
    """(subject, channel, score) to the weighted sum of each channel's greatest score; a gate asks for .9 and two channels."""
    best = [F.coalesce(F.max(F.when(F.col("channel") == c, F.col("score"))), F.lit(0.0)).alias(c) for c in FUSION]
    g = scores.groupBy(subject).agg(*best, F.count_distinct("channel").alias("detectors"))
    fused = sum((F.col(c) * w for c, w in FUSION.items()), F.lit(0.0))
    top = F.greatest(*FUSION)
    return g.select(subject, *FUSION, "detectors", fused.alias("fused"), ((top >= 0.9) & (F.col("detectors") >= 2)).alias("gate"))


def sensor_health(windows: DataFrame) -> DataFrame:
    """(sensor, datasource, start, end, received, parsed, normalized, expected) to coverage, completeness, gaps, trust and a
    status ladder per sensor, in basis points."""
    w = W.partitionBy("sensor").orderBy("start")
    x = windows.withColumn("gap", F.coalesce(F.greatest(F.col("start") - F.lag("end").over(w), F.lit(0)), F.lit(0)))
    g = x.groupBy("sensor", "datasource").agg(F.sum("received").alias("received"), F.sum("normalized").alias("normalized"), F.sum("expected").alias("expected"), F.sum("gap").alias("gap"), F.max("end").alias("seen"))
    bp = lambda n, d: F.when(F.col(d) > 0, F.least(F.floor(F.col(n) * 10000 / F.when(F.col(d) > 0, F.col(d))), F.lit(10000))).otherwise(0).cast("long")
    g = g.withColumns({"coverage": bp("received", "expected"), "completeness": bp("normalized", "received")})
    status = F.when(F.col("received") == 0, "silent").when(F.col("completeness") < 5000, "failing").when((F.col("coverage") < 9000) | (F.col("completeness") < 9000), "degraded").otherwise("healthy")
    return g.select("sensor", "datasource", "coverage", "completeness", "gap", "seen", F.least("coverage", "completeness").alias("trust"), status.alias("status"))


def security_edges(events: DataFrame) -> DataFrame:
    """(src, dst, etype) that a security event implies: one projection and one generator."""
    rules = [("principal", "host", "logged_on"), ("principal", "src", "came_from"), ("host", "dst", "connected_to"), ("process", "host", "ran_on"), ("principal", "process", "started"), ("src", "dst", "reached")]
    e = F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("etype"))) for a, b, t in rules))
    return events.select("lsn", F.explode(F.array_compact(e)).alias("x")).select("lsn", "x.src", "x.dst", "x.etype")


def health_at(windows: DataFrame, bound: int, now: int, horizon: int) -> DataFrame:
    """sensor_health of the windows that begin before the bound, with freshness: how much of the horizon is left since the
    sensor was last seen, in basis points. A stale sensor is silent, whatever it sent before; trust is the least of the three."""
    h = sensor_health(windows.where(F.col("start") < bound))
    age = F.greatest(F.lit(now) - F.col("seen"), F.lit(0))
    fresh = F.greatest(F.floor((F.lit(horizon) - age) * 10000 / horizon), F.lit(0)).cast("long")
    return h.withColumn("freshness", fresh).withColumns({"trust": F.least("trust", "freshness"), "status": F.when(F.col("freshness") == 0, "silent").otherwise(F.col("status"))})


def correlate(signals: DataFrame, related: DataFrame | None = None, window: int = 100, cooldown: int = 1000) -> DataFrame:
    """(signal_id, incident) of signals (signal_id, lsn, subject, evidence array): signals that share a subject or a piece of
    evidence within the cooldown are one incident, and so are those of subjects that the graph relates (src, dst) within the
    window. Links join each signal to the one before it under the same key, so no key's signals are paired."""
    from chronolith.operators.graph import components

    one = signals.select("signal_id", "lsn", F.concat(F.lit("s:"), "subject").alias("key")).where("key is not null")
    proof = signals.select("signal_id", "lsn", F.explode("evidence").alias("key")).withColumn("key", F.concat(F.lit("e:"), "key"))

    def chained(rows: DataFrame, gap: int) -> DataFrame:
        w = W.partitionBy("key").orderBy("lsn", "signal_id")
        x = rows.distinct().withColumn("src", F.lag("signal_id").over(w)).withColumn("was", F.lag("lsn").over(w))
        return x.where((F.col("src") != F.col("signal_id")) & (F.col("lsn") - F.col("was") <= gap)).select("src", F.col("signal_id").alias("dst"))

    links = chained(one.unionByName(proof), cooldown)
    if related is not None:
        # A relation is a key of its own; neighbours under it within the window are linked.
        pair = related.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        ends = pair.select(F.concat_ws(">", "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("subject"))
        links = links.unionByName(chained(signals.join(ends, "subject").select("signal_id", "lsn", F.concat(F.lit("g:"), "key").alias("key")), window))
    c = components(links).withColumnRenamed("node", "signal_id")
    return signals.select("signal_id").distinct().join(c, "signal_id", "left").select("signal_id", F.coalesce("community", "signal_id").alias("incident"))
