"""Reports over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronolith.functions.scalars import ts_ms


def field_values(episodes: DataFrame, field: str) -> DataFrame:
    v = F.col("attrs")[field]
    return episodes.where(v.isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def fields(episodes: DataFrame) -> DataFrame:
    e = episodes.select("lsn", F.explode("attrs").alias("field", "value"))
    return e.groupBy("field").agg(F.count_distinct("value").alias("distinct_values"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def diff(episodes: DataFrame, value: Column, start: int, end: int) -> DataFrame:
    """[start, end) against the window of equal length before it, per value: events now and before, and whether the value is
    new (never seen before start), silent (was there, is gone) or active. Nothing before the earlier window is scanned but
    for the first sighting, which one aggregate gives in the same pass."""
    back = start - (end - start)
    e = episodes.where(F.col("lsn") < end).select("lsn", value.alias("value")).where("value is not null")
    g = e.groupBy("value").agg(F.count_if(F.col("lsn") >= start).alias("events"), F.count_if((F.col("lsn") >= back) & (F.col("lsn") < start)).alias("before"), F.min("lsn").alias("first_lsn"))
    g = g.where("events > 0 or before > 0")
    return g.select("value", "events", "before", (F.col("first_lsn") >= start).alias("new"), (F.col("events") == 0).alias("silent"))


def sources(episodes: DataFrame) -> DataFrame:
    ms = ts_ms(F.col("ts_hlc"))
    return episodes.groupBy("agent_id").agg(F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"))


def source_detail(episodes: DataFrame, agent: str) -> DataFrame:
    """Per kind of one agent: events, and how many have each attribute filled."""
    e = episodes.where(F.col("agent_id") == agent)
    return e.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("attrs")).alias("attrs_filled"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def access_report(episodes: DataFrame, subject: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """The newest rows that mention the subject, and their total."""
    hit = episodes.where(F.col("content").contains(subject) | (F.col("kind").contains(subject)))
    return hit.select("lsn", "agent_id", "kind").orderBy(F.col("lsn").desc()).limit(limit), hit.agg(F.count(F.lit(1)).alias("total"), (F.count(F.lit(1)) > limit).alias("truncated"))


def security_counts(events: DataFrame) -> DataFrame:
    """Counts by category, source and outcome in one pass of grouping sets."""
    e = events.groupingSets([["category"], ["datasource"], ["outcome"], []], "category", "datasource", "outcome")
    return e.agg(F.grouping_id("category", "datasource", "outcome").alias("level"), F.count(F.lit(1)).alias("n"))


def run_summaries(events: DataFrame) -> DataFrame:
    """(run_id, lsn, at, kind, status) to a row per run: counts, times and a status ladder."""
    n = lambda k: F.count_if(F.col("kind") == k)
    g = events.groupBy("run_id").agg(
        n("tool_call").alias("tool_calls"), n("approval").alias("approvals"), F.count_if(F.col("status") == "denied").alias("denied"), F.count_if(F.col("status") == "error").alias("errors"),
        F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.min("at").alias("started"), F.max(F.when(F.col("kind") == "finish", F.col("at"))).alias("finished"),
    )
    status = F.when(F.col("errors") > 0, "failed").when(F.col("denied") > 0, "blocked").when(F.col("finished").isNotNull(), "finished").otherwise("running")
    return g.withColumn("status", status)


def lifecycle(events: DataFrame) -> DataFrame:
    """Per call: when it was requested, started and finished, and its first decision."""
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("lsn")))
    g = events.groupBy("call_id").agg(at("requested").alias("requested"), at("started").alias("started"), at("finished").alias("finished"), F.min_by("status", "lsn").alias("decision"))
    return g.withColumn("state", F.when(F.col("finished").isNotNull(), "finished").when(F.col("started").isNotNull(), "started").otherwise("requested"))


def noisy_or(matches: DataFrame, by: str) -> DataFrame:
    """1 - prod(1 - confidence * trust * breadth); a certain match makes the score 1."""
    x = F.greatest(F.least(F.col("confidence") * F.col("trust") * F.when(F.col("exact"), 1.0).otherwise(0.5), F.lit(1.0)), F.lit(0.0))
    g = matches.groupBy(by).agg(F.bool_or(x >= 1).alias("sure"), F.sum(F.when(x < 1, F.ln(1 - F.when(x < 1, x)))).alias("s"))
    return g.select(by, F.when(F.col("sure"), 1.0).otherwise(1 - F.exp(F.coalesce("s", F.lit(0.0)))).alias("score"))


def health(windows: DataFrame) -> DataFrame:
    """Per datasource over its sensors: all healthy, least trust (unknown 0), greatest age, worst sensor. windows: (sensor,
    datasource, healthy, trust, age)."""
    t = F.coalesce("trust", F.lit(0.0))
    return windows.groupBy("datasource").agg(F.bool_and("healthy").alias("healthy"), F.min(t).alias("trust"), F.max(F.coalesce("age", F.lit(float("inf")))).alias("age"), F.min_by("sensor", F.struct(t, "sensor")).alias("worst"))


def latest(df: DataFrame, key: list[str], order: str, deleted: Column | None = None) -> DataFrame:
    """A ledger folded to its latest row per key, without deleted ones; aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))
    return out if deleted is None else out.where(~deleted)


def group_sum(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Keys as text (key0, ...), count and sums, in order of the keys."""
    names = [f"key{i}" for i in range(len(keys))]
    g = df.groupBy(*(F.col(k).cast("string").alias(n) for k, n in zip(keys, names, strict=True)))
    return g.agg(F.count(F.lit(1)).alias("count"), *(F.sum(c).cast("long").alias(f"sum{i}") for i, c in enumerate(sums))).orderBy(*names)


def ewma(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """The last exponentially weighted mean per key: a weighted sum, as weights depend on the rank from the end alone."""
    w = W.partitionBy(key).orderBy(F.col(order).desc())
    n = W.partitionBy(key)
    r = df.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(n))
    weight = F.when(F.col("r") == F.col("n"), F.pow(F.lit(1 - alpha), F.col("n") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("r") - 1))
    return r.groupBy(key).agg(F.sum(F.col(value) * weight).alias("ewma"))


def diff_totals(rows: DataFrame) -> DataFrame:
    """Of the rows of `diff`: values and events of both windows, new and silent values."""
    return rows.agg(
        F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"), F.coalesce(F.sum("before"), F.lit(0)).alias("before"), F.count_if("new").alias("new"), F.count_if("silent").alias("silent")
    )


def diff_top(rows: DataFrame, n: int) -> DataFrame:
    """New values first, then silent ones, then by the greater count."""
    return rows.orderBy(F.col("new").desc(), F.col("silent").desc(), F.greatest("events", "before").desc(), "value").limit(n)


def source_totals(episodes: DataFrame) -> DataFrame:
    return episodes.agg(F.count_distinct("agent_id").alias("agents"), F.count(F.lit(1)).alias("n"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


def both_ends(rows: DataFrame, n: int) -> DataFrame:
    """The first and the last n rows by lsn, each once; a sample for a report."""
    return rows.orderBy("lsn").limit(n).union(rows.orderBy(F.col("lsn").desc()).limit(n)).distinct()


def weighted_moments(df: DataFrame, by: str, value: str, weight: str) -> DataFrame:
    """Weighted mean and variance as sums, which merge; a weight of zero or less counts nothing."""
    w, x = F.when(F.col(weight) > 0, F.col(weight)), F.col(value)
    g = df.groupBy(by).agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return g.select(by, "w", mean.alias("mean"), F.greatest(F.col("wxx") / F.col("w") - mean * mean, F.lit(0.0)).alias("variance"))


def reservoir(df: DataFrame, by: str, value: str, n: int, seed: int = 1) -> DataFrame:
    """Up to n values per group, every subset alike: those with the least hashes of the row. A sample that merges and that
    the order of rows doesn't change."""
    rank = F.struct(F.xxhash64(F.lit(seed), *df.columns).alias("h"), F.col(value).alias("v"))
    kept = df.select(by, rank.alias("x")).withColumn("r", F.row_number().over(W.partitionBy(by).orderBy("x"))).where(F.col("r") <= n)
    return kept.groupBy(by).agg(F.collect_list("x.v").alias("sample"))


def approvals(events: DataFrame) -> DataFrame:
    """(approval_id, lsn, at, kind, approver) to a row per approval: when it was asked for and decided, by whom and how; the
    last decision counts."""
    decided = F.col("kind").isin("granted", "denied")
    last = lambda c: F.max_by(F.when(decided, c), F.when(decided, F.col("lsn")))
    return events.groupBy("approval_id").agg(
        F.max_by(F.when(F.col("kind") == "requested", F.col("at")), F.when(F.col("kind") == "requested", F.col("lsn"))).alias("requested_at"), last(F.col("at")).alias("decided_at"), last(F.col("approver")).alias("approver"), last(F.col("kind") == "granted").alias("granted"), F.count(F.lit(1)).alias("evidence"),
    )


def policy_decisions(events: DataFrame) -> DataFrame:
    """Decisions by policy, rule and outcome, with how many were enforced."""
    return events.where("policy_id is not null").groupBy("policy_id", "rule_id", "decision").agg(F.count(F.lit(1)).alias("n"), F.count_if("enforced").alias("enforced"), F.min("lsn").alias("first_lsn"))
