"""Detection rules over security events: predicates, look-back counts and sequences, in batch and as streams."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def predicate(rule) -> Column:
    """("eq", field, v), ("ne", field, v), ("in", field, [v]), ("and", ...), ("or", ...), ("not", r). A missing field
    makes eq, ne and in false; not flips."""
    op = rule[0]
    no = F.lit(False)
    if op == "eq":
        return F.coalesce(F.col(rule[1]) == rule[2], no)
    if op == "ne":
        return F.coalesce(F.col(rule[1]) != rule[2], no)
    if op == "in":
        return F.coalesce(F.col(rule[1]).isin(*rule[2]), no)
    if op == "not":
        return ~predicate(rule[1])
    parts = [predicate(r) for r in rule[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if op == "and" else out | p
    return out


def count_rule(events: DataFrame, test: Column, key: str, at: str, window_ms: int, threshold: int) -> DataFrame:
    """Events that end a look-back [t - w, t] with at least `threshold` matches of their key. One range frame per key."""
    w = W.partitionBy(key).orderBy(at).rangeBetween(-window_ms, 0)
    hit = events.where(test)
    return hit.withColumn("matches", F.count(F.lit(1)).over(w)).where(F.col("matches") >= threshold)


def distinct_rule(events: DataFrame, test: Column, key: str, at: str, field: str, window_ms: int, threshold: int) -> DataFrame:
    w = W.partitionBy(key).orderBy(at).rangeBetween(-window_ms, 0)
    hit = events.where(test & F.col(field).isNotNull())
    return hit.withColumn("matches", F.size(F.collect_set(field).over(w)).cast("long")).where(F.col("matches") >= threshold)


def sequences(pdf: pd.DataFrame, steps: list[str], within_ms: int) -> pd.DataFrame:
    """Per anchor (an event of the last step), the earliest steps in order within [t - w, t]."""
    pdf = pdf.sort_values("lsn")
    out = []
    rows = list(pdf[["lsn", "at", "step"]].itertuples(index=False))
    for i, r in enumerate(rows):
        if r.step != steps[-1]:
            continue
        chain: list[int] = []
        for q in rows[: i + 1]:
            if r.at - within_ms <= q.at <= r.at and len(chain) < len(steps) and q.step == steps[len(chain)]:
                chain.append(int(q.lsn))
        if len(chain) == len(steps):
            out.append((pdf["key"].iloc[0], int(r.lsn), ">".join(map(str, chain))))
    return pd.DataFrame(out, columns=["key", "lsn", "chain"])


def sequence_rule(events: DataFrame, step: Column, key: str, at: str, steps: list[str], within_ms: int) -> DataFrame:
    """(key, lsn, chain). step: the name of the step an event is, or null."""
    e = events.select(F.col(key).cast("string").alias("key"), "lsn", F.col(at).alias("at"), step.alias("step")).where("step is not null")
    run = lambda pdf: sequences(pdf, steps, within_ms)
    return e.groupBy("key").applyInPandas(run, "key string, lsn long, chain string")


def on_time(events: DataFrame, at: str, now_ms: int, window_ms: int, lateness_ms: int = 300_000) -> DataFrame:
    """What is not later than the watermark: the greatest time that isn't in the future, less window and lateness."""
    top = events.where(F.col(at) <= now_ms).agg(F.max(at).alias("__top"))
    return events.join(F.broadcast(top)).where(F.col(at) >= F.col("__top") - (window_ms + lateness_ms)).drop("__top")


def signals(hits: DataFrame, rule: str, cols: list[str]) -> DataFrame:
    """Signals with an identity that depends on rule and evidence alone, each once."""
    s = hits.withColumn("signal_id", F.sha2(F.concat_ws("|", F.lit(rule), *(F.col(c).cast("string") for c in cols)), 256))
    return s.dropDuplicates(["signal_id"])


# --- streams


def stream(spark, path: str, schema, at: str = "ts", lateness: str = "5 minutes", files_per_trigger: int = 64, bytes_per_trigger: int | None = None) -> DataFrame:
    """A stream of a folder's files; a batch takes so many files or bytes at most, and the rest waits in the folder, so a slow
    consumer falls behind but loses nothing: its checkpoint is where it catches up from."""
    r = spark.readStream.schema(schema)
    s = (r.option("maxBytesPerTrigger", bytes_per_trigger) if bytes_per_trigger else r.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)
    return s.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, lateness)


def tumbling(events: DataFrame, at: str, width: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts per window; the same expression over a table and over a stream."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("start_ms"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str]) -> DataFrame:
    return events.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("w.start").alias("start_ms"), *keys, "n")


def interval_join(left: DataFrame, right: DataFrame, key: str, lt: str, rt: str, within: str) -> DataFrame:
    """Right rows up to `within` after a left row of their key; over streams the bound lets state go."""
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    return l.join(r, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"r.{rt}") >= F.col(f"l.{lt}")) & (F.col(f"r.{rt}") <= F.col(f"l.{lt}") + F.expr(f"interval {within}")))


def counted(times: list[int], rows: list[tuple[int, int]], window_ms: int, threshold: int) -> tuple[list[int], list[int], list[int]]:
    """Takes (at, lsn) in order into the sorted times of their key: the times that are still within the window, and the lsn and
    count of each row that reaches the threshold."""
    hits, counts = [], []
    for t, lsn in rows:
        insort(times, t)
        n = bisect_right(times, t) - bisect_left(times, t - window_ms)
        if n >= threshold:
            hits.append(lsn)
            counts.append(n)
    return times[bisect_left(times, times[-1] - window_ms) :], hits, counts


def count_stream(events: DataFrame, key: str, at: str, window_ms: int, threshold: int, buckets: int = 512) -> DataFrame:
    """The count rule over a stream: per key, the times within the window are the state, and a key that is idle for longer than
    the window, by the watermark of column `ts` if there is one, is dropped. Keys share a state by buckets, as each state is a
    call of its own. An event counts what has arrived by then, in
    order of time within a batch. Emits (key, lsn, matches)."""
    timed = "ts" in events.columns

    def step(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*map(list, state.get), strict=True)) if state.exists else {}
        mark = state.getCurrentWatermarkMs() if timed else None
        rows: dict[str, list] = {}
        for f in () if state.hasTimedOut else frames:
            for k, *row in zip(f["key"].tolist(), f["at"].tolist(), f["lsn"].tolist(), strict=True):
                rows.setdefault(k, []).append(tuple(row))
        out = []
        for k, new in rows.items():
            held[k], hits, counts = counted(sorted(held.get(k, ())), sorted(new), window_ms, threshold)
            out += zip([k] * len(hits), hits, counts, strict=True)
        if timed:
            held = {k: times for k, times in held.items() if times[-1] + window_ms >= mark}
        if held:
            state.update((list(held), [list(t) for t in held.values()]))
            if timed:
                state.setTimeoutTimestamp(max(min(t[-1] for t in held.values()) + window_ms, mark) + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "lsn", "matches"])

    e = events.select(F.col(key).cast("string").alias("key"), F.col("lsn"), F.col(at).alias("at"), *["ts"] * timed)
    e = e.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return e.groupBy("bucket").applyInPandasWithState(step, "key string, lsn long, matches long", "keys array<string>, times array<array<long>>", "append", "EventTimeTimeout" if timed else "NoTimeout")


def run_to_table(df: DataFrame, spark, out: str, checkpoint: str, mode: str = "append") -> None:
    """Everything available, once, into a Parquet folder; exactly once through the checkpoint."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def idempotent_append(batch: DataFrame, target: str, keys: list[str]) -> None:
    """Appends rows whose keys the target doesn't hold: a batch that is run again adds nothing."""
    spark = batch.sparkSession
    try:
        old = spark.read.parquet(target).select(*keys)
        batch = batch.join(old, keys, "left_anti")
    except Exception as e:  # the first batch finds no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
    batch.dropDuplicates(keys).write.mode("append").parquet(target)
