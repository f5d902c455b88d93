"""The newest rows beside the log: merged reads, and a subscription that catches up before it follows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merged(log: DataFrame, tail: DataFrame, key: str = "id", order: str = "lsn") -> DataFrame:
    """The log with rows that it doesn't have yet: of each key that with the highest lsn, aggregated before the shuffle."""
    rest = [c for c in log.columns if c != key]
    one = log.unionByName(tail.select(log.columns)).groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x"))
    return one.select(*(F.col(key) if c == key else F.col(f"x.{c}").alias(c) for c in log.columns))


def subscribe(log: DataFrame, stream: DataFrame, start: int, head: int) -> tuple[DataFrame, DataFrame]:
    """(history, live): what stands in the log from `start` up to the head, and what the stream brings from the head on. The two
    meet at the head, so nothing is lost or seen twice, whenever the stream begins."""
    inside = lambda df: df.where(F.col("lsn") >= start)
    return inside(log).where(F.col("lsn") < head), inside(stream).where(F.col("lsn") >= head)


def catch_up(log: DataFrame, seen: int, head: int) -> DataFrame:
    """What a subscriber that fell behind has missed: rows after the last that it saw."""
    return log.where((F.col("lsn") > seen) & (F.col("lsn") < head)).orderBy("lsn")


def concat(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
