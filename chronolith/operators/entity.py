"""Entity resolution as of a bound: mentions, merges (whole groups, the least name survives) and splits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVALS = "key string, entity string, from_lsn long, to_lsn long"


def history(rows: Iterable[tuple]) -> list[tuple]:
    """(lsn, op, a, b) in order of lsn: mention a, merge a b, split a -> intervals of keys. One entity's history at a time."""
    of: dict[str, str] = {}
    members: dict[str, set[str]] = {}
    since: dict[str, int] = {}
    out = []

    def move(key: str, entity: str, lsn: int) -> None:
        old = of.get(key)
        if old == entity:
            return
        if old is not None:
            out.append((key, old, since[key], lsn))
            members[old].discard(key)
        of[key], since[key] = entity, lsn
        members.setdefault(entity, set()).add(key)

    for lsn, op, a, b in rows:
        if op == "mention":
            if a not in of:
                move(a, a, lsn)
        elif op == "merge":
            for k in (a, b):
                if k not in of:
                    move(k, k, lsn)
            keep, lose = sorted((of[a], of[b]))
            if keep != lose:
                for k in sorted(members[lose]):
                    move(k, keep, lsn)
        elif op == "split" and a in of:
            move(a, f"{a}@{lsn}", lsn)
    out += [(k, e, since[k], None) for k, e in of.items()]
    return out


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of batches (grp, lsn, op, a, b) that are sorted by group and lsn: groups are many and small, so a batch holds
    many of them, and only the rows of the one that is open are kept from batch to batch."""
    group, rows = None, []
    schema = pa.schema([("key", pa.string()), ("entity", pa.string()), ("from_lsn", pa.int64()), ("to_lsn", pa.int64())])
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        out: list[tuple] = []
        for grp, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "lsn", "op", "a", "b")), strict=True):
            if grp != group:
                out += history(rows)
                group, rows = grp, []
            rows.append(row)
        if out:
            yield pack(out)
    if rows:
        yield pack(history(rows))


def resolver(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Intervals of all keys. groups (key, grp): keys that any merge ever joins share a group; each is folded on its own, in
    order. Keys that are only mentioned need no fold and never reach Python."""
    e = events.join(groups.withColumnRenamed("key", "a"), "a", "left")
    alone = e.where("grp is null and op = 'mention'").groupBy(F.col("a").alias("key")).agg(F.min("lsn").alias("from_lsn")).select("key", F.col("key").alias("entity"), "from_lsn", F.lit(None).cast("long").alias("to_lsn"))
    run = lambda batches: fold(batches)
    joined = e.where("grp is not null").select("grp", F.col("lsn").cast("long").alias("lsn"), "op", "a", "b").repartition("grp").sortWithinPartitions("grp", "lsn").mapInArrow(run, INTERVALS)
    return alone.unionByName(joined)


def resolve(intervals: DataFrame, key: str | None, bound: int) -> DataFrame:
    """(key, entity) at the bound."""
    p = bound - 1
    at = intervals.where((F.col("from_lsn") <= p) & (F.col("to_lsn").isNull() | (F.col("to_lsn") > p)))
    return (at if key is None else at.where(F.col("key") == key)).select("key", "entity")


def cluster(intervals: DataFrame, entity: str, bound: int) -> DataFrame:
    return resolve(intervals, None, bound).where(F.col("entity") == entity).orderBy("key")
