"""Batches of Arrow IPC out of the log and into it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources.adapters import EPISODE, episode

ROWS, MOST_BYTES = 1024, 128 << 20


def ticket(text: str) -> int | None:
    """The bound of "events" or "events?as_of=N"."""
    m = re.fullmatch(r"events(?:\?as_of=(\d+))?", text)
    if not m:
        raise ValueError(f"unknown ticket {text!r}")
    return None if m[1] is None else int(m[1])


def encoded(episodes: DataFrame, rows: int = ROWS) -> DataFrame:
    """(first_lsn, rows, ipc): each an IPC stream of at most `rows` rows, made where the rows are."""
    plain = episodes.select(*(F.to_json(f.name).alias(f.name) if f.name in ("attrs", "parents", "embedding") else F.col(f.name) for f in EPISODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, rows):
                part = b.slice(at, rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("lsn")[0].as_py()]), pa.array([part.num_rows], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["first_lsn", "rows", "ipc"])

    return plain.mapInArrow(run, "first_lsn long, rows long, ipc binary")


def do_get(episodes: DataFrame, request: str, most: int = MOST_BYTES) -> list[bytes]:
    """The batches of a ticket in order of lsn; more than `most` bytes are an error, never a part: `stream` has no such bound."""
    bound = ticket(request)
    here = episodes if bound is None else episodes.where(F.col("lsn") < bound)
    out = encoded(here)
    total = out.agg(F.coalesce(F.sum(F.octet_length("ipc")), F.lit(0)).alias("n")).first().n
    if total > most:
        raise ValueError(f"{total} bytes of batches, more than {most}; read them as a stream")
    return [r.ipc for r in out.orderBy("first_lsn").select("ipc").collect()]


def stream(episodes: DataFrame, request: str) -> Iterator[bytes]:
    """The batches one after the other; the driver holds those of one partition."""
    bound = ticket(request)
    for r in encoded(episodes if bound is None else episodes.where(F.col("lsn") < bound)).toLocalIterator():
        yield r.ipc


def do_put(spark: SparkSession, batches: list[bytes], head: int) -> DataFrame:
    """Episodes of batches, numbered from the head on; each needs text columns agent_id and kind, all else is ignored."""
    tables = [pa.ipc.open_stream(b).read_all() for b in batches]
    for t in tables:
        for c in ("agent_id", "kind"):
            if c not in t.schema.names or not (pa.types.is_string(t.schema.field(c).type) or pa.types.is_large_string(t.schema.field(c).type)):
                raise ValueError(f"{c} must be a column of text")
    rows = pa.concat_tables([t.select(["agent_id", "kind"]).cast(pa.schema([("agent_id", pa.string()), ("kind", pa.string())])) for t in tables]) if tables else pa.table({"agent_id": pa.array([], pa.string()), "kind": pa.array([], pa.string())})
    df = spark.createDataFrame(rows.append_column("lsn", pa.array(range(head, head + rows.num_rows), pa.int64())))
    return episode(df, lsn=F.col("lsn"), id=F.concat(F.lit("p"), F.col("lsn")), agent_id=F.col("agent_id"), kind=F.col("kind"))
