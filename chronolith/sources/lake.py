"""The log as a lake table: Parquet data files by segment and generation, and a commit log of JSON actions beside them.

A segment is exported once per generation; a newer generation replaces it by an add and a remove in one commit, so readers
of any version see whole segments. A commit is a file that is created or fails, never overwritten: two writers can't both
have one version. The log follows the public protocol of Delta tables (protocol, metaData, add, remove; reader version 1).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources.shared import UNFORKED, listing

#: Columns of the table, with whether they may be null.
COLUMNS = (
    ("lsn", "long", False), ("id", "string", False), ("agent_id", "string", False), ("session_id", "string", False), ("ts_hlc", "long", False), ("kind", "string", False), ("content", "binary", False), ("attrs_json", "string", False),
    ("parents_json", "string", False), ("valid_from", "long", True), ("valid_to", "long", True), ("embedding_json", "string", True), ("segment_id", "long", False), ("generation", "long", False),
)
SCHEMA = json.dumps({"type": "struct", "fields": [{"name": n, "type": t, "nullable": x, "metadata": {}} for n, t, x in COLUMNS]})
READ = ", ".join(f"{n} {t}" for n, t, _ in COLUMNS)


def rows_of(episodes: DataFrame, segment_rows: int, generation: int = 0) -> DataFrame:
    """The fourteen columns; nested ones as JSON text, content as bytes."""
    text = lambda c: F.coalesce(F.to_json(c), F.lit("{}"))
    return episodes.select(
        "lsn", "id", F.coalesce("agent_id", F.lit("")).alias("agent_id"), F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("ts_hlc", F.lit(0)).alias("ts_hlc"), "kind", F.encode("content", "UTF-8").alias("content"),
        text("attrs").alias("attrs_json"), F.coalesce(F.to_json("parents"), F.lit("[]")).alias("parents_json"), "valid_from", "valid_to", F.to_json("embedding").alias("embedding_json"),
        F.floor(F.col("lsn") / segment_rows).cast("long").alias("segment_id"), F.lit(generation).cast("long").alias("generation"),
    )


class CommitLog:
    """Versions of a table of data files; a file is known by its path below the table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, version: int):
        return self._path(f"{self.path}/_delta_log/{version:020d}.json")

    def version(self) -> int:
        """The newest version; -1 before the first."""
        folder = self._path(f"{self.path}/_delta_log")
        if not self.fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return max((int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit()), default=-1)

    def commit(self, version: int, actions: list[dict]) -> None:
        """Creates the version; raises if it exists."""
        out = self.fs.create(self._file(version), False)
        try:
            out.write(bytearray("".join(json.dumps(a, sort_keys=True) + "\n" for a in actions).encode()))
        finally:
            out.close()

    def create(self, at_ms: int, schema: str = SCHEMA) -> None:
        meta = {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": schema, "partitionColumns": [], "configuration": {}, "createdTime": at_ms}
        self.commit(0, [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": meta}])

    def append(self, added: list[dict], removed: list[str], at_ms: int) -> int:
        """One commit of new files and those they replace; a removed file must be live. Returns the version."""
        version = self.version() + 1
        live = set(self.files())
        if gone := [p for p in removed if p not in live]:
            raise ValueError(f"not in the table: {gone}")
        acts = [{"add": {"path": a["path"], "size": a["size"], "partitionValues": {}, "modificationTime": at_ms, "dataChange": True, "tags": a.get("tags", {})}} for a in added]
        self.commit(version, acts + [{"remove": {"path": p, "deletionTimestamp": at_ms, "dataChange": True}} for p in removed])
        return version

    def files(self, as_of: int | None = None) -> dict[str, dict]:
        """Live files of a version by replay of its commits: the last action on a path counts."""
        top = self.version() if as_of is None else as_of
        live: dict[str, dict] = {}
        for v in range(top + 1):
            for (line,) in self.spark.read.text(self._file(v).toString()).where("value <> ''").collect():  # one line a file of data
                action = json.loads(line)
                if "add" in action:
                    live[action["add"]["path"]] = action["add"]
                elif "remove" in action:
                    live.pop(action["remove"]["path"], None)
        return live

    def read(self, as_of: int | None = None, schema: str = READ) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in sorted(self.files(as_of))]
        with listing(self.spark):
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def export(episodes: DataFrame, path: str, segment_rows: int, generation: int = 0, at_ms: int = 0) -> dict[int, str]:
    """Exports the segments that the table doesn't have in this generation, in one commit, and says of each segment whether it
    was exported, current already or superseded an older generation. Each segment is a folder of sorted files."""
    spark = episodes.sparkSession
    log = CommitLog(spark, path)
    if log.version() < 0:
        log.create(at_ms)
    held: dict[int, int] = {}
    old: dict[int, list[str]] = {}
    for p, add in log.files().items():
        s, g = int(add["tags"]["segment"]), int(add["tags"]["generation"])
        held[s] = max(g, held.get(s, -1))
        old.setdefault(s, []).append(p)
    rows = rows_of(episodes, segment_rows, generation)
    segments = [r.segment_id for r in rows.select("segment_id").distinct().collect()]  # one per segment
    said = {s: "current" if held.get(s) == generation else "superseded" if s in held else "exported" for s in segments}
    fresh = [s for s in segments if said[s] != "current"]
    if fresh:
        name = f"data/gen-{generation:04d}-{uuid.uuid4().hex}"
        if len(fresh) < len(segments):
            rows = rows.join(F.broadcast(spark.createDataFrame([(s,) for s in fresh], "segment_id long")), "segment_id", "left_semi")
        part = rows.withColumn("segment", F.col("segment_id"))
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        part.repartition(n, "segment").sortWithinPartitions("segment", "lsn").write.options(**UNFORKED).partitionBy("segment").option("parquet.block.row.count.limit", 8192).parquet(f"{log.path}/{name}")
        # The files are listed by Spark, as there is a folder for each segment.
        with listing(spark):
            files = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.parquet").load(f"{log.path}/{name}").select(F.regexp_extract("path", "segment=(-?[0-9]+)/", 1).alias("segment"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length")
        added = [{"path": f"{name}/segment={f.segment}/{f.file}", "size": f.length, "tags": {"segment": f.segment, "generation": str(generation)}} for f in sorted(files.collect())]
        log.append(added, [p for s in fresh for p in old.get(s, [])], at_ms)
    return said


def segment(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One segment: only its files are opened."""
    log = CommitLog(spark, path)
    paths = [f"{log.path}/{p}" for p, a in log.files().items() if int(a["tags"]["segment"]) == number]
    return spark.read.schema(READ).parquet(*paths) if paths else spark.createDataFrame([], READ)


def write_indexed(episodes: DataFrame, path: str, by: str = "agent_id", parts: int | None = None) -> None:
    """The log laid out for equality filters on a column: ranges of it per file, sorted, so row groups part by least and
    greatest value, and a Bloom filter per row group beside them."""
    n = parts or max(1, int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = episodes.repartitionByRange(n, by, "lsn").sortWithinPartitions(by, "lsn")
    out.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{by}", "true").option("parquet.block.size", 32 << 20).parquet(path)
