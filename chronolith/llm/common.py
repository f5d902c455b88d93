"""Shared folder handling and by-value shipping of worker code."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Pickle this subpackage's functions by value, so that workers need no copy of it on their path."""
    cloudpickle.register_pickle_by_value(sys.modules["chronolith.llm"])


def free(columns: list[str], name: str) -> str:
    """The name of a new column: with "_" behind for as long as it is taken (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only on one machine (a local master), where it is unset as in
    tests, a new folder takes its place."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Options of a workspace whose folder may be a local one: Hadoop's checked local files take a forked chmod for each file and
#: each checksum beside it, and a fork counts as a second executor of the same size for whoever adds up processes.
UNFORKED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


class Workspace:
    """Tables that cut lineage: each is written once to the shared folder and read back, so a lost executor costs one task."""

    def __init__(self, spark: SparkSession, name: str, options: dict[str, str] | None = None):
        self.spark, self.root, self.options = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", options or {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, codec: str = "zstd", partition_by: str | None = None) -> DataFrame:
        w = df.write.mode("overwrite").options(**self.options).option("compression", codec)
        (w.partitionBy(partition_by) if partition_by else w).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
        """Saved as an external table in buckets, so that joins on the column leave it where it lies."""
        table = f"chronolith_{uuid.uuid4().hex}"
        df.write.options(**self.options).bucketBy(buckets, column).option("path", self.path(name)).option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        jvm, path = self.spark._jvm, self.path(name)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def integral(df: DataFrame, column: str) -> None:
    """Raises if ids aren't integers."""
    if (kind := df.schema[column].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"ids of column {column} are {kind}, not integers")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
