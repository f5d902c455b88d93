"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only on one machine (a local master), where it is unset as in tests, a new folder
    takes its place: on a cluster executors would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Options of a writer whose folder may be a local one: Hadoop's checked local files take a forked chmod for each file, for each
#: folder and for each checksum, which is most of the time where files are many and small.
UNFORKED = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@contextmanager
def listing(spark: SparkSession):
    """Spark lists many paths by a task each; within this, by a few tasks a core."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    was = spark.conf.get(key, None)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below it."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def through(df: DataFrame, name: str) -> DataFrame:
    """Written and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
