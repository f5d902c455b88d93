"""Exports and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.functions.scalars import ts_ms


def events_view(episodes: DataFrame, name: str = "events_log") -> DataFrame:
    """The SQL table over the log: scalar columns, and JSON text of the nested ones."""
    v = episodes.select("lsn", "id", "ts_hlc", ts_ms(F.col("ts_hlc")).alias("ts_ms"), "agent_id", "session_id", "kind", "content", F.to_json("attrs").alias("attrs_json"), F.to_json("parents").alias("parents_json"), "valid_from", "valid_to")
    v.createOrReplaceTempView(name)
    return v


def sql(spark: SparkSession, query: str, max_rows: int | None = None) -> DataFrame:
    """A SELECT over registered views; statements that define or change anything are refused."""
    if query.lstrip().split(None, 1)[0].upper() not in ("SELECT", "WITH", "VALUES", "FROM", "("):
        raise ValueError("only queries are allowed")
    df = spark.sql(query)
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows; no partial result")
    return df


def lake_export(episodes: DataFrame, path: str, segment_rows: int = 1_000_000) -> None:
    """Parquet by segment of the log, sorted by lsn, so a reader prunes by folder and by row group; a segment is replaced
    as a whole, so running an export again changes nothing."""
    e = episodes.withColumn("segment_id", F.floor(F.col("lsn") / segment_rows)).withColumn("attrs", F.to_json("attrs")).withColumn("parents", F.to_json("parents")).withColumn("embedding", F.to_json("embedding"))
    e.repartition("segment_id").sortWithinPartitions("segment_id", "lsn").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("segment_id").parquet(path)


def bi_export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV or Parquet with nested columns as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    out = df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema))
    w = out.write.mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def read_csv(spark: SparkSession, path: str, schema=None, encoding: str = "ISO-8859-1", sep: str = ";") -> DataFrame:
    r = spark.read.option("header", True).option("encoding", encoding).option("sep", sep)
    return (r.schema(schema) if schema else r).csv(path)


def append_once(spark: SparkSession, batch: DataFrame, path: str, key: str) -> None:
    """Rows whose idempotency key the log doesn't hold yet."""
    held = spark.read.parquet(path).select(key)
    batch.dropDuplicates([key]).join(held, key, "left_anti").write.mode("append").parquet(path)


DATASETS = {"socios": "partner", "empresas": "company", "pagamentos": "payment", "contratos": "contract"}


def ingest_csv(spark: SparkSession, path: str, names: dict[str, str] = DATASETS) -> DataFrame:
    """All CSV files below a folder as rows (dataset, file, row): the dataset by the name of the file's folder, Latin-1 read,
    blanks trimmed, each row as JSON text, as the files' columns differ."""
    folder = F.lower(F.regexp_extract(F.input_file_name(), "/([^/]+)/[^/]+$", 1))
    kind = folder
    for k, v in names.items():
        kind = F.when(folder == k, v).otherwise(kind)
    out = None
    for sub in sorted({r.d for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("d")).distinct().collect()}):
        rows = read_csv(spark, sub)
        plain = rows.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in rows.columns))
        one = plain.select(kind.alias("dataset"), F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "dataset string, file string, row string")


class TooManyObjects(ValueError):
    pass


def read_stix(spark: SparkSession, path: str, most: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """(id, type, pattern, confidence) of STIX bundles' objects. A bundle of more objects or bytes than allowed is an error,
    never a part of it; so is a document that is no bundle."""
    files = spark.read.format("binaryFile").load(path)
    if (big := files.where(F.col("length") > most_bytes).select("path", "length").first()) is not None:
        raise TooManyObjects(f"{big.path}: {big.length} bytes, at most {most_bytes}")
    b = spark.read.option("multiLine", True).schema("type string, id string, objects array<struct<id:string,type:string,pattern:string,confidence:int>>").json(path)
    if (big := b.where(F.size("objects") > most).select(F.size("objects").alias("n")).first()) is not None:
        raise TooManyObjects(f"{big.n} objects, at most {most}")
    if b.where("type is null or type <> 'bundle'").take(1):
        raise ValueError("not a bundle")
    return b.select(F.explode("objects").alias("o")).select("o.*")


SECRET = r"(?i)\b(authorization|password|passwd|secret|token|api[_-]?key)\b([\"']?\s*[:=]\s*[\"']?)(?:bearer\s+)?[^\s\"',;&]+"


def redacted(text):
    """What follows the name of a credential is masked."""
    return F.regexp_replace(text, SECRET, "$1$2[redacted]")


def evidence(records: DataFrame) -> DataFrame:
    """(key, hash, body) of records (key, body): bodies redacted, each key and content once; a key with two contents keeps
    both, as conflicting evidence is none to drop."""
    r = records.select("key", redacted(F.col("body")).alias("body"))
    return r.withColumn("hash", F.sha2(F.col("body").cast("binary"), 256)).dropDuplicates(["key", "hash"]).select("key", "hash", "body")


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """Spans of OTLP/JSON traces, each (trace, span) once."""
    schema = "resourceSpans array<struct<scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string>>>>>>"
    s = spark.read.schema(schema).json(path).select(F.explode("resourceSpans").alias("r")).select(F.explode("r.scopeSpans").alias("s")).select(F.explode("s.spans").alias("x")).select("x.*")
    return s.dropDuplicates(["traceId", "spanId"])
