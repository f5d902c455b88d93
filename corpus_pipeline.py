"""From raw documents to token ids: quality, near duplicates, benchmark leaks, secrets, SentencePiece.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. The quality stage keeps what its
classifier predicts as good, one document of each group of near copies stays (five words, similarity 0.8), documents with
a leaked test item go, secrets are replaced in the text (n_chars follows), and the last stage gives each document's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm import decontaminate, neardup, pieces, quality, secret_scan
from chronolith.llm.common import Workspace


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, "doc_id", "text", "quality", Workspace(spark, "quality"))
    return quality.keep_good(docs, "text", model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_duplicates(docs, "doc_id", "text", Workspace(spark, "neardup"))


def decontam(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, "text", spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs, "doc_id", "text", Workspace(spark, "secrets"))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = pieces.encode(docs.select("doc_id", "lang", "source", "text"), "text")
    return rows.select("doc_id", "lang", "source", "n_tokens", "ids", "parity", "round_trip")


STAGES = [("quality classifier", classify), ("near-duplicates", dedup), ("decontamination", decontam), ("secret scan", redact), ("sentencepiece", tokenize)]
#: Classifier, similarity join and tokenizer are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage is written and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = ws.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
