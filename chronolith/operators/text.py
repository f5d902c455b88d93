"""Text retrieval: tf-idf recall, BM25, substring counts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.scalars import tokens

K1, B = 1.2, 0.75


def terms(text: str) -> list[str]:
    """A query's tokens, as `tokens` has them."""
    out, word = [], []
    for ch in text.lower() + " ":
        if ch.isalnum():
            word.append(ch)
        elif word:
            out.append("".join(word))
            word = []
    return out


def _tf(tok: Column, term: str) -> Column:
    return F.size(F.filter(tok, lambda x: x == term))


def recall(episodes: DataFrame, query: str, k: int, bound: int | None = None) -> DataFrame:
    """Sum of tf * idf, idf = max(ln(1 + (N - df + .5) / (df + .5)), 1e-4); N counts all texts, df those before the bound;
    a term twice in the query counts twice; ties: the later first. Term counts are columns of the scan, one small
    aggregate gives df, and only the k best rows are sorted: the texts themselves never move."""
    q = Counter(terms(query))
    here = episodes if bound is None else episodes.where(F.col("lsn") < bound)
    tok = here.select("lsn", tokens(F.col("content")).alias("tok"))
    tf = tok.select("lsn", *(_tf(F.col("tok"), t).alias(f"t{i}") for i, t in enumerate(q)))
    df = tf.agg(*(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(q)))).join(F.broadcast(episodes.agg(F.count(F.lit(1)).alias("n"))))
    idf = lambda i: F.greatest(F.ln(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)), F.lit(1e-4))
    score = sum((F.lit(float(c)) * F.col(f"t{i}") * idf(i) for i, c in enumerate(q.values())), F.lit(0.0))
    return tf.join(F.broadcast(df)).select("lsn", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), F.col("lsn").desc()).limit(k)


def bm25(episodes: DataFrame, query: str, k: int | None, bound: int | None = None) -> DataFrame:
    """BM25 over tokens of more than one byte; ties: the earlier first. The same plan as recall."""
    q = list(dict.fromkeys(t for t in terms(query) if len(t.encode()) > 1))
    here = episodes if bound is None else episodes.where(F.col("lsn") < bound)
    tok = here.select("lsn", F.filter(tokens(F.col("content")), lambda t: F.octet_length(t) > 1).alias("tok"))
    tf = tok.select("lsn", F.size("tok").alias("len"), *(_tf(F.col("tok"), t).alias(f"t{i}") for i, t in enumerate(q)))
    stat = tf.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("mean"), *(F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(q))))
    part = lambda i: F.ln((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5) + 1) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    out = tf.join(F.broadcast(stat)).select("lsn", sum((part(i) for i in range(len(q))), F.lit(0.0)).alias("score")).where("score > 0")
    out = out.orderBy(F.col("score").desc(), F.col("lsn").asc())
    return out if k is None else out.limit(k)


def substring_tf(episodes: DataFrame, needle: str) -> DataFrame:
    """How often a lower-cased text holds the lower-cased needle, without overlaps."""
    low, n = F.lower("content"), needle.lower()
    count = ((F.length(low) - F.length(F.replace(low, F.lit(n), F.lit("")))) / len(n)).cast("long")
    return episodes.select("lsn", count.alias("tf")).where("tf > 0")
