"""Mergeable sketches: distinct counts, heavy hitters, quantiles, membership."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct(df: DataFrame, by: list[str], col: str, lg: int = 12) -> DataFrame:
    return df.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_sketch_agg(col, lg)).alias("estimate"))


def merged_distinct(df: DataFrame, part: str, col: str, lg: int = 12) -> DataFrame:
    """Sketches per part, united: parts are sketched once and merged for any range."""
    s = df.groupBy(part).agg(F.hll_sketch_agg(col, lg).alias("s"))
    return s.agg(F.hll_sketch_estimate(F.hll_union_agg("s", F.lit(False))).alias("estimate"))


def heavy_hitters(df: DataFrame, col: str, k: int) -> DataFrame:
    top = df.agg(F.expr(f"approx_top_k({col}, {k})").alias("x"))
    return top.select(F.explode("x").alias("x")).select(F.col("x.item").alias("item"), F.col("x.count").alias("count"))


def frequencies(df: DataFrame, col: str) -> DataFrame:
    """Every value's exact count, whatever their number; what the sketch of bounded size can't promise."""
    return df.groupBy(F.col(col).alias("item")).agg(F.count(F.lit(1)).alias("count"))


def count_min(df: DataFrame, col: str, eps: float = 0.001, confidence: float = 0.99, seed: int = 42) -> DataFrame:
    return df.agg(F.count_min_sketch(F.col(col), F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def quantiles(df: DataFrame, by: list[str], col: str, qs: list[float]) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile_approx(col, qs, 10_000).alias("q"))


# --- Bloom filters and Count-Min tables, as rows of native expressions that merge by union

#: A Bloom filter is cut into blocks of so many words; all bits of a key lie in one of them.
BLOCK = 128
#: A filter of more bits than this isn't broadcast.
SENT = 1 << 28


def _block(key: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(size // (BLOCK * 64)).cast("long"))


def _slots(key: Column, n: int) -> Column:
    """n different positions within the key's block by double hashing."""
    h, size = F.xxhash64(key, F.lit(1)), BLOCK * 64
    at = F.array(*((F.pmod(h, F.lit(size)) + i * (F.pmod(F.shiftright(h, 20), F.lit(size // 2)) * 2 + 1)) % size for i in range(n)))
    return F.transform(at, lambda p: p.cast("int"))


def bloom_shape(expected: int, fpr: float) -> tuple[int, int]:
    """(bits, hashes): bits as the rate asks for, in whole blocks."""
    n, p = max(1, expected), min(max(fpr, 1e-6), 0.5)
    m, block = math.ceil(-n * math.log(p) / math.log(2) ** 2), BLOCK * 64
    m = -(-m // block) * block
    return m, min(max(1, round(m / n * math.log(2))), 16)


def bloom(df: DataFrame, key: str, shape: tuple[int, int]) -> DataFrame:
    """(word, bits): the filter's words that have a bit; filters of one shape unite by merge_bloom."""
    m, k = shape
    at = df.where(F.col(key).isNotNull()).select((_block(F.col(key), m) * BLOCK).alias("at"), F.explode(_slots(F.col(key), k)).alias("p"))
    return at.groupBy((F.col("at") + F.floor(F.col("p") / 64)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, p % 64)")).alias("bits"))


def merge_bloom(*filters: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, filters).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def might_contain(df: DataFrame, key: str, words: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """The rows whose key the filter may hold: none that it holds is lost. Each key meets its own block alone, in a semi-join
    that never copies it; a small filter is broadcast and a large one joined by shuffle, so neither the driver nor one
    executor has to hold it."""
    m, k = shape
    held = F.map_from_entries(F.collect_list(F.struct((F.col("word") % BLOCK).cast("int").alias("i"), "bits")))
    blocks = words.groupBy(F.floor(F.col("word") / BLOCK).alias("__of")).agg(held.alias("held")).select("__of", F.transform(F.array("held"), lambda h: F.transform(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda i: F.coalesce(F.try_element_at(h, i), F.lit(0).cast("long"))))[0].alias("__bits"))
    hit = lambda p: F.call_function("shiftrightunsigned", F.get("__bits", F.shiftright(p, 6)), p.bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long")) == 1
    rows = df.where(F.col(key).isNotNull()).withColumn("__block", _block(F.col(key), m))
    return rows.join(F.broadcast(blocks) if m <= SENT else blocks, (F.col("__block") == F.col("__of")) & F.forall(_slots(F.col(key), k), hit), "left_semi").drop("__block")


def bloom_semi_join(big: DataFrame, small: DataFrame, key: str, fpr: float = 0.01) -> DataFrame:
    """Rows of `big` with a partner: what the filter of the small side rules out never reaches the shuffle."""
    shape = bloom_shape(small.count(), fpr)
    return might_contain(big, key, bloom(small, key, shape), shape).join(small.select(key).distinct(), key, "left_semi")


def count_min_table(df: DataFrame, key: str, width: int, depth: int) -> DataFrame:
    """(row, slot, n): the counters that aren't zero; tables merge by union and sum."""
    at = df.where(F.col(key).isNotNull()).select(F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.pmod(F.xxhash64(F.col(key), i), F.lit(width)))).alias("row", "slot"))
    return at.groupBy("row", "slot").agg(F.count(F.lit(1)).alias("n"))


def count_min_merge(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("row", "slot").agg(F.sum("n").alias("n"))


def count_min_estimate(keys: DataFrame, key: str, table: DataFrame, width: int, depth: int) -> DataFrame:
    """(key, estimate): never below the true count; a counter that is missing is zero."""
    at = keys.select(key, F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.pmod(F.xxhash64(F.col(key), i), F.lit(width)))).alias("row", "slot"))
    return at.join(table, ["row", "slot"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
