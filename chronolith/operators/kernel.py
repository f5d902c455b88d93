"""Selections as bitmaps, filters over them, a small expression form, and radix partitions.

A bitmap is rows (bucket, bits) of Spark's bitmap functions over lsn: and, or and not are joins or unions of buckets, so a
selection is as parallel as the log and never one object.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.functions.codecs import radix, splitmix64


def bitmap(rows: DataFrame, key: str = "lsn") -> DataFrame:
    return rows.groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def filter_eq(episodes: DataFrame, field: str, value: str) -> DataFrame:
    """The bitmap of rows whose column or attribute equals the value."""
    col = F.col(field) if field in episodes.columns else F.col("attrs")[field]
    return bitmap(episodes.where(col == value).select("lsn"))


def either(*maps: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, maps).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets that only one side has are empty."""
    two = a.unionByName(b).groupBy("bucket").agg(F.count(F.lit(1)).alias("sides"), F.bitmap_and_agg("bits").alias("bits"))
    return two.where("sides = 2").select("bucket", "bits")


def without(episodes: DataFrame, gone: DataFrame) -> DataFrame:
    """The bitmap of all rows of the log that `gone` doesn't hold."""
    keys = members(gone)
    return bitmap(episodes.select("lsn").join(keys, "lsn", "left_anti"))


def cardinality(m: DataFrame) -> DataFrame:
    return m.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))


def members(m: DataFrame) -> DataFrame:
    """(lsn) of a bitmap: the set bits of each bucket, 32,768 at most, in place."""
    digits = F.hex("bits")
    byte = F.posexplode(F.filter(F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.struct(i.alias("i"), F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int").alias("v"))), lambda x: x["v"] > 0)).alias("at", "x")
    bits = m.select("bucket", byte).select("bucket", "x.i", "x.v", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where(F.expr("shiftright(v, k) & 1") == 1)
    return bits.select(((F.col("bucket") - 1) * 32768 + F.col("i") * 8 + F.col("k") + 1).alias("lsn"))


def dense(m: DataFrame, total: int, share: float = 0.25) -> bool:
    """Whether a selection is better kept as bits than as a list."""
    return total > 0 and cardinality(m).first().n >= share * total


def fused(df: DataFrame, tests: list[Column]) -> DataFrame:
    """A chain of filters as one: Catalyst splits the conjunction again and pushes what it can into the scan."""
    return df.where(reduce(Column.__and__, (F.coalesce(t, F.lit(False)) for t in tests)))


#: Instructions of `evaluate`: (operator, operands); an operand is a column's name, a number, or ("%", index of a result).
OPS = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "gt": lambda a, b: a > b, "lt": lambda a, b: a < b, "eq": lambda a, b: a == b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a,
}


def evaluate(program: list[tuple]) -> Column:
    """The last value of a program in single-assignment form, as one Column: code generation compiles it with its stage."""
    done: list[Column] = []

    def operand(x) -> Column:
        if isinstance(x, tuple):
            if x[1] >= len(done):
                raise ValueError(f"%{x[1]} is used before it is set")
            return done[x[1]]
        return F.col(x) if isinstance(x, str) else F.lit(x)

    for op, *args in program:
        done.append(OPS[op](*map(operand, args)))
    return done[-1]


def radix_histogram(df: DataFrame, key: str, bits: int) -> DataFrame:
    """(part, n): rows of each radix partition of a key's hash, aggregated before the shuffle."""
    return df.groupBy(radix(splitmix64(F.col(key)), bits).alias("part")).agg(F.count(F.lit(1)).alias("n"))
