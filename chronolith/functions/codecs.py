"""Hashes of 64 bits, an order-preserving key of doubles, and integer codecs over arrays, as Columns.

Unsigned arithmetic modulo 2**64 runs on decimals, as longs would overflow; a value is a long of the same bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TWO64, TWO63, TWO32 = 1 << 64, 1 << 63, 1 << 32


def _dec(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def unsigned(x: Column) -> Column:
    d = x.cast("decimal(38,0)")
    return F.when(d < 0, d + _dec(TWO64)).otherwise(d)


def signed(d: Column) -> Column:
    return F.when(d >= _dec(TWO63), d - _dec(TWO64)).otherwise(d).cast("long")


def add64(x: Column, n: int) -> Column:
    return signed((unsigned(x) + _dec(n)) % _dec(TWO64))


def mul64(x: Column, n: int) -> Column:
    """Times a constant: its halves apart, so that no product has more than 30 digits."""
    u = unsigned(x)
    high = (u * _dec(n >> 32).cast("decimal(10,0)")) % _dec(TWO32)
    low = u.cast("decimal(20,0)") * _dec(n & 0xFFFFFFFF).cast("decimal(10,0)")
    return signed((high.cast("decimal(10,0)") * _dec(TWO32).cast("decimal(10,0)") + low).cast("decimal(38,0)") % _dec(TWO64))


def splitmix64(x: Column) -> Column:
    z = add64(x.cast("long"), 0x9E3779B97F4A7C15)
    step = lambda z, s, m: mul64(z.bitwiseXOR(F.shiftrightunsigned(z, s)), m)
    let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
    return let(z, lambda a: let(step(a, 30, 0xBF58476D1CE4E5B9), lambda b: let(step(b, 27, 0x94D049BB133111EB), lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, 31)))))


def fnv1a(text: Column) -> Column:
    raw = F.hex(F.encode(text, "UTF-8"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(raw), F.lit(1)), F.lit(2)), lambda i: i < F.length(raw))
    byte = lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(at, F.lit(0xCBF29CE484222325 - (1 << 64)), lambda h, i: mul64(h.bitwiseXOR(byte(i)), 0x100000001B3))


def radix(h: Column, bits: int) -> Column:
    """The partition of a hash: its highest bits."""
    return F.shiftrightunsigned(h, 64 - bits).cast("int")


def _keys(x: pd.Series) -> pd.Series:
    bits = (x.to_numpy(np.float64, na_value=np.nan) + 0.0).view(np.uint64)
    nan = np.isnan(bits.view(np.float64))
    key = np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))
    return pd.Series(["ffffffffffffffff" if n else f"{k:016x}" for k, n in zip(key.tolist(), nan.tolist(), strict=True)])


def f64_key(x: Column) -> Column:
    """Sixteen hexadecimal digits whose order as text is the order of the doubles; -0.0 and 0.0 are one, NaN comes last."""
    return F.when(x.isNotNull(), F.pandas_udf(_keys, StringType())(x))


# --- integer codecs: each with its inverse


def rle(a: Column) -> Column:
    """Runs [(value, count)]: a value begins a run where it differs from the one before."""
    n = F.size(a)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & ((i == 1) | ~F.get(a, i - 1).eqNullSafe(F.get(a, i - 2))))
    ends = F.concat(F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1))), F.array(n + 1))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(F.get(a, s - 1).alias("value"), (e - s).alias("count")))
    return F.filter(runs, lambda r: r["count"].isNotNull())  # an empty array has no run


def unrle(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["count"])))


def _let(v: Column, f) -> Column:
    """f(v) with v computed once: what stands in a lambda is computed again for each element."""
    return F.element_at(F.transform(F.array(v), f), 1)


def delta(a: Column) -> Column:
    """The first value, then differences."""
    return _let(a, lambda v: F.transform(v, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(v, i - 1))))


def undelta(d: Column) -> Column:
    """Running sums by doubling: round k adds what stands 2**k places before, so n values take n log n steps."""

    def add(step: int):
        return lambda v: F.when(F.size(v) > step, F.transform(v, lambda x, i: x + F.coalesce(F.get(v, i - step), F.lit(0)))).otherwise(v)

    for k in range(31):  # no array is longer
        d = _let(d, add(1 << k))
    return d


def frame(a: Column) -> Column:
    """Frame of reference: (base, width, offsets) with offsets of `width` bits above the least value."""

    def of(v: Column, low: Column, high: Column) -> Column:
        width = F.when(high == low, 0).otherwise(F.length(F.bin(high - low)))
        return F.struct(low.alias("base"), width.alias("width"), F.transform(v, lambda x: x - low).alias("offsets"))

    return _let(a, lambda v: _let(F.array_min(v), lambda low: of(v, low, F.array_max(v))))


def unframe(f: Column) -> Column:
    return _let(f, lambda v: F.transform(v["offsets"], lambda x: x + v["base"]))


def _pieces(text: Column, size: Column) -> Column:
    """Pieces of `size` digits, in one pass; a shorter rest is left out."""
    return F.regexp_extract_all(text, F.concat(F.lit("[01]{"), size, F.lit("}")), F.lit(0))


def bit_pack(offsets: Column, width: Column) -> Column:
    """Offsets of `width` bits (0 to 63) as text of bits, padded to whole bytes, as binary."""
    bits = _let(width, lambda w: F.array_join(F.transform(offsets, lambda x: F.lpad(F.bin(x), w, "0")), ""))
    whole = _let(bits, lambda b: F.rpad(b, (F.ceil(F.length(b) / 8) * 8).cast("int"), "0"))
    return F.unhex(F.array_join(F.transform(_pieces(whole, F.lit("8")), lambda byte: F.lpad(F.conv(byte, 2, 16), 2, "0")), ""))


def bit_unpack(packed: Column, width: Column, count: Column) -> Column:
    bits = F.translate(F.hex(packed), "01", "gh")  # so that no digit of the result is taken for one of the input
    for i, digit in enumerate("gh23456789ABCDEF"):
        bits = F.replace(bits, F.lit(digit), F.lit(f"{i:04b}"))
    none = F.array_repeat(F.lit(0).cast("long"), count)
    some = lambda w: F.transform(F.slice(_pieces(bits, w.cast("string")), F.lit(1), count), lambda x: F.conv(x, 2, 10).cast("long"))
    return _let(width, lambda w: F.when(w == 0, none).otherwise(some(w)))
