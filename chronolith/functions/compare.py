"""The language's comparison and ordering rules as Columns.

Attribute values are strings. If either side of a comparison is a number, both are compared as numbers (a numeric string
counts, trimmed); otherwise both are strings and compare by bytes. A missing operand makes the condition false, even for
!=; an incomparable pair satisfies != alone. Conditions are two-valued, so AND and OR need no third truth value.
Spellings of infinity and NaN are text here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
EXACT = 1 << 53


def number(s: Column) -> Column:
    """A string as double, or null."""
    t = F.trim(s)
    return F.when(t.rlike(NUMERIC), t.try_cast("double"))


def exact(s: Column) -> Column:
    """A string of digits as decimal(38,0), or null."""
    t = F.trim(s)
    return F.when(t.rlike("^[+-]?[0-9]{1,37}$"), t.try_cast("decimal(38,0)"))


def _apply(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]


def compare(op: str, left: Column, right: Column, left_number: bool, right_number: bool, big: bool = False) -> Column:
    """left op right; *_number: that side is a number by itself. big: a whole literal from 2**53 on, compared exactly."""
    there = left.isNotNull() & right.isNotNull()
    if left_number or right_number:
        as_number = exact if big else number
        a = left if left_number else as_number(left)
        b = right if right_number else as_number(right)
        test = F.coalesce(_apply(op, a, b), F.lit(op == "!="))
        if big:
            # A value that is no whole number falls back to doubles.
            a, b = (left.cast("double") if left_number else number(left)), (right.cast("double") if right_number else number(right))
            whole = (F.lit(True) if left_number else exact(left).isNotNull()) & (F.lit(True) if right_number else exact(right).isNotNull())
            test = F.when(whole, test).otherwise(F.coalesce(_apply(op, a, b), F.lit(op == "!=")))
    else:
        test = _apply(op, left, right)
    return F.coalesce(there & test, F.lit(False))


def order_keys(value: Column, is_number: bool, descending: bool, tie: Column) -> list[Column]:
    """Numbers first by size, then all else by its JSON text (a missing value is the text null, after quoted strings); descending
    is the exact reverse; ties keep the log's order."""
    if is_number:
        num, text = value.cast("double"), F.lit("")
    else:
        num = number(value)
        text = F.coalesce(F.concat(F.lit('"'), value, F.lit('"')), F.lit("null"))
    keys = [num.isNull().cast("int"), num, F.when(num.isNull(), text).otherwise("")]
    return [*(k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys), tie.asc()]
