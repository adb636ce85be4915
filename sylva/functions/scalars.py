"""Column functions with the number rules of path literals and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_int(value: Column) -> Column:
    """The decimal integer that a text begins with, after blanks; 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(0).cast("bigint"))


def leading_float(value: Column) -> Column:
    """The number that a text begins with, after blanks; 0 if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0))


def based_int(value: Column) -> Column:
    """The integer that a text begins with; 0x starts a hexadecimal one, a further leading 0 an octal one."""
    sign = F.when(F.regexp_extract(value, r"^\s*([+-]?)", 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    hexadecimal = F.regexp_extract(value, r"^\s*[+-]?0[xX]([0-9a-fA-F]+)", 1)
    octal = F.regexp_extract(value, r"^\s*[+-]?0([0-7]+)", 1)
    return F.when(hexadecimal != "", sign * F.conv(hexadecimal, 16, 10).cast("bigint")).when(octal != "", sign * F.conv(octal, 8, 10).cast("bigint")).otherwise(leading_int(value))


def compare(value: Column, op: str, literal: str | int | float) -> Column:
    """The literal's type chooses the comparison: byte order for strings, leading numbers otherwise."""
    left = value if isinstance(literal, str) else leading_int(value) if isinstance(literal, int) else leading_float(value)
    right = F.lit(literal)
    return {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
