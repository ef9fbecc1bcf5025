"""Exact integer arithmetic on columns, and the rounding that the metrics use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ceil_div(n: Column, d: Column | int) -> Column:
    """Ceiling of n / d for n >= 0, d > 0."""
    d = F.lit(d) if isinstance(d, int) else d
    return F.floor((n + d - 1) / d).cast("long")


def trunc_div(n: int, d: int) -> int:
    """Quotient truncated toward zero, as SQL's ``div``."""
    q = abs(n) // abs(d)
    return q if (n < 0) == (d < 0) else -q


def round_div(n: int, d: int) -> int:
    """Nearest quotient; halves go away from zero."""
    half = abs(d) // 2
    return trunc_div(n + half if (n < 0) == (d < 0) else n - half, d) if n else 0


def sign(x: Column) -> Column:
    """1 or -1; 0 counts as positive."""
    return F.when(x >= 0, 1).otherwise(-1)


def ratio(n: Column, d: Column) -> Column:
    """n / d rounded half to even at six places; 0 where d is 0."""
    return F.when(d == 0, F.lit(0.0)).otherwise(F.bround(n.cast("double") / F.nullif(d.cast("double"), F.lit(0.0)), 6))
