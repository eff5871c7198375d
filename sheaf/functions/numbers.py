"""Numeric helpers: rounding that is stable under summation order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Averages of doubles differ in the last bits with summation order; plain
# round() then flips exact ties (x.xxxxxx5) either way.  Half-up with a
# small bias is stable: float noise is ~1e-10 in the scaled space.
_BIAS = 1e-6


def round6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.floor(c * 1_000_000 + 0.5 + _BIAS) / 1_000_000).cast("double")


def round6_sql(x: str) -> str:
    return f"(floor(({x}) * 1000000 + 0.5 + {_BIAS}) / 1000000)"
