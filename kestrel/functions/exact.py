"""Exact numeric helpers.

Double sums depend on the order rows arrive in, so two engines (or two runs
with different partitioning) can differ in the last bits. Money and price
columns carry at most four decimals, so we sum them as DECIMAL (exact in any
order) and only then cast to DOUBLE and divide by the count. The same IEEE
operations on the same inputs give the same bits everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["dec", "exact_sum", "exact_avg", "STD_DIGITS"]

# Sample stddev goes through a square root of a difference of large sums;
# it is rounded to this many decimals so it is reproducible across engines.
STD_DIGITS = 6


def dec(c, scale: int = 4, precision: int = 18) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({precision},{scale})")


def _over(agg: Column, w) -> Column:
    return agg if w is None else agg.over(w)


def exact_sum(c, scale: int = 4, w=None) -> Column:
    """Order-independent sum of a value with at most ``scale`` decimals,
    returned as DOUBLE. ``w``: optional window spec."""
    return _over(F.sum(dec(c, scale)), w).cast("double")


def exact_avg(c, scale: int = 4, w=None) -> Column:
    """sum(decimal) / count, as DOUBLE; NULL on an empty frame."""
    return F.try_divide(_over(F.sum(dec(c, scale)), w).cast("double"),
                        _over(F.count(c), w).cast("double"))
