"""Join operators.

Broadcasts are only issued behind a row-count check (``bounded_broadcast``):
the check reads at most ``max_rows + 1`` rows, and beyond the bound the side
is joined by a normal shuffle join (AQE may still choose a broadcast from
runtime statistics, and splits skewed partitions of sort-merge joins).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default bound for dimension tables we are willing to broadcast.
DIM_ROWS_MAX = 200_000


def bounded_broadcast(df: DataFrame, max_rows: int = DIM_ROWS_MAX) -> DataFrame:
    """``broadcast(df)`` when it provably has at most ``max_rows`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def left_dimension_join(fact: DataFrame, dim: DataFrame, key: str, columns,
                        renames: dict | None = None,
                        max_broadcast_rows: int = DIM_ROWS_MAX) -> DataFrame:
    """Fact ⟕ dimension on ``key``, keeping every fact row and adding
    ``columns`` of the dimension (renamed by ``renames``). Rows without a
    match keep NULLs, so the row count of ``fact`` is preserved as long as
    the dimension is unique on ``key``."""
    renames = renames or {}
    d = dim.select(F.col(key), *[F.col(c).alias(renames.get(c, c)) for c in columns])
    return fact.join(bounded_broadcast(d, max_broadcast_rows), on=key, how="left")


def has_repeats(dim: DataFrame, key: str) -> bool:
    """Whether a key (not NULL) of the dimension stands in more than one row."""
    return not dim.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()


def left_dimension_repeats(fact: DataFrame, dim: DataFrame, key: str,
                           max_broadcast_rows: int = DIM_ROWS_MAX) -> DataFrame:
    """The rows of ``left_dimension_join`` when no column of the dimension is
    wanted: every fact row as often as the dimension holds its key, once if it
    does not. Only keys that repeat meet the fact, so with unique keys it is
    the fact as it lies."""
    again = (dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"))
    n = again.limit(max_broadcast_rows + 1).count()
    if not n:
        return fact
    f = fact.join(F.broadcast(again) if n <= max_broadcast_rows else again, on=key, how="left")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_times", F.lit(1).cast("long"))))
    return f.select(*fact.columns, copies.alias("_copy")).drop("_copy")


def null_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where NULL meets NULL, with the keys once."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond, "left").drop(*[f"_r_{k}" for k in keys])
