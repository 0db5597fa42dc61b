"""Ordering operators that avoid single-partition windows.

``global_ordinal`` numbers rows of a total order without ``row_number()``
over an unpartitioned window (which moves every row into one task): the rows
are range-partitioned and sorted (distributed), each row's position inside
its partition comes from ``monotonically_increasing_id`` (partition id in
the upper 31 bits, position in the lower 33 — documented behaviour), and a
per-partition prefix of counts (at most one row per partition, so its size
is bounded by the partition count) is broadcast back.

The sorted frame is checkpointed into the shared checkpoint folder first, so
the count pass and the numbering pass read the same materialised partitions
even if executors are lost or AQE re-plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import cut_lineage

_POS_MASK = (1 << 33) - 1


def global_ordinal(df: DataFrame, order_cols, name: str = "ordinal",
                   materialize: bool = True) -> DataFrame:
    """Adds ``name``: 0-based position of the row in ``order_cols`` order.
    ``order_cols`` must be a total order for the result to be reproducible."""
    s = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    if materialize:
        s = cut_lineage(s)
    s = (s.withColumn("_pid", F.shiftright("_mid", 33))
         .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_POS_MASK))))
    per_part = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # offsets has one row per partition: a bounded broadcast.
    out = s.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_pos")).cast("long")).drop(
        "_mid", "_pid", "_pos", "_off")


def frequency_index(df: DataFrame, col: str, name: str | None = None,
                    materialize: bool = True) -> DataFrame:
    """Label encoding by frequency, as ``StringIndexer`` with
    ``stringOrderType='frequencyDesc'``: most frequent value -> 0.0, ties by
    the value's text, ascending. Returns (value, index DOUBLE) — one row per
    distinct value, built by partial aggregation and a distributed sort."""
    name = name or f"{col}_label"
    counts = (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("_cnt"))
              .withColumn("_txt", F.col(col).cast("string")))
    idx = global_ordinal(counts, [F.desc("_cnt"), F.asc("_txt")], "_ord", materialize)
    return idx.select(col, F.col("_ord").cast("double").alias(name))


def frequency_index_from_counts(counts: DataFrame, col: str, count_col: str, name: str,
                                materialize: bool = True) -> DataFrame:
    """X10 from a table that already holds one row and its count per value."""
    c = counts.select(col, F.col(count_col).alias("_cnt")).withColumn("_txt", F.col(col).cast("string"))
    idx = global_ordinal(c, [F.desc("_cnt"), F.asc("_txt")], "_ord", materialize)
    return idx.select(col, F.col("_ord").cast("double").alias(name))
