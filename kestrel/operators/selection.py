"""Selection operators.

All are group-wise picks computed without collecting a group: limits on row
numbers and ``max_by`` aggregates both work map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_k_per_group(df: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The last ``k`` rows of each group in ``order``. The limit on the
    row number reaches below the exchange (a window group limit in each map
    task), so at most ``k`` rows a task of a hot group are shuffled."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("position_from_end", F.row_number().over(w)).where(F.col("position_from_end") <= k)


def chosen_or_first(df: DataFrame, key: str, rank_col: str, chosen, order: list[str]) -> DataFrame:
    """Per group, the row whose ``rank_col`` equals ``chosen``, else the
    first row in ``order`` — one ``max_by`` per group."""
    pick = F.struct((F.col(rank_col) == F.lit(chosen)).alias("_hit"),
                    *[(-F.col(c)).alias(f"_neg_{c}") for c in order])
    cols = [c for c in df.columns if c != key]
    g = df.groupBy(key).agg(F.max_by(F.struct(*cols), pick).alias("_row"),
                            F.max((F.col(rank_col) == F.lit(chosen)).cast("int")).alias("_found"))
    return g.select(key, *[F.col(f"_row.{c}").alias(c) for c in cols],
                    (F.col("_found") == 1).alias("was_chosen"))


def rank_opportunities(inventory: DataFrame, profile: DataFrame) -> DataFrame:
    """Rank tables as candidate use cases by value × readiness ×
    1/complexity. value = log10(rows + 1); readiness = mean non-null share
    of the columns, doubled when the table has a date column and a
    label-like column; complexity = column count. The rank window runs over
    one row per table (bounded by the table count)."""
    r = profile.groupBy("table_name").agg(
        F.avg(1 - F.col("null_count") / F.greatest(F.col("row_count"), F.lit(1))).alias("fill"),
        F.max(F.col("data_type").isin("date", "timestamp", "timestamp_ntz").cast("int")).alias("has_date"),
        F.max(((F.col("distinct_count") <= 20) & (F.col("distinct_count") >= 2)).cast("int")).alias("has_label"))
    # a table without a profile has no readiness, and stays
    t = inventory.join(r, inventory.name == r.table_name, "left").na.fill({"fill": 0.0, "has_date": 0, "has_label": 0})
    value = F.log10(F.col("row_count").cast("double") + 1)
    ready = F.col("fill") * (1 + F.col("has_date") * F.col("has_label"))
    score = F.round(value * ready / F.col("column_count").cast("double"), 9)
    w = Window.orderBy(F.desc("score"), F.asc("name"))
    return (t.select("name", "row_count", "column_count", F.round("fill", 9).alias("readiness_fill"),
                     "has_date", "has_label", score.alias("score"))
            .withColumn("rank", F.row_number().over(w)))
