"""Run history as a table.

The reference upserts one row per run: catalog / schema_name / use_case keep
their old value when the new one is the empty string, status is always
replaced, created_at is kept, updated_at replaced. Over a log of updates
that is: last non-empty value per field, last status, min and max time.

``merge_history`` applies a batch of updates to a stored history with one
aggregation over their union (stored rows act as updates stamped with their
own times) — ``max_by`` and ``min`` aggregate partially on the map side, so
a run with a huge number of updates is not a hot task, and no join is
needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP_IF_EMPTY = ["catalog", "schema_name", "use_case"]
HISTORY_COLS = ["run_id", "catalog", "schema_name", "use_case", "status", "created_at", "updated_at"]


def _latest_non_empty(c: str):
    order = F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("_at", "_tie"))
    return F.coalesce(F.max_by(c, order), F.lit("")).alias(c)


def history_from_updates(updates: DataFrame) -> DataFrame:
    """updates: run_id, catalog, schema_name, use_case, status, at (ISO text
    or timestamp), tie (total order among updates with equal ``at``)."""
    u = updates.withColumn("_at", F.col("at").cast("string")).withColumn("_tie", F.col("tie"))
    if "created" not in u.columns:
        u = u.withColumn("created", F.col("_at"))
    return u.groupBy("run_id").agg(
        *[_latest_non_empty(c) for c in KEEP_IF_EMPTY],
        F.max_by("status", F.struct("_at", "_tie")).alias("status"),
        F.min("created").alias("created_at"),
        F.max("_at").alias("updated_at"))


def merge_history(stored: DataFrame, updates: DataFrame) -> DataFrame:
    """The upsert of ``updates`` into ``stored`` (both as above;
    stored has created_at / updated_at)."""
    tie_type = updates.schema["tie"].dataType
    s = stored.select("run_id", *KEEP_IF_EMPTY, "status", F.col("updated_at").cast("string").alias("at"),
                      F.lit(None).cast(tie_type).alias("tie"), F.col("created_at").cast("string").alias("created"))
    u = updates.select("run_id", *KEEP_IF_EMPTY, "status", F.col("at").cast("string").alias("at"),
                       "tie", F.col("at").cast("string").alias("created"))
    return history_from_updates(s.unionByName(u))


def latest_runs(history: DataFrame, limit: int = 20) -> DataFrame:
    """Newest first by updated_at, limit clamped to 1..100 (top-k is the
    feature); ties by run_id."""
    limit = max(1, min(int(limit), 100))
    return history.orderBy(F.desc("updated_at"), F.asc("run_id")).limit(limit)
