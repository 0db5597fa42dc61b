"""Scans of the given parquet tables (S1) and temp views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """One temp view per table, so SQL and DataFrame code share plans."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """S3: empty-input guard. ``isEmpty`` reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df
