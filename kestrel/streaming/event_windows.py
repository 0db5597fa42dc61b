"""Rolling event features over the ``events`` stream (ours).

Tumbling (1 h) and sliding (1 h every 15 min) windows are aggregated inside
each micro-batch and the partial rows are logged by ``foreachBatch`` in a
folder of the batch's own (written over if the batch is retried); the current
table is their sum by key. No state is kept and no row is too late to count,
in whatever order files arrive. Sessions (30 min gap) need a watermark and run
in append mode, or over the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.exact import dec
from kestrel.session import shared_path


def _aggs():
    return [F.count(F.lit(1)).alias("events"), F.sum(dec("value", 4)).cast("double").alias("value_sum")]


def _partials():
    return [F.count(F.lit(1)).alias("events"), F.sum(dec("value", 4)).alias("value_sum")]


def tumbling(e: DataFrame) -> DataFrame:
    """Partial rows of a batch of events."""
    tum = (e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(*_partials())
           .select(F.lit("tumbling_1h").alias("window_kind"), "event_type",
                   F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                   F.col("w.end").cast("timestamp_ntz").alias("window_end"), "events", "value_sum"))
    return tum


def sliding(e: DataFrame) -> DataFrame:
    """Partial rows of a batch of events."""
    return (e.groupBy(F.window("ts", "1 hour", "15 minutes").alias("w"), "event_type").agg(*_partials())
            .select(F.lit("sliding_1h_15m").alias("window_kind"), "event_type",
                    F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "events", "value_sum"))


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "2 hours") -> DataFrame:
    e = events.withWatermark("ts", watermark)
    return (e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(*_aggs())
            .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("session_end"),
                    "events", "value_sum"))


def sessions_batch(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions over a table (skew-safe; see ``windows.sessionize``)."""
    from kestrel.operators.windows import sessionize
    s = sessionize(events, ["user_id"], "ts", gap_seconds)
    g = s.groupBy("user_id", "session_no").agg(
        F.min("ts").alias("_start"), F.max("ts").alias("_last"), *_aggs())
    return g.select("user_id", F.col("_start").cast("timestamp_ntz").alias("session_start"),
                    (F.col("_last").cast("timestamp_ntz") + F.expr(f"INTERVAL {gap_seconds} SECONDS"))
                    .alias("session_end"), "events", "value_sum")


def run_partial_log(stream: DataFrame, partial, keys: list[str], name: str) -> DataFrame:
    """Run a stream of events to completion, logging ``partial`` of each
    micro-batch, and return the sums by key."""
    spark = stream.sparkSession
    base = shared_path(spark, "streams", f"{name}-{uuid.uuid4().hex}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{base}/log/batch={batch_id}")

    q = (stream.writeStream.foreachBatch(sink)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    log = spark.read.parquet(f"{base}/log")
    return log.groupBy(*keys).agg(F.sum("events").alias("events"), F.sum("value_sum").cast("double").alias("value_sum"))


def stream_sessions_closed(events: DataFrame, name: str = "sessions") -> DataFrame:
    """Session windows on a stream in append mode: a session is written once
    the watermark passes its end, so on an endless stream every session is
    emitted exactly once and state stays bounded; sessions still open when
    an availableNow run ends stay in state for the next run."""
    spark = events.sparkSession
    base = shared_path(spark, "streams", f"{name}-{uuid.uuid4().hex}")
    q = (sessions(events).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/data")
