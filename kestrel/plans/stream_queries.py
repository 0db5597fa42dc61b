"""Registered streaming queries (run to completion with an availableNow
trigger) and their oracles."""

from __future__ import annotations

from kestrel.plans.audit_queries import ORACLES as AUDIT_ORACLES
from kestrel.streaming import audit_ingest as ai
from kestrel.streaming import event_windows as ew


def stream_audit_chain(spark, sf_dir):
    """The chained trail built by the stateful stream; equal to the
    batch chain."""
    return ai.run_to_table(ai.audit_ingest(ai.event_stream(spark, sf_dir)), "audit_ingest")


def stream_audit_replayed(spark, sf_dir):
    """Z1 on a careless source: the events in four files of no time order, every
    eleventh without an id, every seventh of those with one sent again in a
    later file. Per run: every event is there once, the chain holds."""
    import uuid

    from pyspark.sql import functions as F

    from kestrel.operators import audit as au
    from kestrel.session import shared_path
    from kestrel.sources.tables import table
    events = table(spark, sf_dir, "events").withColumn("_file", F.pmod("event_id", F.lit(4)))
    events = events.withColumn("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_id")))
    again = events.where("event_id % 7 = 0").withColumn("_file", F.lit(4).cast("long"))
    both = events.unionByName(again)
    folder = shared_path(spark, "tables", f"replayed-{uuid.uuid4().hex}")
    for k in (2, 0, 3, 1, 4):  # their order in time is that of writing
        # read by all tasks, written by one
        both.where(F.col("_file") == k).drop("_file").repartition(1).write.mode("append").parquet(f"{folder}/events.parquet")
    trail = ai.run_to_table(ai.audit_ingest(ai.event_stream(spark, folder)), "replayed")
    runs = au.verify_runs(trail).join(au.run_completeness(trail).select("run_id", "gap_free"), "run_id")
    return runs.select("run_id", "valid", "event_count", "gap_free", "reason")


def stream_event_windows(spark, sf_dir):
    """Tumbling and sliding hourly windows per event type."""
    keys = ["window_kind", "event_type", "window_start", "window_end"]
    both = lambda e: ew.tumbling(e).unionByName(ew.sliding(e))
    return ew.run_partial_log(ai.event_stream(spark, sf_dir), both, keys, "event_windows")


def event_sessions(spark, sf_dir):
    """Z2 on the table: per-user sessions with a 30-minute gap, the same
    sessions ``session_window`` gives on the stream (where they run in append
    mode, ``stream_sessions_closed``), built with split windows so a very
    active user is not one task."""
    from kestrel.sources.tables import table
    return ew.sessions_batch(table(spark, sf_dir, "events"))


QUERIES = {
    "stream_audit_chain": stream_audit_chain,
    "stream_audit_replayed": stream_audit_replayed,
    "stream_event_windows": stream_event_windows,
    "event_sessions": event_sessions,
}

_VSUM = "CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS value_sum"

ORACLES = {
    "stream_audit_chain": AUDIT_ORACLES["audit_chain"],
    "stream_audit_replayed": """
SELECT CAST(user_id AS VARCHAR) AS run_id, true AS valid, count(*) AS event_count, true AS gap_free, CAST(NULL AS VARCHAR) AS reason
FROM events GROUP BY user_id""",
    "stream_event_windows": f"""
SELECT 'tumbling_1h' AS window_kind, event_type, date_trunc('hour', ts) AS window_start,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS events, {_VSUM}
FROM events GROUP BY ALL
UNION ALL
SELECT 'sliding_1h_15m', event_type, s AS window_start, s + INTERVAL 1 HOUR AS window_end, count(*), {_VSUM}
FROM (SELECT *, unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE,
                                       time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS s FROM events)
GROUP BY ALL""",
    "event_sessions": f"""
WITH o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events, {_VSUM}
FROM g GROUP BY user_id, sid""",
}
