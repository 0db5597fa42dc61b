"""Registered audit-trail queries over the ``events`` table (one run per
user) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import audit as au
from kestrel.sources.tables import table

# A tampered copy of the chain used by the verification queries: the payload
# of every 'error' event at sequence 3 is rewritten, and every 'purchase'
# event at sequence 5 is removed (a deleted middle event).
TAMPER_PAYLOAD = '{"k": -1}'
STORED_BEFORE = "2024-01-20"
BATCH_FROM = "2024-01-15"
REPLAY_FROM = "2024-01-25"
EXPECTED_FUNNEL = ["signup", "view", "click", "purchase"]


def _events(spark, sf_dir) -> DataFrame:
    return au.events_as_audit(table(spark, sf_dir, "events"))


def _chain(spark, sf_dir, materialize: bool = True) -> DataFrame:
    """The chained trail, written once to the shared checkpoint folder when
    a query reads it more than once (the chain is the expensive, sequential
    step)."""
    c = au.build_chain(_events(spark, sf_dir))
    if materialize:
        from kestrel.session import cut_lineage
        c = cut_lineage(c)
    return c


def _tampered(spark, sf_dir) -> DataFrame:
    c = _chain(spark, sf_dir)
    c = c.where(~((F.col("event_type") == "purchase") & (F.col("sequence_number") == 5)))
    return c.withColumn("payload", F.when(
        (F.col("event_type") == "error") & (F.col("sequence_number") == 3),
        F.lit(TAMPER_PAYLOAD)).otherwise(F.col("payload")))


def _runs(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run_id"))
    u = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"))
    return c.unionByName(u).distinct()


def audit_events(spark, sf_dir):
    """W12 + F25: events mapped onto audit events, sequence per run."""
    return _events(spark, sf_dir)


def audit_chain(spark, sf_dir):
    """G1 + F14: the hash chain (per-run streaming fold)."""
    return _chain(spark, sf_dir, materialize=False)


def audit_verify(spark, sf_dir):
    """G2 + W11: first failing event per run, no_events for unknown runs."""
    return au.verify_runs(_tampered(spark, sf_dir), _runs(spark, sf_dir))


def audit_verify_exact(spark, sf_dir):
    """G2 with the Arrow-batched byte-exact hash (F14 exact form)."""
    return au.verify_runs(_tampered(spark, sf_dir), _runs(spark, sf_dir), exact=True)


def audit_link_check(spark, sf_dir):
    """Link-only check (split lag of the stored hash)."""
    return au.link_check(_tampered(spark, sf_dir))


def audit_completeness(spark, sf_dir):
    """Count, gaps, actors and order against an expected funnel."""
    return au.run_completeness(_tampered(spark, sf_dir), EXPECTED_FUNNEL)


def audit_trail_validity(spark, sf_dir):
    """G5 + T3: every event with its run's verification result."""
    return au.trail_with_validity(_tampered(spark, sf_dir))


def audit_insert_or_ignore(spark, sf_dir):
    """Rows an INSERT OR IGNORE keeps from an overlapping batch."""
    c = _chain(spark, sf_dir)
    stored = c.where(F.col("timestamp_utc") < STORED_BEFORE)
    batch = c.where(F.col("timestamp_utc") >= BATCH_FROM).unionByName(
        c.where(F.col("timestamp_utc") >= REPLAY_FROM))
    return au.insert_or_ignore(stored, batch)


def audit_sequence_assign(spark, sf_dir):
    """New events numbered after each run's stored maximum."""
    ev = table(spark, sf_dir, "events")
    stored = _events(spark, sf_dir).where(F.col("timestamp_utc") < STORED_BEFORE)
    new = ev.where(F.col("ts") >= F.lit(STORED_BEFORE).cast("timestamp")).select(
        F.col("user_id").cast("string").alias("run_id"), F.to_date("ts").alias("day"),
        "ts", "event_id", "event_type")
    out = au.assign_sequences(stored, new, ["day", "ts", "event_id"])
    return out.select("run_id", "event_id", "event_type", "sequence_number")


def audit_max_sequence(spark, sf_dir):
    """A10: max sequence per run, 0 without events."""
    return au.max_sequence(_events(spark, sf_dir), _runs(spark, sf_dir))


def audit_events_per_run(spark, sf_dir):
    """Events per run plus the total (ROLLUP)."""
    return au.events_per_run(_events(spark, sf_dir))


def audit_recent_runs(spark, sf_dir):
    """T5: the five most recently active runs."""
    return au.recent_runs(_events(spark, sf_dir), 5)


QUERIES = {
    "audit_events": audit_events,
    "audit_chain": audit_chain,
    "audit_verify": audit_verify,
    "audit_verify_exact": audit_verify_exact,
    "audit_link_check": audit_link_check,
    "audit_completeness": audit_completeness,
    "audit_trail_validity": audit_trail_validity,
    "audit_insert_or_ignore": audit_insert_or_ignore,
    "audit_sequence_assign": audit_sequence_assign,
    "audit_max_sequence": audit_max_sequence,
    "audit_events_per_run": audit_events_per_run,
    "audit_recent_runs": audit_recent_runs,
}

# ---------------------------------------------------------------- oracles

EV_CTE = """
ev0 AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id,
         row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), ts, event_id) AS sequence_number,
         event_type,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'user' ELSE 'agent' END AS actor,
         event_type || '_node' AS node_name,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp_utc,
         props AS payload
  FROM events
),
ev AS (
  SELECT sha256(run_id || '|' || CAST(sequence_number AS VARCHAR)) AS event_id, run_id, sequence_number,
         event_type, actor, node_name, timestamp_utc, payload
  FROM ev0
)"""


def _before(p=""):
    return (f"""'{{"actor":' || to_json({p}actor) || ',"event_id":' || to_json({p}event_id) ||
      ',"event_type":' || to_json({p}event_type) || ',"node_name":' || to_json({p}node_name) ||
      ',"payload":' || coalesce(CAST(json({p}payload) AS VARCHAR), 'null') || ',"prev_hash":"'""")


def _after(p=""):
    return (f"""'","run_id":' || to_json({p}run_id) || ',"sequence_number":' || CAST({p}sequence_number AS VARCHAR) ||
      ',"timestamp_utc":' || to_json({p}timestamp_utc) || '}}'""")


CHAIN_CTE = f"""{EV_CTE},
parts AS (SELECT *, {_before()} AS b, {_after()} AS a FROM ev),
chain(run_id, sequence_number, prev_hash, event_hash) AS (
  SELECT run_id, sequence_number, 'GENESIS', sha256(b || 'GENESIS' || a) FROM parts WHERE sequence_number = 1
  UNION ALL
  SELECT p.run_id, p.sequence_number, c.event_hash, sha256(p.b || c.event_hash || p.a)
  FROM chain c JOIN parts p ON p.run_id = c.run_id AND p.sequence_number = c.sequence_number + 1
),
chain_full AS (
  SELECT e.event_id, e.run_id, e.sequence_number, e.event_type, e.actor, e.node_name, e.timestamp_utc,
         e.payload, c.prev_hash, c.event_hash
  FROM ev e JOIN chain c ON e.run_id = c.run_id AND e.sequence_number = c.sequence_number
)"""

TAMPER_CTE = f"""{CHAIN_CTE},
tampered AS (
  SELECT event_id, run_id, sequence_number, event_type, actor, node_name, timestamp_utc,
         CASE WHEN event_type = 'error' AND sequence_number = 3 THEN '{TAMPER_PAYLOAD}' ELSE payload END AS payload,
         prev_hash, event_hash
  FROM chain_full WHERE NOT (event_type = 'purchase' AND sequence_number = 5)
),
runs AS (
  SELECT CAST(c_custkey AS VARCHAR) AS run_id FROM customer
  UNION SELECT CAST(user_id AS VARCHAR) FROM events
),
chk AS (
  SELECT t.*,
         CASE WHEN sha256({_before('t.')} || t.prev_hash || {_after('t.')}) <> t.event_hash THEN 'hash_mismatch'
              WHEN t.prev_hash <> coalesce(lag(t.event_hash) OVER (PARTITION BY t.run_id ORDER BY t.sequence_number), 'GENESIS')
              THEN 'chain_broken' END AS failure
  FROM tampered t
),
per AS (
  SELECT run_id, count(*) AS event_count,
         min(sequence_number) FILTER (WHERE failure IS NOT NULL) AS tampered_at_sequence,
         arg_min(failure, sequence_number) FILTER (WHERE failure IS NOT NULL) AS reason
  FROM chk GROUP BY run_id
)"""

ORACLES = {
    "audit_events": f"WITH {EV_CTE} SELECT * FROM ev",
    "audit_chain": f"WITH RECURSIVE {CHAIN_CTE} SELECT * FROM chain_full",
    "audit_verify": f"""WITH RECURSIVE {TAMPER_CTE}
SELECT r.run_id,
       CASE WHEN p.run_id IS NULL THEN false ELSE p.tampered_at_sequence IS NULL END AS valid,
       coalesce(p.event_count, 0) AS event_count, p.tampered_at_sequence,
       CASE WHEN p.run_id IS NULL THEN 'no_events' ELSE p.reason END AS reason
FROM runs r LEFT JOIN per p ON r.run_id = p.run_id""",
    "audit_link_check": f"""WITH RECURSIVE {TAMPER_CTE},
lk AS (SELECT run_id, sequence_number,
              prev_hash <> coalesce(lag(event_hash) OVER (PARTITION BY run_id ORDER BY sequence_number), 'GENESIS') AS broken
       FROM tampered)
SELECT run_id, count(*) AS event_count,
       min(sequence_number) FILTER (WHERE broken) AS first_broken_sequence,
       count(*) FILTER (WHERE broken) AS broken_links
FROM lk GROUP BY run_id""",
    "audit_completeness": f"""WITH RECURSIVE {TAMPER_CTE},
expected(sequence_number, expected_type) AS (VALUES {", ".join(f"({i + 1}, '{t}')" for i, t in enumerate(EXPECTED_FUNNEL))}),
agg AS (
  SELECT run_id, count(*) AS event_count, min(sequence_number) AS first_sequence,
         max(sequence_number) AS last_sequence, count(DISTINCT sequence_number) AS distinct_sequences,
         count(*) FILTER (WHERE actor = 'user') AS user_events,
         count(*) FILTER (WHERE actor NOT IN ('user', 'agent')) AS unknown_actor_events
  FROM tampered GROUP BY run_id
),
mism AS (
  SELECT t.run_id, count(DISTINCT e.sequence_number) FILTER (WHERE t.event_type = e.expected_type) AS hits
  FROM tampered t JOIN expected e ON t.sequence_number = e.sequence_number GROUP BY t.run_id
)
SELECT a.*, (first_sequence = 1 AND last_sequence = event_count AND distinct_sequences = event_count) AS gap_free,
       (SELECT count(*) FROM expected) - coalesce(m.hits, 0) AS order_mismatches
FROM agg a LEFT JOIN mism m ON a.run_id = m.run_id""",
    "audit_trail_validity": f"""WITH RECURSIVE {TAMPER_CTE}
SELECT t.*, p.tampered_at_sequence IS NULL AS valid, p.event_count, p.tampered_at_sequence, p.reason
FROM tampered t LEFT JOIN per p ON t.run_id = p.run_id""",
    "audit_insert_or_ignore": f"""WITH RECURSIVE {CHAIN_CTE},
stored AS (SELECT * FROM chain_full WHERE timestamp_utc < '{STORED_BEFORE}'),
batch AS (SELECT * FROM chain_full WHERE timestamp_utc >= '{BATCH_FROM}'
          UNION ALL SELECT * FROM chain_full WHERE timestamp_utc >= '{REPLAY_FROM}'),
fresh AS (
  SELECT b.* FROM batch b
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.event_id = b.event_id)
    AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.run_id = b.run_id AND s.sequence_number = b.sequence_number)
),
d1 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY run_id, sequence_number) AS r1 FROM fresh),
d2 AS (SELECT * EXCLUDE (r1), row_number() OVER (PARTITION BY run_id, sequence_number ORDER BY event_id) AS r2
       FROM d1 WHERE r1 = 1)
SELECT * EXCLUDE (r2) FROM d2 WHERE r2 = 1""",
    "audit_sequence_assign": f"""WITH {EV_CTE},
base AS (SELECT run_id, max(sequence_number) AS m FROM ev WHERE timestamp_utc < '{STORED_BEFORE}' GROUP BY run_id),
new AS (SELECT CAST(user_id AS VARCHAR) AS run_id, ts, event_id, event_type FROM events
        WHERE ts >= TIMESTAMP '{STORED_BEFORE}')
SELECT n.run_id, n.event_id, n.event_type,
       coalesce(b.m, 0) + row_number() OVER (PARTITION BY n.run_id ORDER BY CAST(n.ts AS DATE), n.ts, n.event_id)
         AS sequence_number
FROM new n LEFT JOIN base b ON n.run_id = b.run_id""",
    "audit_max_sequence": f"""WITH {EV_CTE},
runs AS (SELECT CAST(c_custkey AS VARCHAR) AS run_id FROM customer UNION SELECT CAST(user_id AS VARCHAR) FROM events)
SELECT r.run_id, CAST(coalesce(max(e.sequence_number), 0) AS BIGINT) AS max_sequence
FROM runs r LEFT JOIN ev e ON r.run_id = e.run_id GROUP BY r.run_id""",
    "audit_events_per_run": f"WITH {EV_CTE} SELECT run_id, count(*) AS events FROM ev GROUP BY ROLLUP (run_id)",
    "audit_recent_runs": f"""WITH {EV_CTE}
SELECT run_id, max(timestamp_utc) AS last_event_at FROM ev GROUP BY run_id
ORDER BY last_event_at DESC, run_id ASC LIMIT 5""",
}
ORACLES["audit_verify_exact"] = ORACLES["audit_verify"]
