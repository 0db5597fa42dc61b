"""Hash-chained audit trail as tables (SURVEY 2.11 G1–G5, S12, W11, W12, A10,
A11, T3, T5; F14, F25).

Event schema (F-4): event_id, run_id, sequence_number, event_type, actor,
node_name, timestamp_utc, payload (JSON text), prev_hash, event_hash.

event_hash = SHA-256 of the canonical JSON of every field except event_hash:
keys sorted at every level, separators ``,`` and ``:``, non-ASCII as ``\\uXXXX``,
numbers as Python writes them. This is byte for byte the original application's
form; batch, stream and verification all use it. A payload that is no JSON text
is written as ``!`` and a JSON string, which no JSON payload can look like.
``prev_hash`` is the previous event's hash in sequence order, ``GENESIS`` for
the first.

* Building a chain is sequential inside a run (each hash needs the previous
  one). Runs are spread over partitions by hash, each partition is sorted
  (spilling sort) and a ``mapInPandas`` fold streams it with constant memory,
  carrying only the last hash. No run is ever collected into one row. A run's
  chain is still computed by one task: SHA-256 chaining has no parallel form.
* Verifying is parallel: each row's hash is recomputed from its own fields;
  the link check needs the previous row's stored hash, found with a window
  split into sequence buckets (``split_lag``) so a hot run is spread out.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.scalars import deterministic_event_id
from kestrel.operators.joins import null_safe_left_join
from kestrel.operators.windows import prior_frame
from kestrel.session import cut_lineage

GENESIS = "GENESIS"
EVENT_FIELDS = ["event_id", "run_id", "sequence_number", "event_type", "actor",
                "node_name", "timestamp_utc", "payload", "prev_hash", "event_hash"]


# --------------------------------------------------------------------------
# canonical JSON
# --------------------------------------------------------------------------

def _js(c) -> Column:
    """JSON string literal of a text column (``null`` for NULL), ASCII only. Text
    of printable ASCII takes the fast way; else the UTF-16 code units are
    written one by one (a character beyond them is a surrogate pair)."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.concat(F.lit('"'), F.regexp_replace(c, r'(["\\\\])', r"\\$1"), F.lit('"'))
    short = F.create_map(*[F.lit(x) for u, e in (("0022", '\\"'), ("005C", "\\\\"), ("0008", "\\b"), ("0009", "\\t"), ("000A", "\\n"), ("000C", "\\f"), ("000D", "\\r")) for x in (u, e)])
    unit = lambda u: F.coalesce(
        F.try_element_at(short, u),
        F.when((u >= "0020") & (u <= "007E"), F.char(F.conv(u, 16, 10).cast("long"))),
        F.concat(F.lit("\\u"), F.lower(u)))
    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("([0-9A-F]{4})"), F.lit(1))
    long = F.concat(F.lit('"'), F.array_join(F.transform(units, unit), ""), F.lit('"'))
    return F.when(c.isNull(), F.lit("null")).when(c.rlike(r"[^\x20-\x7E]"), long).otherwise(plain)


def _canonical(payload: str | None) -> str:
    """The payload's canonical text, as the module says."""
    if payload is None:
        return "null"
    try:
        return json.dumps(json.loads(payload), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    except (ValueError, RecursionError):
        return "!" + json.dumps(payload)


@F.pandas_udf(T.StringType())
def _canonical_payloads(payload: pd.Series) -> pd.Series:
    known = {p: _canonical(p) for p in payload.unique()}
    return payload.map(known.__getitem__)


def canonical_payload(c) -> Column:
    """Payload JSON text -> canonical text; ``null`` for NULL. JSON of any depth
    with Python's number forms has no expression, so an Arrow function reads
    each distinct payload of a batch once."""
    return F.coalesce(_canonical_payloads(F.col(c) if isinstance(c, str) else c), F.lit("null"))


def hash_parts(df: DataFrame) -> DataFrame:
    """Adds ``_before`` and ``_after``: canonical JSON of the event around
    the prev_hash value, so ``sha256(_before || prev_hash || _after)`` is the
    event hash. Keys in sorted order: actor, event_id, event_type, node_name,
    payload, prev_hash, run_id, sequence_number, timestamp_utc."""
    before = F.concat(
        F.lit('{"actor":'), _js(F.col("actor")),
        F.lit(',"event_id":'), _js(F.col("event_id")),
        F.lit(',"event_type":'), _js(F.col("event_type")),
        F.lit(',"node_name":'), _js(F.col("node_name")),
        F.lit(',"payload":'), canonical_payload("payload"),
        F.lit(',"prev_hash":"'))
    after = F.concat(
        F.lit('","run_id":'), _js(F.col("run_id")),
        F.lit(',"sequence_number":'), F.col("sequence_number").cast("string"),
        F.lit(',"timestamp_utc":'), _js(F.col("timestamp_utc")),
        F.lit("}"))
    return df.withColumn("_before", before).withColumn("_after", after)


def recomputed_hash(df: DataFrame) -> Column:
    """SHA-256 of the canonical event with its stored prev_hash (native)."""
    return F.sha2(F.concat(F.col("_before"), F.col("prev_hash"), F.col("_after")), 256)


@F.pandas_udf(T.StringType())
def exact_event_hash(actor: pd.Series, event_id: pd.Series, event_type: pd.Series,
                     node_name: pd.Series, payload: pd.Series, prev_hash: pd.Series,
                     run_id: pd.Series, seq: pd.Series, ts: pd.Series) -> pd.Series:
    """The same hash, the whole event written by Python's ``json`` (sorted keys,
    ASCII escapes): an independent check of the expressions above."""
    out = []
    for a, e, t, n, p, ph, r, s, u in zip(actor, event_id, event_type, node_name, payload,
                                          prev_hash, run_id, seq, ts):
        fields = {"actor": a, "event_id": e, "event_type": t, "node_name": n, "payload": None, "prev_hash": ph,
                  "run_id": r, "sequence_number": int(s), "timestamp_utc": u}
        written = {k: json.dumps(v) for k, v in fields.items()} | {"payload": _canonical(p)}
        canon = "{" + ",".join(f'"{k}":{written[k]}' for k in sorted(written)) + "}"
        out.append(hashlib.sha256(canon.encode("utf-8")).hexdigest())
    return pd.Series(out)


# --------------------------------------------------------------------------
# sources
# --------------------------------------------------------------------------

def events_as_audit(events: DataFrame) -> DataFrame:
    """Map the ``events`` table onto audit events without hashes: one run per
    user, sequence by (ts, event_id) — assigned with the split running count
    bucketed by hour (same order: the hour is monotone in ts), so a hot user
    is spread over its hours (W12)."""
    e = events.select(
        F.col("user_id").cast("string").alias("run_id"),
        F.date_trunc("hour", "ts").alias("_hour"), F.col("ts").alias("_ts"), F.col("event_id").alias("_eid"),
        "event_type",
        F.when(F.col("event_type").isin("signup", "purchase"), "user").otherwise("agent").alias("actor"),
        F.concat(F.col("event_type"), F.lit("_node")).alias("node_name"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp_utc"),
        F.col("props").alias("payload"))
    e = prior_frame(e, ["run_id"], ["_hour", "_ts", "_eid"],
                    {"sequence_number": ("count", "_eid")}, skew_split=True, include_current=True)
    return (e.withColumn("event_id", deterministic_event_id("run_id", "sequence_number"))
             .select("event_id", "run_id", "sequence_number", "event_type", "actor",
                     "node_name", "timestamp_utc", "payload"))


# --------------------------------------------------------------------------
# G1: build the chain
# --------------------------------------------------------------------------

_CHAIN_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()), T.StructField("run_id", T.StringType()),
    T.StructField("sequence_number", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("actor", T.StringType()), T.StructField("node_name", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()), T.StructField("payload", T.StringType()),
    T.StructField("prev_hash", T.StringType()), T.StructField("event_hash", T.StringType()),
])


def _fold_chain(batches):
    run, last = None, None
    for pdf in batches:
        prevs, hashes = [], []
        for r, b, a in zip(pdf["run_id"], pdf["_before"], pdf["_after"]):
            if r != run:
                run, last = r, GENESIS
            prevs.append(last)
            last = hashlib.sha256((b + last + a).encode("utf-8")).hexdigest()
            hashes.append(last)
        out = pdf.drop(columns=["_before", "_after"])
        out["prev_hash"] = prevs
        out["event_hash"] = hashes
        yield out[[f.name for f in _CHAIN_SCHEMA.fields]]


def build_chain(events: DataFrame) -> DataFrame:
    """G1: adds prev_hash and event_hash to events (event_id, run_id,
    sequence_number, event_type, actor, node_name, timestamp_utc, payload)."""
    df = hash_parts(events.select(*EVENT_FIELDS[:8]))
    s = df.repartition("run_id").sortWithinPartitions("run_id", "sequence_number")
    return s.mapInPandas(_fold_chain, _CHAIN_SCHEMA)


# --------------------------------------------------------------------------
# Previous row's value in sequence order, split into buckets
# --------------------------------------------------------------------------

def split_lag(df: DataFrame, part: str, order: str, value: str, out: str,
              bucket_size: int = 1 << 16) -> DataFrame:
    """``lag(value) over (partition by part order by order)`` without putting
    a whole hot group into one task: rows are windowed inside (part, bucket)
    with bucket = order // bucket_size; the first row of a bucket takes the
    last value of the nearest earlier non-empty bucket, from a per-bucket
    histogram (one row per bucket)."""
    b = F.floor(F.col(order) / F.lit(bucket_size)).cast("long")
    d = df.withColumn("_b", b)
    w = Window.partitionBy(part, "_b").orderBy(order)
    d = d.withColumn("_lag", F.lag(value).over(w)).withColumn("_first", F.lag(order).over(w).isNull())
    last = d.groupBy(part, "_b").agg(F.max_by(value, order).alias("_last"))
    carry = last.select(part, "_b", F.lag("_last").over(Window.partitionBy(part).orderBy("_b")).alias("_carry"))
    d = null_safe_left_join(d, carry, [part, "_b"])
    return d.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))) \
            .drop("_b", "_lag", "_first", "_carry")


# --------------------------------------------------------------------------
# verification
# --------------------------------------------------------------------------

def event_checks(trail: DataFrame, exact: bool = False) -> DataFrame:
    """Per event: recomputed hash, expected prev_hash and failure reason
    (hash_mismatch checked before chain_broken, as the reference does)."""
    d = hash_parts(trail)
    if exact:
        rec = exact_event_hash("actor", "event_id", "event_type", "node_name", "payload",
                               "prev_hash", "run_id", "sequence_number", "timestamp_utc")
    else:
        rec = recomputed_hash(d)
    d = d.withColumn("_rec", rec).drop("_before", "_after")
    d = split_lag(d, "run_id", "sequence_number", "event_hash", "_prev_stored")
    expected_prev = F.coalesce(F.col("_prev_stored"), F.lit(GENESIS))
    # null-safe: a missing hash is no match
    reason = (F.when(~F.col("_rec").eqNullSafe(F.col("event_hash")) | F.col("_rec").isNull(), "hash_mismatch")
              .when(~F.col("prev_hash").eqNullSafe(expected_prev), "chain_broken"))
    return d.withColumn("expected_prev_hash", expected_prev).withColumn("failure", reason) \
            .drop("_rec", "_prev_stored")


def verify_runs(trail: DataFrame, runs: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """One row per run: valid, event_count, tampered_at_sequence, reason.
    ``runs`` (run_id) lists runs to report; runs without events get
    ``no_events`` (valid false, count 0)."""
    chk = event_checks(trail, exact)
    first_fail = F.min(F.when(F.col("failure").isNotNull(),
                              F.struct(F.col("sequence_number"), F.col("failure"))))
    per = chk.groupBy("run_id").agg(F.count(F.lit(1)).alias("event_count"), first_fail.alias("_f"))
    per = per.select("run_id", F.col("_f").isNull().alias("valid"), "event_count",
                     F.col("_f.sequence_number").alias("tampered_at_sequence"),
                     F.col("_f.failure").alias("reason"))
    if runs is None:
        return per
    r = runs.select("run_id").distinct()
    out = r.join(per, "run_id", "left")
    none = F.col("event_count").isNull()
    return out.select(
        "run_id",
        F.when(none, F.lit(False)).otherwise(F.col("valid")).alias("valid"),
        F.coalesce(F.col("event_count"), F.lit(0)).alias("event_count"),
        "tampered_at_sequence",
        F.when(none, F.lit("no_events")).otherwise(F.col("reason")).alias("reason"))


def link_check(trail: DataFrame) -> DataFrame:
    """Link-only check: per run, the first sequence whose prev_hash is
    not the previous stored hash (NULL when every link holds)."""
    d = split_lag(trail.select("run_id", "sequence_number", "prev_hash", "event_hash"),
                  "run_id", "sequence_number", "event_hash", "_prev")
    broken = ~F.col("prev_hash").eqNullSafe(F.coalesce(F.col("_prev"), F.lit(GENESIS)))
    return d.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min(F.when(broken, F.col("sequence_number"))).alias("first_broken_sequence"),
        F.count_if(broken).alias("broken_links"))


def trail_with_validity(trail: DataFrame) -> DataFrame:
    """Every event of a run with the run's verification result, by
    sequence (a distributed sort)."""
    v = verify_runs(trail)
    return trail.join(v, "run_id", "left").orderBy("run_id", "sequence_number")


def run_completeness(trail: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Per run: count, first/last sequence, gap-free, actor rule (user
    events are approvals/confirmations), and — if ``expected`` event types are
    given — how many of those positions do not hold the expected type (a
    position without an event does not)."""
    aggs = [
        F.count(F.lit(1)).alias("event_count"),
        F.min("sequence_number").alias("first_sequence"),
        F.max("sequence_number").alias("last_sequence"),
        F.count_distinct("sequence_number").alias("distinct_sequences"),
        F.count_if(F.col("actor") == "user").alias("user_events"),
        F.count_if(~F.col("actor").isin("user", "agent")).alias("unknown_actor_events")]
    if expected:  # a handful of types, given by the caller
        place = F.when(F.col("sequence_number").between(1, len(expected)), F.col("sequence_number").cast("int"))
        right = F.col("event_type") == F.try_element_at(F.array(*map(F.lit, expected)), place)
        aggs.append((F.lit(len(expected)) - F.count_distinct(F.when(right, place))).alias("order_mismatches"))
    return trail.groupBy("run_id").agg(*aggs).withColumn(
        "gap_free", (F.col("first_sequence") == 1)
        & (F.col("last_sequence") == F.col("event_count"))
        & (F.col("distinct_sequences") == F.col("event_count")))


# --------------------------------------------------------------------------
# S12, W12, A10, A11, T5
# --------------------------------------------------------------------------

def insert_or_ignore(stored: DataFrame, batch: DataFrame, max_broadcast_keys: int = 1_000_000) -> DataFrame:
    """Rows of ``batch`` that an INSERT OR IGNORE keeps: not already
    stored by event_id nor by (run_id, sequence_number), and, in event_id
    order, no clash with a row of the batch that was kept before it.

    The stored trail grows without bound while a batch is small: the stored
    keys are first reduced to those present in the batch with a semi-join
    against the batch's keys (broadcast when they provably fit, so the
    stored trail is scanned but not shuffled), and the batch is anti-joined
    with that small set."""
    from kestrel.operators.joins import bounded_broadcast
    ids = bounded_broadcast(batch.select("event_id").distinct(), max_broadcast_keys)
    seqs = bounded_broadcast(batch.select("run_id", "sequence_number").distinct(), max_broadcast_keys)
    hit_ids = stored.select("event_id").join(ids, "event_id", "left_semi")
    hit_seqs = stored.select("run_id", "sequence_number").join(seqs, ["run_id", "sequence_number"], "left_semi")
    b = batch.join(hit_ids, "event_id", "left_anti")
    todo = b.join(hit_seqs, ["run_id", "sequence_number"], "left_anti")
    # within the batch, in order: a row is kept unless one kept before it has
    # its event_id or its place. Rows first by both keys are kept, rows that
    # clash with those are not, and what is left goes through the same again.
    order = ["event_id", "run_id", "sequence_number"]
    kept = None
    while True:
        by_id = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
        by_place = F.row_number().over(Window.partitionBy("run_id", "sequence_number").orderBy(*order))
        ranked = cut_lineage(todo.withColumn("_i", by_id).withColumn("_p", by_place), "insert")
        first = ranked.where("_i = 1 AND _p = 1").drop("_i", "_p")
        kept = first if kept is None else kept.unionByName(first)
        rest = ranked.where("_i > 1 OR _p > 1").drop("_i", "_p")
        todo = (rest.join(first.select("event_id"), "event_id", "left_anti")
                .join(first.select("run_id", "sequence_number"), ["run_id", "sequence_number"], "left_anti"))
        if todo.isEmpty():
            return kept


def max_sequence(trail: DataFrame, runs: DataFrame) -> DataFrame:
    """A10: max sequence per run, 0 for runs without events."""
    m = trail.groupBy("run_id").agg(F.max("sequence_number").alias("max_sequence"))
    return runs.select("run_id").distinct().join(m, "run_id", "left") \
               .select("run_id", F.coalesce("max_sequence", F.lit(0)).cast("long").alias("max_sequence"))


def assign_sequences(stored: DataFrame, new: DataFrame, order_cols) -> DataFrame:
    """Sequence numbers for new events continue each run's stored
    maximum: max + position of the event among the run's new events."""
    m = stored.groupBy("run_id").agg(F.max("sequence_number").alias("_base"))
    order_cols = list(order_cols)
    n = prior_frame(new, ["run_id"], order_cols, {"_pos": ("count", "run_id")},
                    skew_split=True, include_current=True)
    n = n.join(m, "run_id", "left")
    return n.withColumn("sequence_number", F.coalesce("_base", F.lit(0)) + F.col("_pos")) \
            .drop("_base", "_pos")


def events_per_run(trail: DataFrame) -> DataFrame:
    """Events per run plus a total row (run_id NULL), by ROLLUP."""
    return trail.rollup("run_id").agg(F.count(F.lit(1)).alias("events"))


def recent_runs(trail: DataFrame, n: int = 5) -> DataFrame:
    """T5: the n most recently active runs (top-k is the feature)."""
    last = trail.groupBy("run_id").agg(F.max("timestamp_utc").alias("last_event_at"))
    return last.orderBy(F.desc("last_event_at"), F.asc("run_id")).limit(n)
