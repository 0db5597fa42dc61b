"""Audit trail: the reference's cases (full run, tampered payload, unknown
run) plus removed middle event, duplicate insert and hash parity."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from kestrel.operators import audit as au

# The event sequence of one complete run.
FULL_RUN = [
    ("opportunity_ranked", "agent", "rank_opportunities", {"ranked": 3}),
    ("opportunity_approved", "user", "human_checkpoint", {"selected_rank": 1}),
    ("dry_run_planned", "agent", "plan_dry_run", {"tables": ["orders", "customers"]}),
    ("dry_run_confirmed", "user", "dry_run_checkpoint", {"confirmed": True}),
    ("code_generated", "agent", "generate_code", {"files": 3, "sha256": "ab" * 32}),
    ("risk_scorecard_computed", "agent", "compute_risk_scorecard", {"overall": "review_needed"}),
    ("code_approved", "user", "human_checkpoint_code", {"approved": True}),
    ("bundle_written", "agent", "write_bundle", {"paths": ["a.py", "b.yml"]}),
    ("exec_summary_generated", "agent", "exec_summary", {"words": 250, "score": 0.75}),
]


def _events(spark, run_id="run-1", events=FULL_RUN):
    rows = [(f"{run_id}-e{i}", run_id, i, t, a, n, f"2024-01-15T10:30:0{i}.000000+00:00", json.dumps(p))
            for i, (t, a, n, p) in enumerate(events, start=1)]
    return spark.createDataFrame(rows, "event_id string, run_id string, sequence_number long, event_type string, "
                                       "actor string, node_name string, timestamp_utc string, payload string")


def _py_hash(row):
    fields = {k: row[k] for k in ("event_id", "run_id", "sequence_number", "event_type", "actor",
                                  "node_name", "timestamp_utc", "prev_hash")}
    fields["payload"] = json.loads(row["payload"])
    canon = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    return hashlib.sha256(canon.encode("utf-8")).hexdigest()


@pytest.fixture(scope="module")
def chain(spark):
    return au.build_chain(_events(spark)).orderBy("sequence_number").collect()


def test_full_run_chain(spark, chain):
    assert [r.sequence_number for r in chain] == list(range(1, 10))
    assert [r.event_type for r in chain] == [e[0] for e in FULL_RUN]
    assert [r.actor for r in chain].count("user") == 3
    assert chain[0].prev_hash == "GENESIS"
    for a, b in zip(chain, chain[1:]):
        assert b.prev_hash == a.event_hash
    # the native canonical JSON hashes exactly as Python's json.dumps form
    for r in chain:
        assert r.event_hash == _py_hash(r.asDict())
    v = au.verify_runs(spark.createDataFrame(chain)).collect()
    assert len(v) == 1 and v[0].valid and v[0].event_count == 9
    assert v[0].tampered_at_sequence is None and v[0].reason is None


def test_exact_and_native_verification_agree(spark, chain):
    df = spark.createDataFrame(chain)
    assert au.verify_runs(df, exact=True).collect() == au.verify_runs(df).collect()


def test_tampered_payload_detected(spark, chain):
    df = spark.createDataFrame(chain[:2]).withColumn(
        "payload", F.when(F.col("sequence_number") == 1, F.lit('{"ranked": 99}')).otherwise(F.col("payload")))
    v = au.verify_runs(df).collect()[0]
    assert (v.valid, v.event_count, v.tampered_at_sequence, v.reason) == (False, 2, 1, "hash_mismatch")


def test_unknown_run_has_no_events(spark, chain):
    runs = spark.createDataFrame([("run-1",), ("nope",)], "run_id string")
    v = {r.run_id: r for r in au.verify_runs(spark.createDataFrame(chain), runs).collect()}
    assert v["nope"].valid is False and v["nope"].event_count == 0 and v["nope"].reason == "no_events"
    assert v["run-1"].valid is True


def test_removed_middle_event_breaks_chain(spark, chain):
    df = spark.createDataFrame([r for r in chain if r.sequence_number != 5])
    v = au.verify_runs(df).collect()[0]
    assert (v.valid, v.tampered_at_sequence, v.reason) == (False, 6, "chain_broken")
    lk = au.link_check(df).collect()[0]
    assert lk.first_broken_sequence == 6 and lk.broken_links == 1


def test_hash_mismatch_reported_before_later_break(spark, chain):
    rows = [r.asDict() for r in chain if r.sequence_number != 7]
    rows[2]["payload"] = '{"tables": []}'          # sequence 3 tampered
    v = au.verify_runs(spark.createDataFrame(rows)).collect()[0]
    assert (v.tampered_at_sequence, v.reason) == (3, "hash_mismatch")


def test_duplicate_insert_ignored(spark, chain):
    stored = spark.createDataFrame(chain[:5])
    batch = spark.createDataFrame(chain[3:] + chain[7:])   # overlaps and repeats
    new = au.insert_or_ignore(stored, batch).orderBy("sequence_number").collect()
    assert [r.sequence_number for r in new] == [6, 7, 8, 9]


def test_sequences_continue_after_stored_max(spark, chain):
    stored = spark.createDataFrame(chain[:4])
    new = spark.createDataFrame([("run-1", "2024-01-16", 2, "x"), ("run-1", "2024-01-16", 1, "y"),
                                 ("run-2", "2024-01-16", 1, "z")], "run_id string, day string, t int, e string")
    got = {r.e: r.sequence_number for r in au.assign_sequences(stored, new, ["day", "t"]).collect()}
    assert got == {"y": 5, "x": 6, "z": 1}
    runs = spark.createDataFrame([("run-1",), ("run-9",)], "run_id string")
    assert {r.run_id: r.max_sequence for r in au.max_sequence(stored, runs).collect()} == {"run-1": 4, "run-9": 0}


def test_completeness_and_order(spark, chain):
    df = spark.createDataFrame([r for r in chain if r.sequence_number != 5])
    c = au.run_completeness(df, [e[0] for e in FULL_RUN]).collect()[0]
    assert c.event_count == 8 and c.gap_free is False and c.user_events == 3
    full = au.run_completeness(spark.createDataFrame(chain), [e[0] for e in FULL_RUN]).collect()[0]
    assert full.gap_free and full.order_mismatches == 0


def test_long_run_chain_and_verify(spark):
    n = 100_000
    rows = [(f"e{i}", "big", i, "step", "agent", "node", f"t{i:06d}", '{"i": %d}' % i) for i in range(1, n + 1)]
    ev = spark.createDataFrame(rows, "event_id string, run_id string, sequence_number long, event_type string, "
                                     "actor string, node_name string, timestamp_utc string, payload string")
    ch = au.build_chain(ev)
    v = au.verify_runs(ch).collect()[0]
    assert v.valid and v.event_count == n
    # one changed payload deep inside the run is found at its sequence
    bad = ch.withColumn("payload", F.when(F.col("sequence_number") == 77_777, F.lit('{"i": 0}'))
                        .otherwise(F.col("payload")))
    v = au.verify_runs(bad).collect()[0]
    assert (v.valid, v.tampered_at_sequence, v.reason) == (False, 77_777, "hash_mismatch")


def _verify(spark, trail):
    return {r.run_id: r for r in au.verify_runs(trail).collect()}


def test_missing_hashes_are_no_match(spark):
    chain = au.build_chain(_events(spark))
    last = chain.withColumn("event_hash", F.when(F.col("sequence_number") < 9, F.col("event_hash")))
    assert not _verify(spark, last)["run-1"].valid
    blank = chain.withColumn("prev_hash", F.lit(None).cast("string")).withColumn("payload", F.lit("{}"))
    assert not _verify(spark, blank)["run-1"].valid
    assert au.link_check(blank).first().broken_links == 9


def test_malformed_payloads_hash_as_they_stand(spark):
    events = _events(spark, events=FULL_RUN[:2]).withColumn("payload", F.lit("not json A"))
    trail = au.build_chain(events)
    assert _verify(spark, trail)["run-1"].valid
    assert not _verify(spark, trail.withColumn("payload", F.lit("other junk B")))["run-1"].valid


@pytest.mark.parametrize("mark", [" ", " ", "\u0085", "é", '"', "]"])
def test_every_character_counts(spark, mark):
    trail = au.build_chain(_events(spark, events=FULL_RUN[:2]).withColumn("node_name", F.lit(f"a{mark}b")))
    assert _verify(spark, trail)["run-1"].valid
    assert not _verify(spark, trail.withColumn("node_name", F.lit(f"a{mark}c")))["run-1"].valid


def test_crossed_keys_are_ignored_in_order(spark):
    chain = au.build_chain(_events(spark))
    template = chain.limit(1)
    batch = None
    for e, n in (("e1", 1), ("e2", 1), ("e2", 5), ("e3", 5), ("e3", 7)):
        row = template.withColumn("event_id", F.lit(e)).withColumn("run_id", F.lit("r")).withColumn("sequence_number", F.lit(n).cast("long"))
        batch = row if batch is None else batch.union(row)
    kept = {(r.event_id, r.sequence_number) for r in au.insert_or_ignore(chain.limit(0), batch).collect()}
    assert kept == {("e1", 1), ("e2", 5), ("e3", 7)}


HOSTILE = ['{"b":1,"a":{"z":[1,2.50,1e5,-0,-0.0,1E400],"y":null}}', '{"a":1.0}', '{"a":1}', '{"é":"漢😀\\u0007\\/","A B":"\\ud83d"}', '[]', '"x"', "12345678901234567890123", "NaN",
           '{"k":1,"k":2}', '{"$raw":"not json A"}', "not json A", '!"not json A"', "", " {}", '{"a": "\\u0000"}', "[" * 3000 + "]" * 3000, '{"n": 0.1e-7}', "true", '{"a":\u2028"x"}', "\x7f", "1_000"]


def test_canonical_text_is_python_json(spark):
    texts = ["", "plain", 'q"b\\s/', "tab\tnl\ncr\rbs\bff\f", "nul\x00bell\x07esc\x1bdel\x7f", "é漢", "😀 pair", "\u2028\u0085", "$1 \\1", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", au._js("t").alias("c")).collect()}
    assert got == {i: json.dumps(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*HOSTILE, None])], "i int, t string")
    got = {r.i: r.c for r in df.select("i", au.canonical_payload("t").alias("c")).collect()}
    for i, t in enumerate(HOSTILE):
        try:
            want = json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            want = "!" + json.dumps(t)
        assert got[i] == want, t
    assert got[len(HOSTILE)] == "null"
    assert len(set(got.values())) == len(got)  # no two of these payloads look alike


def test_a_trail_that_the_original_wrote_is_valid(spark):
    """Hashes made by Python's json over the whole event, with hostile payloads and names."""
    rows, last = [], "GENESIS"
    for n, p in enumerate([h for h in HOSTILE if h not in ("not json A", '!"not json A"', "", "\x7f", "1_000", '{"a":\u2028"x"}') and not h.startswith("[[")], start=1):
        r = {"event_id": f"é{n}", "run_id": "r😀", "sequence_number": n, "event_type": 'a"b', "actor": None, "node_name": "n\\x", "timestamp_utc": "t\n", "payload": p, "prev_hash": last}
        last = _py_hash(r)
        rows.append({**r, "event_hash": last})
    schema = "event_id string, run_id string, sequence_number long, event_type string, actor string, node_name string, timestamp_utc string, payload string, prev_hash string, event_hash string"
    trail = spark.createDataFrame(rows, schema)
    for exact in (False, True):
        v = au.verify_runs(trail, exact=exact).first()
        assert v.valid and v.event_count == len(rows)
    rebuilt = au.build_chain(trail)
    assert rebuilt.exceptAll(trail).isEmpty()


@pytest.mark.parametrize("one, other", [("not json A", '{"$raw":"not json A"}'), ('{"a":1.0}', '{"a":1}'), ("x", '!"x"'), (None, "null "), ('{"a":"1"}', '{"a":1}')])
def test_payloads_that_look_alike_are_told_apart(spark, one, other):
    events = _events(spark, events=FULL_RUN[:2]).withColumn("payload", F.lit(one).cast("string"))
    trail = au.build_chain(events)
    assert _verify(spark, trail)["run-1"].valid
    changed = trail.withColumn("payload", F.lit(other))
    same = one is None  # JSON null and no payload are one value in the original, too
    assert _verify(spark, changed)["run-1"].valid is same
    assert au.verify_runs(changed, exact=True).first().valid is same
