"""Streaming audit ingest across several micro-batches, with a replayed
duplicate, must equal the batch-built chain."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from kestrel.operators import audit as au
from kestrel.plans import stream_queries
from kestrel.streaming import audit_ingest as ai
from kestrel.streaming import event_windows as ew


def test_stream_chain_state_carries_across_batches(spark):
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    src = tempfile.mkdtemp(prefix="kestrel-stream-src-")
    cuts = ["2024-01-10", "2024-01-20"]
    parts = [ev.where(F.col("ts") < cuts[0]),
             ev.where((F.col("ts") >= cuts[0]) & (F.col("ts") < cuts[1])),
             ev.where(F.col("ts") >= cuts[1]).unionByName(ev.where(F.col("ts") >= cuts[1]).limit(5))]  # replay
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(os.path.join(src, f"part{i}"))
        time.sleep(1.1)                      # file order = modification time order
    files = sorted(os.path.join(dp, f) for dp, _, fs in os.walk(src) for f in fs if f.endswith(".parquet"))
    flat = tempfile.mkdtemp(prefix="kestrel-stream-flat-")
    for i, f in enumerate(files):
        os.link(f, os.path.join(flat, f"events_{i}.parquet"))
        time.sleep(1.1)
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(flat)
              .withColumn("ts_wall", F.col("ts")).withColumn("ts", F.col("ts").cast("timestamp")))
    got = ai.run_to_table(ai.audit_ingest(stream), "test_ingest")
    exp = au.build_chain(au.events_as_audit(ev))
    assert got.count() == ev.count()
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0
    assert au.verify_runs(got).where("NOT valid").count() == 0


def test_sessions_batch_match_session_window(spark):
    ev = spark.read.parquet(f"{SF0001}/events.parquet")
    a = ew.sessions_batch(ev)
    b = ew.sessions(ev.withColumn("ts", F.col("ts").cast("timestamp")))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_closed_sessions_stream_emits_only_final_sessions(spark):
    out = ew.stream_sessions_closed(ai.event_stream(spark, SF0001))
    batch = ew.sessions_batch(spark.read.parquet(f"{SF0001}/events.parquet"))
    n_out, n_all = out.count(), batch.count()
    # sessions still inside the watermark stay in state; every emitted one is final
    assert 0 < n_out <= n_all and out.exceptAll(batch).count() == 0


def test_streams_lose_nothing_whatever_the_order_of_files(spark, tmp_path):
    """Four files in no time order: every event is chained once, every window whole."""
    events = spark.read.parquet(f"{SF0001}/events.parquet")
    path = f"{tmp_path}/events.parquet"
    for k in (2, 0, 3, 1):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(path)
    trail = ai.run_to_table(ai.audit_ingest(ai.event_stream(spark, str(tmp_path))), "unsorted")
    assert trail.count() == trail.select("event_id").distinct().count() == events.count()
    assert all(r.valid for r in au.verify_runs(trail).collect())
    assert all(r.gap_free for r in au.run_completeness(trail).collect())
    got = stream_queries.stream_event_windows(spark, str(tmp_path))
    want = stream_queries.stream_event_windows(spark, SF0001)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.where("window_kind = 'tumbling_1h'").agg(F.sum("events")).first()[0] == events.count()


def _stream_of(spark, parts, schema):
    """A file stream, a micro-batch for each part, in this order."""
    flat = tempfile.mkdtemp(prefix="kestrel-stream-")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(os.path.join(flat, f"_{i}"))
        (name,) = [f for f in os.listdir(os.path.join(flat, f"_{i}")) if f.endswith(".parquet")]
        os.link(os.path.join(flat, f"_{i}", name), os.path.join(flat, f"events_{i}.parquet"))
        os.utime(os.path.join(flat, f"events_{i}.parquet"), (1_700_000_000 + i, 1_700_000_000 + i))
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(flat, "events_[0-9].parquet"))
            .withColumn("ts_wall", F.col("ts")).withColumn("ts", F.col("ts").cast("timestamp")))


@pytest.mark.parametrize("held", [ai.HELD, 3])
def test_events_without_id_stay_and_repeated_ids_go(spark, held):
    """Unsorted files, ids missing, events repeated inside and across micro-batches,
    a run without user, an event without time; few rows held outside the store."""
    ev = spark.read.parquet(f"{SF0001}/events.parquet").where("user_id < 12 OR event_id % 3 = 0")
    ev = ev.withColumn("event_id", F.when(F.col("event_id") % 11 != 0, F.col("event_id")))
    ev = ev.withColumn("user_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id"))).withColumn("ts", F.when(F.coalesce("event_id", F.lit(0)) % 50 != 1, F.col("ts")))
    ev = spark.createDataFrame(ev.collect(), ev.schema)
    part = [ev.where(F.pmod(F.xxhash64("event_id", "props"), F.lit(3)) == k) for k in (1, 0, 2)]
    again = ev.where("event_id % 7 = 0")
    part[1], part[2] = part[1].unionByName(part[1].where("event_id IS NOT NULL").limit(9)), part[2].unionByName(again)
    progress = []
    trail = ai.run_to_table(ai.audit_ingest(_stream_of(spark, part, ev.schema), held=held), "ids", progress=progress)
    assert trail.count() == ev.count()
    want = {r.run_id: r["count"] for r in ev.select(F.col("user_id").cast("string").alias("run_id")).groupBy("run_id").count().collect()}
    assert {r.run_id: r["count"] for r in trail.groupBy("run_id").count().collect()} == want
    assert trail.groupBy("run_id", "payload", "timestamp_utc", "event_type").count().exceptAll(
        ev.select(F.col("user_id").cast("string").alias("run_id"), F.col("props").alias("payload"),
                  F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp_utc"), "event_type")
        .groupBy("run_id", "payload", "timestamp_utc", "event_type").count()).isEmpty()
    assert all(r.valid for r in au.verify_runs(trail.where("run_id IS NOT NULL")).collect())
    assert all(r.gap_free for r in au.run_completeness(trail).collect())
    # the store: one end a run, one row an id, nothing that waits
    rows = progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert rows == len(want) + ev.where("event_id IS NOT NULL").select("user_id", "event_id").distinct().count()


def test_ids_expire_by_the_stated_rule(spark):
    """Ids of events more than the time to live before a run's newest are forgotten."""
    given = spark.read.parquet(f"{SF0001}/events.parquet")
    ev = spark.createDataFrame(given.where("user_id < 9").collect(), given.schema)
    day = 86_400_000_000
    newest = {r.user_id: r.t for r in ev.groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t")).collect()}
    old = sum(t < newest[u] - 5 * day for u, t in ((r.user_id, r.t) for r in ev.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).collect()))
    progress = []
    short = ai.run_to_table(ai.audit_ingest(_stream_of(spark, [ev, ev], ev.schema), id_ttl=5 * day), "short", progress=progress)
    long = ai.run_to_table(ai.audit_ingest(_stream_of(spark, [ev, ev], ev.schema), id_ttl=400 * day), "long")
    assert 0 < old < ev.count()
    assert (short.count(), long.count()) == (ev.count() + old, ev.count())
    assert progress[0]["stateOperators"][0]["numRowsTotal"] == len(newest) + ev.count() - old
    assert all(r.valid for r in au.verify_runs(short).collect())


class _State:
    """A map or value state that counts what it is asked."""

    def __init__(self, held):
        self.held, self.asked = held, 0

    def exists(self):
        return bool(self.held)

    def containsKey(self, key):
        self.asked += 1
        return key in self.held

    def updateValue(self, key, value):
        self.held[key] = value

    def getValue(self, key):
        return self.held[key]

    def removeKey(self, key):
        del self.held[key]

    def get(self):
        return self.held.get("end")

    def update(self, value):
        self.held["end"] = value


@pytest.mark.parametrize("held, first", [(100, 0), (4, 7)])
def test_ids_are_asked_for_only_where_some_are_held(held, first):
    """The first micro-batch of a run asks for no id, unless rows went to the store."""
    chain = ai.AuditChain(held=held)
    chain.end, chain.seen, chain.waiting = _State({}), _State({}), _State({})
    row = lambda i: {**dict.fromkeys(ai._WAITING, "x"), "_day": 0, "_ts": 10 * i, "_eid": i}
    given = [0, 1, 1, 2, 3, None, 2, 4, 0, 5, 6]
    rows = lambda ids: [{**row(i or 0), "_eid": i} for i in ids]
    assert len(list(chain.handleInputRows(("=x",), iter(rows(given)), None))) == 8
    assert chain.seen.asked <= first and bool(chain.seen.asked) == bool(first) and len(chain.seen.held) == 7
    chain.seen.asked = 0
    out = list(chain.handleInputRows(("=x",), iter(rows([6, 7, 7, None, 0])), None))
    assert [r.sequence_number for r in out] == [9, 10] and chain.seen.asked >= 3 and not chain.waiting.held


def test_rows_are_dealt_before_their_texts_are_written(spark):
    """A file of a micro-batch is not one task's: the canonical payloads come after an exchange."""
    stream = ai.audit_ingest(ai.event_stream(spark, SF0001))
    plan = stream._jdf.queryExecution().analyzed().toString()
    dealt, texts = (next(i for i, line in enumerate(plan.splitlines()) if x in line) for x in ("RepartitionByExpression", "_canonical_payloads"))
    assert dealt > texts  # below it in the tree


class _Store:
    """The JVM's side of a map state's client: answers in the order of the messages, once they are flushed."""

    def __init__(self, held):
        import io

        from pyspark.serializers import CPickleSerializer
        self.held, self.pickleSer, self.flushed, self.sent, self.answers = held, CPickleSerializer(), 0, io.BytesIO(), []
        self.sockfile = self

    def write(self, data):
        self.sent.write(data)

    def flush(self):
        from pyspark.sql.streaming.proto import StateMessage_pb2 as pb
        self.flushed += 1
        data, at = self.sent.getvalue(), 0
        while at < len(data):
            size = int.from_bytes(data[at + 4:at + 8], "big")
            call = pb.StateRequest.FromString(data[at + 8:at + 8 + size]).stateVariableRequest.mapStateCall
            assert data[at:at + 4] == b"\0" * 4 and call.stateName == "seen"
            if call.WhichOneof("method") == "updateValue":
                self.held[self.pickleSer.loads(call.updateValue.userKey)] = self.pickleSer.loads(call.updateValue.value)
                self.answers.append(0)
            else:
                self.answers.append(0 if self.pickleSer.loads(call.containsKey.userKey) in self.held else 2)
            at += 8 + size
        self.sent.seek(0)
        self.sent.truncate()

    def _receive_proto_message(self):
        return self.answers.pop(0), "", b""


@pytest.mark.parametrize("held, most", [(1000, 2), (30, 30)])
def test_ids_of_many_rows_are_asked_for_and_stored_in_one_message(held, most):
    """Two messages for the ids of up to BURST rows, not two for each; the same rows as one by one."""
    from pyspark.sql.streaming.map_state_client import MapStateClient
    from pyspark.sql.streaming.stateful_processor import MapState
    given = [i % 97 if i % 5 else None for i in range(150)]
    known = {(i,): (0,) for i in range(0, 97, 3)}
    store = _Store(dict(known))
    client = MapStateClient.__new__(MapStateClient)
    client._stateful_processor_api_client = store
    out = []
    for seen in (MapState(client, "seen"), _State(dict(known))):
        chain = ai.AuditChain(held=held)
        chain.end, chain.seen, chain.waiting = _State({"end": (40, "h", 5, None)}), seen, _State({})
        rows = [{**dict.fromkeys(ai._WAITING, "x"), "_day": 0, "_ts": 10 * n, "_eid": i, "payload": str(i)} for n, i in enumerate(given)]
        out.append([tuple(r) for r in chain.handleInputRows(("=x",), iter(rows), None)])
    assert out[0] == out[1] and len(out[0]) == 30 + len({i for i in given if i is not None and i % 3})
    assert store.held == seen.held and 0 < store.flushed <= most
