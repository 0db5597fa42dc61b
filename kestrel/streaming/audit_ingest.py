"""Streaming audit ingest (ours; the reference writes events one by one
from a process with an in-memory map run -> (last sequence, last hash)).

A run is a key of ``transformWithState`` with two states in one store: the
chain's end (sequence, hash), and the ids the run has taken. An event whose id
the run has is ignored (INSERT OR IGNORE); an event without an id is always
taken. The store is asked for an id only if it may hold any of the run. A call
is a message to the JVM and back, so the ids of some rows are asked for, and
stored, by messages that are all sent before the answers are read (``_burst``).
The ids stay for good, or, where the source cannot repeat an event
later than that, until the run has events ``id_ttl`` later (event time; they are
looked through each time the run has moved on by an eighth of it).

Events of a run are numbered in the order in which micro-batches bring them,
and inside a micro-batch by day, time, id and payload. Rows stream through: up
to ``HELD`` of them are held, more wait in the store by hour until all of the
micro-batch have been read, and are then chained hour by hour, so a run that
fills a micro-batch takes the memory of one of its hours.

The canonical texts come from the batch chain's own expressions
(``operators.audit``), so streamed and batch-built trails verify identically.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from kestrel.operators.audit import _CHAIN_SCHEMA, GENESIS, _js, canonical_payload
from kestrel.session import shared_path

#: Rows of one run and micro-batch held outside the store.
HELD = 20_000

#: Messages to the store sent before their answers are read: some kilobytes,
#: less than a socket holds, so neither side waits for the other to read.
BURST = 200

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_WAITING = ["_day", "_ts", "_eid", "event_type", "actor", "node_name", "timestamp_utc", "payload", "run_id", "_before", "_between", "_after"]


class AuditChain(StatefulProcessor):
    def __init__(self, id_ttl: int | None = None, held: int = HELD):
        self.id_ttl, self.held = id_ttl, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.end = handle.getValueState("end", "seq long, hash string, newest long, cleared long")
        self.seen = handle.getMapState("seen", "id long", "at long")
        columns = ", ".join(f"{c} {'long' if c in ('_day', '_ts', '_eid') else 'string'}" for c in _WAITING)
        self.waiting = handle.getMapState("waiting", "hour long, n long", columns)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        hours: dict[int, list] = {}  # rows held, by hour
        stored: dict[int, int] = {}  # how many wait in the store, by hour
        taken: set[int] = set()
        n, rows = 0, iter(rows)
        end = self.end.get()
        known = end is not None  # whether the store may hold an id that is not in ``taken``
        while some := list(islice(rows, min(BURST, self.held - n))):
            ids = {r["_eid"]: r["_ts"] for r in reversed(some) if r["_eid"] is not None and r["_eid"] not in taken}  # at first sight
            if known:
                for i in _stored(self.seen, list(ids)):
                    del ids[i]
            _store(self.seen, ids)
            for r in some:
                if r["_eid"] is not None and ids.pop(r["_eid"], None) is None:
                    continue
                hour = r["_ts"] // 3_600_000_000
                hours.setdefault(hour, []).append(tuple(r[c] for c in _WAITING))
                n += 1
                if r["_eid"] is not None:
                    taken.add(r["_eid"])
            if n >= self.held:
                for h, held in hours.items():
                    for row in held:
                        self.waiting.updateValue((h, stored.get(h, 0)), row)
                        stored[h] = stored.get(h, 0) + 1
                known = known or bool(taken)
                hours, n, taken = {}, 0, set()
        if not hours and not stored:
            return
        seq, last, newest, cleared = end or (0, GENESIS, None, None)
        for hour in sorted(hours.keys() | stored.keys()):
            group = hours.pop(hour, [])
            for i in range(stored.get(hour, 0)):
                group.append(tuple(self.waiting.getValue((hour, i))))
                self.waiting.removeKey((hour, i))
            for x in sorted(group, key=_order):
                r = dict(zip(_WAITING, x))
                seq += 1
                newest = r["_ts"] if newest is None else max(newest, r["_ts"])
                event_id = hashlib.sha256(f"{r['run_id']}|{seq}".encode()).hexdigest()
                text = f"{r['_before']}{event_id}{r['_between']}{last}{r['_after']}".replace("\x00", str(seq))
                h = hashlib.sha256(text.encode()).hexdigest()
                yield Row(event_id=event_id, run_id=r["run_id"], sequence_number=seq, event_type=r["event_type"], actor=r["actor"],
                          node_name=r["node_name"], timestamp_utc=r["timestamp_utc"], payload=r["payload"], prev_hash=last, event_hash=h)
                last = h
        if self.id_ttl and newest - (cleared if cleared is not None else newest - self.id_ttl) >= self.id_ttl // 8:
            for (i,) in [k for k, v in self.seen.iterator() if v[0] < newest - self.id_ttl]:
                self.seen.removeKey((i,))
            cleared = newest
        self.end.update((seq, last, newest, cleared))

    def close(self) -> None:
        pass


def _burst(state, calls: list) -> list[int] | None:
    """The answers (0: done or yes, 2: no) to some calls of a map state's client,
    all sent before the first answer is read. None if there is no such client."""
    client = getattr(state, "_mapStateClient", None)
    api = getattr(client, "_stateful_processor_api_client", None)
    if not all(hasattr(api, x) for x in ("sockfile", "pickleSer", "_receive_proto_message")):
        return None
    if not calls:
        return []
    from pyspark.serializers import write_int
    from pyspark.sql.streaming.proto import StateMessage_pb2 as pb
    for call, fields in calls:
        of_map = pb.MapStateCall(stateName=state._stateName, **{call: getattr(pb, call[0].upper() + call[1:])(**{k: api.pickleSer.dumps(v) for k, v in fields.items()})})
        message = pb.StateRequest(stateVariableRequest=pb.StateVariableRequest(mapStateCall=of_map)).SerializeToString()
        write_int(0, api.sockfile)
        write_int(len(message), api.sockfile)
        api.sockfile.write(message)
    api.sockfile.flush()
    answers = [api._receive_proto_message() for _ in calls]
    for status, text, _ in answers:
        if status not in (0, 2):
            raise RuntimeError(f"state {state._stateName}: {text}")
    return [status for status, _, _ in answers]


def _stored(state, ids: list[int]) -> list[int]:
    """Those of some ids that the store has."""
    answers = _burst(state, [("containsKey", {"userKey": (i,)}) for i in ids])
    return [i for i in ids if state.containsKey((i,))] if answers is None else [i for i, x in zip(ids, answers) if x == 0]


def _store(state, ids: dict[int, int]) -> None:
    answers = _burst(state, [("updateValue", {"userKey": (i,), "value": (at,)}) for i, at in ids.items()])
    if answers is None:
        for i, at in ids.items():
            state.updateValue((i,), (at,))
    elif any(answers):
        raise RuntimeError("an id was not stored")


def _order(x: tuple) -> tuple:
    """Day, time, id (none first), then the content."""
    return (x[0], x[1], x[2] is not None, x[2] or 0, *((v is not None, v or "") for v in x[3:9]))


def event_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """The ``events`` table as a file stream (a glob path, so one file is a
    valid source)."""
    path = f"{sf_dir.rstrip('/')}/event[s].parquet"
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    s = (spark.readStream.schema(schema).option("basePath", sf_dir)
         .option("maxFilesPerTrigger", max_files).parquet(path))
    # windows need TIMESTAMP (the session time zone reads the wall clock;
    # UTC in our sessions); the original wall-clock value stays in ts_wall
    return s.withColumn("ts_wall", F.col("ts")).withColumn("ts", F.col("ts").cast("timestamp"))


def audit_ingest(events: DataFrame, id_ttl: int | None = None, held: int = HELD) -> DataFrame:
    """Streaming events (event_id, ts, user_id, event_type, props) -> chained
    audit rows, one run per user. ``id_ttl``: microseconds that an id is kept.
    An event without a time comes first; one without a user is of the run NULL.
    The rows of a micro-batch are dealt to all tasks before their texts are
    written: a file is one task's otherwise, and a run's rows are when they meet."""
    e = events.repartition("event_id", "user_id", "ts", "props").select(
        F.col("user_id").cast("string").alias("run_id"), F.coalesce(F.unix_micros("ts"), F.lit(-(2**62))).alias("_ts"),
        F.coalesce(F.unix_date(F.to_date("ts_wall")), F.lit(-(2**30))).cast("long").alias("_day"),
        F.col("event_id").cast("long").alias("_eid"), "event_type",
        F.when(F.col("event_type").isin("signup", "purchase"), "user").otherwise("agent").alias("actor"),
        F.concat(F.col("event_type"), F.lit("_node")).alias("node_name"),
        F.concat(F.date_format("ts_wall", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")).alias("timestamp_utc"),
        F.col("props").alias("payload"))
    # the canonical event around the id, the previous hash and the sequence (a
    # NUL, which JSON text cannot hold, stands for the last)
    e = e.withColumns({
        "_before": F.concat(F.lit('{"actor":'), _js("actor"), F.lit(',"event_id":"')),
        "_between": F.concat(F.lit('","event_type":'), _js("event_type"), F.lit(',"node_name":'), _js("node_name"),
                             F.lit(',"payload":'), canonical_payload("payload"), F.lit(',"prev_hash":"')),
        "_after": F.concat(F.lit('","run_id":'), _js("run_id"), F.lit(',"sequence_number":\x00,"timestamp_utc":'), _js("timestamp_utc"), F.lit("}")),
        "_key": F.coalesce(F.concat(F.lit("="), F.col("run_id")), F.lit(""))})
    return e.groupBy("_key").transformWithState(AuditChain(id_ttl, held), _CHAIN_SCHEMA, "Append", "None")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run a stream to completion (availableNow) into a parquet table in
    the shared checkpoint folder and return the table. ``progress`` gets the
    progress of each micro-batch."""
    spark = stream.sparkSession
    base = shared_path(spark, "streams", f"{name}-{uuid.uuid4().hex}")
    provider = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)  # states of several kinds need it; read when the query starts
    try:
        q = (stream.writeStream.format("parquet").outputMode(mode)
             .option("checkpointLocation", f"{base}/_checkpoint").option("path", f"{base}/data")
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if provider is None else spark.conf.set(_PROVIDER, provider)
    if progress is not None:
        progress += q.recentProgress
    return spark.read.parquet(f"{base}/data")
