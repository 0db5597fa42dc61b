"""Best-fit packing by linear grouping.

Texts become token ids; a document longer than a sequence is cut into full
pieces after a first, possibly shorter one. Pieces longer than ``SMALL`` are
large. In order of length they fall into ``GROUPS`` groups of equal
cardinality, each rounded up to its longest; with so few sizes the patterns of
a sequence are optimised by column generation (a linear programme over
patterns, each new pattern a knapsack), rounded to whole patterns, and the
actual pieces take the places of their group in order. What the rounding left
free, and new sequences, are then filled best-fit with the small pieces, longest first.

At scale: the plan is made from two histograms (pieces by length, sequences by
room left), whose size is bounded by the sequence length whatever the number
of documents. A piece finds its place from its rank among the pieces of its
length, which comes from counts per block and a running number inside a block;
no task holds all pieces of a length and no pieces go through the driver.

Null text: empty, so the end token alone. A repeated row is a document of its
own (pieces of equal ids are told apart by their order). An empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.llm.common import chunks, cut_lineage, read, texts_of

CAPACITY = 2048
#: Pieces up to this length are small.
SMALL = 256
#: Groups of equal cardinality that the large pieces are rounded within.
GROUPS = 48
#: Bytes of text whose ids are made at once.
PART_BYTES = 2 << 20
#: Pieces numbered in one task.
BLOCK = 1 << 16


def cut_pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter."""
    n = len(ids)
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, vocabulary: str = "byte_bpe_50k", end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; runs where the rows lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from kestrel.llm.pretokens import Spaced

        tokenizer = Spaced(vocabulary)
        for batch in chunks(batches, most=PART_BYTES):
            ids, first = tokenizer.ids(batch.column(1), end)
            raw, doc = ids.astype("<u4"), batch.column(0).to_pylist()
            out = [(doc[i], k, a, n, zlib.crc32(raw[first[i] + a : first[i] + a + n])) for i in range(len(doc)) for k, (a, n) in enumerate(cut_pieces(raw[first[i] : first[i + 1]], capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def numbered(rows: DataFrame, value: str, *order: str) -> DataFrame:
    """The rows (a table, read again the same) with ``rank``: 0, 1, ... among
    those of equal ``value``. Blocks of rows are numbered each in its task;
    the counts by block and value give where each block begins."""
    blocks = max(1, -(-rows.count() // BLOCK))
    b = F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int")
    rows = rows.withColumn("_block", b)
    inside = rows.withColumn("_own", F.row_number().over(W.partitionBy("_block", value).orderBy(*order)) - 1)
    counts = rows.groupBy("_block", value).agg(F.count("*").alias("_n"))
    # one row a block and value: the running sum over the blocks of a value
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(value).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)))
    joined = inside.join(before.select("_block", value, F.coalesce("_before", F.lit(0)).alias("_before")), ["_block", value])
    return joined.withColumn("rank", F.col("_before") + F.col("_own")).drop("_block", "_own", "_before")


def linear_groups(histogram: np.ndarray, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, int, int]]:
    """(size, first, last) of groups of equal cardinality among the large
    pieces in order of falling length: ranks first..last-1 round up to size."""
    lengths = [n for n in range(len(histogram) - 1, small, -1) if histogram[n]]
    total = int(sum(histogram[n] for n in lengths))
    if not total:
        return []
    ends = np.cumsum([histogram[n] for n in lengths])
    cuts = sorted({total * k // groups for k in range(groups)})
    return [(lengths[int(np.searchsorted(ends, a, side="right"))], a, b) for a, b in zip(cuts, [*cuts[1:], total])]


def best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The fullest-worth multiset of sizes within the capacity (knapsack)."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        value[c], took[c] = value[c - 1], -1
        fits = np.flatnonzero(sizes <= c)
        if len(fits):
            v = value[c - sizes[fits]] + worth[fits]
            k = int(np.argmax(v))
            if v[k] > value[c] + 1e-12:
                value[c], took[c] = v[k], fits[k]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(value[capacity]), pattern


def optimise(sizes: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold the demand of every size: the linear programme
    by column generation with the revised simplex method, rounded down, and the
    rest placed first-fit into patterns of their own."""
    k = len(sizes)
    basis = [np.eye(k, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(k)]
    for _ in range(rounds):
        a = np.array(basis, float).T
        inverse = np.linalg.inv(a)
        worth = inverse.sum(axis=0)
        value, pattern = best_pattern(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        x, d = inverse @ demand, inverse @ pattern
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        basis[int(np.argmin(ratio))] = pattern
    x = np.maximum(np.linalg.inv(np.array(basis, float).T) @ demand, 0)
    left, out = demand.astype(np.int64).copy(), []
    for p, t in zip(basis, np.floor(x + 1e-9).astype(np.int64)):
        used = p > 0
        t = int(min(t, (left[used] // p[used]).min())) if used.any() else 0
        if t:
            out.append((p, t))
            left -= p * t
    while left.any():  # at most a few of each size
        p, room = np.zeros(k, np.int64), capacity
        for i in np.argsort(-sizes, kind="stable"):
            n = int(min(left[i], room // sizes[i]))
            p[i], room = n, room - n * sizes[i]
        t = int((left[p > 0] // p[p > 0]).min())
        out.append((p, t))
        left -= p * t
    return out


def best_fit(rooms: np.ndarray, small: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit of the small lengths, longest first, on counts.

    rooms[r]: sequences with room r (r under the capacity); small[n]: pieces of
    length n. Sequences that began with equal room and got the same since are
    one class: an interval of their ranks. Returns rows (length, first, last,
    each, room0, rank0): pieces of this length ranked first..last-1 go, ``each``
    to a sequence, to the sequences ranked from rank0 among those that began
    with room room0; room0 = capacity means new sequences."""
    at: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, int(n))] for r, n in enumerate(rooms) if n and r}
    new, out = 0, []
    for n in range(len(small) - 1, 0, -1):
        left, rank = int(small[n]), 0
        if not left:
            continue
        for r in [*range(n, capacity), capacity]:
            each = r // n
            if r == capacity:
                if left:
                    count = -(-left // each)
                    at.setdefault(capacity, []).append((capacity, new, new + count))
                    new += count
            todo = at.pop(r, [])
            while todo and left:
                room0, a, b = todo.pop()
                full = min(b - a, left // each)
                if full:
                    out.append((n, rank, rank + full * each, each, room0, a))
                    at.setdefault(r - each * n, []).append((room0, a, a + full))
                    rank, left, a = rank + full * each, left - full * each, a + full
                if a < b and left:
                    out.append((n, rank, rank + left, left, room0, a))
                    at.setdefault(r - left * n, []).append((room0, a, a + 1))
                    rank, left, a = rank + left, 0, a + 1
                if a < b:
                    todo.append((room0, a, b))
            if todo:
                at.setdefault(r, []).extend(todo)
            if not left:
                break
    return out


def _histogram(rows: DataFrame, value: str, capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, np.int64)
    for n, count in rows.groupBy(value).count().collect():  # at most capacity + 1 rows
        out[n] = count
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY, small: int = SMALL) -> DataFrame:
    """The pieces with sequence_id and offset. cut: doc_id, piece, start, length, ids_crc32."""
    cut = cut_lineage(cut, "pieces")
    lengths = _histogram(cut, "length", capacity)
    groups = linear_groups(lengths, small=small)
    sizes = sorted({g[0] for g in groups}, reverse=True)
    demand = np.array([sum(b - a for s, a, b in groups if s == size) for size in sizes], np.int64)
    patterns = optimise(np.array(sizes, np.int64), demand, capacity) if sizes else []
    ranked = cut_lineage(numbered(cut, "length", "doc_id", "piece", "start", "ids_crc32"), "ranked")

    # a large piece: its rank among all large ones, its size's slots in pattern order
    longer = np.append(np.cumsum(lengths[::-1])[::-1][1:], 0)
    first_of = {s: min(a for x, a, _ in groups if x == s) for s in sizes}
    size_starts = np.array([first_of[s] for s in sizes], np.int64)
    times = np.array([t for _, t in patterns], np.int64)
    base = np.append(0, np.cumsum(times))
    slots = [np.append(0, np.cumsum([p[i] * t for p, t in patterns])) for i in range(len(sizes))]

    def place_large(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rank = longer[f["length"].to_numpy()] + f["rank"].to_numpy()
            i = np.searchsorted(size_starts, rank, side="right") - 1
            sequence = np.zeros(len(f), np.int64)
            for s in np.unique(i):
                own = i == s
                q = rank[own] - size_starts[s]
                j = np.searchsorted(slots[s], q, side="right") - 1
                each = np.array([p[s] for p, _ in patterns], np.int64)[j]
                sequence[own] = base[j] + (q - slots[s][j]) // each
            yield f.assign(sequence_id=sequence).drop(columns="rank")

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long"
    large = cut_lineage(ranked.where(F.col("length") > small).mapInPandas(place_large, schema), "large")
    room = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room"))
    room = cut_lineage(numbered(cut_lineage(room, "rooms"), "room", "sequence_id"), "ranked-rooms")
    rows = best_fit(_histogram(room, "room", capacity), lengths[: small + 1], capacity)
    sequences = int(base[-1])

    plan = np.array(rows, np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]

    def place_small(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            at = np.zeros(len(f), np.int64)
            for n in np.unique(length):
                lo, hi = np.searchsorted(plan[:, 0], [n, n + 1])
                own = length == n
                at[own] = lo + np.searchsorted(plan[lo:hi, 1], rank[own], side="right") - 1
            p = plan[at]
            yield f.assign(room=p[:, 4], room_rank=p[:, 5] + (rank - p[:, 1]) // p[:, 3]).drop(columns="rank")

    placed = ranked.where(F.col("length") <= small).mapInPandas(place_small, schema.replace("sequence_id long", "room long, room_rank long"))
    named = room.select(F.col("room").cast("long"), F.col("rank").alias("room_rank"), "sequence_id")
    old = placed.where(F.col("room") < capacity).join(named, ["room", "room_rank"]).drop("room", "room_rank")
    new = placed.where(F.col("room") == capacity).withColumn("sequence_id", F.col("room_rank") + sequences).drop("room", "room_rank")
    together = large.unionByName(old).unionByName(new)
    inside = W.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "piece", "start").rowsBetween(W.unboundedPreceding, -1)
    return together.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0)))


def op6_linear_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(read(spark, sf_dir, "documents")))
