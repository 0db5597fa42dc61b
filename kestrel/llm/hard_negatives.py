"""Hard negatives by an inverted multi-index.

A vector's two halves each have a codebook, fitted on a bounded sample; the two
nearest codewords name its cell. Rows lie in blocks ordered by cell; every block
keeps, for each codeword in it, the largest distance of a row from it. For an
anchor, a half's score with a codeword plus radius times norm bounds the score
of every row behind it, and a heap over the two sorted lists of half bounds (the
multi-sequence walk) visits a block's cells from the highest sum down. It stops
when no further cell can change what is held: first the positives (the best rows
of the anchor's label), then for each positive the best rows of other labels
inside its window of scores. The bounds are safe, so results are exact; where
vectors have no clusters the walk visits all cells. Anchors are a stated query
set: blocks of anchors meet blocks of rows.

Rows without id, label or vector, or with a null or non-finite component, take
no part. Components become floor(256 * x). Vectors of different length are
compared as if zeros followed the shorter ones. Repeated rows count once; of
different rows with one id the one of the smallest label, then vector, counts.
Equal scores: the smaller id first. An empty table, or one without anchors,
positives or rows in a window, gives no row. Other columns play no part. Scores
are exact; one beyond a long counts as its end, and a component of 2**1000 or
more as non-finite.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import cut_lineage, read

#: Rows the codebooks are fitted on (those of the smallest hashes), at most.
SAMPLE = 20_000

#: Rows a cell should hold; codewords a half, at most. Steps of the fit.
CELL_ROWS, CODES, ROUNDS = 128, 256, 8

#: Rows of a block, blocks of rows and anchors that meet in one task.
BLOCK_ROWS, BLOCKS, ANCHORS = 4096, 4, 2048

#: Rows scored before the first look at what is certain; then twice as many each time.
FIRST_LOOK = 512

_LEAST, _MOST = -(2**63), 2**63 - 1


def clean(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, vector (whole numbers as doubles) of the rows that take part, one an id."""
    x = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 2.0**1000))
    x = x.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    # floor gives a long, too small for the largest; those have no fraction
    whole = F.transform("vector", lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * 256).cast("double")).otherwise(c * 256))
    x = x.select("id", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), whole.alias("vector"))
    return x.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.label", "row.vector")


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of ``width`` columns, zeros behind the shorter ones."""
    size = np.asarray(pa.compute.list_value_length(vectors), np.int64)
    out = np.zeros((len(vectors), width))
    out[np.repeat(np.arange(len(vectors)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def codebooks(rows: DataFrame, count: int, width: int) -> list[np.ndarray]:
    """The codewords of each half, by k-means on at most ``SAMPLE`` rows."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    x = matrix(sample.column(0).combine_chunks(), width)
    wanted = int(min(CODES, max(1, 2 ** round(np.log2(max(1, count / CELL_ROWS)) / 2))))
    out = []
    for half in (x[:, : width // 2], x[:, width // 2 :]):
        codes = half[: min(wanted, len(half))].copy()
        for _ in range(ROUNDS):
            near = nearest(half, codes)
            n = np.bincount(near, minlength=len(codes))
            total = np.zeros_like(codes)
            np.add.at(total, near, half)
            codes[n > 0] = total[n > 0] / n[n > 0, None]
        out.append(codes)
    return out


def nearest(half: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (half @ codes.T - (codes * codes).sum(1) / 2).argmax(1) if half.shape[1] else np.zeros(len(half), np.int64)


def blocks(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """block, part, n, ids, labels, cells, vectors: the index, a row for every
    block of at most ``BLOCK_ROWS`` rows, in the order of their cells. A cell of
    many rows (copies of one vector) fills several blocks."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), width)
            codes = [nearest(half, book) for half, book in zip((x[:, : width // 2], x[:, width // 2 :]), books)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c.astype(np.int32)) for c in codes)], [*b.schema.names, "one", "two"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, n = TaskContext.get().partitionId() << 32, [], 0

        def block(table: pa.Table) -> pa.RecordBatch:
            ids, labels, one, two = (np.asarray(table.column(c)) for c in ("id", "label", "one", "two"))
            cell = one.astype(np.int64) << 32 | two
            parts = [ids.astype(np.int64), labels.astype(np.int64), cell, matrix(table.column("vector").combine_chunks(), width)]
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([len(ids)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["block", "n", "ids", "labels", "cells", "vectors"])

        for b in batches:
            while b.num_rows:
                take = b.slice(0, BLOCK_ROWS - n)
                held, n, b = [*held, take], n + take.num_rows, b.slice(take.num_rows)
                if n == BLOCK_ROWS:
                    yield block(pa.Table.from_batches(held))
                    held, n, made = [], 0, made + 1
        if n:
            yield block(pa.Table.from_batches(held))

    placed = rows.mapInArrow(cells, "id long, label long, vector array<double>, one int, two int")
    placed = placed.repartitionByRange("one", "two", "id").sortWithinPartitions("one", "two", "id")
    return placed.mapInArrow(build, "block long, n long, ids binary, labels binary, cells binary, vectors binary")


class Block:
    """A block of the index, read."""

    def __init__(self, row: dict, books: list[np.ndarray], width: int):
        n = row["n"]
        ids, labels, cell = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "cells"))
        x = np.frombuffer(row["vectors"], np.float64).reshape(n, width)
        order = np.lexsort((ids, labels, cell))  # a label's rows of a cell stand together
        self.ids, self.labels, self.x, cell = ids[order], labels[order], x[order], cell[order]
        one, two, half = cell >> 32, cell & 0xFFFFFFFF, width // 2
        self.codes, self.radii = [], []
        for code, book, part in ((one, books[0], self.x[:, :half]), (two, books[1], self.x[:, half:])):
            there, at = np.unique(code, return_inverse=True)
            radius = np.zeros(len(there))
            np.maximum.at(radius, at, np.sqrt(((part - book[code]) ** 2).sum(1)))
            self.codes.append(book[there])
            self.radii.append(radius)
        start = np.flatnonzero(np.diff(cell, prepend=-1))
        a, b = (np.unique(c, return_inverse=True)[1][start].tolist() for c in (one, two))
        self.cells = {place: k for k, place in enumerate(zip(a, b))}
        self.begin, self.end = start.tolist(), [*start[1:].tolist(), n]
        self.norm2 = float((self.x * self.x).sum(1).max(initial=0.0))
        self.as_type: dict = {}
        self.of_label: dict[int, tuple[list[int], list[int]]] = {}

    def label_rows(self, label: int) -> tuple[list[int], list[int]]:
        """Where a label's rows begin and end in each cell."""
        if label not in self.of_label:
            cell = np.repeat(np.arange(len(self.begin)), np.subtract(self.end, self.begin))
            less = lambda test: (self.begin + np.bincount(cell, test, len(self.begin))).astype(np.int64).tolist()
            self.of_label[label] = less(self.labels < label), less(self.labels <= label)
        return self.of_label[label]

    def typed(self, kind) -> np.ndarray:
        if kind not in self.as_type:
            self.as_type = {kind: as_whole(self.x) if kind is object else self.x.astype(kind)}
        return self.as_type[kind]


def as_whole(x: np.ndarray) -> np.ndarray:
    """Whole doubles as Python numbers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def kind_of(norm2: float, other2: float):
    """The type in which every partial sum of products is a whole number of its own."""
    bound = np.sqrt(norm2 * other2) if norm2 < 1e150 and other2 < 1e150 else np.inf
    return np.float32 if bound < 2.0**23 else np.float64 if bound < 2.0**52 else object


def walk(bounds: list[np.ndarray], cells: dict) -> Iterator[tuple[float, int]]:
    """A block's cells, as (bound, number), from the highest bound down:
    the heap holds for each codeword of the first half its best one of the
    second not yet taken."""
    first, second = (np.argsort(-b, kind="stable") for b in bounds)
    u, v = bounds[0][first].tolist(), bounds[1][second].tolist()
    first, second = first.tolist(), second.tolist()
    heap = [(-(u[0] + v[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if j + 1 < len(v):
            heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))
        cell = cells.get((first[i], second[j]))
        if cell is not None:
            yield -bound, cell


class Best:
    """The best rows within a window of scores, and whether a bound settles it."""

    def __init__(self, size: int, positive: int, score: int, low=-np.inf, high=np.inf):
        self.size, self.low, self.high = size, low, high
        self.positive, self.score = positive, score  # whose window it is
        self.scores, self.ids = [], []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        floor = self.scores[-1] if len(self.scores) == self.size else self.low
        own = np.flatnonzero((scores >= max(floor, self.low)) & (scores <= self.high))
        if len(own):
            found = sorted([*zip((-scores[own]).tolist(), ids[own].tolist()), *((-s, i) for s, i in zip(self.scores, self.ids))])[: self.size] if len(own) <= 64 else self._many(scores[own], ids[own])
            self.scores, self.ids = [-s for s, _ in found], [i for _, i in found]

    def _many(self, scores: np.ndarray, ids: np.ndarray) -> list[tuple]:
        scores = np.concatenate([scores, np.array(self.scores, scores.dtype)])
        ids = np.concatenate([ids, np.array(self.ids, np.int64)])
        order = np.lexsort((ids, -scores))[: self.size]
        return list(zip((-scores[order]).tolist(), ids[order].tolist()))

    def settled(self, bound: float) -> bool:
        """No row of a score up to ``bound`` would be held."""
        return bound < self.low or len(self.scores) == self.size and bound < self.scores[-1]


def search(block: Block, anchors: list[dict], x: np.ndarray, positives: bool) -> None:
    """Takes a block into what each anchor holds (``best``): rows of its label,
    or of all other labels. Scores are exact; bounds are rounded up."""
    half = x.shape[1] // 2
    norms2 = (x * x).sum(1)
    bounds = [part @ codes.T + np.sqrt((part * part).sum(1))[:, None] * radii for part, codes, radii in ((x[:, :half], block.codes[0], block.radii[0]), (x[:, half:], block.codes[1], block.radii[1]))]
    kinds = [kind_of(block.norm2, n) for n in norms2.tolist()]
    typed = {k: as_whole(x) if k is object else x.astype(k) for k in set(kinds)}
    for k, anchor in enumerate(anchors):
        best, kind, label, me = anchor["best"], kinds[k], anchor["label"], anchor["id"]
        rows, q = block.typed(kind), typed[kind][k]
        slack = 1.0 + 1e-9 * np.sqrt(norms2[k] * block.norm2)
        low, high = block.label_rows(label)
        parts, seen, look = [], 0, FIRST_LOOK

        def take() -> None:
            s, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for b in best:
                b.add(s, ids)
            parts.clear()

        for bound, c in walk([bounds[0][k], bounds[1][k]], block.cells):
            if all(b.settled(bound + slack) for b in best):
                break
            for i, j in ((low[c], high[c]),) if positives else ((block.begin[c], low[c]), (high[c], block.end[c])):
                if i < j:
                    s, ids = rows[i:j] @ q, block.ids[i:j]
                    own = ids != me if positives else slice(None)
                    parts.append((s[own], ids[own]))
                    seen += j - i
            if seen >= look:
                take()
                look = 2 * seen
        if parts:
            take()


def met(anchors: DataFrame, index: DataFrame, books: list[np.ndarray], width: int, most: int, positives: bool) -> DataFrame:
    """anchor_id, positive_id, positive_score, id, score: the best ``most`` rows for
    each window of each anchor, of each task's blocks. anchors: id, label, vector,
    windows (positive_id, positive_score); positives come without windows."""
    count = {"anchors": anchors.count(), "blocks": index.count()}
    groups, parts = (max(1, -(-count[c] // n)) for c, n in (("anchors", ANCHORS), ("blocks", BLOCKS)))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    packed = anchors.withColumn("group", deal("id", groups)).groupBy("group").agg(F.collect_list(F.struct(*anchors.columns)).alias("anchors")).withColumn("part", number(parts))
    dealt = index.withColumn("part", deal("block", parts)).withColumn("group", number(groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, x = None, [], None

        def send() -> pa.RecordBatch:
            end = lambda n: min(max(int(n), _LEAST), _MOST)
            rows = [(a["id"], b.positive, b.score, i, end(s)) for a in held for b in a["best"] for s, i in zip(b.scores, b.ids)]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], ["anchor_id", "positive_id", "positive_score", "id", "score"])

        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                now = (one["group"], one["part"])
                if now != key:
                    if held:
                        yield send()
                    key, held = now, []
                if one["anchors"] is not None:  # they come first
                    held = one["anchors"]
                    x = matrix(pa.array([a["vector"] for a in held], pa.list_(pa.float64())), width)
                    for a in held:
                        a["best"] = [Best(most, w["id"], w["score"], -(-50 * w["score"] // 100), 95 * w["score"] // 100) for w in a["windows"] or []] or [Best(most, a["id"], 0)]
                elif held:
                    search(Block(one, books, width), held, x, positives)
        if held:
            yield send()

    both = packed.unionByName(dealt, allowMissingColumns=True).repartition("group", "part")
    return both.sortWithinPartitions("group", "part", F.col("block").asc_nulls_first()).mapInArrow(run, "anchor_id long, positive_id long, positive_score long, id long, score long")


def hard_negatives(embeddings: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, **columns: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score:
    for every anchor (id divisible by ``every``) and each of its first
    ``positives`` rows of the same label, the first ``negatives`` rows of other
    labels that score 50 to 95 per cent of the positive."""
    spark = embeddings.sparkSession
    rows = cut_lineage(clean(embeddings, **columns), "vectors")
    count, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(width, 2)
    books = codebooks(rows, count, width)
    index = cut_lineage(blocks(rows, books, width), "index")
    anchors = rows.where(F.col("id") % every == 0)
    none = F.lit(None).cast("array<struct<id: bigint, score: bigint>>")
    first = lambda df, keys, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= n)
    best = first(met(anchors.withColumn("windows", none), index, books, width, positives, True), ["anchor_id"], positives)
    windows = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("windows"))  # at most ``positives``
    searched = cut_lineage(anchors.join(windows, "id"), "windows")
    found = first(met(searched, index, books, width, negatives, False), ["anchor_id", "positive_id"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(read(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pairs USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
