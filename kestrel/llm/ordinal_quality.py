"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - score): all grades share one weight
vector over hashed text features (words present, and the text's shape in
buckets), with ordered thresholds. The expected grade and the probability of
the top grade follow; documents whose tail probability is under ``KEEP`` are
rejected.

The weights are fitted on at most ``SAMPLE`` labelled documents (those with the
least hash of the id, the same in every run), an L1 penalty keeping only words
that tell grades apart; every document is scored, where it lies, with one pass
and no shuffle.

Null text: empty. Labels with a null grade are left out; of several labels of
one document the least grade holds. Without labelled documents nothing is
rejected. Very long texts are read whole. Ties of the hash are broken by id.
Repeated rows get one row each; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import common
from kestrel.llm.common import chunks, mix, raw, read, texts_of

#: Labelled documents the fit may use; the driver holds their feature lists.
SAMPLE = 6000
SLOTS = 1 << 18
#: Bytes of text read at once: what a part needs for a moment is some 25 times that.
PART_BYTES = 2 << 20
#: A slot must occur in so many documents of the sample.
LEAST_DOCS = 8
L1 = 1e-3
ROUNDS = 300
KEEP = 0.5

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>@^~=+_\\{}[]"]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b"!?.,;:\"'()-"]] = True
#: Words also count by their first bytes, once, and again if so many begin alike.
PREFIX = (5, 7)
OFTEN = (2, 4, 8)
#: Upper ends of the buckets of each shape feature.
SHAPE = {
    "words": (5, 10, 20, 50, 100, 1000),
    "upper": (0.02, 0.05, 0.1, 0.2, 0.35, 0.6),
    "symbols": (0.001, 0.005, 0.02, 0.05, 0.1),
    "marks": (0.01, 0.03, 0.05, 0.08, 0.12, 0.2),
    "same as before": (0.005, 0.02, 0.05, 0.1, 0.3),
    "word length": (2.5, 3.5, 4.5, 6, 8, 12),
}
SHAPE_SLOTS = sum(len(v) + 1 for v in SHAPE.values())


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, slot) of every feature a text has; each pair once, sorted."""
    data, at = raw(texts)
    n = len(at) - 1
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[at])
    w = common.words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.where(_WORD[data], data, 32).astype(np.uint8))]), lower=True)
    h = w.hashes()
    doc = w.doc
    size = total(~common._SPACE[data])
    same = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) if len(h) else np.zeros(0, bool)
    least = np.maximum(size, 1)
    measured = {
        "words": w.counts, "upper": total(_UPPER[data]) / least, "symbols": total(_SYMBOL[data]) / least, "marks": total(_MARK[data]) / least,
        "same as before": np.bincount(doc[same], minlength=n) / np.maximum(w.counts, 1),
        "word length": np.bincount(doc, weights=(w.end - w.start).astype(float), minlength=n) / np.maximum(w.counts, 1),
    }
    pairs, base = [doc.astype(np.uint64) << np.uint64(32) | (h & np.uint64(SLOTS - 1))], SLOTS
    for size in PREFIX:
        long = w.end - w.start > size
        begins = doc[long].astype(np.uint64) << np.uint64(32) | (mix(w.hashes(size)[long] + np.uint64(size)) & np.uint64(SLOTS - 1))
        found, times = np.unique(begins, return_counts=True)
        pairs.append(found)
        pairs += [found[times >= k] ^ np.uint64(k) for k in OFTEN]
    for name, ends in SHAPE.items():
        pairs.append(np.arange(n, dtype=np.uint64) << np.uint64(32) | (base + np.searchsorted(ends, measured[name])).astype(np.uint64))
        base += len(ends) + 1
    flat = np.concatenate(pairs)
    return flat >> np.uint64(32), flat & np.uint64(0xFFFFFFFF)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades

    def scores(self, texts: pa.Array) -> np.ndarray:
        table = np.zeros(SLOTS + SHAPE_SLOTS)
        table[self.slots] = self.weights
        doc, slot = features(texts)
        there = table[slot] != 0
        pairs = np.unique(doc[there] << np.uint64(32) | slot[there])
        return np.bincount((pairs >> np.uint64(32)).astype(np.int64), weights=table[pairs & np.uint64(0xFFFFFFFF)], minlength=len(texts))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k, a row a text."""
        return 1 - _logistic(self.thresholds[None, :] - scores[:, None])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_arrays(doc: np.ndarray, slot: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """Proximal gradient steps, a rate of its own for each weight, on the mean
    negative log likelihood plus ``L1`` times the weights' absolute sum."""
    n = len(grade)
    if not n:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.full(grades - 1, -np.inf))
    slots, index, seen = np.unique(slot, return_inverse=True, return_counts=True)
    use = seen >= LEAST_DOCS
    number = np.cumsum(use) - 1
    keep = use[index]
    slots, index, doc = slots[use], number[index[keep]], doc[keep]
    w = np.zeros(len(slots))
    share = (np.cumsum(np.bincount(grade, minlength=grades))[:-1] + 0.5) / (n + 1)
    theta = np.log(share / (1 - share))
    theta += np.arange(grades - 1) * 1e-3
    gw, gt = np.full(len(w), 1e-8), np.full(len(theta), 1e-8)
    rows = np.arange(n)
    for _ in range(ROUNDS):
        eta = np.bincount(doc, weights=w[index], minlength=n)
        f = np.concatenate([np.zeros((n, 1)), _logistic(theta[None, :] - eta[:, None]), np.ones((n, 1))], axis=1)
        low, high = f[rows, grade], f[rows, grade + 1]
        p = np.maximum(high - low, 1e-9)
        g = np.bincount(index, weights=((1 - high - low) / n)[doc], minlength=len(w))
        t = np.zeros(grades + 1)
        np.add.at(t, grade + 1, -high * (1 - high) / p / n)
        np.add.at(t, grade, low * (1 - low) / p / n)
        gw += g * g
        gt += t[1:-1] ** 2
        rate = 0.3 / np.sqrt(gw)
        w -= rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * L1, 0)
        theta = np.maximum.accumulate(theta - 0.1 / np.sqrt(gt) * t[1:-1] + 0.0)
        theta += np.arange(grades - 1) * 1e-6
    there = w != 0
    return Model(slots[there].astype(np.int64), w[there], theta)


def fit(labelled: DataFrame, grades: int, sample: int = SAMPLE) -> Model:
    """From (doc_id, text, grade 0..grades-1): features are made where the rows
    lie, the lists of at most ``sample`` documents come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=PART_BYTES):
            doc, slot = features(batch.column(1))
            pairs = np.unique(doc << np.uint64(32) | slot)
            cut = np.searchsorted(pairs >> np.uint64(32), np.arange(batch.num_rows + 1))
            own = (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([own[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["doc_id", "grade", "slots"])

    rows = labelled.where(F.col("grade").between(0, grades - 1)).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("grade").cast("int"))
    some = rows.mapInArrow(run, "doc_id long, grade int, slots binary").orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "slots").limit(sample).collect()
    lists = [np.frombuffer(r.slots, np.uint32) for r in some]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return fit_arrays(doc, np.concatenate(lists) if lists else np.zeros(0, np.uint32), np.array([r.grade for r in some], np.int64), grades)


def judged(batches: Iterator[pa.RecordBatch], model: Model, t: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows, part by part, and the tails of their texts in column t."""
    for batch in chunks(batches, most=PART_BYTES):
        yield batch, model.tails(model.scores(batch.column(t)))


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the top grade), kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tails in judged(batches, model, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["doc_id", "expected_grade", "tail_probability"])

    scored = texts_of(docs).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return scored.withColumn("kept", F.col("tail_probability") >= KEEP)


def select(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of the table, with all their columns, that are kept."""
    t = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tails in judged(batches, model, t):
            yield batch.filter(pa.array(tails[:, -1] >= KEEP))

    return docs.mapInArrow(run, docs.schema)


def ratings(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, grade) of at most ``sample`` labelled documents: grade 0
    toxic, 1 of low quality, 2 good. The ids are chosen first, so few texts move."""
    g = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = labels.select(F.col("doc_id").cast("long").alias("doc_id"), g.alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = rated.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return texts_of(documents).join(chosen, "doc_id")


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return grade(documents, fit(ratings(documents, read(spark, sf_dir, "labels")), 3))
