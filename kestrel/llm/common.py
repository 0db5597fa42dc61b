"""Shared helpers of the training-data operators.

Texts reach Python as Arrow batches and are handled as numpy arrays over the
bytes of a whole chunk of documents: word boundaries, word hashes, windows.
A chunk is bounded by ``CHUNK_BYTES`` (one longer document makes a chunk of
its own), so a task's memory does not depend on the size of its partition.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import cut_lineage, shared_path, table_of  # noqa: F401

#: Bytes of text handled at once inside a task.
CHUNK_BYTES = 8 * 1024 * 1024

#: Bytes hashed at once.
SLICE = 1 << 19

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE_KEY = _SEED.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table_of(spark, sf_dir, name)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) of any table with these columns; whatever
    else it holds, under whatever names, plays no part."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return shared_path(spark, "tables", f"{name}-{uuid.uuid4().hex}")


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text (or one row). At
    the end of a task the worker, which stays for later tasks, gives back memory
    that it no longer uses."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        sizes = np.asarray(pc.binary_length(batch.column(at)).fill_null(0), np.int64)
        block = np.cumsum(sizes) // most
        cuts = np.flatnonzero(np.diff(block)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together, and where each text starts (one more
    entry than texts). A null is an empty text."""
    texts = pa.array(texts) if not isinstance(texts, (pa.Array, pa.ChunkedArray)) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def powers(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the hash base (or its inverse) modulo 2**64."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "base" else _BASE_INV
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a chunk of texts."""

    data: np.ndarray  # bytes of all texts (lower-cased if asked)
    texts: np.ndarray  # start of each text in data, one more entry than texts
    start: np.ndarray  # of each word in data
    end: np.ndarray
    first: np.ndarray  # index of each text's first word, one more entry than texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Text index of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """64-bit hash of each word (of its first ``most`` bytes), the same in every task."""
        end = self.end if most is None else np.minimum(self.end, self.start + most)
        out, n, a = np.empty(len(self.start), np.uint64), len(self.start), 0
        while a < n:  # a slice of bytes at a time: the sums are eight bytes a byte of text
            b = max(a + 1, int(np.searchsorted(self.start, self.start[a] + SLICE)))
            low, part = self.start[a], self.data[self.start[a] : end[b - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE_KEY[part] * powers("base", len(part)), out=sums[1:])
            begin, stop = self.start[a:b] - low, end[a:b] - low
            h = sums[stop] - sums[begin]
            h *= powers("inverse", len(part) + 1)[begin]
            out[a:b] = mix(h + (stop - begin).astype(np.uint64))
            a = b
        return out

    def strings(self, i: int) -> list[bytes]:
        """The words of text i."""
        return self.data[self.texts[i] : self.texts[i + 1]].tobytes().split()


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, at = raw(texts)
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:-1])
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[at[:-1]] = False
    start = np.flatnonzero(inside[:-1] & ~before[:-1])
    edge = np.zeros(len(data) + 1, bool)
    edge[at[1:]] = True  # a text's end closes its last word
    after = inside.copy()
    after[edge] = False
    end = np.flatnonzero(inside[:-1] & ~after[1:]) + 1
    return Words(data, at, start, end, np.searchsorted(start, at))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` consecutive words of one text.

    Returns the hashes, the index of each window's first word, and the index
    of each text's first window (one more entry than texts). With ``short``, a
    text of fewer words (but at least one) has its whole sequence as one
    window."""
    n = np.diff(first)
    count = np.maximum(n - size + 1, 0)
    at = np.zeros(len(n) + 1, np.int64)
    if short:
        few = (n > 0) & (n < size)
        count = np.where(few, 1, count)
    np.cumsum(count, out=at[1:])
    begin = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    out = np.zeros(len(begin), np.uint64)
    for i in range(size):
        out *= np.uint64(0xD1342543DE82EF95)
        out += padded[begin + i]
        out ^= out >> np.uint64(29)
    out = mix(out)
    if short and few.any():
        for i in np.flatnonzero(few):
            h = np.uint64(n[i])
            for x in hashes[first[i] : first[i + 1]]:
                h = np.uint64((int(h) * 0xD1342543DE82EF95 + int(x)) % 2**64)
                h ^= h >> np.uint64(29)
            out[at[i]] = mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)]))[0]
    return out, begin, at


def array(x: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.array(x, type=kind)
