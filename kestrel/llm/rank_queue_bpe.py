"""Byte-level BPE encoding and decoding with a rank queue.

A text is cut into pre-tokens; those that are vocabulary strings are one token,
the other distinct ones of a chunk are merged together over one linked list of
bytes. Positions whose pair has a merge rank wait in that rank's bucket; three
levels of 64-bit words mark the buckets that hold something, and finding the
first set bit of each level gives the lowest rank. A position whose pair has
changed since it was put there is skipped. Every merge costs a constant number
of steps, so a pre-token of millions of bytes takes time in proportion; a bucket
of many positions is merged with numpy in one step if their order cannot count.

Null text: empty, no ids. Empty text: no ids. Very long texts are handled whole
(a chunk of their own; about 100 bytes of memory for each byte merged at once).
Ties: of equal ranks the leftmost is merged first. One output row per input row
(repeated rows stay); an empty table gives an empty result; other columns,
whatever their names, play no part. Ids outside the vocabulary raise in decode.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import chunks, raw, read, texts_of
from kestrel.llm.pretokens import spaced_starts

#: Bytes of pre-tokens merged over one list (one longer pre-token: a list of its own).
MERGED_BYTES = 1 << 20

#: Bytes of text encoded at once inside a task.
PART_BYTES = 4 << 20

#: So many positions of one rank are merged at once with numpy.
TOGETHER = 24


class RankQueue:
    """Numbers waiting under ranks 0..size-1, lowest rank first."""

    def __init__(self, size: int):
        self.words, self.blocks, self.top = [0] * (size // 64 + 1), [0] * (size // 4096 + 1), 0
        self.buckets: dict[int, list] = {}  # of numbers and arrays of numbers

    def put(self, rank: int, numbers) -> None:
        held = self.buckets.get(rank)
        if held is not None:
            held.append(numbers)
            return
        self.buckets[rank] = [numbers]
        self.words[rank >> 6] |= 1 << (rank & 63)
        self.blocks[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def put_all(self, ranks: np.ndarray, numbers: np.ndarray) -> None:
        """Each number under its rank; a negative rank is none."""
        there = np.flatnonzero(ranks >= 0)
        there = there[np.argsort(ranks[there], kind="stable")]
        ranks, numbers = ranks[there], numbers[there]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for rank, a, b in zip(ranks[cuts].tolist(), cuts, [*cuts[1:], len(ranks)]):
            self.put(rank, numbers[a:b])

    def take(self) -> tuple[int, np.ndarray | list[int]]:
        """The lowest rank and what waits there, ascending and each once; -1 if
        nothing waits."""
        if not self.top:
            return -1, []
        block = (self.top & -self.top).bit_length() - 1
        word = block << 6 | (self.blocks[block] & -self.blocks[block]).bit_length() - 1
        rank = word << 6 | (self.words[word] & -self.words[word]).bit_length() - 1
        self.words[word] &= self.words[word] - 1
        if not self.words[word]:
            self.blocks[block] &= self.blocks[block] - 1
            if not self.blocks[block]:
                self.top &= self.top - 1
        parts = self.buckets.pop(rank)
        if len(parts) == 1 and type(parts[0]) is int:
            return rank, parts
        arrays, single = [x for x in parts if type(x) is not int], [x for x in parts if type(x) is int]
        return rank, np.unique(np.concatenate([*arrays, np.array(single, np.int32)]))


class Merging:
    """Pre-tokens side by side as linked lists of tokens. ``first`` holds the
    rank of the pair that starts at each position, -1 where none merges."""

    def __init__(self, bpe: Bpe, data: np.ndarray, at: np.ndarray):
        n, self.bpe, self.queue = len(data), bpe, RankQueue(bpe.size)
        first = np.full(n, -1, np.int32)
        first[:-1] = bpe.byte_pair[data[:-1], data[1:]]
        first[at[1:] - 1] = -1
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[at[1:] - 1] = -1
        before[at[:-1]] = -1
        # arrays of Python for single steps, and the same memory for numpy
        self.token, self.first, self.after, self.before = (array("i", x.tobytes()) for x in (bpe.byte[data], first, after, before))
        self.alive = bytearray(b"\1") * n
        self.tokens, self.firsts, self.afters, self.befores = (np.frombuffer(x, np.int32) for x in (self.token, self.first, self.after, self.before))
        self.alives = np.frombuffer(self.alive, np.uint8)
        self.queue.put_all(first, np.arange(n, dtype=np.int32))

    def run(self) -> None:
        while True:
            rank, waiting = self.queue.take()
            if rank < 0:
                return
            if len(waiting) < TOGETHER or not self.together(rank, waiting):
                self.single(rank, waiting if type(waiting) is list else waiting.tolist())

    def single(self, rank: int, waiting: list[int]) -> None:
        """Merges from left to right, until a lower rank comes up."""
        token, first, after, before, put, get = self.token, self.first, self.after, self.before, self.queue.put, self.bpe.pair.get
        for k, p in enumerate(waiting):
            if first[p] != rank:
                continue  # stale: the pair has changed
            gone = after[p]
            token[p], self.alive[gone], first[gone] = rank, 0, -1
            right, left, lowest = after[gone], before[p], rank
            after[p], first[p] = right, -1
            if right >= 0:
                before[right] = p
                first[p] = new = get(rank << 32 | token[right], -1)
                if new >= 0:
                    put(new, p)
                    lowest = new if new < lowest else lowest
            if left >= 0:
                first[left] = new = get(token[left] << 32 | rank, -1)
                if new >= 0:
                    put(new, left)
                    lowest = new if new < lowest else lowest
            if lowest < rank:  # it goes first
                for rest in waiting[k + 1 :]:
                    put(rank, rest)
                return

    def together(self, rank: int, waiting: np.ndarray) -> bool:
        """All merges of a rank at once. Not done, and nothing changed, if two of
        them overlap or a lower rank would come up: then their order counts."""
        p = waiting[self.firsts[waiting] == rank]
        gone = self.afters[p]
        if (self.firsts[gone] == rank).any():
            return False
        old = self.tokens[p]
        self.tokens[p], self.alives[gone] = rank, 0
        right, left = self.afters[gone], self.befores[p]
        left = np.where((left >= 0) & (self.alives[left] == 0), self.befores[left], left)  # merged as well: its head
        to_right, to_left = np.full(len(p), -1, np.int32), np.full(len(p), -1, np.int32)
        r, l = np.flatnonzero(right >= 0), np.flatnonzero(left >= 0)  # noqa: E741
        to_right[r] = self.bpe.pair_ranks(rank, self.tokens[right[r]])
        to_left[l] = self.bpe.pair_ranks(self.tokens[left[l]], rank)
        if ((to_right >= 0) & (to_right < rank)).any() or ((to_left >= 0) & (to_left < rank)).any():
            self.tokens[p], self.alives[gone] = old, 1
            return False
        self.firsts[gone] = -1
        self.afters[p] = right
        self.befores[right[r]] = p[r]
        self.firsts[p] = to_right
        self.firsts[left[l]] = to_left[l]
        self.queue.put_all(np.concatenate([to_right, to_left]), np.concatenate([p, left]))
        return True


class Bpe:
    """A rank file: token bytes by rank, and the rank of every pair that merges."""

    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        self.size = max(self.ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.large_binary())
        self.numbers = pa.array([b"%d " % i for i in range(self.size)], pa.large_binary())
        self.known = np.array([t in self.ranks for t in tokens])
        get, pair = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = get(token[:cut]), get(token[cut:])
                if left is not None and right is not None:
                    pair[left << 32 | right] = rank
        self.pair = pair
        self.pairs = np.array(sorted(pair), np.int64)
        self.ranks_of = np.array([pair[k] for k in self.pairs.tolist()], np.int32)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.byte_pair = np.array([[get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int32)

    def pair_ranks(self, left, right) -> np.ndarray:
        """The rank of each pair of tokens, -1 where they don't merge."""
        key = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks_of[at], -1)

    def merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty pre-tokens, one after the other, and how many each has."""
        data, at = raw(pieces)
        merging = Merging(self, data, at)
        merging.run()
        kept = merging.alives > 0
        return merging.tokens[kept], np.add.reduceat(kept.astype(np.int64), at[:-1])

    def pieces_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of any pre-tokens: a vocabulary string is one token."""
        whole = pc.index_in(pieces, value_set=self.tokens)
        rest = np.flatnonzero(np.asarray(whole.is_null()))
        alone = np.asarray(whole.fill_null(0), np.int32)
        size = np.ones(len(pieces), np.int64)
        if not len(rest):
            return alone, size
        left = pieces.take(pa.array(rest))
        block = np.cumsum(np.asarray(pc.binary_length(left), np.int64)) // MERGED_BYTES
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        parts = [self.merge(left.slice(a, b - a)) for a, b in zip(cuts, [*cuts[1:], len(rest)])]
        size[rest] = np.concatenate([x[1] for x in parts])
        merged = np.repeat(np.isin(np.arange(len(pieces)), rest), size)
        out = np.empty(len(merged), np.int32)
        out[merged] = np.concatenate([x[0] for x in parts])
        out[~merged] = np.delete(alone, rest)
        return out, size

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text (a list array; a null is an empty text)."""
        data, at = raw(texts)
        begin = spaced_starts(data, at) if len(data) else np.zeros(0, np.int64)
        offsets = np.append(begin, len(data)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        flat, size = self.pieces_ids(coded.dictionary)
        index = coded.indices.to_numpy()
        n = size[index]
        place = np.append(0, np.cumsum(n))
        ids = flat[np.repeat((np.cumsum(size) - size)[index] - place[:-1], n) + np.arange(place[-1])]
        first = place[np.searchsorted(begin, at)]
        return pa.LargeListArray.from_arrays(pa.array(first), pa.array(ids)).cast(pa.list_(pa.int32()))

    def _joined(self, strings: pa.Array, ids: pa.Array) -> pa.Array:
        """The strings of each list of ids (a null is an empty list), joined."""
        ids = ids.fill_null([]) if ids.null_count else ids
        numbers = ids.flatten().to_numpy(zero_copy_only=False)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= self.size or not self.known[numbers].all()):
            raise ValueError("an id is not in the vocabulary")
        data, at = raw(strings.take(pa.array(numbers)))
        offsets = np.asarray(ids.offsets, np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(at[offsets - offsets[0]]), pa.py_buffer(np.ascontiguousarray(data))])

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids."""
        return self._joined(self.tokens, ids).cast(pa.binary())

    def written(self, ids: pa.Array) -> pa.Array:
        """Each list of ids as decimal numbers, a blank after each."""
        return self._joined(self.numbers, ids)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``PART_BYTES`` of text, or one row."""
    for batch in chunks(batches):
        block = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64)) // PART_BYTES
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
            yield batch.slice(a, b - a)


@functools.cache
def vocabulary(name: str) -> Bpe:
    """A rank file by name, read once in a process."""
    return Bpe(public_tokenizers.path(name))


def encode(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and the ids (array of int) of every whole text. Runs where the
    rows lie: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(name)
        for batch in _parts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.encode(batch.column(1))], ["doc_id", "ids"])

    return texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(name)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bpe.decode(batch.column(1))], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, encoded and
    decoded where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(name)
        digest = lambda strings: [hashlib.sha256(x).hexdigest() for x in strings]
        for batch in _parts(batches):
            ids = bpe.encode(batch.column(1))
            numbers = digest(memoryview(x.as_buffer())[:-1] for x in bpe.written(ids))
            decoded = digest(memoryview(x.as_buffer()) for x in bpe.decode(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.list_value_length(ids).cast(pa.int64()), pa.array(numbers), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_bitmap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
