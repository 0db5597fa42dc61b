"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to ``SLOTS`` columns. The document frequency of every slot
over all passages gives the weights of a TF-IDF matrix; its leading right
singular vectors are found by a distributed randomised SVD (each partition
multiplies its passages with a test matrix and back; only slots x dimensions
numbers are summed, whatever the corpus); a random sketch of the remainder keeps
rare words apart. A region of an item (its words and 16 to 22 more, from every
fourth word on) is a candidate if its cosine with the item in that space reaches
a floor; no other is looked at. The floor is what the lightest words of a leak
give, less ``NOISE`` standard deviations of the sketch, and more than 0.

A candidate leaks its item by the longest common subsequence: a copy by the
higher share, a paraphrase by the lower one if the item's answer (the words
after its last question mark, or its last words) is there as well. Copies are
searched by the cosines of all passages that hold such a region, then of the
regions; the cosines of a paraphrase are asked for where its answer stands. A
slot's products with all items are made once and rounded to steps of a 31st of
the largest, so those of a region are their sum, however many dimensions there
are.

The frequencies and the singular vectors are those of all texts, and every text
is searched whole. Items are searched in blocks of ``ITEMS``, a pass over the
texts each, so what goes to the tasks is bounded. Rows are searched where they lie: the texts are never shuffled.

Null text: empty, never a leak. Items that are null or without words are not
searched; those shorter than ``LEAST_WORDS`` leak where all their words stand in
a row; longer ones are searched whole, however long. Repeated rows give the same leaks once. Empty
documents or an empty benchmark: no leaks; other columns play no part (and are
passed on by ``decontaminate``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import InitVar, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import common
from kestrel.llm.common import chunks, cut_lineage, raw, read, texts_of

SLOTS = 1 << 15
DIMS = 32
#: Columns of the random sketch of what the singular vectors leave over.
SKETCH = 2048
#: Deviations of the sketch by which a candidate may stay behind a leak's words.
NOISE = 3.5
#: Steps of a word's product with an item: four words' sum fits a byte.
LEVELS = 31
EXTRA = 8
POWER = 0
#: Sums of slots x dimensions that are added in one task.
SUMS = 64
#: Words of a passage in the frequency counts and the fit.
PASSAGE = 32
#: Items searched in one pass over the texts.
ITEMS = 2000
BLOCK = 4
#: Blocks between the places where passages begin.
UNIT = 4
#: Words of a region beyond its item's.
SPARE = 4 * BLOCK
#: A shorter item leaks only where its words stand in a row.
LEAST_WORDS = 8
#: A leak: this share of the item in order, or the lower share and the answer.
LEAST_COPY, LEAST_PARAPHRASE = 0.8, 0.55
ANSWER_WORDS = 5
#: Words of an answer that are hashed; the rest are compared.
HEAD = 8
#: Bytes of text read at once.
PART_BYTES = 4 << 20
#: Words of a text handled at once; items and blocks counted at once.
SEGMENT = 200_000
GROUP, SLICE = 256, 4096

#: Letters (in lower case) and digits as they are, other bytes as blanks.
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_PLAIN[65:91] = range(97, 123)


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, in lower case) of all
    texts, and the index of each text's first."""
    data, at = raw(texts)
    plain = _PLAIN[data]
    w = common.words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(plain)]))
    return w.hashes(), w.first


def _slots(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SLOTS - 1)).astype(np.int64)


def hashed(docs: DataFrame) -> DataFrame:
    """Each text's words as slots of two bytes, stored: the frequencies and the fit read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=PART_BYTES):
            h, first = text_words(batch.column(1))
            at = pa.py_buffer((first * 2).astype(np.int64))
            slots = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, at, pa.py_buffer(_slots(h).astype(np.uint16))])
            yield pa.RecordBatch.from_arrays([slots.cast(pa.binary())], ["text"])

    return cut_lineage(texts_of(docs).mapInArrow(run, "text binary"), "slots")


def _read_slots(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, at = raw(batch.column(0))
    return data.view(np.uint16).astype(np.int64), at // 2


def frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that each slot occurs in, and all passages, over all hashed texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in chunks(batches, most=PART_BYTES):
            h, first = _read_slots(batch)
            n = np.diff(first)
            own = np.repeat(np.append(0, np.cumsum(-(-n // PASSAGE)))[:-1], n) + (np.arange(len(h)) - np.repeat(first[:-1], n)) // PASSAGE
            pairs = own * SLOTS + h
            pairs = np.sort(pairs.astype(np.uint32) if len(own) and own[-1] < 2**32 // SLOTS else pairs)
            once = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
            total[:SLOTS] += np.bincount(once % SLOTS, minlength=SLOTS)
            total[SLOTS] += int((-(-n // PASSAGE)).sum())
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], ["slot", "n"])

    out = np.zeros(SLOTS + 1, np.int64)
    for slot, n in texts.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out[:SLOTS], int(out[SLOTS])


def weights(df: np.ndarray, passages: int) -> np.ndarray:
    """A word that every passage has still counts."""
    return (1 + np.maximum(np.log((passages + 1) / (df + 1)), 0)).astype(np.float32)


def _passage_rows(s: np.ndarray, first: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weight of every word (each passage of unit length), and where passages begin."""
    n = np.diff(first)
    inside = np.arange(len(s)) - np.repeat(first[:-1], n)
    begin = np.flatnonzero(inside % PASSAGE == 0)
    w = idf[s]
    if len(begin):
        # repeated words of a passage add up before squaring only roughly; the scale of a row is all this sets
        size = np.sqrt(np.add.reduceat(w * w, begin))
        w = w / np.repeat(np.maximum(size, 1e-6), np.diff(np.append(begin, len(s))))
    return w, begin


def singular_vectors(texts: DataFrame, idf: np.ndarray) -> np.ndarray:
    """SLOTS x DIMS: the leading right singular vectors of the weighted
    passages of all hashed texts, by subspace iteration from a random test matrix."""
    basis = np.random.Generator(np.random.PCG64(11)).standard_normal((SLOTS, DIMS + EXTRA)).astype(np.float32)
    parts = 32
    for _ in range(POWER + 1):
        basis = np.linalg.qr(basis)[0].astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch], basis=basis) -> Iterator[pa.RecordBatch]:
            total = np.zeros(basis.shape, np.float32)
            for batch in chunks(batches, most=PART_BYTES):
                s, first = _read_slots(batch)
                w, begin = _passage_rows(s, first, idf)
                ends = np.append(begin, len(s))
                for a in range(0, len(begin), 2000):
                    lo, hi = ends[a], ends[min(a + 2000, len(begin))]
                    rows = np.repeat(np.arange(min(2000, len(begin) - a)), np.diff(ends[a : a + 2001]))
                    place = np.zeros((len(begin[a : a + 2000]), PASSAGE), np.int64)
                    weight = np.zeros(place.shape, np.float32)
                    inside = np.arange(lo, hi) - begin[a : a + 2000][rows]
                    place[rows, inside], weight[rows, inside] = s[lo:hi], w[lo:hi]
                    y = np.concatenate([np.matmul(weight[k : k + 100, None, :], basis[place[k : k + 100]])[:, 0] for k in range(0, len(place), 100)])
                    order = np.argsort(s[lo:hi].astype(np.uint16), kind="stable")
                    slot = s[lo:hi][order]
                    cut = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                    total[slot[cut]] += np.add.reduceat(w[lo:hi][order, None] * y[rows[order]], cut, axis=0)
            if total.any():
                size = SLOTS // parts
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([total[i * size : (i + 1) * size].tobytes() for i in range(parts)], pa.binary())], ["part", "sums"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in table.column("sums"))
            return pa.table({"part": table.column("part")[:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        sums = texts.mapInArrow(run, "part int, sums binary").withColumn("some", F.floor(F.spark_partition_id() / SUMS))
        sums = sums.groupBy("part", "some").applyInArrow(add, "part int, sums binary")
        rows = sums.groupBy("part").applyInArrow(add, "part int, sums binary").collect()
        if not rows:
            break
        basis = np.concatenate([np.frombuffer(r.sums, np.float32).reshape(-1, DIMS + EXTRA) for r in sorted(rows)])
    return np.linalg.svd(basis, full_matrices=False)[0][:, :DIMS].astype(np.float32)


def word_vectors(singular: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A row a slot (and one of zeros): its weighted place in the latent space,
    and a random sketch of what the leading directions leave over, so that rare
    words count too. Dot products stay those of the TF-IDF space, about."""
    rng = np.random.Generator(np.random.PCG64(13))
    out = np.zeros((SLOTS + 1, singular.shape[1] + SKETCH), np.float16)
    out[:SLOTS, : singular.shape[1]] = singular * idf[:, None]
    for a in range(singular.shape[1], out.shape[1], 64):  # some columns at a time: the table is large
        rest = rng.integers(0, 2, (SLOTS, min(64, out.shape[1] - a)), np.int8).astype(np.float32)
        rest = (rest * 2 - 1) / np.float32(np.sqrt(SKETCH))
        rest -= singular @ (singular.T @ rest)
        out[:SLOTS, a : a + 64] = rest * idf[:, None]
    return out


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]
    blocks: int


@dataclass
class Index:
    """What a task needs to search: a block of items, and the products of every
    slot's vector with theirs."""

    table: InitVar[np.ndarray]  # SLOTS + 1 rows, the last of zeros
    items: list[Item]

    def __post_init__(self, table):
        self.masks = []
        for item in self.items:
            masks: dict[int, int] = {}
            for k, w in enumerate(item.words):
                masks[w] = masks.get(w, 0) | 1 << k
            self.masks.append(masks)
        sizes = np.array([len(x.words) for x in self.items], np.int64)
        #: Blocks of an item's region: its words and SPARE more lie in one, wherever they begin.
        self.span = -(-(sizes + SPARE + BLOCK - 1) // BLOCK)
        #: Units of a passage: every region that begins in the first lies in it.
        self.units = -(-(self.span + UNIT - 1) // UNIT)
        #: Shared words without which a region cannot be a copy, or a paraphrase.
        self.copy, self.paraphrase = (np.ceil(x * sizes - 1e-9).astype(np.int64) for x in (LEAST_COPY, LEAST_PARAPHRASE))
        #: Every item's slots, and how often each is there.
        self.own = [np.unique(_slots(np.array(x.words, np.uint64)), return_counts=True) for x in self.items]
        #: Square of every slot's length; every item's length, step and least products with its leaks.
        self.squares = np.concatenate([np.einsum("ij,ij->i", x, x) for x in _parts(table)]).astype(np.float64)
        self.length, self.step, self.least_copy, self.least_paraphrase = (np.zeros(len(self.items)) for _ in range(4))
        self.columns = max(1, table.shape[1] - DIMS)
        order = np.argsort(self.units, kind="stable")
        # short items are their own answers: no passages are searched for them
        parts = [x[at : at + GROUP] for x in (order[sizes[order] >= LEAST_WORDS], order[sizes[order] < LEAST_WORDS]) for at in range(0, len(x), GROUP)]
        self.groups = []
        for some in parts:
            vectors = np.zeros((len(some), table.shape[1]), np.float32)
            for k, i in enumerate(some):
                own = _slots(np.array(self.items[i].words, np.uint64))
                vectors[k] = table[own].sum(axis=0, dtype=np.float32)
                lightest = np.append(0, np.cumsum(np.sort(self.squares[own])))
                self.least_copy[i], self.least_paraphrase[i] = lightest[self.copy[i]], lightest[self.paraphrase[i] if len(own) >= LEAST_WORDS else len(own)]
            product = np.concatenate([x @ vectors.T for x in _parts(table)])
            self.length[some] = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            step = np.maximum(np.abs(product).max(axis=0), 1e-9) / LEVELS
            self.step[some] = step
            self.groups.append((some, np.rint(product / step).astype(np.int8)))
        self.place = {int(i): (g, k) for g, (some, _) in enumerate(self.groups) for k, i in enumerate(some)}
        self.phrases: dict[int, dict[int, list[int]]] = {}
        for i, item in enumerate(self.items):
            head = np.array(item.answer[:HEAD], np.uint64)
            self.phrases.setdefault(len(head), {}).setdefault(int(_heads(head, len(head))[0]), []).append(i)

    def common_length(self, i: int, region: np.ndarray) -> int:
        """Longest common subsequence of item i and the words, bit by bit."""
        masks, n = self.masks[i], len(self.items[i].words)
        s = full = (1 << n) - 1
        for w in region.tolist():
            u = s & masks.get(w, 0)
            if u:
                s = ((s + u) | (s - u)) & full
        return n - s.bit_count()

    def answers(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(place, item) of every item's answer in the words."""
        out, h = [], words
        for k in range(1, max(self.phrases, default=0) + 1):
            if k > len(words):
                break
            h = words if k == 1 else _next_heads(h, words, k)
            if k not in self.phrases:
                continue
            known = self.phrases[k]
            keys = np.array(list(known), np.uint64)
            low = np.zeros(1 << 16, bool)
            low[keys >> np.uint64(48)] = True
            at = np.flatnonzero(low[h >> np.uint64(48)])
            at = at[np.isin(h[at], keys)]
            out += [(p, i) for p in at.tolist() for i in known[int(h[p])] if words[p : p + len(self.items[i].answer)].tolist() == self.items[i].answer]
        return out

    def search(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int, float, float, bool]]:
        """(text, item, cosine, share in order, answered) of every leak."""
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        overlap = max([int(x) for x in self.span], default=0) * BLOCK
        most = max(SEGMENT // BLOCK * BLOCK, 4 * overlap)  # every region lies whole in a segment
        segments = [(d, a, min(a + most, first[d + 1])) for d in range(len(first) - 1) for a in range(first[d], max(first[d] + 1, first[d + 1] - (overlap if first[d + 1] - first[d] > most else 0)), most - overlap) if first[d + 1] > first[d]]
        group, size = [], 0
        for seg in [*segments, None]:
            if seg is None or size + seg[2] - seg[1] > most:
                if group:
                    self._search(h, group, best)
                group, size = [], 0
            if seg is not None:
                group.append(seg)
                size += seg[2] - seg[1]
        return [(d, i, *v) for (d, i), v in best.items()]

    def _search(self, h, segments, best):
        n = np.array([b - a for _, a, b in segments])
        at = np.append(0, np.cumsum(-(-n // (BLOCK * UNIT)) * UNIT))
        inside = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n))[:-1], n)
        slots = np.full(at[-1] * BLOCK, SLOTS, np.int64)
        slots[np.repeat(at[:-1] * BLOCK, n) + inside] = _slots(h[np.repeat([a for _, a, _ in segments], n) + inside])
        # the regions worth a look, by segment and item: start block -> most words shared
        copies: dict[tuple[int, int], dict[int, int]] = {}
        for items, member in self.groups:
            near = list(self._near(slots, items, member)) if len(self.items[items[0]].words) >= LEAST_WORDS else []
            if near:
                p, q, shared = self._shared(slots.reshape(-1, BLOCK), *map(np.concatenate, zip(*near)))
                for seg, start, i, c in zip((np.searchsorted(at, p, side="right") - 1).tolist(), p.tolist(), q.tolist(), shared.tolist()):
                    copies.setdefault((seg, i), {})[start - int(at[seg])] = c
        answered: dict[tuple[int, int], dict[int, int]] = {}
        begins = np.append(0, np.cumsum(n))
        for p, i in self.answers(np.concatenate([h[a:b] for _, a, b in segments])):
            seg = int(np.searchsorted(begins, p, side="right")) - 1
            _, a, b = segments[seg]
            p -= int(begins[seg])
            if p + len(self.items[i].answer) <= b - a:
                # every region with this answer, and its shared words
                last = p // BLOCK
                low = max(0, -(-(p + len(self.items[i].answer)) // BLOCK) - int(self.span[i]))
                part = np.isin(h[a + low * BLOCK : min(b, a + (last + int(self.span[i])) * BLOCK)], np.array(self.items[i].words, np.uint64))
                sums = np.append(0, np.cumsum(part))
                start = np.arange(low, last + 1)
                shared = sums[np.minimum((start - low + self.span[i]) * BLOCK, len(part))] - sums[(start - low) * BLOCK]
                start, shared = start[shared >= self.paraphrase[i]], shared[shared >= self.paraphrase[i]]
                enough = self._reached(slots, start + at[seg], i, self.least_paraphrase[i])
                answered.setdefault((seg, i), {}).update(zip(start[enough].tolist(), shared[enough].tolist()))
        for key in {**answered, **copies}:
            (d, a, b), i = segments[key[0]], key[1]
            size = len(self.items[i].words)
            share, begin = 0.0, 0
            for regions, least in ((answered.get(key, {}), LEAST_PARAPHRASE), (copies.get(key, {}), LEAST_COPY)):
                for start, c in sorted(regions.items(), key=lambda x: (-x[1], x[0])):
                    if min(c, size) / size <= share:
                        break  # the words shared bound the words in order
                    lo = a + start * BLOCK
                    x = self.common_length(i, h[lo : min(b, lo + int(self.span[i]) * BLOCK)]) / size
                    if x >= least and x > share:
                        share, begin = x, lo
                if least == LEAST_PARAPHRASE:
                    full = share > 0
            if share:
                old = best.get((d, i), (0.0, 0.0, False))
                if share > old[1]:
                    old = (self.cosine(i, h[begin : min(b, begin + int(self.span[i]) * BLOCK)]), share, old[2])
                best[d, i] = (*old[:2], old[2] or full)

    def floor(self, items, least, squares, words: int):
        """The product with the items (greater than 0) that regions of so many
        words and this sum of squares need, if their leaks have the least."""
        noise = np.sqrt(self.length[items] ** 2 * squares / self.columns + self.step[items] ** 2 * words / 12)
        return np.maximum(least - NOISE * noise, self.step[items] / 2)

    def _reached(self, slots: np.ndarray, p: np.ndarray, i: int, least: float) -> np.ndarray:
        """Whether the cosine of each region (by its start block) and item i reaches the floor."""
        group, column = self.place[i]
        words, begin = int(self.span[i]) * BLOCK, p * BLOCK
        out = np.zeros(len(p), bool)
        most = max(1, SEGMENT // words)
        for lo in range(0, len(p), most):
            at = begin[lo : lo + most, None] + np.arange(words)
            there = np.where(at < len(slots), slots[np.minimum(at, len(slots) - 1)], SLOTS)
            product = self.groups[group][1][there, column].sum(axis=1, dtype=np.int64) * self.step[i]
            out[lo : lo + most] = product >= self.floor(i, least, self.squares[there].sum(axis=1), words)
        return out

    def _near(self, slots, items, member):
        """(start blocks, items) of the regions whose cosine with an item of the
        group is enough for a copy. One may run on into the next text here."""
        slots = slots.reshape(-1, BLOCK * UNIT)
        reach, words = int(self.units[items[-1]]), BLOCK * UNIT
        step = max(SLICE, 3 * reach)
        kind = np.int16 if reach * words * LEVELS < 1 << 15 else np.int32
        edge = np.flatnonzero(np.append(True, np.diff(self.units[items]) > 0))
        for lo in range(0, len(slots), step):
            part = slots[lo : lo + step + reach]
            starts = min(step, len(slots) - lo)
            sums = np.zeros((len(part) + 1 + reach, len(items)), kind)
            for k in range(0, words, 4):
                four = member[part[:, k]]
                for j in range(1, 4):
                    four += member[part[:, k + j]]
                sums[1 : len(part) + 1] += four
            np.cumsum(sums, axis=0, dtype=kind, out=sums)
            squares = np.zeros(len(part) + 1 + reach)
            squares[1 : len(part) + 1] = self.squares[part].sum(axis=1)
            squares = np.cumsum(squares)
            for a, b in zip(edge, np.append(edge[1:], len(items))):
                span, some = int(self.units[items[a]]), items[a:b]
                size = squares[span : span + starts] - squares[:starts]
                product = sums[span : span + starts, a:b] - sums[:starts, a:b]
                # what the heaviest passage here needs, then what each does
                least = np.ceil(self.floor(some, self.least_copy[some], size.max(), span * words) / self.step[some])
                near = product >= least.clip(max=np.iinfo(kind).max).astype(kind)
                p = np.flatnonzero(near.any(axis=1))
                k, q = np.nonzero(near[p])
                p = p[k]
                enough = product[p, q] * self.step[some[q]] >= self.floor(some[q], self.least_copy[some[q]], size[p], span * words)
                p, q = p[enough], q[enough]
                most = max(1, SEGMENT // (span * words))
                for x in range(0, len(p), most):
                    yield from self._begin(slots, member[:, a:b], some, p[x : x + most] + lo, q[x : x + most], span * words)

    def _begin(self, slots, member, items, p, q, words):
        """The regions (start blocks, items) of the passages (units, places in
        the items) whose cosine is enough for a copy."""
        at = p[:, None] * BLOCK * UNIT + np.arange(words)
        there = np.where(at < slots.size, slots.ravel()[np.minimum(at, slots.size - 1)], SLOTS)
        products, squares = np.zeros((len(p), words // BLOCK + 1), np.int64), np.zeros((len(p), words // BLOCK + 1))
        np.cumsum(member[there, q[:, None]].reshape(len(p), -1, BLOCK).sum(axis=2, dtype=np.int64), axis=1, out=products[:, 1:])
        np.cumsum(self.squares[there].reshape(len(p), -1, BLOCK).sum(axis=2), axis=1, out=squares[:, 1:])
        own, rows = items[q], np.arange(len(p))
        for k in range(UNIT):
            end = k + self.span[own]
            product = (products[rows, end] - products[:, k]) * self.step[own]
            enough = product >= self.floor(own, self.least_copy[own], squares[rows, end] - squares[:, k], self.span[own] * BLOCK)
            if enough.any():
                yield p[enough] * UNIT + k, own[enough]

    def _shared(self, slots, p, q):
        """Those of the regions (start block, item) that have enough of the
        item's words for a copy when none counts more often than in the item;
        and that count."""
        order = np.argsort(q, kind="stable")
        p, q = p[order], q[order]
        total = np.zeros(len(p), np.int64)
        local = np.zeros(SLOTS + 1, np.int64)
        edge = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        for a, b in zip(edge, np.append(edge[1:], len(q))):
            i = int(q[a])
            own, times = self.own[i]
            local[own] = np.arange(1, len(own) + 1)
            span, size = int(self.span[i]), len(own) + 1
            most = max(1, SEGMENT // (span * BLOCK))
            for lo in range(a, b, most):
                rows = p[lo : min(b, lo + most)]
                block = rows[:, None] + np.arange(span)
                there = np.where((block < len(slots))[:, :, None], local[slots[np.minimum(block, len(slots) - 1)]], 0).reshape(len(rows), -1)
                count = np.bincount((there + np.arange(len(rows))[:, None] * size).ravel(), minlength=len(rows) * size).reshape(len(rows), size)
                total[lo : lo + len(rows)] = np.minimum(count[:, 1:], times).sum(axis=1)
            local[own] = 0
        enough = total >= self.copy[q]
        return p[enough], q[enough], total[enough]

    def cosine(self, i: int, region: np.ndarray) -> float:
        """The best cosine of item i and a window of about its length in the region."""
        group, column = self.place[i]
        slots = _slots(region)
        size = min(self.items[i].blocks * BLOCK, len(region))
        products = np.append(0, np.cumsum(self.groups[group][1][slots, column], dtype=np.int64))
        product = (products[size:] - products[: len(products) - size]) * self.step[i]
        # words of a window that occur again in it count as often as they meet
        own, number = np.unique(slots, return_inverse=True)
        counts = np.zeros((len(product), len(own)), np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(number, size) if size else np.zeros((len(product), 0), np.int64)
        np.add.at(counts, (np.repeat(np.arange(len(product)), size), windows.ravel()), 1)
        lengths = np.sqrt(counts**2 @ self.squares[own])
        return float(np.clip(np.max(product / np.maximum(self.length[i] * lengths, 1e-9)), -1, 1))


def _parts(table: np.ndarray) -> Iterator[np.ndarray]:
    """The rows in single precision, some at a time."""
    for a in range(0, len(table), SLICE):
        yield table[a : a + SLICE].astype(np.float32)


def _next_heads(h: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, from those of k - 1."""
    return common.mix(h[: len(words) - k + 1] * np.uint64(0xD1342543DE82EF95) + words[k - 1 :])


def _heads(words: np.ndarray, k: int) -> np.ndarray:
    h = words
    for j in range(2, k + 1):
        h = _next_heads(h, words, j)
    return h


def item_of(item_id: int, text: str) -> Item | None:
    h, _ = text_words(pa.array([text]))
    if not len(h):
        return None
    if len(h) < LEAST_WORDS:
        return Item(item_id, [int(x) for x in h], [int(x) for x in h], 2)
    head, mark, tail = text.rpartition("?")
    after = text_words(pa.array([tail]))[0] if mark and head else h[:0]
    answer = after if 0 < len(after) < len(h) else h[-ANSWER_WORDS:]
    blocks = max(2, 2 * round(len(h) / (2 * BLOCK)))
    return Item(item_id, [int(x) for x in h], [int(x) for x in answer], blocks)


def indexes(docs: DataFrame, benchmark: DataFrame) -> list[Index]:
    """One index for every ``ITEMS`` items, with the word vectors of the corpus."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")
    blocks = max(1, -(-items.count() // ITEMS))
    texts = hashed(docs)
    df, passages = frequencies(texts)
    if not passages:
        return []
    idf = weights(df, passages)
    table = word_vectors(singular_vectors(texts, idf), idf)
    out = []
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        found = [x for x in (item_of(r[0], r[1]) for r in some) if x is not None]
        if found:
            out.append(Index(table, found))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, share (of the item's words, in order), answered."""
    schema = "doc_id long, item_id long, cosine double, share double, answered boolean"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(docs, benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, most=PART_BYTES):
                found = index.search(*text_words(batch.column(1)))
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], index.items[i].item_id, c, s, a) for d, i, c, s, a in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()))], schema.replace(",", "").split()[::2])

        out = out.union(texts_of(docs).mapInArrow(run, schema))
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("share").alias("share"), F.max("answered").alias("answered"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, whose text leaks no item."""
    t = docs.columns.index("text")
    found, out = indexes(docs, benchmark), docs
    for index in found:

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, most=PART_BYTES):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, *_ in index.search(*text_words(batch.column(t)))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
