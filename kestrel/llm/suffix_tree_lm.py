"""LM scoring by a probabilistic suffix tree over words.

A text's tokens are its lower-cased words and one end. The root holds the
unigram distribution (c + 1) / (N + V + 1). A context of one or more preceding
words is kept in the tree if its next-word distribution diverges from that of
its suffix: the gain of predicting each of its tokens from the others of the
context (leave-one-out, in nats) must reach ``GAIN``; only contexts seen
``LEAST`` times whose suffix and prefix are kept are tested, to ``DEPTH``
words. A kept context s gives (c(s, x) + MASS * P(x | suffix)) / (c(s) + MASS).
Each token is scored from its longest context in the tree.

At scale: nothing of the model is collected or broadcast; what is gathered
grows with the corpus. A block of documents sends each shard the distinct words
(then contexts and next words) it holds with its counts, and gets the totals
and the verdicts back; the text is dealt to blocks by one exchange that all
passes share. A context with more than ``SPLIT`` occurrences is spread over
several shards by its next words, whose partial gains go to all blocks.

Null text: empty, so the end alone. Null ids: training, as crc32 has no value.
Very long texts are read and scored whole. Ties: a context at ``GAIN`` or
``LEAST`` is kept. Repeated rows count as often as they come and get one row
each. An empty table gives an empty result; without training documents every
word is unknown; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.codes import pack, shard_of, steps, unpack
from kestrel.llm.common import mix, read, words

DEPTH = 2
LEAST = 8
GAIN = 2.0
MASS = 8.0
SPLIT = 1 << 18
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 * 1024 * 1024
#: Blocks for each shard. Messages are blocks times shards, whatever the session's partitions.
SHARD_BLOCKS = 2
END = np.uint64(0x243F6A8885A308D3)
MESSAGE = "block int, level int, shard int, body binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def bundle(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor().compress(np.array([len(parts), *map(len, parts)], "<u4").tobytes() + b"".join(parts))


def unbundle(data: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data[:4], "<u4")[0])
    at = 4 + 4 * n + np.append(0, np.cumsum(np.frombuffer(data[4 : 4 + 4 * n], "<u4").astype(np.int64)))
    return [data[a:b] for a, b in zip(at, at[1:])]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.flatnonzero(np.append(True, change))


def _spread(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(starts, n)))


def _byte_of(p: np.ndarray) -> np.ndarray:
    """A probability as a byte: quarter bits."""
    return np.clip(np.rint(-4 * np.log2(p)), 0, 255).astype(np.uint8)


def _of_byte(b: np.ndarray) -> np.ndarray:
    return np.exp2(-b.astype(float) / 4)


class Block:
    """The tokens of a block of documents, and what is known of each so far."""

    def __init__(self, table: pa.Table):
        self.table = table
        w = words(table.column("text").combine_chunks(), lower=True)
        n = w.counts + 1
        self.first = np.append(0, np.cumsum(n))
        self.h = np.insert(w.hashes(), w.first[1:], END)
        self.place = np.arange(len(self.h)) - np.repeat(self.first[:-1], n)
        self.train = np.repeat(~np.asarray(table.column("held_out").combine_chunks().fill_null(False)), n)
        order = np.argsort(self.h, kind="stable")
        at = _starts(self.h[order])
        self.vocab = self.h[order][at]
        self.word = np.empty(len(self.h), np.int64)
        self.word[order] = _spread(np.arange(len(at)), at, len(order))
        self.known: list[tuple[np.ndarray, np.ndarray]] = []

    # the root

    def ask_words(self, shards: int) -> list[tuple[int, bytes]]:
        counts = np.bincount(self.word, weights=self.train, minlength=len(self.vocab)).astype(np.uint64)
        shard = shard_of(self.vocab, 64, shards)
        cut = _starts(shard)
        return [(int(shard[a]), bundle(pack(steps(self.vocab[a:b])), pack(counts[a:b]))) for a, b in zip(cut, [*cut[1:], len(shard)])]

    def hear_words(self, answers: list[tuple[int, bytes]], shards: int) -> None:
        """Every shard says its tokens and distinct words, and the counts and
        ranks of what was asked: rank and shard number a word everywhere alike."""
        parts = [unbundle(a) for _, a in answers]
        ranks = [np.cumsum(unpack(p[2]), dtype=np.uint64) * np.uint64(shards) + np.uint64(s) for (s, _), p in zip(answers, parts)]
        self.number = np.concatenate(ranks)[self.word] if parts else np.zeros(0, np.uint64)
        totals = [unpack(p[0]) for p in parts]
        self.n, self.v = (int(sum(int(t[i]) for t in totals)) for i in (0, 1))
        counts = np.concatenate([unpack(p[1]) for p in parts]) if parts else np.zeros(0, np.uint64)
        self.count = counts.astype(np.int64)[self.word]
        self.base = (self.count + 1) / (self.n + self.v + 1)
        self.p = self.base.copy()
        # occurrences of the context that ends before each token; whether it is kept
        self.context_count = np.where(self.place > 0, np.append(0, self.count[:-1]), 0)
        self.kept = np.ones(len(self.h), bool)
        self.context = np.append(np.uint64(0), mix(self.h[:-1] + np.uint64(1)))

    # contexts of ``level`` words

    def entries(self, level: int, shards: int, split: int):
        """Tokens whose context is tested at this level, in the order of
        (shard, context, part, next word), with where equal ones begin."""
        own = np.flatnonzero((self.place >= level) & (self.context_count >= LEAST) & self.kept)
        s, word = self.context[own], self.number[own]
        parts = -(-self.context_count[own] // split)
        part = ((mix(word + np.uint64(1)) >> np.uint64(32)) * parts.astype(np.uint64)) >> np.uint64(32)
        shard = shard_of(mix(s + part * np.uint64(0xD1342543DE82EF95)), 64, shards)
        # one sort: contexts numbered in the order of (shard, context, part)
        run = np.lexsort((part, s, shard))
        at = _starts(shard[run], s[run], part[run])
        number = np.empty(len(own), np.uint64)
        number[run] = _spread(np.arange(len(at), dtype=np.uint64), at, len(run))
        bits = int(word.max(initial=np.uint64(0))).bit_length()
        if len(at) < 2 ** (64 - bits):
            order = np.argsort(number << np.uint64(bits) | word, kind="stable")
        else:
            order = np.lexsort((word, number))
        return own[order], shard[order], s[order], part[order], word[order], number[order]

    def ask_contexts(self, level: int, shards: int, split: int) -> list[tuple[int, bytes]]:
        own, shard, s, part, word, number = self.entries(level, shards, split)
        at = _starts(number, word)
        counts = np.add.reduceat(self.train[own].astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)
        own, shard, s, part, word, number = (x[at] for x in (own, shard, s, part, word, number))
        delta = steps(word)
        head = _starts(number)
        delta[head] = word[head]
        size = np.diff(np.append(head, len(number))).astype(np.uint64)
        cut = _starts(shard)
        out = []
        for a, b in zip(cut, [*cut[1:], len(shard)]):
            lo, hi = np.searchsorted(head, [a, b])
            runs = head[lo:hi]
            out.append((int(shard[a]), bundle(
                s[runs].tobytes(), pack(part[runs]), pack(self.context_count[own[runs]].astype(np.uint64)), pack(size[lo:hi]),
                pack(delta[a:b]), pack(counts[a:b]), _byte_of(self.p[own[a:b]]).tobytes(),
            )))
        return out

    def hear_contexts(self, level: int, shards: int, split: int, answers: list[bytes], shared: list[bytes]) -> None:
        own, shard, s, part, word, number = self.entries(level, shards, split)
        at = _starts(number, word)
        head = _starts(number[at])
        said = [unbundle(a) for a in answers]
        verdict = np.concatenate([np.frombuffer(x[0], np.uint8) for x in said]) if said else np.zeros(0, np.uint8)
        counts = np.concatenate([unpack(x[1]) for x in said]).astype(np.int64) if said else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(at)))
        listed = np.repeat(verdict > 0, size)
        pair = np.zeros(len(at), np.int64)
        pair[listed] = counts
        keep = verdict == 1
        if (verdict == 2).any():
            gains: dict[int, float] = {}
            for x in shared:
                names, parts = unbundle(x)
                for name, gain in zip(np.frombuffer(names, np.uint64).tolist(), np.frombuffer(parts, np.float64).tolist()):
                    gains[name] = gains.get(name, 0.0) + gain
            heads = own[at[head]]
            for i in np.flatnonzero(verdict == 2):
                n = float(self.context_count[heads[i]])
                keep[i] = gains[int(self.context[heads[i]])] - n * np.log(n - 1 + MASS) >= GAIN
        keep = _spread(np.repeat(keep, size), at, len(own))
        pair = _spread(pair, at, len(own))
        hit = own[keep]
        self.p[hit] = (pair[keep] + MASS * self.p[hit]) / (self.context_count[hit] + MASS)
        kept, count = np.zeros(len(self.h), bool), np.zeros(len(self.h), np.int64)
        kept[hit], count[hit] = True, pair[keep]
        # the context one word longer: its suffix is this token's, its prefix that of the token before
        self.kept = kept & np.append(False, kept[:-1])
        self.context_count = np.append(0, count[:-1])
        self.context = np.append(np.uint64(0), mix(self.context[:-1] * np.uint64(0xAF251AF3B0F025B5) + self.h[:-1]))

    def rows(self) -> pa.Table:
        def sums(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x, self.first[:-1]) if len(self.first) > 1 else x[:0]

        return pa.table({
            "doc_id": self.table.column("doc_id"), "held_out": self.table.column("held_out"), "n_tokens": pa.array(np.diff(self.first)),
            "n_known": pa.array(sums((self.count > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(self.first) - 1, self.n)),
            "base_score": pa.array(sums(np.log10(self.base))), "score": pa.array(sums(np.log10(self.p))),
        })


def merge_words(bodies: list[bytes]) -> tuple[list[bytes], bytes]:
    """Of one shard: the answer to each message (totals, counts, and the words'
    ranks in the shard), and the shard's totals alone."""
    parts = [unbundle(b) for b in bodies]
    names = [np.cumsum(unpack(p[0]), dtype=np.uint64) for p in parts]
    counts = [unpack(p[1]) for p in parts]
    every, source = np.concatenate(names), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    at = _starts(every[order])
    total = np.add.reduceat(source[order], at)
    back = np.empty(len(every), np.uint64)
    back[order] = _spread(total, at, len(every))
    rank = np.empty(len(every), np.uint64)
    rank[order] = _spread(np.arange(len(at), dtype=np.uint64), at, len(every))
    totals = pack(np.array([int(total.sum()), int((total > 0).sum())], np.uint64))
    cut = np.append(0, np.cumsum([len(x) for x in names]))
    return [bundle(totals, pack(back[a:b]), pack(steps(rank[a:b]))) for a, b in zip(cut, cut[1:])], bundle(totals, b"", b"")


def merge_contexts(bodies: list[bytes], split: int) -> tuple[list[bytes], bytes | None]:
    """Of one shard: for each message a verdict a context (0 not kept, 1 kept, 2
    split: see the shared gains) and the counts where not 0; and the partial
    gains of split contexts, for all blocks."""
    parts = [unbundle(b) for b in bodies]
    s = [np.frombuffer(p[0], np.uint64) for p in parts]
    part = [unpack(p[1]) for p in parts]
    n = [unpack(p[2]).astype(np.int64) for p in parts]
    size = [unpack(p[3]).astype(np.int64) for p in parts]
    numbers = []
    for p, z in zip(parts, size):
        delta = unpack(p[4])
        run = np.cumsum(delta, dtype=np.uint64)
        head = np.append(0, np.cumsum(z))[:-1]
        numbers.append(run - np.repeat(run[head] - delta[head], z))
    each = np.concatenate(size)
    all_s, all_part, all_n = np.concatenate(s), np.concatenate(part), np.concatenate(n)
    order = np.lexsort((all_part, all_s))
    at = _starts(all_s[order], all_part[order])
    number = np.empty(len(all_s), np.int64)
    number[order] = _spread(np.arange(len(at)), at, len(order))
    run_s, run_n = all_s[order][at], all_n[order][at]
    entry, word = np.repeat(number, each), np.concatenate(numbers)
    counts = np.concatenate([unpack(p[5]) for p in parts]).astype(np.int64)
    prior = np.concatenate([np.frombuffer(p[6], np.uint8) for p in parts])
    by = np.lexsort((word, entry))
    first = _starts(entry[by], word[by])
    total = np.add.reduceat(counts[by], first)
    p0 = _of_byte(prior[by][first])
    seen = total > 0
    gain = np.zeros(len(first))
    gain[seen] = total[seen] * (np.log(total[seen] - 1 + MASS * p0[seen]) - np.log(p0[seen]))
    gains = np.bincount(entry[by][first], weights=gain, minlength=len(at))
    several = run_n > split
    kept = gains - run_n * np.log(run_n - 1 + MASS) >= GAIN
    verdict = np.where(several, 2, kept.astype(int)).astype(np.uint8)
    back = np.empty(len(entry), np.uint64)
    back[by] = _spread(total.astype(np.uint64), first, len(by))
    listed = verdict[entry] > 0
    answers, e, r = [], 0, 0
    for z in size:
        k = int(z.sum())
        mine = slice(e, e + k)
        answers.append(bundle(verdict[number[r : r + len(z)]].tobytes(), pack(back[mine][listed[mine]])))
        e, r = e + k, r + len(z)
    shared = bundle(run_s[several].tobytes(), gains[several].tobytes()) if several.any() else None
    return answers, shared


def suffix_tree_scores(docs: DataFrame, held_out, depth: int = DEPTH, split: int = SPLIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of
    every text; the model learns from the rows where ``held_out`` (a column of
    the table) is not true."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    shards = -(-blocks // SHARD_BLOCKS)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def table_of(found: list[tuple[int, int, int, bytes]]) -> pa.Table:
        return pa.table({name: pa.array([x[i] for x in found], t) for i, (name, t) in enumerate(zip(("block", "level", "shard", "body"), kinds))})

    def heard(texts: pa.Table, answers: pa.Table, levels: int) -> Block:
        b = Block(texts)
        said: dict[int, list[tuple[int, bytes]]] = {}
        for level, shard, body in zip(*(answers.column(c).to_pylist() for c in ("level", "shard", "body"))):
            said.setdefault(level, []).append((shard, body))
        b.hear_words(sorted(said.get(0, [])), shards)
        for level in range(1, levels + 1):
            shared = [x for _, x in sorted(said.get(-level, []))]
            b.hear_contexts(level, shards, split, [x for _, x in sorted(said.get(level, []))], shared)
        return b

    def first_ask(texts: pa.Table) -> pa.Table:
        block = texts.column("block")[0].as_py()
        return table_of([(block, 0, shard, body) for shard, body in Block(texts).ask_words(shards)])

    def asking(level: int):
        def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
            if not texts.num_rows:
                return table_of([])
            block = texts.column("block")[0].as_py()
            own = heard(texts, answers, level - 1).ask_contexts(level, shards, split)
            # what the block has heard so far travels on to its next pass
            before = [(block, lv, -1 - sh, body) for lv, sh, body in zip(*(answers.column(c).to_pylist() for c in ("level", "shard", "body")))]
            return table_of([*((block, level, shard, body) for shard, body in own), *before])

        return ask

    def merging(level: int):
        def merge(table: pa.Table) -> pa.Table:
            block, lv, shard, body = (table.column(c).to_pylist() for c in ("block", "level", "shard", "body"))
            if shard[0] < 0:
                return table_of([(b, v, -1 - s, x) for b, v, s, x in zip(block, lv, shard, body)])
            if level == 0:
                answers, totals = merge_words(body)
                silent = set(range(blocks)) - set(block)
                more = [(b, 0, shard[0], totals) for b in silent]
            else:
                answers, shared = merge_contexts(body, split)
                more = [(b, -level, shard[0], shared) for b in range(blocks)] if shared else []
            return table_of([*zip(block, lv, shard, answers), *more])

        return merge

    text_blocks = lambda: dealt.groupBy("block")
    # what only travels on is dealt by its block
    to_shard = lambda asked: asked.withColumn("_to", F.when(F.col("shard") >= 0, F.col("shard")).otherwise(-1 - F.col("block"))).groupBy("_to")
    said = to_shard(text_blocks().applyInArrow(first_ask, MESSAGE)).applyInArrow(merging(0), MESSAGE)
    for level in range(1, depth + 1):
        said = to_shard(text_blocks().cogroup(said.groupBy("block")).applyInArrow(asking(level), MESSAGE)).applyInArrow(merging(level), MESSAGE)

    def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        return heard(texts, answers, depth).rows()

    return text_blocks().cogroup(said.groupBy("block")).applyInArrow(finish, OUT)


def op8_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return suffix_tree_scores(documents, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2)
