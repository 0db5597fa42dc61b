"""Substring dedup behind a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document; words covered by a
window that also starts in a document with a smaller id are removed (windows
are judged on the input). Two passes find the repeated windows:

1. Each block of documents makes a count-min sketch of its windows, ``DEPTH``
   rows of counters, a window counting once a document. The blocks' sketches
   are merged by shards of counters. A sum never falls short of the count, so
   a window with a counter under two is not repeated; no repeated one is lost.
2. Only windows whose counters all reach two are grouped exactly, by a 96-bit
   hash, with the smallest document id of each.

At scale: counters number ``WIDTH`` times the windows, so the share of false
alarms is the same at any size, and neither sketch nor windows ever meet in one
place. A block sends each shard its touched counters (ascending, as differences
of a few bits) and gets a bit for each; then it sends the suspected windows,
one row of bytes a shard, each window once a block with its least id, so a
passage that a third of all documents share arrives once a block. The text is
dealt to blocks by one exchange, which the three passes over it share.

Null text: no words. Null ids come after all others, and repeat nothing among
themselves. Ties: of the documents that hold a window the smallest id keeps it,
rows of one id are one document. Repeated rows have one id, so they repeat
nothing. Documents of fewer words than a window stay whole; very long texts are
read whole, in a block of their own if need be. An empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.codes import pack, shard_of, steps, unpack, unzigzag, zigzag
from kestrel.llm.common import Words, mix, read, texts_of, words

WINDOW = 13
DEPTH = 2
#: Counters of a sketch row for each window of the input, at least.
WIDTH = 4
#: Bytes of text in a block, about.
BLOCK_BYTES = 8 * 1024 * 1024
LAST = 2**63 - 1


class Windows:
    """The windows of a block of texts."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").combine_chunks()
        self.ids = ids
        self.key = np.asarray(ids.fill_null(LAST), np.int64)
        self.words: Words = words(table.column("text").combine_chunks())
        self.h = np.append(self.words.hashes(), np.zeros(WINDOW, np.uint64))
        count = np.maximum(self.words.counts - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.begin = np.repeat(self.words.first[:-1] - np.append(0, np.cumsum(count))[:-1], count) + np.arange(count.sum())
        self.one = self.hash(self.begin, 0xD1342543DE82EF95)

    def hash(self, begin: np.ndarray, factor: int) -> np.ndarray:
        out = np.zeros(len(begin), np.uint64)
        for i in range(WINDOW):
            out *= np.uint64(factor)
            out += self.h[begin + i]
            out ^= out >> np.uint64(29)
        return mix(out)

    def two(self, which: np.ndarray) -> np.ndarray:
        return (self.hash(self.begin[which], 0xAF251AF3B0F025B5) >> np.uint64(32)).astype(np.uint32)

    def counters(self, row: int, bits: int) -> np.ndarray:
        return (self.one if row == 0 else mix(self.one ^ np.uint64(0x9E3779B97F4A7C15 * row % 2**64))) >> np.uint64(64 - bits)


def once_a_document(w: Windows) -> np.ndarray:
    """Index of each window's first place in its document."""
    key = mix(w.one ^ mix(w.key[w.doc].view(np.uint64)))
    order = np.argsort(key, kind="stable")
    first = np.append(True, key[order][1:] != key[order][:-1])[: len(order)]
    return order[first]


def touched(w: Windows, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters a block touches, ascending, and whether twice or more."""
    c = np.sort(w.counters(row, bits)[w.once])
    first = np.append(True, c[1:] != c[:-1])[: len(c)]
    at = np.flatnonzero(first)
    return c[at], np.diff(np.append(at, len(c))) > 1


def removed_words(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space."""
    spark = docs.sparkSession
    rows = texts_of(docs)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    bits = max(10, int(np.ceil(np.log2(max(1, size // 4) * WIDTH))))
    shards = blocks
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(blocks)).cast("int"))

    def block_windows(table: pa.Table) -> Windows:
        w = Windows(table)
        w.once = once_a_document(w)
        return w

    def sketch(table: pa.Table) -> pa.Table:
        w, out = block_windows(table), {"block": [], "row": [], "shard": [], "counters": []}
        for row in range(DEPTH):
            cell, twice = touched(w, row, bits)
            shard = shard_of(cell, bits, shards)
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
            for a, b in zip(cut, [*cut[1:], len(cell)]):
                out["block"].append(table.column("block")[0].as_py())
                out["row"].append(row)
                out["shard"].append(int(shard[a]))
                out["counters"].append(pack(steps(cell[a:b]) << np.uint64(1) | twice[a:b].astype(np.uint64)))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))})

    def merge(table: pa.Table) -> pa.Table:
        read_ = [unpack(x.as_py()) for x in table.column("counters")]
        cells = [np.cumsum(x >> np.uint64(1), dtype=np.uint64) for x in read_]
        everything = np.concatenate([*cells, *(c[(x & np.uint64(1)).astype(bool)] for c, x in zip(cells, read_))])
        everything.sort()
        again = np.unique(everything[1:][everything[1:] == everything[:-1]])
        answer = [np.packbits(_among(c, again)).tobytes() for c in cells]
        return pa.table({"block": table.column("block"), "row": table.column("row"), "shard": table.column("shard"), "repeated": pa.array(answer, pa.binary())})

    def suspects(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"block": [], "shard": [], "windows": []}
        if texts.num_rows and answers.num_rows:
            w = block_windows(texts)
            possible = np.ones(len(w.once), bool)
            answers = answers.sort_by([("row", "ascending"), ("shard", "ascending")])
            rows_, bits_ = np.asarray(answers.column("row")), answers.column("repeated").to_pylist()
            for row in range(DEPTH):
                cell, _ = touched(w, row, bits)
                shard = shard_of(cell, bits, shards)
                cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
                n = np.diff(np.append(cut, len(cell)))
                said = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip((bits_[i] for i in np.flatnonzero(rows_ == row)), n, strict=True)])
                own = np.flatnonzero(possible)
                possible[own] = said[np.searchsorted(cell, w.counters(row, bits)[w.once[own]])].astype(bool)
            which = w.once[possible]
            one, two, doc = w.one[which], w.two(which), w.key[w.doc[which]]
            order = np.lexsort((doc, two, one))
            one, two, doc = one[order], two[order], doc[order]
            first = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
            at = np.flatnonzero(first)
            several = (np.diff(np.append(at, len(one))) > 1).astype(np.uint64)
            one, two, doc = one[at], two[at], doc[at]
            shard = shard_of(one, 64, shards)
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
            for a, b in zip(cut, [*cut[1:], len(one)]):
                out["block"].append(texts.column("block")[0].as_py())
                out["shard"].append(int(shard[a]))
                out["windows"].append(_write(one[a:b], two[a:b], doc[a:b], several[a:b]))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int32(), pa.binary()))})

    def exact(table: pa.Table) -> pa.Table:
        parts = [_read(x.as_py()) for x in table.column("windows")]
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        one, two, doc, several = (np.concatenate([p[i] for p in parts]) for i in range(4))
        order = np.lexsort((doc, two, one))
        o, t = one[order], two[order]
        first = np.append(True, (o[1:] != o[:-1]) | (t[1:] != t[:-1]))
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(o)))
        again = (n > 1) | (np.maximum.reduceat(several[order], at) > 0)
        least = np.empty(len(o), np.int64)
        least[order] = np.repeat(doc[order][at], n)
        keep = np.empty(len(o), bool)
        keep[order] = np.repeat(again, n)
        answers = []
        for i in range(len(parts)):
            own = np.flatnonzero((source == i) & keep) if len(parts) < 8 else None
            if own is None:
                a, b = np.searchsorted(source, [i, i + 1])
                own = a + np.flatnonzero(keep[a:b])
            answers.append(_write(one[own], two[own], least[own], np.zeros(len(own), np.uint64)) if len(own) else None)
        return pa.table({"block": table.column("block"), "shard": table.column("shard"), "windows": pa.array(answers, pa.binary())})

    def cut_words(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        w = Windows(texts)
        answers = answers.sort_by("shard") if answers.num_rows else answers
        parts = [_read(x.as_py()) for x in answers.column("windows") if x.is_valid] if answers.num_rows else []
        gone = np.zeros(len(w.words.start) + 1, np.int32)
        if parts:
            one, two, least = (np.concatenate([p[i] for p in parts]) for i in range(3))
            maybe = np.zeros(1 << 22, bool)
            maybe[one >> np.uint64(42)] = True
            which = np.flatnonzero(maybe[w.one >> np.uint64(42)])
            second = w.two(which)
            at = np.searchsorted(one, w.one[which])
            hit = np.zeros(len(which), bool)
            for _ in range(4):  # windows of one 64-bit hash lie side by side
                inside = np.minimum(at, len(one) - 1)
                same = (at < len(one)) & (one[inside] == w.one[which])
                hit |= same & (two[inside] == second) & (least[inside] < w.key[w.doc[which]])
                at = at + 1
            start = w.begin[which[hit]]
            np.add.at(gone, start, 1)
            np.add.at(gone, start + WINDOW, -1)
        lost = np.cumsum(gone[:-1]) > 0
        n = np.diff(np.append(0, np.cumsum(lost))[w.words.first])
        kept = []
        for i in range(texts.num_rows):
            own = w.words.strings(i)
            if n[i]:
                a, b = w.words.first[i], w.words.first[i + 1]
                own = [x for x, out in zip(own, lost[a:b].tolist()) if not out]
            kept.append(b" ".join(own))
        return pa.table({"doc_id": w.ids, "n_words": pa.array(w.words.counts.astype(np.int64)), "n_removed": pa.array(n.astype(np.int64)), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})

    text_blocks = lambda: dealt.groupBy("block")
    sketches = text_blocks().applyInArrow(sketch, "block int, row int, shard int, counters binary")
    answers = sketches.groupBy("row", "shard").applyInArrow(merge, "block int, row int, shard int, repeated binary")
    found = text_blocks().cogroup(answers.groupBy("block")).applyInArrow(suspects, "block int, shard int, windows binary")
    grouped = found.groupBy("shard").applyInArrow(exact, "block int, shard int, windows binary")
    return text_blocks().cogroup(grouped.groupBy("block")).applyInArrow(cut_words, "doc_id long, n_words long, n_removed long, kept_text string")


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return ascending[at] == values


def _write(one: np.ndarray, two: np.ndarray, doc: np.ndarray, several: np.ndarray) -> bytes:
    parts = [pack(steps(one)), two.astype("<u4").tobytes(), pack(zigzag(doc)), np.packbits(several.astype(np.uint8)).tobytes()]
    return np.array([len(one), len(parts[0]), len(parts[2])], "<u4").tobytes() + b"".join(parts)


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, a, c = (int(x) for x in np.frombuffer(data[:12], "<u4"))
    b = 12 + a + 4 * n
    several = np.unpackbits(np.frombuffer(data[b + c :], np.uint8), count=n)
    return np.cumsum(unpack(data[12 : 12 + a]), dtype=np.uint64), np.frombuffer(data[12 + a : b], "<u4"), unzigzag(unpack(data[b : b + c])), several


def op4_sketch_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = removed_words(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT k, doc_id, unnest(list_transform(range(1, len(w) - 11), lambda p: array_to_string(w[p:p + 12], ' '))) AS piece,
         unnest(range(1, len(w) - 11)) AS p
  FROM d WHERE len(w) >= 13),
least AS (SELECT piece, min(doc_id) AS low FROM s GROUP BY piece),
gone AS (SELECT DISTINCT k, unnest(range(p, p + 13)) AS i FROM s JOIN least USING (piece) WHERE low < doc_id),
word AS (SELECT k, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT k, string_agg(word, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (k, i) GROUP BY k),
cut AS (SELECT k, count(*) AS n FROM gone GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (k) LEFT JOIN cut USING (k)
"""
