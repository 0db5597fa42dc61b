"""How far the sources of a language differ in their words.

Terms are counted in two passes. The first finds, exactly, the terms that stand
in enough documents of their language. They are dealt to shards; every shard
gets a minimal perfect hash (levels of bits: a key alone at its bit has its slot
there, the others go to the next level) and its keys in slot order. The shards
are broadcast, as many as ``PASS_BYTES`` allow at a time (a pass over the texts
for each such set), and the second pass looks terms up, compares the stored key
and adds to dense slots per (language, source). Tasks send what is not zero in
their slots; sums, shares and differences are made on dense arrays, the pairs
of sources in blocks. All arithmetic is of whole numbers.

Null text, lang or source is an empty one, and an empty one is a value of its
own. Empty texts hold no term; their group is in the result all the same. Very
long texts are read whole. Repeated rows count as often as they are there; ties
of a value are ranked by the item's UTF-8 bytes. An empty table gives an empty
result; other columns, whatever their names, play no part. Counts may reach
9e15.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.codes import pack, steps, unpack
from kestrel.llm.common import Words, chunks, cut_lineage, fresh, mix, raw, read

#: Terms and bytes of terms of a shard, on average at most.
SHARD_TERMS, SHARD_BYTES = 1 << 14, 1 << 20

#: Bytes of shards broadcast at once; one larger shard goes alone.
PASS_BYTES = 64 << 20

#: Bytes of dense slots a task holds before it sends them.
SLOT_BYTES = 128 << 20

#: A hot group's messages are summed in so many parts first.
SALT = 16

#: Sources of a language compared in one block.
BLOCK = 64

#: Levels of a perfect hash; keys still not alone (equal hashes) are kept in a table.
LEVELS = 40

_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MESSAGE = "lang string, source string, shard long, salt int, at binary, counts binary"


class Terms:
    """The terms of a chunk of texts: the distinct ones, which of them stands at
    each place, and in which text."""

    def __init__(self, texts: pa.Array):
        data, at = raw(texts)
        inside = _TERM[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True  # a text's border ends a term
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        flat = _LOWER[data[inside]]
        offsets = np.append(0, np.cumsum(end - start)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        coded = pieces.dictionary_encode()
        self.distinct, self.index = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(start, at)))


def hashes(keys: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every task."""
    data, at = raw(keys)
    return Words(data, at, at[:-1], at[1:], at).hashes() if len(keys) else np.zeros(0, np.uint64)


class PerfectHash:
    """Slots 0..n-1 of n keys. Any other string gets no slot: the stored key of
    the slot it falls on is compared."""

    def __init__(self, levels: list[bytes], keys: pa.Array):
        self.keys, self.levels, base = keys, [], 0
        for i, packed in enumerate(levels):
            bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
            below = np.cumsum(bits) - bits + base
            base += int(bits.sum())
            self.levels.append((self._seed(i), bits, below))
        self.rest = {k: base + i for i, k in enumerate(keys[base:].to_pylist())}

    @staticmethod
    def _seed(level: int) -> np.uint64:
        return np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)

    @classmethod
    def build(cls, keys: pa.Array, most_levels: int = LEVELS) -> tuple[list[bytes], pa.Array]:
        """The levels, and the distinct ``keys`` in the order of their slots."""
        h, left, levels, order = hashes(keys), np.arange(len(keys)), [], []
        while len(left) and len(levels) < most_levels:
            size = 8 * (len(left) // 4 + 1)
            place = (mix(h[left] ^ cls._seed(len(levels))) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            own = alone[place]
            order.append(left[own][np.argsort(place[own])])
            levels.append(np.packbits(alone).tobytes())
            left = left[~own]
        return levels, keys.take(pa.array(np.concatenate([*order, left]) if len(keys) else left))

    def slots(self, terms: pa.Array, h: np.ndarray) -> np.ndarray:
        """The slot of each term, -1 if it is no key. h: their hashes."""
        out, left = np.full(len(terms), -1), np.arange(len(terms))
        for seed, bits, below in self.levels:
            place = (mix(h[left] ^ seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[left[hit]] = below[place[hit]]
            left = left[~hit]
        found = np.flatnonzero(out >= 0)
        same = pc.equal(self.keys.take(pa.array(out[found])), terms.take(pa.array(found))).to_numpy(zero_copy_only=False)
        out[found[~same]] = -1
        if self.rest:
            for i in left:
                out[i] = self.rest.get(terms[i].as_py(), -1)
        return out


def _grouped(docs: DataFrame) -> DataFrame:
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(part("lang"), part("source"), part("text"))


def kept_terms(docs: DataFrame, least_docs: int = 30) -> DataFrame:
    """lang, term: the terms in at least ``least_docs`` documents of the language.
    Chunks send a row for each of their terms, summed before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            terms = Terms(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64)
            wide = max(1, len(terms.distinct))
            once = np.unique(terms.text * wide + terms.index)
            key, n = np.unique(lang[once // wide] * wide + once % wide, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(key // wide)), terms.distinct.take(pa.array(key % wide)).cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())],
                ["lang", "term", "n"],
            )

    rows = _grouped(docs).select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return rows.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least_docs).select("lang", "term")


def shards(kept: DataFrame) -> DataFrame:
    """The perfect hashes: lang, shard, n_shards (of the language), n (keys),
    size (bytes), levels, keys (in slot order)."""
    sizes = kept.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes"))
    sizes = sizes.select("of", F.greatest(F.ceil(F.col("n") / SHARD_TERMS), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("long").alias("n_shards"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = hashes(b.column("term").cast(pa.large_binary()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((h % np.asarray(b.column("n_shards")).astype(np.uint64)).astype(np.int64))], [*b.schema.names, "shard"])

    def build(table: pa.Table) -> pa.Table:
        levels, keys = PerfectHash.build(table.column("term").combine_chunks().cast(pa.large_binary()))
        size = sum(map(len, levels)) + sum(map(len, keys.to_pylist()))
        one = lambda c: [table.column(c)[0].as_py()]
        return pa.table({"lang": one("lang"), "shard": one("shard"), "n_shards": one("n_shards"), "n": [len(keys)], "size": [size], "levels": [levels], "keys": [keys.to_pylist()]}, schema=_shard_type())

    dealt = kept.join(sizes, F.col("lang") == F.col("of")).select("lang", "term", "n_shards").mapInArrow(deal, "lang string, term string, n_shards long, shard long")
    return dealt.groupBy("lang", "shard").applyInArrow(build, "lang string, shard long, n_shards long, n long, size long, levels array<binary>, keys array<binary>")


def _shard_type() -> pa.Schema:
    number, many = pa.int64(), pa.list_(pa.binary())
    return pa.schema({"lang": pa.string(), "shard": number, "n_shards": number, "n": number, "size": number, "levels": many, "keys": many})


class Recount:
    """Dense slots per group for the shards of a pass."""

    def __init__(self, rows: list):
        self.n_shards = {r.lang: r.n_shards for r in rows}
        self.tables = {(r.lang, r.shard): PerfectHash([bytes(x) for x in r.levels], pa.array([bytes(k) for k in r.keys], pa.large_binary())) for r in rows}
        self.slots: dict[tuple[str, str, int], np.ndarray] = {}

    def add(self, langs: list[str], sources: list[str], terms: Terms) -> None:
        groups: dict[tuple[str, str], int] = {}
        group = np.fromiter((groups.setdefault(g, len(groups)) for g in zip(langs, sources)), np.int64, len(langs))
        wide = max(1, len(terms.distinct))
        key, n = np.unique(group[terms.text] * wide + terms.index, return_counts=True)
        of, code = key // wide, key % wide
        h = hashes(terms.distinct)
        own = np.array([lang for lang, _ in groups], object)
        for lang in set(own) & set(self.n_shards):
            mine = np.flatnonzero((own == lang)[of])
            used = np.unique(code[mine])
            shard = (h[used] % np.uint64(self.n_shards[lang])).astype(np.int64)
            shard_of, slot_of = np.full(wide, -1), np.full(wide, -1)
            for s in np.unique(shard):
                if (table := self.tables.get((lang, int(s)))) is not None:
                    part = used[shard == s]
                    shard_of[part], slot_of[part] = s, table.slots(terms.distinct.take(pa.array(part)), h[part])
            mine = mine[slot_of[code[mine]] >= 0]
            mine = mine[np.lexsort((shard_of[code[mine]], of[mine]))]
            where = of[mine] * (self.n_shards[lang] + 1) + shard_of[code[mine]]
            cuts = np.flatnonzero(np.diff(where, prepend=-1))
            names = list(groups)
            for a, b in zip(cuts, [*cuts[1:], len(mine)]):
                i = mine[a]
                s = int(shard_of[code[i]])
                dense = self.slots.get((*names[of[i]], s))
                if dense is None:
                    dense = self.slots[(*names[of[i]], s)] = np.zeros(len(self.tables[lang, s].keys), np.int64)
                dense[slot_of[code[mine[a:b]]]] += n[mine[a:b]]  # a slot once in a chunk and group

    def held(self) -> int:
        return sum(x.nbytes for x in self.slots.values())

    def send(self, salt: int) -> pa.RecordBatch:
        out, self.slots = _batch([(*k, salt, *_sparse(x)) for k, x in self.slots.items()]), {}
        return out


def _sparse(dense: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(dense)
    return pack(steps(at.astype(np.uint64))), pack(dense[at].astype(np.uint64))


def _dense(at: bytes | None, counts: bytes | None, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if at:
        out[np.cumsum(unpack(at)).astype(np.int64)] = unpack(counts).astype(np.int64)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    names = ["lang", "source", "shard", "salt", "at", "counts"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal (lang, source, shard, salt) stand together: their sum."""
    key, at, counts = None, [], []

    def total() -> pa.RecordBatch:
        where, n = np.concatenate(at), np.concatenate(counts)
        dense = np.zeros(where.max(initial=-1) + 1, np.int64)
        np.add.at(dense, where, n)
        return _batch([(*key, *_sparse(dense))])

    for batch in batches:
        for *now, a, c in zip(*(x.to_pylist() for x in batch.columns)):
            if now != key and key is not None:
                yield total()
                at, counts = [], []
            key = now
            at.append(np.cumsum(unpack(a)).astype(np.int64))
            counts.append(unpack(c).astype(np.int64))
            if sum(map(len, at)) > 1 << 20:
                both = _sum(np.concatenate(at), np.concatenate(counts))
                at, counts = [both[0]], [both[1]]
    if key is not None:
        yield total()


def _sum(at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    where, inverse = np.unique(at, return_inverse=True)
    out = np.zeros(len(where), np.int64)
    np.add.at(out, inverse, counts)
    return where, out


def summed(messages: DataFrame) -> DataFrame:
    """One row per (lang, source, shard): a hot group in ``SALT`` parts first."""
    for salt in (F.col("salt"), F.lit(0)):
        keys = ["lang", "source", "shard", "salt"]
        messages = messages.withColumn("salt", salt.cast("int")).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_fold, _MESSAGE)
    return messages


def recount(docs: DataFrame, hashed: DataFrame) -> DataFrame:
    """lang, source, shard, at, counts: how often each kept term stands in each
    group, by slot. hashed: the shards, a table."""
    spark = docs.sparkSession
    total = hashed.agg(F.sum("size")).first()[0]
    if total is None:
        return spark.createDataFrame([], _MESSAGE)
    passes = -(-total // PASS_BYTES)
    turn = lambda n: F.pmod(F.xxhash64("lang", "shard"), F.lit(n))
    while hashed.groupBy(turn(passes)).agg(F.sum("size").alias("size"), F.count("*").alias("n")).where((F.col("size") > PASS_BYTES) & (F.col("n") > 1)).limit(1).count():
        passes *= 2
    paths = []
    for k in range(passes):
        rows = hashed.where(turn(passes) == k).collect()
        if rows:
            sent = spark.sparkContext.broadcast([r.asDict() for r in rows])
            paths.append(fresh(spark, "recount"))
            summed(_grouped(docs).mapInArrow(functools.partial(_count, sent), _MESSAGE)).write.parquet(paths[-1])
            sent.unpersist()
    return spark.read.schema(_MESSAGE).parquet(*paths)


def _count(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from types import SimpleNamespace

    recounted, salt = Recount([SimpleNamespace(**r) for r in sent.value]), TaskContext.get().partitionId() % SALT
    for batch in chunks(batches):
        recounted.add(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), Terms(batch.column("text")))
        if recounted.held() > SLOT_BYTES:
            yield recounted.send(salt)
    yield recounted.send(salt)


def share(count: np.ndarray, total: int, terms: int, smooth: int) -> np.ndarray:
    """1 + floor(10**9 * (count + smooth) / (total + smooth * terms)), by long division."""
    whole, out, x = total + smooth * terms, np.zeros(len(count), np.int64), count + smooth
    for _ in range(3):
        x = x * 1000
        digit = x // whole
        x -= digit * whole
        out = out * 1000 + digit
    return out + 1


def _distances(smooth: int):
    """Sums of differences between the sources of two blocks, over one shard."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["block"], r["source"].encode()))
        p = [share(_dense(r["at"], r["counts"], r["n"]), r["total"], r["terms"], smooth) if r["n"] else np.zeros(0, np.int64) for r in rows]
        p = np.stack(p)
        one, other, value = [], [], []
        for i, r in enumerate(rows):
            js = [j for j in range(i + 1, len(rows)) if r["low"] == r["high"] or rows[j]["block"] != r["block"]]
            if js:
                value += np.abs(p[js] - p[i]).sum(1).tolist()
                one += [r["source"]] * len(js)
                other += [rows[j]["source"] for j in js]
        return pa.table({"lang": pa.array([rows[0]["lang"]] * len(one), pa.string()), "one": pa.array(one, pa.string()), "other": pa.array(other, pa.string()), "value": pa.array(value, pa.int64())})

    return run


def _best_terms(smooth: int, top: int):
    """The first ``top`` terms of each group in each shard. A shard's first row
    holds its keys and the language's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, order = [], None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["keys"] is not None:
                    keys = r["keys"]
                    q = share(_dense(r["at"], r["counts"], r["n"]), r["total"], r["terms"], smooth)
                    order = np.empty(len(keys), np.int64)
                    order[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
                    continue
                count = _dense(r["at"], r["counts"], r["n"])
                over = share(count, r["total"], r["terms"], smooth) - q
                mine = np.flatnonzero((count > 0) & (over > 0))
                mine = mine[np.lexsort((order[mine], -over[mine]))][:top]
                out += [(r["lang"], r["source"], keys[i].decode(), int(over[i])) for i in mine]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["lang", "source", "item", "value"])

    return run


def divergence(docs: DataFrame, least_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank: for every group its distance to each
    other source of the language (part pair) and the ``top`` terms that it uses
    more than the language does (part term)."""
    groups = cut_lineage(_grouped(docs.withColumn("text", F.lit(""))).groupBy("lang", "source").count().select("lang", "source"), "groups")
    hashed = cut_lineage(shards(kept_terms(docs, least_docs)), "shards")
    counts = cut_lineage(recount(docs, hashed).select("lang", "source", "shard", "at", "counts").mapInArrow(_with_totals, "lang string, source string, shard long, at binary, counts binary, here long"), "counts")

    terms = hashed.groupBy("lang").agg(F.sum("n").alias("terms"))
    of_group = groups.join(counts.groupBy("lang", "source").agg(F.sum("here").alias("total")), ["lang", "source"], "left")
    of_group = of_group.join(terms, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    of_group = cut_lineage(of_group, "groups")
    places = groups.select("lang").distinct().join(hashed.select("lang", "shard", "n"), "lang", "left").select("lang", F.coalesce("shard", F.lit(0)).alias("shard"), F.coalesce("n", F.lit(0)).alias("n"))
    cells = of_group.join(places, "lang").join(counts.drop("here"), ["lang", "source", "shard"], "left")

    # pairs: sources in blocks, every two blocks of a language together, shard by shard
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = cells.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")}).drop("with", "blocks")
    far = dealt.groupBy("lang", "shard", "low", "high").applyInArrow(_distances(smooth), "lang string, one string, other string, value long")
    far = far.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    way = lambda a, b: F.struct(F.col(a).alias("source"), F.col(b).alias("item"))
    pair = far.select("lang", "value", F.inline(F.array(way("one", "other"), way("other", "one"))))

    # terms: the language's counts and keys come first in each shard, once for every part of its sources
    every = summed(counts.select("lang", F.lit("").alias("source"), "shard", F.pmod(F.xxhash64("source"), F.lit(SALT)).cast("int").alias("salt"), "at", "counts"))
    whole = of_group.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    head = hashed.select("lang", "shard", "n", "keys").join(every.select("lang", "shard", "at", "counts"), ["lang", "shard"], "left").join(whole, "lang")
    columns = ["lang", "shard", "part", "source", "n", "total", "terms", "at", "counts", "keys"]
    head = head.select(*(F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part") if c == "part" else F.lit(None).cast("string").alias(c) if c == "source" else F.col(c) for c in columns))
    rows = cells.where(F.col("at").isNotNull()).withColumns({"part": F.pmod(F.xxhash64("source"), F.lit(SALT)).cast("int"), "keys": F.lit(None).cast("array<binary>")}).select(*columns)
    stood = head.union(rows).repartition("lang", "shard", "part").sortWithinPartitions("lang", "shard", "part", F.col("source").asc_nulls_first())
    term = stood.mapInArrow(_best_terms(smooth, top), "lang string, source string, item string, value long")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pair, "pair").union(ranked(term, "term").where(F.col("rank") <= top))


def _with_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        here = [int(unpack(c).sum()) for c in b.column("counts").to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(here, pa.int64())], [*b.schema.names, "here"])


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
seen AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY lang, source, term),
grid AS (
  SELECT grp.lang, grp.source, kept.term, coalesce(seen.c, 0) AS c
  FROM grp JOIN kept ON kept.lang = grp.lang
  LEFT JOIN seen ON seen.lang = grp.lang AND seen.source = grp.source AND seen.term = kept.term),
of_group AS (
  SELECT lang, source, term, c,
         1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p
  FROM grid JOIN size USING (lang)),
of_lang AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM grid GROUP BY lang, term) JOIN size USING (lang)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM of_group a JOIN of_group b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (
  SELECT lang, source, term AS item, (p - q)::BIGINT AS value
  FROM of_group JOIN of_lang USING (lang, term) WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair
UNION ALL
SELECT * FROM (
  SELECT lang, source, 'term' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM term)
WHERE rank <= 50
"""
