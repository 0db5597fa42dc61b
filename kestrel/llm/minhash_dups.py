"""Near-duplicates by b-bit MinHash.

A document's shingles are its distinct five-word windows. Of ``HASHES`` minima
the low ``BITS`` bits are packed into a signature; minima in bands of ``ROWS``
give candidates; equal bits, counted and corrected for chance agreement,
estimate the similarity; links are confirmed on the full shingle sets.

No bucket's pairs are all written out. Equal sets are settled first (the one
with the least id stands for them). In each bucket a leader is compared with the
others: the member with most company over all its buckets, which in a group of
near copies is the original they share their bands with. The confirmed links
are joined to components; a bucket that lies within one component is done. In
what is left the heaviest member outside the leader's component leads once more.

Documents that share a long passage but are no near-duplicates keep buckets
unsettled. Their pairs are not made: the members of all unsettled buckets are
joined by a prefix filter, which loses no link. Shingles in one component only
cannot be shared with another; a document with too few others is done. The rest
of its shingles are ordered, those of the fewest documents first, and only the
first are looked at, so many that two sets that miss each other there cannot
reach the threshold; a passage of many documents stands last. Documents that
share such a shingle form groups (of more than ``GROUP``, every two blocks
meet); a group gives only pairs of different components whose sizes, estimate
and number of shingles from there on allow a link.

A pair at similarity 0.75 shares a band with probability 1 - 5e-6; its estimate
stays over ``NEAR`` by over six standard deviations (1 - 2e-9).

Null or empty text, or one without words: an empty set, linked with nothing.
Fewer than five words: the whole sequence is the one shingle. Repeated rows
have equal sets; rows of one id with different texts are one document that has
the links of either. Null ids are never chosen to stand for others and are
kept. An empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kestrel.llm.common import chunks, cut_lineage, mix, read, texts_of, windows, words
from kestrel.llm.graph import components

SHINGLE = 5
HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Least similarity of a link, in hundredths.
LEAST = 75
#: Least estimate that is confirmed on full sets.
NEAR = 0.5
#: Bytes of text whose shingles are made at once.
PART_BYTES = 3 << 20
#: Most members of a group compared at once.
GROUP = 400
#: Most ids (8 bytes each) that are broadcast to pick their texts.
FEW_IDS = 500_000

_rng = np.random.Generator(np.random.PCG64(7))
_A = (_rng.integers(0, 2**31, HASHES, dtype=np.uint32) * 2 + 1).astype(np.uint32)[:, None]
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    w = words(texts, lower=True)
    h, _, first = windows(w.hashes(), w.first, SHINGLE, short=True)
    return [np.unique(h[a:b]) for a, b in zip(first, first[1:])]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set (not empty)."""
    x = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 4096):
        np.minimum(out, (_A * x[None, a : a + 4096] + _B).min(axis=1), out=out)
    return out


def signature(least: np.ndarray) -> bytes:
    """The low bits of the (mixed) minima, two to a byte."""
    low = (mix(least.astype(np.uint64)) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    key = _BAND.copy()
    for i in range(ROWS):
        key = mix(key ^ rows[:, i]) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(i)
    return key


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of one packed signature (uint64 words) and others."""
    x = one[None, :] ^ many
    x = x | x >> np.uint64(1)
    x = (x | x >> np.uint64(2)) & np.uint64(0x1111111111111111)
    agree = 1 - np.bitwise_count(x).sum(axis=1) / HASHES
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (equal for equal sets), signature, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=PART_BYTES):
            sets = shingle_sets(batch.column(1))
            n, keys, signatures, bands = [], [], [], []
            for s in sets:
                n.append(len(s))
                if not len(s):
                    keys.append(None), signatures.append(None), bands.append(None)
                    continue
                least = minima(s)
                keys.append(np.array([len(s), mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s + np.uint64(77)))], np.uint64).tobytes())
                signatures.append(signature(least))
                bands.append(band_keys(least).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "signature", "bands"])

    return texts_of(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary, bands array<long>")


def shared_buckets(reps: DataFrame) -> DataFrame:
    """(bucket, id) of every band key that at least two representatives have."""
    keys = reps.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"))
    more = keys.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("bucket")
    return keys.join(more, "bucket")


def confirm(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The links (a, b) among the candidate pairs: by size and estimate first,
    then on the full sets, which are made again for just these documents."""
    small = reps.select("doc_id", "n_shingles", "signature")
    p = pairs.select("a", "b").distinct()
    p = p.join(small.toDF("a", "n_a", "s_a"), "a").join(small.toDF("b", "n_b", "s_b"), "b")
    p = p.where(100 * F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3)]
                x = estimates(np.zeros(s[0].shape[1], np.uint64), s[0] ^ s[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(x >= NEAR))

    p = cut_lineage(p.select("a", "b", "s_a", "s_b").mapInArrow(near, "a long, b long").distinct(), "near-pairs")
    if p.isEmpty():
        return p

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=PART_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1))], pa.binary())], ["id", "shingles"])

    wanted = cut_lineage(p.select(F.col("a").alias("doc_id")).union(p.select("b")).distinct(), "wanted")
    if wanted.limit(FEW_IDS + 1).count() <= FEW_IDS:
        wanted = F.broadcast(wanted)  # then the texts stay where they lie; else both sides meet by id
    full = texts_of(docs).join(wanted, "doc_id").mapInArrow(sets, "id long, shingles binary")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = len(a) + len(b) - len(np.union1d(a, b))
                kept.append(100 * both >= LEAST * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    joined = p.join(full.toDF("a", "x"), "a").join(full.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return cut_lineage(joined.mapInArrow(linked, "a long, b long"), "links")


def unsettled(members: DataFrame, component: DataFrame) -> DataFrame:
    """The members (bucket, used, id) of buckets that still touch several
    components, with component and the bucket's size."""
    m = members.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = m.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low < high")
    return m.join(several.select("bucket", "size"), "bucket")


def prefixes(todo: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the documents of ``todo`` (id, component): (bucket, id, place), the
    shingles by which links to other components can be found and their place in
    the document's order (from 1), and (id, shareable), the number of shingles
    that other components have as well.

    A link of sets of n and m shingles has at least LEAST * n / 100 in common. If
    s of the n occur in several components, two sets that share none of their
    first s - ceil(LEAST * n / 100) + 1 (in one order for all) share too few."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=PART_BYTES):
            sets = shingle_sets(batch.column(1))
            n = np.array([len(x) for x in sets], np.int64)
            ids = np.asarray(batch.column(0), np.int64)
            key = np.array([mix(x).sum(dtype=np.uint64) for x in sets], np.uint64)
            key = mix(key ^ mix(ids.astype(np.uint64))).view(np.int64)  # of a document and set
            flat = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (flat, np.repeat(key, n), np.repeat(ids, n), np.repeat(n, n), np.repeat(np.asarray(batch.column(2), np.int64), n))], ["shingle", "key", "id", "n", "component"])

    own = texts_of(docs).join(todo, F.col("doc_id") == F.col("id")).select("doc_id", "text", "component")
    every = cut_lineage(own.mapInArrow(rows, "shingle long, key long, id long, n long, component long"), "shingles")
    several = every.groupBy("shingle").agg(F.count("*").alias("c"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle", "c")
    shared = every.select("shingle", "key", "id", "n").join(several, "shingle")
    of_set = W.partitionBy("key", "id", "n")  # the shingles of one text
    shared = shared.withColumns({"place": F.row_number().over(of_set.orderBy("c", "shingle")), "shareable": F.count("*").over(of_set)})
    first = shared.where(F.col("place") <= F.col("shareable") - F.ceil(F.col("n") * LEAST / 100) + 1)
    first = cut_lineage(first.select(F.col("shingle").alias("bucket"), "id", "place", "shareable"), "prefixes")
    return first.groupBy("bucket", "id").agg(F.min("place").alias("place")), first.groupBy("id").agg(F.max("shareable").alias("shareable"))


def small_groups(members: DataFrame, component: DataFrame) -> DataFrame:
    """(bucket, id, component, place): groups of at most ``GROUP`` members or so. A larger
    bucket becomes pairs of blocks, so that every pair of its members is in a
    group."""
    todo = cut_lineage(unsettled(members.withColumn("used", F.array("bucket")), component), "unsettled")
    fine = todo.where(F.col("size") <= GROUP).select("bucket", "id", "component", "place")
    large = todo.where(F.col("size") > GROUP)
    large = large.withColumn("blocks", F.ceil(F.col("size") / max(1, GROUP // 2)).cast("int"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    parts = large.withColumn("block", block).select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    return fine.union(parts.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("bucket"), "id", "component", "place"))


def group_pairs(groups: DataFrame, reps: DataFrame, shareable: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) of different components in a group whose sizes and shareable
    shingles from this place on allow a link (at the first shingle that a link's
    documents share, all they share is from there on) and whose estimate is at
    least ``NEAR``; with ``best``, only the best of every two components."""

    def run(table: pa.Table) -> pa.Table:
        ids, own, sizes, common, place = (np.asarray(table.column(c)) for c in ("id", "component", "n_shingles", "shareable", "place"))
        common = common - place + 1
        bits = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint64).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, own, sizes, common, bits = ids[order], own[order], sizes[order], common[order], bits[order]
        a, b, score = [], [], []
        least, most = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
        both = np.minimum(np.minimum(common[:, None], common), least)  # at most so many in common
        worth = np.triu((own[:, None] != own) & (100 * least >= LEAST * most) & (100 * both >= LEAST * (least + most - both)), 1)
        i, j = np.nonzero(worth)
        nothing = np.zeros(bits.shape[1], np.uint64)
        for at in range(0, len(i), 20_000):
            left, right = i[at : at + 20_000], j[at : at + 20_000]
            x = estimates(nothing, bits[left] ^ bits[right])
            near = x >= NEAR
            a.append(left[near])
            b.append(right[near])
            score.append(x[near])
        a, b, score = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b, score))
        if best and len(a):
            low, high = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
            order = np.lexsort((-score, high, low))
            low, high = low[order], high[order]
            first = order[np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))]
            a, b = a[first], b[first]
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    # many shingles have the same members: they make one group, each member at its first place
    g = groups.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who"))
    one = groups.join(g, "bucket").groupBy("n", "who", "id").agg(F.min("component").alias("component"), F.min("place").alias("place"))
    drawn = reps.select(F.col("doc_id").alias("id"), "n_shingles", "signature").join(shareable, "id")
    return one.join(drawn, "id").groupBy("n", "who").applyInArrow(run, "a long, b long").distinct()


def star_pairs(members: DataFrame, component: DataFrame | None) -> DataFrame:
    """(a, b): each bucket's leader a and its other members b that are not yet
    of its component. The leader is the member whose buckets hold most members
    together; once components are known, the heaviest outside the component
    that holds the heaviest."""
    members = members.select("bucket", "id", *([] if component is None else ["component"]))
    size = members.groupBy("bucket").agg(F.count("*").alias("size"))
    weight = members.join(size, "bucket").groupBy("id").agg(F.sum("size").alias("weight"))
    m = members.join(weight, "id")
    rank = F.struct("weight", -F.col("id"))
    if component is None:
        leader = m.groupBy("bucket").agg(F.max_by("id", rank).alias("a"))
        return members.join(leader, "bucket").where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    # members already carry their component here
    first = m.groupBy("bucket").agg(F.max_by("component", rank).alias("led"))
    second = m.join(first, "bucket").where("component <> led").groupBy("bucket").agg(F.max_by(F.struct("id", "component"), rank).alias("lead"))
    second = second.select("bucket", F.col("lead.id").alias("a"), F.col("lead.component").alias("of"))
    return members.join(second, "bucket").where("component <> of").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable over links), kept."""
    drawn = cut_lineage(sketches(docs), "sketches")
    rep = drawn.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    marked = cut_lineage(drawn.select("doc_id", "n_shingles", "set_key").join(rep, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep")), "marked")
    reps = drawn.join(marked.where("doc_id = rep AND n_shingles > 0").select("doc_id").distinct(), "doc_id")
    reps = cut_lineage(reps.where("n_shingles > 0").select("doc_id", "n_shingles", "signature", "bands"), "representatives")
    members = cut_lineage(shared_buckets(reps), "buckets")

    links = confirm(star_pairs(members, None), reps, docs)
    component = components(links)
    left = cut_lineage(unsettled(members.withColumn("used", F.array("bucket")), component), "unsettled")
    more = confirm(star_pairs(left, component), reps, docs)
    if not more.isEmpty():
        links = links.union(more)
        component = components(links)
    todo = unsettled(left.select("bucket", "id", F.col("id").alias("used")), component).select("id", "component").distinct()
    members, shareable = prefixes(cut_lineage(todo, "unsettled"), docs)
    for best in (True, False):
        pairs = cut_lineage(group_pairs(small_groups(members, component), reps, shareable, best), "pairs")
        if pairs.isEmpty():
            continue
        more = confirm(pairs, reps, docs)
        if not more.isEmpty():
            links = links.union(more)
            component = components(links)
    out = marked.join(component.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    # a component's least node is the least id among its sets' least ids
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The table with one document of each component, the one with the least
    id; of the rows of an id one stays (that of the largest text, then the least
    hash of all columns), rows without an id all do."""
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    place = "_place"
    while place.lower() in {c.lower() for c in docs.columns}:
        place += "_"
    others = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = W.partitionBy("doc_id").orderBy(F.col("text").desc_nulls_last(), F.xxhash64(*others))
    one = named.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return one.union(docs.where("doc_id IS NULL"))


def op3_minhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
