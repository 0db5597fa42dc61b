"""Near-duplicates in large buckets that share a single band."""

import math
import random
from itertools import combinations

import pyarrow as pa
from pyspark.sql import functions as F

from kestrel.llm import minhash_dups as md


def test_a_true_link_stays_over_the_estimate():
    agree = 0.75 + 0.25 * 2.0**-md.BITS
    least = math.ceil(md.HASHES * (md.NEAR * (1 - 2.0**-md.BITS) + 2.0**-md.BITS) - 1e-9)
    assert sum(math.comb(md.HASHES, k) * agree**k * (1 - agree) ** (md.HASHES - k) for k in range(least)) < 1e-8


def test_every_pair_of_a_large_bucket_meets(spark, monkeypatch):
    monkeypatch.setattr(md, "GROUP", 10)
    members = spark.createDataFrame([(7, i) for i in range(60)] + [(8, i) for i in range(100, 105)], "bucket long, id long").withColumn("place", F.lit(1))
    none = spark.createDataFrame([], "id long, component long")
    groups = {}
    for r in md.small_groups(members, none).collect():
        groups.setdefault(r.bucket, set()).add(r.id)
    met = {p for g in groups.values() for p in combinations(sorted(g), 2)}
    assert met == set(combinations(range(60), 2)) | set(combinations(range(100, 105), 2))


def test_pairs_with_one_shared_band_in_a_large_bucket_are_linked(spark, monkeypatch):
    """Only one band in common, and it is that of a bucket over ``GROUP``."""
    monkeypatch.setattr(md, "GROUP", 10)
    rng = random.Random(2)
    keys = md.band_keys

    def one_band(least):
        # all share the first band; every other band is its document's own
        out = keys(least)
        out[0] = 5
        out[1:] ^= md.mix(least.astype("uint64").sum(keepdims=True))
        return out

    monkeypatch.setattr(md, "band_keys", one_band)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((i, " ".join(words)))
        if i % 4 == 0:
            rows.append((100 + i, " ".join([*words[:-3], "x", "y", "z"])))
    out = {r.doc_id: r.component_id for r in md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: d - 100 if d >= 100 else d for d, _ in rows}


def test_documents_with_a_common_passage_make_few_pairs(spark, monkeypatch):
    """2000 documents that share 200 of 280 words (similarity 0.54) are no links:
    their pairs are never written out. Near copies among them are found."""
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(200)]
    rows = []
    for i in range(2000):
        own = [f"w{rng.randrange(10**7)}" for _ in range(80)]
        rows.append((i, " ".join(own[:40] + passage + own[40:])))
        if i % 50 == 0:  # a near copy of a document, with the passage
            rows.append((10_000 + i, " ".join(own[:40] + passage + own[40:78] + ["x", "y"])))
    made = []
    confirm = md.confirm
    monkeypatch.setattr(md, "confirm", lambda pairs, reps, docs: (made.append(pairs.count()), confirm(pairs, reps, docs))[1])
    out = {r.doc_id: r.component_id for r in md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {d: d - 10_000 if d >= 10_000 else d for d, _ in rows}
    assert sum(made[2:]) < 5 * len(rows)  # what is looked at after the leaders' pairs


def test_the_prefix_filter_loses_no_link(spark):
    """All documents unsettled, each a component of its own: every pair at the
    threshold or over it shares a bucket."""
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 9, 40, 90]))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w + [rng.choice(vocabulary) for _ in range(rng.choice([0, 0, 1, 5]))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members, shareable = md.prefixes(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")), docs)
    buckets, place = {}, {}
    for r in members.collect():
        buckets.setdefault(r.bucket, set()).add(r.id)
        place[r.bucket, r.id] = r.place
    met = {p for g in buckets.values() for p in combinations(sorted(g), 2)}
    sets = [set(x.tolist()) for x in md.shingle_sets(pa.array(texts))]
    linked = {(a, b) for a, b in combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked and linked <= met
    common = {r.id: r.shareable for r in shareable.collect()}
    assert all(common[a] >= len(sets[a] & sets[b]) for a, b in linked)
    for a, b in linked:  # in one of their buckets, all that they share is from there on
        both = len(sets[a] & sets[b])
        assert any(min(common[a] - place[k, a], common[b] - place[k, b]) + 1 >= both for k, g in buckets.items() if {a, b} <= g)


def test_clashing_names_and_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (1, "a b c d e f", 2, "y"), (2, "other words here", 3, "z")], "doc_id long, text string, _place int, _PLACE_ string")
    out = md.deduplicate(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]
    assert sorted(map(str, out.collect())) == sorted(map(str, md.deduplicate(docs.repartition(3)).collect()))
