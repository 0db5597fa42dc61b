"""The divergence audit against brute force and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from conftest import SF0001
from kestrel.llm import divergence_audit as da

from .helpers import CLASHING, SCHEMA, empty_docs, odd_docs


def brute(rows, least=30, smooth=5, top=50):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t.translate(lower)) for _, _, t in rows]
    docs, out = Counter(), set()
    for (lang, _, _), words in zip(rows, found):
        docs.update((lang, w) for w in set(words))
    for lang in {r[0] for r in rows}:
        kept = {w for (x, w), n in docs.items() if x == lang and n >= least}
        count = defaultdict(Counter)
        for (x, source, _), words in zip(rows, found):
            if x == lang:
                count[source].update(w for w in words if w in kept)
        share = lambda c: {w: 1 + 10**9 * (c[w] + smooth) // (sum(c.values()) + smooth * len(kept)) for w in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in count:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in count if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(items) if part == "pair" or i < top}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_perfect_hash_is_minimal_and_takes_no_other_string():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdéß漢") for _ in range(rng.randint(1, 7))).encode() for _ in range(9000)})
    keys, others = pa.array(words[::2], pa.large_binary()), pa.array(words[1::2], pa.large_binary())
    for most in (da.LEVELS, 1, 0):  # 1, 0: many keys, or all, are left to the table
        levels, stored = da.PerfectHash.build(keys, most)
        table = da.PerfectHash(levels, stored)
        got = table.slots(keys, da.hashes(keys))
        assert sorted(got) == list(range(len(keys)))
        assert stored.take(pa.array(got)).equals(keys)
        assert (table.slots(others, da.hashes(others)) == -1).all()
    assert da.PerfectHash.build(pa.array([], pa.large_binary()))[0] == []


def test_share_is_exact():
    for total, terms in ((7, 3), (10**15, 10**6), (0, 1)):
        counts = np.array(sorted({0, 1, min(3, total), total // 3, total}), np.int64)
        assert da.share(counts, total, terms, 5).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * terms) for c in counts]


def test_sql_and_brute_force_agree_on_the_table(spark):
    found = result(da.op12_divergence_audit(spark, SF0001))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF0001}/documents.parquet')")
    assert found == set(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({da.ORACLE_SQL})").fetchall())
    assert found == brute(con.execute("SELECT lang, source, text FROM documents").fetchall())


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:  # many shards, passes and blocks
        monkeypatch.setattr(da, "SHARD_TERMS", 8)
        monkeypatch.setattr(da, "PASS_BYTES", 60)
        monkeypatch.setattr(da, "BLOCK", 2)
    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in "aBcé漢" for b in "xYzß"] + ["the", "THE", "o'clock", "Éa"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", None, "", "de", "one"]), rng.choice(["a", "b", None, "漢", "Z", "z"]), 0) for i in range(160)]
    docs += [(500, None, "en", "a", 0), (501, None, "void", "a", 0), (502, " ", "void", "é", 0), (503, "\x00a\x7fb`c{", "en", None, None), (504, "the " * 400_000, "en", "long", 0)]
    docs += [docs[3]] * 5
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    from pyspark.sql import functions as F

    df = df.withColumns({k: F.lit(v) for k, v in {**CLASHING, "shard": 1, "part": 2, "salt": 3, "term": "t", "n": 4, "item": 5, "value": 6, "keys": 7, "one": 8}.items()})
    rows = [(r[2], r[3], r[1]) for r in docs]
    assert result(da.divergence(df, least_docs=3)) == brute(rows, 3)
    if not small:
        assert result(da.divergence(df, least_docs=3, smooth=1, top=2)) == brute(rows, 3, 1, 2)


def test_equal_values_are_ranked_by_bytes(spark):
    docs = [(i, text, "en", source, 0) for i, (text, source) in enumerate([("a b", "x"), ("a b", "é"), ("a b", "Z"), ("c d C", "k")])]
    found = result(da.divergence(spark.createDataFrame(docs, SCHEMA), least_docs=1))
    assert found == brute([(r[2], r[3], r[1]) for r in docs], 1)
    assert [i for _, i in sorted((r[5], r[3]) for r in found if r[1] == "k" and r[2] == "pair")] == ["Z", "x", "é"]


def test_given_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    assert result(da.divergence(docs, least_docs=2)) == brute([(r.lang, r.source, r.text) for r in docs.collect()], 2)
    assert result(da.divergence(docs, least_docs=10**6)) == brute([(r.lang, r.source, r.text) for r in docs.collect()], 10**6)
    assert da.divergence(empty_docs(spark)).collect() == []
