"""Near-duplicates and repeated substrings against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from kestrel.llm import codes, common, graph
from kestrel.llm import minhash_dups as mh
from kestrel.llm import sketch_substrings as ss
from kestrel.llm.common import read

from .helpers import empty_docs, odd_docs


def test_words_are_those_of_the_pattern():
    import re

    texts = ["", None, " a\tb\x0b\x0cc\r\nd  ", "x", "É é z", "\n", "q r"]
    w = common.words(pa.array(texts))
    flat = [m for t in texts for m in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == flat
    assert w.counts.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    h = w.hashes()
    again = common.words(pa.array([" ".join(flat)])).hashes()
    assert (h == again).all() and len(set(h.tolist())) == len(set(flat))


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def expected_components(rows):
    sets = defaultdict(set)
    for i, t in rows:
        sets[i].add(shingles(t))
    ids = sorted(sets)
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    index = defaultdict(set)
    for i in ids:
        for s in sets[i]:
            near = Counter((j, o) for x in s for j, o in index[x])
            for (j, o), n in near.items():
                if 100 * n >= 75 * (len(s) + len(o) - n):
                    a, b = sorted((root(i), root(j)))
                    low[b] = a
        for s in sets[i]:
            for x in s:
                index[x].add((i, s))
    return {i: root(i) for i in ids}, sets


@pytest.mark.parametrize("group", [400, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(mh, "GROUP", group)
    for docs in (read(spark, SF0001, "documents"), odd_docs(spark)):
        want, sets = expected_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        rows = mh.near_duplicates(docs).collect()
        assert len(rows) == docs.count()
        for r in rows:
            assert r.component_id == want[r.doc_id] and r.n_shingles in {len(s) for s in sets[r.doc_id]}
            assert r.kept == (r.doc_id == want[r.doc_id])


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    docs = odd_docs(spark)
    out = mh.deduplicate(docs)
    assert out.dtypes == docs.dtypes
    want, _ = expected_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
    assert mh.deduplicate(empty_docs(spark)).count() == 0


def test_null_ids_stay(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in mh.deduplicate(docs).collect()) == [-1, -1, 1]


@pytest.mark.parametrize("j", [0.5, 0.75, 0.9])
def test_estimate_is_close(j):
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        both = rng.integers(0, 2**63, 1200, dtype=np.uint64)
        shared = int(1200 * 2 * j / (1 + j) / 2)
        a, b = np.unique(both[: shared + 300]), np.unique(np.concatenate([both[:shared], both[600:900]]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = [np.frombuffer(mh.signature(mh.minima(x)), np.uint64) for x in (a, b)]
        errors.append(mh.estimates(s[0], s[1][None])[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (2, 1)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100 + i: 100 for i in range(30)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_codes_round_trip():
    rng = np.random.default_rng(1)
    x = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64) >> rng.integers(0, 64, 1000).astype(np.uint64))
    assert (np.cumsum(codes.unpack(codes.pack(codes.steps(x))), dtype=np.uint64) == x).all()
    y = np.array([0, -1, 1, -(2**63), 2**63 - 1])
    assert (codes.unzigzag(codes.unpack(codes.pack(codes.zigzag(y)))) == y).all()
    assert len(codes.unpack(codes.pack(x[:0]))) == 0


def expected_cut(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - 12):
            s = tuple(w[k : k + 13])
            least[s] = min(least.get(s, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out)


def test_removed_words_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ss, "BLOCK_BYTES", 20_000)  # several blocks
    got = sorted(tuple(r) for r in ss.op4_sketch_substrings(spark, SF0001).collect())
    assert got == expected_cut([(r.doc_id, r.text) for r in read(spark, SF0001, "documents").collect()])


def test_removed_words_odd_rows(spark):
    docs = odd_docs(spark)
    got = ss.removed_words(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    assert sorted(tuple(r) for r in got) == expected_cut([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert ss.removed_words(empty_docs(spark)).count() == 0
    null = spark.createDataFrame([(None, " ".join("abcdefghijklmnop")), (5, " ".join("abcdefghijklmnop"))], "doc_id long, text string")
    assert {(r.doc_id, r.n_removed) for r in ss.removed_words(null).collect()} == {(None, 16), (5, 0)}
