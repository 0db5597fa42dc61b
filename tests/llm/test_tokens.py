"""Token counts and packing against the library and brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from conftest import SF0001
from kestrel.llm import linear_packing as lp
from kestrel.llm.common import read
from kestrel.llm.pretokens import Bare, Spaced
from kestrel.llm.token_counts import op10_token_counts, token_counts

from .helpers import empty_docs, odd_docs

PARTS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", " ", "  ", "\n", "\t", " ", " ", "a", "B", "é", "ñ", "1", "23", "!", "<", "İ", "Σ", "ß", "漢", "😀", "é", "ﬁ", "\r\n", "re", "ll", "½", "Ⅷ", "​", "K", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(1)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["", "  ", "a  "]


def test_ids_are_the_librarys(odd_texts):
    ids, at = Spaced().ids(pa.array(odd_texts), 0)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, text in enumerate(odd_texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_counts_are_the_librarys(odd_texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = Bare().counts(pa.array(odd_texts))
    for i, text in enumerate(odd_texts):
        assert found[i] == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_whole_tokens_encode_alone():
    b = Bare()
    assert len(b.whole) > 30_000
    assert all(len(b.library.encode(t.decode(), add_special_tokens=False).ids) == 1 for t in list(b.whole)[:200])


def test_query_counts_every_document(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r.doc_id: r for r in op10_token_counts(spark, SF0001).collect()}
    for r in read(spark, SF0001, "documents").collect():
        n = len(library.encode(r.text, add_special_tokens=False).ids)
        assert (found[r.doc_id].n_tokens, found[r.doc_id].n_bytes, found[r.doc_id].over_limit) == (n, len(r.text.encode()), n > 2048)


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    rows = token_counts(docs).collect()
    assert len(rows) == docs.count()
    assert [(r.n_bytes, r.n_tokens) for r in rows if r.doc_id in (1, 2)] == [(0, 0), (0, 0)]
    assert token_counts(empty_docs(spark)).count() == 0


def check_packing(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for items in by.values():
        at = 0
        for r in sorted(items, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by)


def test_packing_query(spark):
    rows = lp.op6_linear_packing(spark, SF0001).collect()
    n = check_packing(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    total = 0
    for d in read(spark, SF0001, "documents").collect():
        ids = [*library.encode(d.text, add_special_tokens=False).ids, 0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by[d.doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert n <= 1.1 * -(-total // 2048) + 2


def test_packing_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    rows = lp.pack(lp.pieces(docs)).collect()
    check_packing(rows)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sum(r.piece == 0 for r in rows) == docs.count()
    assert lp.pack(lp.pieces(empty_docs(spark))).count() == 0


def test_only_small_and_only_large_pieces(spark):
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    small = spark.createDataFrame([(i, 0, 0, 1 + i % 250, 7) for i in range(500)], schema)
    n = check_packing(lp.pack(small).collect())
    assert n <= -(-sum(1 + i % 250 for i in range(500)) // 2048) + 1
    large = spark.createDataFrame([(i, 0, 0, 700, 7) for i in range(100)] + [(200 + i, 0, 0, 1348, 7) for i in range(100)], schema)
    assert check_packing(lp.pack(large).collect()) == 100


@pytest.mark.parametrize("seed", range(4))
def test_plans_hold_all_and_are_tight(seed):
    rng = np.random.default_rng(seed)
    sizes = np.unique(rng.integers(257, 2049, 20))[::-1]
    demand = rng.integers(1, 400, len(sizes))
    plan = lp.optimise(sizes, demand)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert all((p * sizes).sum() <= 2048 for p, _ in plan)
    # never worse than first-fit decreasing by more than the rounding
    bins = []
    for s, d in zip(sizes, demand):
        for _ in range(d):
            k = next((i for i, x in enumerate(bins) if x >= s), None)
            if k is None:
                bins.append(2048 - s)
            else:
                bins[k] -= s
    assert sum(t for _, t in plan) <= len(bins) + 2


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    rooms, small = np.zeros(2049, int), np.zeros(257, int)
    np.add.at(rooms, rng.integers(0, 900, 300), 1)
    np.add.at(small, rng.integers(1, 257, 2000), 1)
    left = {(r, i): r for r in range(2048) for i in range(rooms[r])}
    seen = defaultdict(list)
    for n, a, b, each, room, rank in lp.best_fit(rooms, small):
        seen[n].append((a, b))
        for k in range(b - a):
            key = (room, rank + k // each)
            left[key] = left.get(key, 2048) - n
            assert left[key] >= 0
    for n in range(1, 257):
        at = 0
        for a, b in sorted(seen[n]):
            assert a == at
            at = b
        assert at == small[n]
