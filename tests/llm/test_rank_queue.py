"""Byte-level BPE against the tiktoken library, and its round trip."""

import base64
import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from conftest import SF0001
from kestrel.llm import rank_queue_bpe as bpe
from kestrel.llm.common import read

from .helpers import empty_docs, odd_docs
from .test_tokens import PARTS

NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(name=NAMES[0]):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queue_gives_lowest_rank_and_ascending_numbers():
    rng, queue, held = random.Random(3), bpe.RankQueue(60_000), {}
    for _ in range(5000):
        if rng.random() < 0.6:
            rank, number = rng.choice([rng.randrange(60_000), rng.randrange(70)]), rng.randrange(100)
            if rng.random() < 0.5:
                queue.put(rank, number)
            else:
                queue.put_all(np.array([rank, -1], np.int32), np.array([number, 5], np.int32))
            held.setdefault(rank, set()).add(number)
        else:
            rank = min(held, default=-1)
            assert taken(queue) == (rank, sorted(held.pop(rank, [])))
    while held:
        rank = min(held)
        assert taken(queue) == (rank, sorted(held.pop(rank)))
    assert taken(queue) == (-1, [])


def taken(queue):
    rank, numbers = queue.take()
    return rank, list(numbers)


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_the_librarys(name):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(97, 123), rng.randrange(0x20, 0x2000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["", "a" * 700, "ab" * 333 + "a", " " * 90, "\n" * 41, "<|endoftext|>", "".join(rng.choice("abcdeilnorst") for _ in range(5000))]
    one, own = library(name), bpe.vocabulary(name)
    found = own.encode(pa.array([*texts, None]))
    for text, ids in zip([*texts, ""], found.to_pylist()):
        assert ids == one.encode_ordinary(text), repr(text)
    assert own.decode(found).to_pylist() == [t.encode() for t in [*texts, ""]]
    cut = found.slice(100, 50)  # offsets that do not start at zero
    assert own.decode(cut).to_pylist() == [t.encode() for t in texts[100:150]]


def test_a_lower_rank_that_comes_up_goes_first(tmp_path):
    """A vocabulary in which merging gives pairs of lower rank than the merge itself."""
    rng = random.Random(8)
    tokens = [bytes([b]) for b in range(256)]
    extra = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(120)}
    tokens += rng.sample(sorted(extra), len(extra))
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    one = tiktoken.Encoding("odd", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    own = bpe.Bpe(str(path))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    assert own.encode(pa.array(texts)).to_pylist() == [one.encode_ordinary(t) for t in texts]


def test_very_long_pre_tokens_take_time_in_proportion():
    own, one, rng = bpe.vocabulary(NAMES[0]), library(), np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 1_200_000, dtype=np.uint8)).decode()
    own.encode(pa.array([text[:20_000]]))
    took = []
    for n in (100_000, 1_200_000):
        t = time.process_time()
        ids = own.encode(pa.array([text[:n]])).to_pylist()[0]
        took.append(time.process_time() - t)
        if n == 100_000:
            assert ids == one.encode_ordinary(text[:n])
    assert b"".join(own.tokens[i].as_py() for i in ids[:1000]) == text.encode()[: sum(len(own.tokens[i].as_py()) for i in ids[:1000])]
    assert own.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [text.encode()]
    assert took[1] < 60 * took[0]


def test_query_equals_the_library(spark):
    one = library()
    found = {r.doc_id: r for r in bpe.op11_bitmap_bpe(spark, SF0001).collect()}
    rows = read(spark, SF0001, "documents").collect()
    assert len(found) == len(rows)
    for r in rows:
        ids = one.encode_ordinary(r.text or "")
        assert found[r.doc_id].n_tokens == len(ids)
        assert found[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark)
    one, texts = library(), sorted((r.doc_id, r.text or "") for r in docs.collect())
    rows = sorted((r.doc_id, bytes(r.decoded).decode(), r.ids) for r in bpe.decode(bpe.encode(docs)).collect())
    assert [(d, t) for d, t, _ in rows] == texts  # repeated rows stay
    assert all(ids == one.encode_ordinary(t) for _, t, ids in rows)
    assert bpe.decode(bpe.encode(empty_docs(spark))).collect() == []
    assert bpe.vocabulary(NAMES[0]).decode(pa.array([None, []], pa.list_(pa.int32()))).to_pylist() == [b"", b""]
    with pytest.raises(ValueError):
        bpe.vocabulary(NAMES[0]).decode(pa.array([[50_256]], pa.list_(pa.int32())))
