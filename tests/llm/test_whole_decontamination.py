"""Decontamination finds all that its verdict calls a leak."""

import numpy as np
import pyarrow as pa

from kestrel.llm import latent_decontamination as ld

rng = np.random.default_rng(5)
VOCAB = [f"v{i}" for i in range(3000)]
CHANCE = 1 / (np.arange(3000) + 10.0)
CHANCE /= CHANCE.sum()


def some(n):
    return rng.choice(VOCAB, n, p=CHANCE).tolist()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def paraphrase(words, share, extra):
    """The last five words and others up to the share of all, with extra new words put in."""
    n = len(words)
    kept = set(rng.choice(n - 5, max(0, int(np.ceil(share * n)) - 5), replace=False).tolist())
    out = [w if i in kept or i >= n - 5 else f"new{rng.integers(10**6)}" for i, w in enumerate(words)]
    for _ in range(extra):
        out.insert(int(rng.integers(1, len(out) - 5)), f"put{rng.integers(10**6)}")
    return out


def test_every_paraphrase_of_every_length_is_found():
    items = [some(n) for n in range(8, 60)]
    texts, wanted = [], set()
    for i, words in enumerate(items):
        for share in (0.56, 0.6, 0.7, 0.85):
            for extra in (0, 8, 16):
                passage = paraphrase(words, share, extra)
                assert lcs(words, passage) >= ld.LEAST_PARAPHRASE * len(words) and len(passage) <= len(words) + 16
                wanted.add((len(texts), i))
                texts.append(" ".join(some(int(rng.integers(0, 90))) + passage + some(int(rng.integers(0, 90)))))
    texts += [" ".join(some(300)) for _ in range(40)]
    found = search(texts, items)
    assert not wanted - set(found)
    for (d, i), (share, answered) in found.items():
        n, words = len(items[i]), texts[d].split()
        regions = [words[a : a + n + 22] for a in range(0, len(words), 4)]
        best = max(lcs(items[i], r) / n for r in regions)
        assert ld.LEAST_PARAPHRASE <= share <= best and (answered or share >= ld.LEAST_COPY)
        assert not answered or " ".join(items[i][-5:]) in texts[d]


def test_long_items_are_searched_whole():
    item = some(400)
    late, middle, early = item[100:], item[20:260], item[:330]
    texts = [" ".join(some(50) + x + some(50)) for x in (late, middle, early)]
    assert set(search(texts, [item, some(30)])) == {(0, 0), (2, 0)}


def test_long_items_over_the_border_of_segments(monkeypatch):
    monkeypatch.setattr(ld, "SEGMENT", 3000)
    item = some(700)
    texts = [" ".join(some(n) + item + some(4000)) for n in range(1800, 3400, 100)]
    assert {(d, 0) for d in range(len(texts))} == set(search(texts, [item]))


def test_short_items_are_found_verbatim_only():
    items = [["only"], ["two", "words"], ["seven", "rare", "words", "that", "stand", "like", "this"]]
    texts = ["a two words b", "a two other words", "Only, this", "x seven rare words that stand like this", "seven rare words that stand so like this", "", "words two"]
    found = search(texts, items)
    assert set(found) == {(0, 1), (2, 0), (3, 2)} and set(found.values()) == {(1.0, True)}


def test_singular_vectors_are_fitted_on_all_texts(spark, monkeypatch):
    monkeypatch.setattr(ld, "SAMPLE", 10, raising=False)
    docs = spark.createDataFrame([(i, " ".join(some(40))) for i in range(100)], "doc_id long, text string").repartition(7)
    bench = spark.createDataFrame([(1, " ".join(some(20)))], "item_id long, text string")
    fitted, fit = [], ld.singular_vectors
    monkeypatch.setattr(ld, "singular_vectors", lambda texts, idf: fitted.append(texts.count()) or fit(texts, idf))
    assert ld.indexes(docs, bench) and fitted == [100]
    texts = ld.hashed(docs)
    idf = ld.weights(*ld.frequencies(texts))
    one = fit(texts, idf)
    monkeypatch.setattr(ld, "SUMS", 2)
    two = fit(texts, idf)
    assert np.allclose(one @ one.T @ one, two @ (two.T @ one), atol=1e-3)


def test_the_cosine_decides(spark, monkeypatch):
    """Without word vectors nothing is a candidate, not even a copy."""
    item = some(30)
    docs = spark.createDataFrame([(i, " ".join(some(40) + item * (i % 2) + some(40))) for i in range(6)] + [(6, "two words")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "two words")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in ld.leaks(docs, bench).collect()} == {(1, 1), (3, 1), (5, 1), (6, 2)}
    monkeypatch.setattr(ld, "word_vectors", lambda singular, idf: np.zeros((ld.SLOTS + 1, ld.DIMS + 8), np.float32))
    assert ld.leaks(docs, bench).count() == 0


def test_words_of_every_passage_still_count(spark):
    docs = spark.createDataFrame([(i, "all these words are in every one of them") for i in range(3)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "these words are in every one of them")], "item_id long, text string")
    assert ld.leaks(docs, bench).count() == 3


def test_cosines_are_those_of_the_space():
    """A region's rounded sum gives about the cosine of the vectors."""
    items = [some(n) for n in (12, 20, 45)]
    h, first = ld.text_words(pa.array([" ".join(some(30) + x + some(30)) for x in items]))
    idf = ld.weights(np.bincount(ld._slots(h), minlength=ld.SLOTS), 8)
    table = ld.word_vectors(np.linalg.qr(np.random.default_rng(1).standard_normal((ld.SLOTS, ld.DIMS)))[0].astype(np.float32), idf)
    index = ld.Index(table, [ld.item_of(i, " ".join(w)) for i, w in enumerate(items)])
    for d, i, cosine, *_ in index.search(h, first):
        own, size = table[ld._slots(np.array(index.items[i].words, np.uint64))].astype(float).sum(axis=0), index.items[i].blocks * ld.BLOCK
        windows = [table[ld._slots(h[a : a + size])].astype(float).sum(axis=0) for a in range(first[d], first[d + 1] - size + 1)]
        assert abs(max(w @ own / np.linalg.norm(w) / np.linalg.norm(own) for w in windows) - cosine) < 0.1


def search(texts, items):
    h, first = ld.text_words(pa.array(texts))
    made = [ld.item_of(i, " ".join(w)) for i, w in enumerate(items)]
    df = np.bincount(ld._slots(h), minlength=ld.SLOTS)
    idf = ld.weights(df, max(1, len(h) // ld.PASSAGE))
    table = ld.word_vectors(np.linalg.qr(np.random.default_rng(1).standard_normal((ld.SLOTS, ld.DIMS)))[0].astype(np.float32), idf)
    index = ld.Index(table, [x for x in made if x is not None])
    return {(d, index.items[i].item_id): (share, answered) for d, i, _, share, answered in index.search(h, first)}
