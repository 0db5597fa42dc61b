"""Quality rules, classifier, decontamination and LM scores."""

import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF0001
from kestrel.llm import latent_decontamination as ld
from kestrel.llm import ordinal_quality as oq
from kestrel.llm import quality_outliers as qo
from kestrel.llm import suffix_tree_lm as lm
from kestrel.llm.common import read

from .helpers import empty_docs, odd_docs

SF01 = "/root/testdata/sf0.1"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if twice[g] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_base_rules_match_brute_force(spark):
    for docs in (read(spark, SF0001, "documents"), odd_docs(spark)):
        rows = qo.quality_outliers(docs).collect()
        assert len(rows) == docs.count()
        texts = defaultdict(set)
        for r in docs.collect():
            texts[r.doc_id].add(base_counts(r.text))
        for r in rows:
            c = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert c in texts[r.doc_id]
            assert r.base_failed == (c[0] < 10 or 100 * c[4] > 20 * c[0])
            assert not (r.base_failed and r.kept)
    assert qo.quality_outliers(empty_docs(spark)).count() == 0


def test_outliers_are_the_bad_ones(spark):
    rows = qo.quality_outliers(read(spark, SF001, "documents")).join(read(spark, SF001, "labels"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_estimate_resists_contamination(spark, monkeypatch):
    """A quarter of gross outliers does not move the centre, nor hide behind the spread."""
    rng = np.random.default_rng(0)
    x = rng.normal(0.5, 0.05, (4000, qo.P))
    x[:800] = rng.normal(1.4, 0.01, (800, qo.P))
    rows = [(i, "g", *map(float, v)) for i, v in enumerate(x)]
    stats = spark.createDataFrame(rows, ["doc_id", "scope", *(f"x{i}" for i in range(qo.P))])
    estimate = qo.cut_lineage(qo.start(stats), "t")
    for _ in range(qo.STEPS):
        estimate = qo.cut_lineage(qo.step(stats, estimate), "t")
    e = estimate.first()
    assert all(abs(e[f"m{i}"] - 0.5) < 0.02 for i in range(qo.P))
    d = qo.distances(stats, estimate).select("doc_id", "d2").collect()
    cut = qo.chi2_quantile(qo.COVERED, qo.P)
    assert all(r.d2 > cut for r in d if r.doc_id < 800) and np.mean([r.d2 <= cut for r in d if r.doc_id >= 800]) > 0.99


def test_steps_reach_the_exact_estimate_of_small_groups(spark):
    """Against all subsets: the one of the least determinant is what the steps end
    at, with nothing to be drawn toward."""
    from itertools import combinations

    rng = np.random.default_rng(4)
    columns = ["doc_id", "scope", *(f"x{i}" for i in range(qo.P))]
    rows, want = [], {}
    for g in range(4):
        x = rng.normal(0.5, 0.1, (12, qo.P))
        x[:3] += rng.choice([-1, 1], (3, qo.P)) * 1.5  # a quarter far out
        rows += [(100 * g + i, f"g{g}", *map(float, v)) for i, v in enumerate(x)]
        floor = np.diag(np.square(qo.FLOOR))
        best = min(combinations(range(12), 9), key=lambda c: np.linalg.det(np.cov(x[list(c)].T, bias=True) + floor))
        want[f"g{g}"] = (x[list(best)].mean(0), np.cov(x[list(best)].T, bias=True))
    stats = spark.createDataFrame(rows, columns)
    estimate = qo.cut_lineage(qo.start(stats), "t")
    for _ in range(qo.STEPS):
        estimate = qo.cut_lineage(qo.step(stats, estimate, weight=0.0), "t")
    for r in estimate.collect():
        mean, cov = qo._moments(r.asDict())
        assert np.allclose(mean, want[r.scope][0], atol=1e-9) and np.allclose(cov, want[r.scope][1], atol=1e-9)


def test_groups_of_all_sizes_are_drawn_toward_the_wider_one(spark):
    """A group of n documents moves by n of n + WEIGHT parts; no size switches."""
    rng = np.random.default_rng(5)
    columns = ["doc_id", "scope", *(f"x{i}" for i in range(qo.P))]
    rows = []
    for n in (1, 150, 250, 3000):
        rows += [(0, f"n{n}", *map(float, v)) for v in rng.normal(0.9, 0.02, (n, qo.P))]
    stats = spark.createDataFrame(rows, columns)
    toward = spark.createDataFrame([{k: v if k == "scope" else float(v) for k, v in qo._whitened(f"n{n}", np.full(qo.P, 0.5), np.eye(qo.P) * 0.01).items()} for n in (1, 150, 250, 3000)]).select(*[x.split()[0] for x in qo.ESTIMATE.split(", ")])
    estimate = qo.cut_lineage(qo.start(stats), "t")
    for _ in range(qo.STEPS):
        estimate = qo.cut_lineage(qo.step(stats, estimate, toward), "t")
    got = {r.scope: qo._moments(r.asDict())[0][0] for r in estimate.collect()}
    for n in (1, 150, 250, 3000):
        near = np.ceil(qo.SUBSET * n)  # whole bins: a few more
        assert 0.5 + 0.4 * near / (near + qo.WEIGHT) - 0.03 < got[f"n{n}"] < 0.5 + 0.4 * n / (n + qo.WEIGHT) + 0.03


def test_verdicts_of_small_and_large_groups(spark):
    """Groups of 3 to 900 documents, one bad text in each: it goes, the others stay."""
    import random

    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, bad = [], set()
    for g, n in enumerate((3, 30, 190, 210, 900)):
        for k in range(n):
            i = len(rows)
            words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
            text = " ".join(w.capitalize() + "." if j % 12 == 0 else w for j, w in enumerate(words))
            if k == 0:
                bad.add(i)
                text = " ".join("#%$&" if j % 2 else w.upper() for j, w in enumerate(words))
            rows.append((i, text, "en", f"s{g}"))
    out = qo.quality_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id for r in out if not r.kept} == bad


def test_chi2_quantiles():
    assert abs(qo.chi2_quantile(0.5, 2) - 2 * math.log(2)) < 1e-9
    assert abs(qo.chi2_quantile(0.95, 1) - 3.841459) < 1e-5 and abs(qo.chi2_quantile(0.99, 7) - 18.475307) < 1e-5


# classifier


def test_held_out_documents_are_graded(spark):
    docs, labels = read(spark, SF01, "documents"), read(spark, SF01, "labels")
    model = oq.fit(oq.ratings(docs, labels.where("doc_id % 3 <> 0")), 3)
    rows = oq.grade(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    clean = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    rest = [r.kept for r in rows if not (r.quality == 1 and r.toxic == 0)]
    assert sum(clean) >= 0.95 * len(clean) and sum(rest) <= 0.1 * len(rest)
    assert all(0 <= r.tail_probability <= r.expected_grade <= 2 for r in rows)


def test_ordered_thresholds_and_gradients():
    rng = np.random.default_rng(0)
    n = 3000
    slot = rng.integers(0, 20, n)
    grade = np.clip((slot // 5 + rng.integers(-1, 2, n)), 0, 3)
    m = oq.fit_arrays(np.arange(n), slot.astype(np.uint32), grade, 4)
    assert (np.diff(m.thresholds) >= 0).all()
    w = dict(zip(m.slots.tolist(), m.weights))
    means = [np.mean([w.get(k, 0) for k in range(5 * j, 5 * j + 5)]) for j in range(4)]
    assert means == sorted(means) and means[3] - means[0] > 1


def test_select_odd_rows_and_no_labels(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = oq.fit(oq.ratings(docs, none), 3)
    assert oq.select(docs, model).count() == docs.count() and oq.select(docs, model).dtypes == docs.dtypes
    odd = spark.createDataFrame([(10, None, None), (11, 1, None), (11, 0, 1), (None, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int")
    model = oq.fit(oq.ratings(docs, odd), 3)
    assert oq.grade(docs, model).count() == docs.count()
    assert oq.grade(empty_docs(spark), model).count() == 0


def test_texts_are_judged_in_small_parts():
    """Eight megabytes of text in one batch: what they need at once, and the same scores."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"word{x}" for x in rng.integers(0, 5000, 160)) for _ in range(6000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    model = oq.Model(np.arange(0, oq.SLOTS, 3), np.linspace(-1, 1, len(range(0, oq.SLOTS, 3))), np.array([-0.5, 0.5]))
    tracemalloc.start()
    parts = list(oq.judged(iter([batch]), model, 0))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 8 << 20 and most < 120 << 20
    assert np.array_equal(np.concatenate([x for _, x in parts]), model.tails(model.scores(batch.column(0))))


# decontamination


def test_planted_passages_are_found(spark):
    docs, bench = read(spark, SF001, "documents"), read(spark, SF001, "benchmark")
    items = {r.item_id: " ".join(r.text.lower().split()) for r in bench.collect()}
    planted = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in " ".join(r.text.lower().split())}
    found = {(r.doc_id, r.item_id) for r in ld.leaks(docs, bench).collect()}
    assert len(planted) > 10 and len(planted - found) <= 0.02 * len(planted)
    assert len(found - planted) <= 2
    kept = {r.doc_id for r in ld.decontaminate(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_paraphrases_need_their_answer(spark):
    docs, bench = read(spark, SF001, "documents"), read(spark, SF001, "benchmark")
    clean = ld.decontaminate(docs, bench).where("n_chars > 500").limit(40).collect()
    item = max(bench.collect(), key=lambda r: len(r.text.split()))
    words = item.text.split()
    changed = [w if i % 4 else f"other{i}" for i, w in enumerate(words[:-5])]
    with_answer, without = [*changed, *words[-5:]], [*changed, "all", "of", "this", "is", "new"]
    rows = [(r.doc_id, r.text) for r in clean] + [(10**6, clean[0].text + " " + " ".join(with_answer) + " " + clean[1].text), (10**6 + 1, clean[2].text + " " + " ".join(without) + " " + clean[3].text)]
    found = {(r.doc_id, r.item_id): r for r in ld.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert (10**6, item.item_id) in found and found[10**6, item.item_id].answered
    assert (10**6 + 1, item.item_id) not in found


def test_common_subsequence_matches_the_table():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.integers(0, 6, 12).tolist(), rng.integers(0, 6, 20)
        index = ld.Index(np.ones((ld.SLOTS + 1, 4), np.float32), [ld.Item(0, a, a[-2:], 2)])
        t = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert index.common_length(0, b.astype(np.uint64)) == t[-1, -1]


def test_decontamination_odd_rows(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string")
    assert ld.decontaminate(docs, bench).dtypes == docs.dtypes
    assert ld.leaks(docs, bench.where("item_id < 4")).count() == 0
    assert ld.leaks(empty_docs(spark), bench).count() == 0 and ld.decontaminate(empty_docs(spark), bench).count() == 0


# suffix tree


def brute_scores(rows, depth2=True):
    """rows: (doc_id, text, held out). The same model with dictionaries."""
    texts = [(i, (t or "").encode().lower().split() + [None], bool(h)) for i, t, h in rows]
    c = Counter(w for _, t, h in texts if not h for w in t)
    n, v = sum(c.values()), len(c)
    one, two = defaultdict(Counter), defaultdict(Counter)
    for _, t, h in texts:
        if not h:
            for j in range(1, len(t)):
                one[t[j - 1]][t[j]] += 1
            for j in range(2, len(t)):
                two[t[j - 2], t[j - 1]][t[j]] += 1
    base = lambda x: (c[x] + 1) / (n + v + 1)
    coarse = lambda p: 2 ** (-min(255, max(0, round(-4 * math.log2(p)))) / 4)
    gain = lambda cs, p, k: sum(m * (math.log(m - 1 + lm.MASS * coarse(p(x))) - math.log(coarse(p(x)))) for x, m in cs.items()) - k * math.log(k - 1 + lm.MASS)
    kept1 = {s for s, cs in one.items() if c[s] >= lm.LEAST and gain(cs, base, c[s]) >= lm.GAIN}
    first = lambda s, x: (one[s][x] + lm.MASS * base(x)) / (c[s] + lm.MASS) if s in kept1 else base(x)
    kept2 = {s for s, cs in two.items() if s[0] in kept1 and s[1] in kept1 and one[s[0]][s[1]] >= lm.LEAST and gain(cs, lambda x, s=s: first(s[1], x), one[s[0]][s[1]]) >= lm.GAIN}
    out = []
    for i, t, h in texts:
        b = score = 0.0
        for j, x in enumerate(t):
            b += math.log10(base(x))
            p = first(t[j - 1], x) if j else base(x)
            if j > 1 and (t[j - 2], t[j - 1]) in kept2:
                p = (two[t[j - 2], t[j - 1]][x] + lm.MASS * p) / (one[t[j - 2]][t[j - 1]] + lm.MASS)
            score += math.log10(p)
        out.append((i, h, len(t), sum(c[x] > 0 for x in t), n, b, score))
    return out, len(kept1), len(kept2)


@pytest.mark.parametrize("split,block", [(lm.SPLIT, lm.BLOCK_BYTES), (200, 30_000)])
def test_scores_match_brute_force(spark, monkeypatch, split, block):
    monkeypatch.setattr(lm, "BLOCK_BYTES", block)
    docs = read(spark, SF0001, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    rows = {r.doc_id: r for r in lm.suffix_tree_scores(docs, held, split=split).collect()}
    want, one, two = brute_scores([(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs.collect()])
    assert one > 50 and two > 5 and len(rows) == len(want)
    for i, *exact, b, s in want:
        r = rows[i]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == exact
        assert r.base_score == pytest.approx(b, rel=1e-9) and r.score == pytest.approx(s, rel=1e-9)
    assert sum(r.score for r in rows.values() if r.held_out) > sum(r.base_score for r in rows.values() if r.held_out)


def test_scores_odd_rows(spark):
    docs = odd_docs(spark)
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    rows = lm.suffix_tree_scores(docs, F.col("doc_id") % 5 == 0).collect()
    want, _, _ = brute_scores([(r.doc_id, r.text, r.doc_id % 5 == 0) for r in docs.collect()])
    assert sorted(map(key, rows)) == sorted(map(key, want))
    assert lm.suffix_tree_scores(empty_docs(spark), F.lit(False)).count() == 0
    none = lm.suffix_tree_scores(docs, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == r.base_score == 0 for r in none)


def test_shape_features_of_no_texts():
    doc, slot = oq.features(pa.array(["", None]))
    assert len(doc) == 2 * len(oq.SHAPE)
