"""Hard negatives against brute force and the query's SQL."""

import math
import random
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from conftest import SF001
from kestrel.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"
WIDE = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3):
    """rows: (vec_id, embedding, label)."""
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i % 7 == 0 else label
        whole = [math.floor(256 * Fraction(x)) for x in v]
        kept[i] = min(kept.get(i, (label, whole)), (label, whole))
    out = set()
    for a, (label, v) in kept.items():
        if a % every:
            continue
        score = lambda w: sum(x * y for x, y in zip(v, w))
        all_rows = sorted((-score(w), i, own) for i, (own, w) in kept.items() if i != a)
        for s, p, own in [r for r in all_rows if r[2] == label][:positives]:
            inside = [r for r in all_rows if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s]
            out |= {(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(inside[:negatives])}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_sql_and_brute_force_agree_on_the_table(spark):
    found = result(hn.op13_hard_negatives(spark, SF001))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF001}/embeddings.parquet')")
    assert found == set(con.execute(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({hn.ORACLE_SQL})").fetchall())
    assert found and found == brute(con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall())


def clustered(seed, n=900, width=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width)) * 2
    rows = [(int(i), [float(np.float32(x)) for x in centres[rng.integers(8)] + rng.normal(size=width) * 0.2], int(rng.integers(4))) for i in rng.permutation(n) - 20]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_odd_rows(spark, monkeypatch, small):
    if small:  # many cells, blocks and groups
        for name, value in {"BLOCK_ROWS": 64, "BLOCKS": 2, "ANCHORS": 10, "CELL_ROWS": 4, "SAMPLE": 200}.items():
            monkeypatch.setattr(hn, name, value)
    rows = clustered(1)
    rows += [(2000 + i, rows[0][1], 1 + i % 2) for i in range(150)]  # copies: ties
    rows += [(5000, None, 1), (5050, [1.0], None), (None, rows[0][1], 1), (5100, [math.nan] * 6, 1), (5150, [math.inf] * 6, 2), (5200, [None] * 6, 1)]
    rows += [(6000, [], 1), (6050, rows[1][1] + [0.5], 2), (6100, rows[2][1][:3], 3), (6150, [0.0] * 6, 77), (6200, rows[5][1], -1)]
    rows += [rows[3], rows[3], (50, rows[7][1], 3), (50, rows[8][1], 2)]  # repeated, and one id with several rows
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "vector", "block", "part", "group", "score", "rank", "n", "cells", "one", "two")})
    assert result(hn.hard_negatives(df)) == brute(rows)
    if small:
        assert result(hn.hard_negatives(df, 7, 2, 1)) == brute(rows, 7, 2, 1)


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    for scale in (300.0, 2.0**22, 2.0**27, 1e12):
        rows = [(i, [rng.choice([-1, 1, 1, 1]) * rng.random() * scale / 256 for _ in range(5)], rng.randrange(3)) for i in range(0, 300, 5)]
        rows = [(i, [max(-(2.0**22), min(x, 2.0**22)) for x in v], label) for i, v, label in rows]
        assert result(hn.hard_negatives(spark.createDataFrame(rows, WIDE))) == brute(rows)
    far = [(i, [1e38, -1e300, float(i)], i % 3) for i in range(60)] + [(100, [1e308] * 3, 1)]
    assert hn.hard_negatives(spark.createDataFrame(far, WIDE)).count() >= 0  # beyond a long: no crash


def test_walk_gives_every_cell_once_from_the_highest_bound_down():
    rng = np.random.default_rng(3)
    bounds = [rng.integers(0, 9, 12).astype(float), rng.integers(0, 9, 9).astype(float)]
    cells = {(int(a), int(b)): k for k, (a, b) in enumerate({(rng.integers(12), rng.integers(9)) for _ in range(70)})}
    got = list(hn.walk(bounds, cells))
    assert sorted(c for _, c in got) == sorted(cells.values())
    assert [b for b, _ in got] == sorted((bounds[0][i] + bounds[1][j] for i, j in cells), reverse=True)


def test_bounds_leave_cells_out_where_vectors_have_clusters(monkeypatch):
    """The certified stop: with clusters most rows are never scored."""
    rng = np.random.default_rng(4)
    books = [rng.normal(size=(16, 8)) * 300, rng.normal(size=(16, 8)) * 300]
    n = 4000
    codes = rng.integers(16, size=(n, 2))
    x = np.floor(np.hstack([books[0][codes[:, 0]], books[1][codes[:, 1]]]) + rng.normal(size=(n, 16)) * 5)
    cell = codes[:, 0].astype(np.int64) << 32 | codes[:, 1]
    row = {"n": n, "ids": np.arange(n).tobytes(), "labels": (np.arange(n) % 3).tobytes(), "cells": cell.tobytes(), "vectors": x.tobytes()}
    block, seen = hn.Block(row, books, 16), []
    add = hn.Best.add
    monkeypatch.setattr(hn.Best, "add", lambda self, scores, ids: (seen.append(len(ids)), add(self, scores, ids))[1])
    anchors = [{"id": i, "label": i % 3, "best": [hn.Best(5, i, 0)]} for i in range(0, n, 100)]
    hn.search(block, anchors, x[[a["id"] for a in anchors]], True)
    score = x @ x.T
    for a in anchors:
        want = sorted((-score[a["id"], j], j) for j in range(n) if j != a["id"] and j % 3 == a["label"])[:5]
        assert [(-s, i) for s, i in zip(a["best"][0].scores, a["best"][0].ids)] == want
    assert sum(seen) < 0.5 * len(anchors) * n / 3


def test_empty_table(spark):
    assert hn.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(50, [1.0, 2.0], 1)], SCHEMA)).collect() == []
    assert hn.hard_negatives(spark.createDataFrame([(51, [1.0, 2.0], 1), (52, [1.0, 2.0], 2)], SCHEMA)).collect() == []
