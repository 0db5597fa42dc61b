"""Running aggregates: split and plain strategies against a brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators.ordering import frequency_index, global_ordinal
from kestrel.operators.windows import prior_frame, prior_last

SPECS = {"n": ("count", "v"), "s": ("sum", "v"), "a": ("avg", "v"), "sd": ("std", "v"),
         "mx": ("max", "v"), "mn": ("min", "v")}


def _rows():
    rnd = random.Random(7)
    rows = []
    # one hot key with a third of the rows, ties on the bucket column, NULLs
    for i in range(600):
        k = 0 if i % 3 == 0 else rnd.randint(1, 20)
        d = rnd.randint(1, 15)
        v = None if rnd.random() < 0.1 else round(rnd.uniform(-50, 500), 2)
        rows.append((k, d, i, v))
    return rows


def _brute(rows, include_current):
    out = {}
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for k, rs in by.items():
        for j, r in enumerate(rs):
            frame = rs[: j + 1] if include_current else rs[:j]
            vs = [x[3] for x in frame if x[3] is not None]
            n = len(vs)
            s = round(sum(vs), 2) if vs else None
            sd = None
            if n > 1:
                m = sum(vs) / n
                sd = math.sqrt(sum((x - m) ** 2 for x in vs) / (n - 1))
            out[r[2]] = (n, s, (sum(vs) / n) if n else None, sd, max(vs) if vs else None, min(vs) if vs else None)
    return out


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("include_current", [False, True])
def test_prior_frame_matches_brute_force(spark, split, include_current):
    rows = _rows()
    df = spark.createDataFrame(rows, "k int, d int, i int, v double")
    got = {r.i: r for r in prior_frame(df, ["k"], ["d", "i"], SPECS, skew_split=split,
                                       include_current=include_current).collect()}
    exp = _brute(rows, include_current)
    assert len(got) == len(rows)
    for i, (n, s, a, sd, mx, mn) in exp.items():
        g = got[i]
        assert g.n == n
        assert (g.s is None) == (s is None) and (s is None or abs(g.s - s) < 1e-6)
        assert (g.a is None) == (a is None) and (a is None or abs(g.a - a) < 1e-6)
        assert (g.sd is None) == (sd is None) and (sd is None or abs(g.sd - sd) < 1e-5)
        assert g.mx == mx and g.mn == mn


def test_split_and_plain_are_bit_identical(spark):
    df = spark.createDataFrame(_rows(), "k int, d int, i int, v double")
    a = prior_frame(df, ["k"], ["d", "i"], SPECS, skew_split=False).orderBy("i").collect()
    b = prior_frame(df, ["k"], ["d", "i"], SPECS, skew_split=True).orderBy("i").collect()
    assert a == b


def test_prior_last_split_equals_lag(spark):
    df = spark.createDataFrame(_rows(), "k int, d int, i int, v double")
    a = prior_last(df, ["k"], ["d", "i"], "i", "prev", skew_split=True).select("i", "prev").orderBy("i").collect()
    b = prior_last(df, ["k"], ["d", "i"], "i", "prev", skew_split=False).select("i", "prev").orderBy("i").collect()
    assert a == b


def test_global_ordinal_is_dense_and_ordered(spark):
    vals = [(random.Random(i).randint(0, 10_000), i) for i in range(2000)]
    df = spark.createDataFrame(vals, "x int, i int").repartition(7)
    got = global_ordinal(df, ["x", "i"], "o").select("x", "i", "o").collect()
    exp = sorted(vals)
    assert sorted(r.o for r in got) == list(range(len(vals)))
    pos = {(r.x, r.i): r.o for r in got}
    assert [pos[v] for v in exp] == list(range(len(vals)))


def test_frequency_index_matches_string_indexer_order(spark):
    from pyspark.ml.feature import StringIndexer
    rows = [(v,) for v in [10, 9, 9, 100, 100, 100, 7, 8, 8, 10]]
    df = spark.createDataFrame(rows, "p long")
    ours = {r.p: r.p_label for r in frequency_index(df, "p").collect()}
    model = StringIndexer(inputCol="p", outputCol="lab").fit(df.withColumn("p", F.col("p").cast("string")))
    theirs = {int(v): float(i) for i, v in enumerate(model.labels)}
    assert ours == theirs


def test_stddev_keeps_digits_at_a_large_mean_and_null_keys_form_a_group(spark):
    rows = [(1, 1, 0, 1e9), (1, 2, 1, 1e9 + 0.01), (1, 3, 2, 1e9 + 0.02), (None, 1, 3, 1.0), (None, 2, 4, 2.0), (None, 3, 5, 4.0)]
    df = spark.createDataFrame(rows, "k long, d long, i long, x double")
    specs = {"sd": ("std", "x"), "n": ("count", "x")}
    split, plain = ([tuple(r) for r in prior_frame(df, ["k"], ["d", "i"], specs, skew_split=s, include_current=True).orderBy("i").collect()] for s in (True, False))
    assert split == plain
    assert split[2][4] == 0.01 and [r[5] for r in split[3:]] == [1, 2, 3]
