"""Exact order statistics and fitted transforms against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kestrel.functions.scalars import unique_names
from kestrel.operators import quantiles as qt
from kestrel.plans import fitted

SHARES = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def brute(values, share):
    v = sorted(x for x in values if x is not None and not math.isnan(x))
    at = share * (len(v) - 1)
    a, b = v[int(at)], v[min(int(at) + 1, len(v) - 1)]
    return v[max(0, math.ceil(len(v) * share) - 1)], a if a == b else a * (1 - (at - int(at))) + b * (at - int(at))


@pytest.mark.parametrize("buckets", [2, 4096])
def test_quantiles_are_exact(spark, monkeypatch, buckets):
    monkeypatch.setattr(qt, "BUCKETS", buckets)
    rng = random.Random(buckets)
    n = 300
    cols = {
        "plain": [rng.gauss(0, 10) for _ in range(n)],
        "hot": [7.0 if rng.random() < 0.6 else rng.random() * 1e6 for _ in range(n)],  # one value of most rows
        "holes": [None if rng.random() < 0.3 else math.nan if rng.random() < 0.2 else float(rng.randrange(5)) for _ in range(n)],
        "one": [3.5] * n,
        "ends": [rng.choice([-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1.0]) for _ in range(n)],
        "none": [None] * n,
    }
    if buckets == 2:
        del cols["ends"]  # a bisection of all doubles: right, but a thousand rounds
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(3)
    got = qt.quantiles(df, list(cols), SHARES)
    for c, values in cols.items():
        if c == "none":
            assert got[c] is None
        else:
            assert got[c] == [pytest.approx(brute(values, s), rel=1e-12) for s in SHARES], c


def test_a_fit_is_applied_to_other_rows(spark, tmp_path):
    train = spark.createDataFrame([("a", "x", 1.0, "yes"), ("a", "y-z", None, "no"), ("b", "y z", 4.0, "no"), (None, "x", float("nan"), None), ("c", "x", 2.0, "no")],
                                  "k string, h string, v double, t string")
    plan, target = [("k", "label_encode"), ("h", "one_hot"), ("v", "impute_median")], ("t", "label_encode")
    fitted.save(fitted.fit(train, plan, target), str(tmp_path / "fit"))
    table = fitted.load(spark, str(tmp_path / "fit"))
    other = spark.createDataFrame([(1, "c", "y z", 9.0, "no"), (2, "new", "w", None, "maybe"), (3, None, None, float("nan"), None), (4, "a", "y-z", 0.0, "yes")],
                                  "i long, k string, h string, v double, t string")
    got = {r.i: r for r in fitted.apply(other, table, plan, "2020-01-01", ("i",), target).collect()}
    assert {i: r.k_label for i, r in got.items()} == {1: 2.0, 2: 3.0, 3: 3.0, 4: 0.0}  # not seen: after the last
    assert {i: r.v for i, r in got.items()} == {1: 9.0, 2: 2.0, 3: 2.0, 4: 0.0}
    assert {i: (r.h_x, r.h_y_z, r.h_y_z_2) for i, r in got.items()} == {1: (0, 1, 0), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 1)}
    assert {i: r.target for i, r in got.items()} == {1: 0.0, 2: None, 3: None, 4: 1.0}
    assert len(set(fitted.apply(other, table, plan, "2020-01-01").columns)) == 5
    with pytest.raises(ValueError):
        fitted.one_hot_columns(table, "h", 2)


def test_names_that_meet_stay_apart():
    assert unique_names(["a_b", "a_b", "c", "a_b", "a_b_2"]) == ["a_b", "a_b_3", "c", "a_b_4", "a_b_2"]


def test_colliding_one_hot_values_keep_their_rows(spark):
    from kestrel.operators.features import onehot_columns
    df = spark.createDataFrame([("A B", 1, 1), ("A-B", 2, 1), ("C", 3, 2)], "c string, month int, quarter int")
    row = df.select("c", *onehot_columns(df, [("c", "c")], 50)).agg(*[F.sum(n).alias(n) for n in ("c_A_B", "c_A_B_2", "c_C")]).first()
    assert tuple(row) == (1, 1, 1)
