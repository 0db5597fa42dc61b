"""As-of joins and the feature time check against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kestrel.operators import asof, features as fx
from kestrel.operators import governance as gv


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("forward", [True, False])
def test_asof_join_equals_brute_force(spark, strict, forward):
    rng = random.Random(9)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 6))  # noqa: E731  many ties
    left = [(rng.choice(["hot", "hot", "hot", "a", None]), None if rng.random() < 0.05 else at(), i) for i in range(300)]
    right = [(rng.choice(["hot", "a", "b", None]), None if rng.random() < 0.05 else at(), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(120)]
    l = spark.createDataFrame(left, "k string, lt timestamp, i int")  # noqa: E741
    r = spark.createDataFrame(right, "k string, rt timestamp, v double")
    got = {x.i: (x.rt, x.v) for x in asof.asof_join(l, r, "k", "lt", "rt", ["v"], strict, forward).collect()}
    assert len(got) == len(left)
    for k, t, i in left:
        found = [(x, v) for key, x, v in right if key == k and x is not None and t is not None
                 and ((x > t if strict else x >= t) if forward else (x < t if strict else x <= t))]
        want = (None, None)
        if found:
            best = (min if forward else max)(x for x, _ in found)
            want = (best, max((v for x, v in found if x == best), key=lambda v: (v is not None, v or 0)))
        assert got[i] == want, (k, t, i)


def test_planted_leaks_are_found(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    history = spark.createDataFrame([("u", day(1), 1.0), ("u", day(3), 3.0), ("w", day(9), 9.0)], "k string, t timestamp, v double")
    used = [("u", day(4), day(3), 3.0, "ok"), ("u", day(3), day(3), 3.0, "leak"), ("u", day(2), day(3), 3.0, "leak"), ("u", day(4), day(1), 1.0, "stale"),
            ("u", day(4), day(3), 5.0, "changed"), ("u", day(4), None, None, "missing"), ("w", day(2), None, None, "none"), ("z", day(2), day(1), 1.0, "stale")]
    df = spark.createDataFrame(used, "k string, lt timestamp, used_time timestamp, used_value double, want string")
    assert all(r.status == r.want for r in asof.feature_time_check(df, history, "k", "lt", "t", "v").collect())


def test_lines_without_a_customer_are_a_customers(spark):
    rows = [(c, d, i, 10 + (i % 2), "x" if i % 3 else "y", 2.0, 5.0 + i, 1.0) for i, (c, d) in enumerate([(None, "2024-01-01"), (None, "2024-01-02"), (None, "2024-01-03"), (7, "2024-01-02"), (7, "2024-01-05")])]
    e = spark.createDataFrame(rows, "customer_id long, order_date string, order_id long, product_id long, product_category string, quantity double, revenue double, product_price double")
    e = e.withColumn("order_date", F.to_date("order_date"))
    keys = ["order_date", "order_id"]
    got = {r.order_id: r for r in fx.customer_features(e, keys, "2024-02-01").collect()}
    assert [got[i].customer_total_orders for i in range(5)] == [0, 1, 2, 0, 1]
    assert [got[i].customer_unique_products for i in range(5)] == [0, 1, 2, 0, 1]
    assert all(str(got[i].first_order_date) == "2024-01-01" for i in range(3))
    plain = {r.order_id: r for r in fx.customer_recency(fx.prior_customer_history(e, keys), "2024-02-01").collect()}
    for i in range(5):
        for c in ("customer_total_orders", "customer_total_revenue", "customer_unique_products", "customer_unique_categories", "first_order_date", "days_since_last_order", "order_frequency_days"):
            assert got[i][c] == plain[i][c], (i, c)


def test_grants_are_read_from_the_texts(spark):
    jobs = spark.createDataFrame([("r", "c.s.orders"), ("r", "c.s.orders_x"), ("r2", "c.s.orders")], "run_id string, table_name string")
    art = spark.createDataFrame([("r", "a.py", "x GRANT SELECT ON TABLE c.s.orders_x TO y; GRANT SELECT ON TABLE `c`.`s`.`orders` TO z"), ("r2", "a.yml", "GRANT SELECT ON TABLE c.s.orders")], "run_id string, filename string, content string")
    assert [(r.run_id, r.table_name) for r in gv.missing_grants(jobs, art).collect()] == [("r2", "c.s.orders")]
