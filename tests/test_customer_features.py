"""Customer features by one shuffle: the same as plain windows, large customers
spread over their days, and no more moves of the rows than that."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF0001
from kestrel.operators import features as fx
from kestrel.operators.joins import has_repeats
from kestrel.plans import feature_queries as fq
from kestrel.sources import starschema as ss

ALL = fq.HISTORY_COLS + ["days_since_first_order", "days_since_last_order", "order_frequency_days",
                         "customer_category_purchase_count", "customer_purchased_this_category_before"]


def _odd(spark):
    """Lines of which a third are one customer's, some no customer's; products, categories and dates are missing."""
    e = fq._enriched(spark, SF0001, materialize=False)
    e = e.withColumn("customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(-1)).when(F.col("order_id") % 10 != 1, F.col("customer_id")))
    e = e.withColumn("product_category", F.when(F.col("order_id") % 7 != 0, F.col("product_category")))
    e = e.withColumn("order_date", F.when(F.col("order_id") % 13 != 0, F.col("order_date")))
    return e.withColumn("revenue", F.when(F.col("order_id") % 5 != 0, F.col("revenue"))).drop("country", "segment")


@pytest.mark.parametrize("bits", [20, 9, 2])
def test_features_equal_plain_windows_whatever_is_large(spark, bits):
    e = spark.createDataFrame(_odd(spark).collect(), _odd(spark).schema)
    large = fx.large_slots(e, 1 << bits)
    assert {20: len(large) == 0, 9: 0 < len(large) < 5, 2: len(large) > 50}[bits]
    fast = fx.customer_features(e, ss.ORDER_KEYS, fq.RUN_DATE, order_bucket_bits=bits)
    slow = fx.category_affinity(fx.customer_recency(fx.prior_customer_history(e, ss.ORDER_KEYS, False), fq.RUN_DATE), ss.ORDER_KEYS, False)
    a, b = fast.select(*e.columns, *ALL), slow.select(*e.columns, *ALL)
    assert a.count() == e.count()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_rows_of_ordinary_customers_move_once(spark):
    e = fq._enriched(spark, SF0001, materialize=False)
    e = spark.createDataFrame(e.collect(), e.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fx.customer_features(e, ss.ORDER_KEYS, fq.RUN_DATE)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(customer_id", plan)) == len(re.findall(r"Exchange ", plan)) == 1
    assert "Join" not in plan


def test_place_stands_for_the_columns_that_break_ties(spark):
    lines = ss.placed_lines(ss.order_lines(spark, SF0001))
    by = lambda keys: F.row_number().over(Window.partitionBy("customer_id").orderBy(*keys))
    both = lines.select(by(ss.ORDER_KEYS).alias("a"), by(ss.SHORT_KEYS).alias("b"))
    assert both.count() == 6000 and both.where("a != b").isEmpty()


def test_repeated_products_are_not_counted_as_purchases(spark):
    """Products of two prices: their rows repeat after the customer's are counted."""
    one = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (None, 0), (None, 1)], "k long, x int")
    assert has_repeats(one, "k") and not has_repeats(one.where("x = 0"), "k")
    products = ss.products(spark, SF0001)
    twice = products.unionByName(products.where("product_id % 5 = 0").withColumn("price", F.col("price") + 1))
    given = ss.order_lines(spark, SF0001), ss.customers(spark, SF0001), twice, ss.dates(spark, SF0001)
    fast, slow = (fx.feature_table(*given, fq._opts(split)) for split in (True, False))
    columns = ["customer_id", "product_id", "quantity", "product_total_sales", "customer_total_orders"]
    rows = [Counter(tuple(r) for r in f.select(*columns).collect()) for f in (fast, slow)]
    assert rows[0] == rows[1] and sum(rows[0].values()) > 6000


@pytest.mark.parametrize("again", [False, True])
def test_dimensions_that_join_late_give_the_same_table(spark, again, monkeypatch):
    """Customers and dates join where rows lie by customer, large customers or not;
    where customers repeat they join first, so that their rows repeat in all sums."""
    written = []
    from kestrel import session
    monkeypatch.setattr(session, "cut_lineage", lambda df, name="", compression=None, was=session.cut_lineage: written.append(df.columns) or was(df, name, compression))
    customers = ss.customers(spark, SF0001).where("customer_id % 9 != 0")
    if again:
        customers = customers.unionByName(customers.where("customer_id % 4 = 0"))
    lines = ss.order_lines(spark, SF0001).withColumn("customer_id", F.when(F.col("order_id") % 10 != 1, F.col("customer_id")))
    given = lines, customers, ss.products(spark, SF0001), ss.dates(spark, SF0001)
    tables = [fx.feature_table(*given, fx.FeatureOptions(fq.RUN_DATE, list(ss.ORDER_KEYS), skew_split=split, order_bucket_bits=bits))
              for split, bits in ((True, 20), (True, 2), (False, 20))]
    # plain windows flag ties of repeats alike, and have other last decimals of squares
    other = {"customer_unique_products", "customer_unique_categories", "customer_revenue_std"} if again else set()
    columns = [c for c in tables[0].columns if c not in other]
    rows = [Counter(tuple(r) for r in t.select(*columns).collect()) for t in tables]
    assert rows[0] == rows[1] == rows[2] and (sum(rows[0].values()) > 6000) == again
    assert tables[0].columns == tables[2].columns
    late = {"country", "segment", "year", "month", "quarter", "days_since_order"}
    assert [late <= set(c) for c in written] == [again, again, True] and (again or not late & {*written[0], *written[1]})
