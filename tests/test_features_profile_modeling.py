"""Feature invariants, profiling and metrics against brute force."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from kestrel.operators import features as fx
from kestrel.operators import modeling as md
from kestrel.operators import profile as pr
from kestrel.plans import feature_queries as fq
from kestrel.sources import starschema as ss


def test_feature_table_keeps_every_line(spark):
    lines = ss.order_lines(spark, SF0001).count()
    ft = fq.feature_table(spark, SF0001)
    assert ft.count() == lines
    assert ft.where((F.col("customer_id_hash") < 0) | (F.col("customer_id_hash") >= 100)).count() == 0
    assert len(ft.columns) == len(set(ft.columns))          # no duplicated column (B2)


def test_prior_features_ignore_later_rows(spark):
    """No leakage: adding rows dated after a line leaves its prior features."""
    e = fq._enriched(spark, SF0001)
    cut = F.lit("1998-01-01").cast("date")
    early = e.where(F.col("order_date") < cut)
    cols = ["order_id", "line_number", "product_id", "supplier_id", "quantity", "extended_price", "discount",
            "tax", "return_flag", "line_status", "ship_date"] + fq.HISTORY_COLS
    a = fx.prior_customer_history(early, ss.ORDER_KEYS, True).select(*cols)
    b = fx.prior_customer_history(e, ss.ORDER_KEYS, True).where(F.col("order_date") < cut).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_onehot_bound_fails_loudly(spark):
    df = spark.createDataFrame([(str(i),) for i in range(30)], "c string")
    with pytest.raises(ValueError):
        fx.onehot_values(df, "c", 20)


def test_column_profile_counts(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "bb", 1.5), (2, None, 2.5)], "k int, s string, x double")
    p = {r.column_name: r for r in pr.column_profile(df, "t").collect()}
    assert p["k"].distinct_count == 2 and p["k"].null_count == 0 and p["k"].max_value == 2.0
    assert p["s"].null_count == 1 and p["s"].max_length == 2
    assert p["x"].null_count == 1 and p["x"].min_value == 1.5


def test_relationships_found_on_testdata(spark):
    from kestrel.sources import catalog as cat
    r = pr.relationship_candidates(spark, SF0001, cat.parquet_columns(spark, SF0001))
    fks = {(x.child_table, x.child_column, x.parent_table) for x in r.where("is_foreign_key").collect()}
    assert ("lineitem", "l_orderkey", "orders") in fks and ("orders", "o_custkey", "customer") in fks


def _auc_brute(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_binary_auc_matches_pairwise(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 1)) for _ in range(400)]   # many ties
    got = md.binary_auc(spark.createDataFrame(pairs, "y int, s double"), "y", "s").first().auc
    assert abs(got - _auc_brute(pairs)) < 1e-12


def test_top_k_and_weighted_auc(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        p = [rnd.random() for _ in range(4)]
        t = sum(p)
        rows.append((rnd.randint(0, 3), [x / t for x in p]))
    df = spark.createDataFrame(rows, "label int, probability array<double>")
    top2 = md.top_k_accuracy(df, (2,)).first().top2_accuracy
    exp = sum(1 for y, p in rows if y in sorted(range(4), key=lambda i: -p[i])[:2]) / len(rows)
    assert abs(top2 - exp) < 1e-12
    w = md.weighted_ovr_auc(df).first().weighted_auc
    aucs = [_auc_brute([(1 if y == c else 0, p[c]) for y, p in rows]) for c in range(4)]
    sup = [sum(1 for y, _ in rows if y == c) for c in range(4)]
    assert abs(w - round(sum(a * s for a, s in zip(aucs, sup)) / sum(sup), 6)) < 1e-9


def test_stratified_split_exact_per_class(spark):
    rows = [(i, 0 if i % 10 else 1) for i in range(1000)]
    s = md.stratified_split(spark.createDataFrame(rows, "id int, y int"), "y", ["id"])
    got = {(r.y, r.split): r.c for r in s.groupBy("y", "split").agg(F.count("*").alias("c")).collect()}
    assert got == {(0, "train"): 720, (0, "test"): 180, (1, "train"): 80, (1, "test"): 20}


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "c string")
    w = {r.c: r.weight for r in md.balanced_class_weights(df, "c").collect()}
    assert w == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}


def test_psi_zero_for_same_distribution(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    assert md.psi(df, df, "x").first().psi == 0.0
    shifted = spark.createDataFrame([(float(i) + 50,) for i in range(100)], "x double")
    assert md.psi(df, shifted, "x").first().psi > 0.5


def test_rmse_and_accuracy(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 2.0)], "y double, p double")
    assert md.rmse(df, "y", "p").first().rmse == round(math.sqrt((1 + 0 + 9) / 3), 6)
    assert md.accuracy(df, "y", "p").first().accuracy == pytest.approx(1 / 3)


def test_single_shuffle_customer_features_equal_plain_windows_with_hot_customer(spark):
    e = fq._enriched(spark, SF0001)
    # a third of the rows move to one customer
    e = e.withColumn("customer_id", F.when(F.col("order_id") % 3 == 0, F.lit(-1)).otherwise(F.col("customer_id")))
    # and some lines lose their category (NULLs are not a distinct value)
    e = e.withColumn("product_category", F.when(F.col("order_id") % 7 == 0, F.lit(None).cast("string"))
                     .otherwise(F.col("product_category")))
    fast = fx.customer_features(e, ss.ORDER_KEYS, fq.RUN_DATE)
    slow = fx.category_affinity(fx.customer_recency(
        fx.prior_customer_history(e, ss.ORDER_KEYS, False), fq.RUN_DATE), ss.ORDER_KEYS, False)
    cols = ["order_id", "line_number", "product_id", "supplier_id", "quantity", "extended_price", "discount",
            "tax", "return_flag", "line_status", "ship_date", "customer_id"] + fq.HISTORY_COLS + [
        "days_since_first_order", "days_since_last_order", "order_frequency_days",
        "customer_category_purchase_count", "customer_purchased_this_category_before"]
    a, b = fast.select(*cols), slow.select(*cols)
    assert a.count() == b.count() == e.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_materialised_and_recomputed_inputs_give_equal_results(spark):
    a = fq.prior_customer_history(spark, SF0001)             # small input: recomputed
    spark.conf.set("kestrel.materialize.minBytes", "0")      # force the parquet materialisation
    try:
        b = fq.prior_customer_history(spark, SF0001)
        plan_a = a._jdf.queryExecution().executedPlan().toString()
        plan_b = b._jdf.queryExecution().executedPlan().toString()
        assert "lineitem.parquet" in plan_a and "lineitem.parquet" not in plan_b   # b reads the written table
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.unset("kestrel.materialize.minBytes")
    c = fx.feature_table(ss.order_lines(spark, SF0001), ss.customers(spark, SF0001), ss.products(spark, SF0001),
                         ss.dates(spark, SF0001), fq._opts(True), (), materialize=False)
    d = fq.feature_table(spark, SF0001)
    assert c.exceptAll(d).count() == 0 and d.exceptAll(c).count() == 0


def test_hot_customer_day_split_into_order_blocks(spark):
    """A third of the rows on one customer AND one day: with 16-order blocks
    the (customer, day) group is cut into many window tasks; results equal
    the plain windows."""
    e = fq._enriched(spark, SF0001, materialize=False)
    hot = F.col("order_id") % 3 == 0
    e = (e.withColumn("customer_id", F.when(hot, F.lit(-1)).otherwise(F.col("customer_id")))
          .withColumn("order_date", F.when(hot, F.lit("1996-06-01").cast("date")).otherwise(F.col("order_date"))))
    fast = fx.customer_features(e, ss.ORDER_KEYS, fq.RUN_DATE, order_bucket_bits=4)
    slow = fx.category_affinity(fx.customer_recency(
        fx.prior_customer_history(e, ss.ORDER_KEYS, False), fq.RUN_DATE), ss.ORDER_KEYS, False)
    cols = ["order_id", "line_number", "product_id", "supplier_id", "quantity", "extended_price", "discount",
            "tax", "return_flag", "line_status", "ship_date", "customer_id", "order_date"] + fq.HISTORY_COLS + [
        "days_since_first_order", "days_since_last_order", "customer_category_purchase_count"]
    a, b = fast.select(*cols), slow.select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_distinct_counts_take_no_row_once_for_each_column(spark):
    """Several count_distinct in one aggregation expand every row by the columns."""
    from kestrel.operators.profile import column_profile
    rows = [(1, "a", 0.0, [1], {"k": 1}), (1, None, -0.0, [1], {"k": 1}), (2, "b", float("nan"), [1, 2], None), (None, "b", float("nan"), None, {"k": 2})]
    df = spark.createDataFrame(rows, "i long, s string, x double, a array<int>, m map<string, int>")
    p = column_profile(df, "t")
    assert "Expand" not in p._jdf.queryExecution().optimizedPlan().toString()
    got = {r.column_name: (r.ordinal_position, r.row_count, r.null_count, r.distinct_count) for r in p.collect()}
    assert got == {"i": (1, 4, 1, 2), "s": (2, 4, 1, 2), "x": (3, 4, 0, 2), "a": (4, 4, 1, 2), "m": (5, 4, 1, 2)}
    assert {r.column_name: r.distinct_count for r in column_profile(df.limit(0), "t").collect()} == dict.fromkeys("isxam", 0)
