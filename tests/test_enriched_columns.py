"""The enriched fact by wanted columns: the same rows, no more than these columns."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from kestrel.operators import features as fx
from kestrel.operators.joins import left_dimension_join, left_dimension_repeats
from kestrel.plans import feature_queries as fq
from kestrel.plans import modeling_queries as mq


def _tables(spark, folder):
    """Lines, orders and dimensions with repeated, missing and null keys."""
    frames = {
        "lineitem": ([(1, 1, 1, 1, 5.0, 10.0, 0.1, 0.0, "N", "O"), (1, 2, 1, 2, 1.0, 20.0, 0.0, 0.0, "N", "O"), (2, 3, 1, 1, 2.0, 30.0, 0.0, 0.0, "R", "F"),
                      (2, None, 1, 2, 2.0, 30.0, 0.0, 0.0, "R", "F"), (3, 2, 1, 1, None, 40.0, 0.0, 0.0, "R", "F"), (3, 9, 1, 2, 7.0, None, 0.0, 0.0, "A", "F")],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"),
        "orders": ([(1, 1, "1995-01-01"), (2, 2, "1996-05-05"), (3, None, "1998-02-02"), (3, 7, "1998-02-03")], "o_orderkey long, o_custkey long, o_orderdate string"),
        "customer": ([(1, "a", 0, "X"), (2, "b", 1, "Y"), (2, "c", 0, "Z"), (None, "d", 0, "Q")], "c_custkey long, c_name string, c_nationkey int, c_mktsegment string"),
        "nation": ([(0, "N0"), (1, "N1")], "n_nationkey int, n_name string"),
        "part": ([(1, "p", "T1", 9.5), (2, "q", "T2", 1.25), (2, "r", "T1", 3.0), (None, "s", "T2", 3.0)], "p_partkey long, p_name string, p_type string, p_retailprice double"),
    }
    for name, (rows, schema) in frames.items():
        df = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            df = df.withColumn("l_shipdate", F.lit("1998-01-01"))
        if name == "orders":
            df = df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_wanted_columns_keep_every_row(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    lines = fq.ss.order_lines(spark, sf)
    whole = fx.enrich_orders(lines, fq.ss.customers(spark, sf), fq.ss.products(spark, sf), fq.ss.dates(spark, sf), fq.RUN_DATE)
    rows = lambda df, cols: Counter(tuple(r) for r in df.select(*cols).collect())
    assert rows(fq._enriched(spark, sf), fq.STAR_COLS) == rows(whole, fq.STAR_COLS)  # customers met the orders first
    for cols in (["order_date", "revenue"], ["product_category"], ["customer_id", "product_price"], ["segment", "quantity"], ["year", "product_id"]):
        some = fq._enriched(spark, sf, columns=cols)
        assert some.columns == cols
        assert rows(some, cols) == rows(whole, cols)


def test_repeats_are_those_of_the_join(spark):
    fact = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (5, "e")], "k long, v string")
    dim = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (None, 0), (None, 1)], "k long, x int")
    want = Counter(tuple(r) for r in left_dimension_join(fact, dim, "k", ["x"]).select("k", "v").collect())
    assert Counter(tuple(r) for r in left_dimension_repeats(fact, dim, "k").collect()) == want
    assert left_dimension_repeats(fact, dim.where("k = 2"), "k") is fact


def test_queries_write_only_what_they_read(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path)
    written = []
    from kestrel import session
    monkeypatch.setattr(session, "materialize_if_large", lambda df, name="": written.append(df.columns) or df)
    mq.class_weights(spark, sf).collect()
    mq.revenue_drift_psi(spark, sf).collect()
    mq.baseline_accuracy(spark, sf).collect()
    assert written == [["product_category"], ["order_date", "revenue"], ["order_date", "product_category"]]
