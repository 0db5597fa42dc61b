"""The star schema the feature job expects (orders fact, customers, products,
dates), mapped onto the given TPC-H-like tables.

order row      = lineitem ⋈ orders on orderkey (one row per line)
customer       = customer ⋈ nation: customer_id, customer_name, country, segment
product        = part: product_id, product_name, category (p_type), price
dates          = calendar rows of the order dates: date_id (yyyyMMdd), year, month, quarter

Line rows are not unique on (orderkey, linenumber); whole rows are. Every
ordered frame therefore orders by ``ORDER_KEYS``, which is a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions.scalars import date_id_of
from kestrel.operators.joins import bounded_broadcast
from kestrel.sources.tables import table

# Total order of order rows within a customer: date first, then every
# remaining column of the line.
ORDER_KEYS = [
    "order_date", "order_id", "line_number", "product_id", "supplier_id",
    "quantity", "extended_price", "discount", "tax", "return_flag",
    "line_status", "ship_date",
]

# The same order with the line's other columns replaced by its place in its order
# (``placed_lines``).
PLACE = "line_place"
SHORT_KEYS = ["order_date", "order_id", PLACE]

# Proven size bound of the nation dimension (25 rows in the TPC-H spec).
NATION_ROWS_MAX = 1000


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: key, customer and date."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"), F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("order_date"))


def order_lines(spark: SparkSession, sf_dir: str, heads: DataFrame | None = None) -> DataFrame:
    """Fact rows: one per line item, with the order's customer and date (and
    the other columns of ``heads``, by default ``order_heads``).

    revenue = extendedprice * (1 - discount), exact in DECIMAL then DOUBLE.
    Both inputs are large and keyed by orderkey: a shuffle join on orderkey
    (uniform key) that AQE may turn into a broadcast at small scale."""
    li = table(spark, sf_dir, "lineitem")
    od = order_heads(spark, sf_dir) if heads is None else heads
    rev = (F.col("l_extendedprice").cast("decimal(12,2)")
           * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
    return (li.join(od, li.l_orderkey == od.o_orderkey, "inner")
            .select(
                F.col("l_orderkey").alias("order_id"),
                F.col("l_linenumber").alias("line_number"),
                "customer_id",
                F.col("l_partkey").alias("product_id"),
                F.col("l_suppkey").alias("supplier_id"),
                date_id_of("order_date").alias("date_id"),
                "order_date",
                F.col("l_quantity").alias("quantity"),
                rev.cast("double").alias("revenue"),
                F.col("l_extendedprice").alias("extended_price"),
                F.col("l_discount").alias("discount"),
                F.col("l_tax").alias("tax"),
                F.col("l_returnflag").alias("return_flag"),
                F.col("l_linestatus").alias("line_status"),
                F.col("l_shipdate").alias("ship_date"),
                *[c for c in od.columns if c not in ("o_orderkey", "customer_id", "order_date")],
            ))


def placed_lines(lines: DataFrame) -> DataFrame:
    """Lines with their place among the lines of their order, by the rest of
    ``ORDER_KEYS``: with date and order it says what all of those say, and the
    columns that only break ties need not move any further. Lines lie by order
    where they have met their orders, so this moves none."""
    w = Window.partitionBy("order_id").orderBy(*ORDER_KEYS[2:])
    return lines.withColumn(PLACE, F.row_number().over(w))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = bounded_broadcast(table(spark, sf_dir, "nation"), NATION_ROWS_MAX)
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
            .select(F.col("c_custkey").alias("customer_id"),
                    F.col("c_name").alias("customer_name"),
                    F.col("n_name").alias("country"),
                    F.col("c_mktsegment").alias("segment")))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"))


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar dimension spanning the order dates: one row per day from the
    first to the last order date. Built from a single min/max aggregate and a
    ``sequence`` — its size is bounded by the date range (366 rows a year),
    never by the data volume, and no distinct over the orders is shuffled."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    rng = o.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    d = rng.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return d.select(date_id_of("d").alias("date_id"),
                    F.year("d").alias("year"), F.month("d").alias("month"),
                    F.quarter("d").alias("quarter"))
