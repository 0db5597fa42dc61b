"""Registered queries of the feature job, each (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import features as fx
from kestrel.operators.joins import left_dimension_join
from kestrel.sources import starschema as ss

RUN_DATE = "2002-01-01"


def _opts(skew_split: bool = True, order_keys=ss.ORDER_KEYS) -> fx.FeatureOptions:
    return fx.FeatureOptions(run_date=RUN_DATE, order_keys=list(order_keys), skew_split=skew_split)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their customer's columns, joined to the orders before
    their lines: an order moves once, not each of its lines."""
    heads = left_dimension_join(ss.order_heads(spark, sf_dir), ss.customers(spark, sf_dir), "customer_id", fx.CUSTOMER_COLS)
    return ss.order_lines(spark, sf_dir, heads)


def _enriched(spark: SparkSession, sf_dir: str, materialize: bool = True, columns=None, placed: bool = False) -> DataFrame:
    """The enriched fact (``columns`` of it: then only these are joined, moved
    and written). Queries that read it more than once (aggregate and join back,
    split windows) get it materialised once in the shared checkpoint folder
    instead of redoing the fact and dimension joins — when the inputs are large
    enough for that to pay off. ``placed``: lines have their place in the order."""
    with_customers = columns is None or not set(fx.CUSTOMER_COLS).isdisjoint(columns)
    lines = _lines(spark, sf_dir) if with_customers else ss.order_lines(spark, sf_dir)
    lines = ss.placed_lines(lines) if placed else lines
    e = fx.enrich_orders(lines, None if with_customers else ss.customers(spark, sf_dir),
                         ss.products(spark, sf_dir), ss.dates(spark, sf_dir), RUN_DATE, columns)
    if materialize:
        from kestrel.session import materialize_if_large
        e = materialize_if_large(e, "enriched")
    return e


LINE = ["order_id", "line_number", "customer_id", "product_id", "supplier_id"]
STAR_COLS = ["order_id", "line_number", "customer_id", "product_id", "supplier_id", "date_id",
             "order_date", "quantity", "revenue", "year", "month", "quarter", "country",
             "segment", "product_price", "product_category", "days_since_order"]


def star_orders(spark, sf_dir):
    """The cleaned fact joined to its dimensions."""
    return _enriched(spark, sf_dir, materialize=False).select(*STAR_COLS)


HISTORY_COLS = ["customer_total_orders", "customer_total_revenue", "customer_total_quantity",
                "customer_avg_order_value", "customer_avg_quantity", "customer_max_quantity",
                "customer_revenue_std", "customer_unique_products", "customer_unique_categories",
                "customer_avg_price_purchased"]


KEYED = ["customer_id", "date_id", "revenue", *ss.ORDER_KEYS]
PLACED = ["line_number", "customer_id", "product_id", "supplier_id", "quantity", "revenue", *ss.SHORT_KEYS]


def _with_customer_features(spark, sf_dir, **how):
    """The fact with its customers' features; orders tell which customers are large."""
    e = _enriched(spark, sf_dir, columns=[*PLACED, "product_price", "product_category"], placed=True)
    return fx.customer_features(e, ss.SHORT_KEYS, RUN_DATE, sizes=ss.order_heads(spark, sf_dir), **how)


def prior_customer_history(spark, sf_dir, skew_split: bool = True):
    """What had this customer bought before this line?"""
    if skew_split:
        f = _with_customer_features(spark, sf_dir, affinity=False)
    else:
        e = _enriched(spark, sf_dir, columns=[*KEYED, "product_price", "product_category"])
        f = fx.prior_customer_history(e, ss.ORDER_KEYS, False)
    return f.select("order_id", "line_number", "customer_id", "product_id", "supplier_id",
                    "order_date", "quantity", "revenue", *HISTORY_COLS)


def customer_recency(spark, sf_dir):
    """first/last order date per customer joined back to lines."""
    e = _enriched(spark, sf_dir, columns=[*LINE, "quantity", "revenue", "order_date"])
    f = fx.customer_recency(e, RUN_DATE)
    return f.select("order_id", "line_number", "customer_id", "product_id", "supplier_id",
                    "quantity", "revenue", "order_date", "first_order_date", "last_order_date",
                    "days_since_first_order", "days_since_last_order")


def product_aggregates(spark, sf_dir):
    """A2 (+ J5 in the feature table)."""
    return fx.product_aggregates(_enriched(spark, sf_dir, materialize=False))


def category_ranking(spark, sf_dir):
    """A3, W7 (+ J6 in the feature table)."""
    return fx.category_ranking(_enriched(spark, sf_dir, materialize=False))


def price_percentile(spark, sf_dir):
    """W8 on the (category, price) histogram, joined back to lines."""
    e = _enriched(spark, sf_dir, columns=[*LINE, "quantity", "revenue", "product_category", "product_price"])
    f = fx.price_percentile(e)
    return f.select("order_id", "line_number", "customer_id", "product_id", "supplier_id",
                    "quantity", "revenue", "product_category", "product_price",
                    "price_percentile_in_category")


def category_affinity(spark, sf_dir, skew_split: bool = True):
    """Earlier purchases of the same category by the same customer."""
    if skew_split:
        f = _with_customer_features(spark, sf_dir)
    else:
        e = _enriched(spark, sf_dir, columns=[*KEYED, "product_price", "product_category"])
        f = fx.category_affinity(e, ss.ORDER_KEYS, False)
    return f.select("order_id", "line_number", "customer_id", "product_id", "supplier_id",
                    "order_date", "quantity", "revenue", "product_category",
                    "customer_category_purchase_count", "customer_purchased_this_category_before")


def customer_hash_bucket(spark, sf_dir):
    """F8: customer bucket in [0, 100) from SHA-256 (engine-independent)."""
    from kestrel.functions.scalars import hash_bucket
    c = ss.customers(spark, sf_dir)
    return c.select("customer_id", hash_bucket("customer_id", 100).alias("customer_id_hash"))


def product_label_index(spark, sf_dir):
    """product_id -> label by frequency (StringIndexer order)."""
    from kestrel.operators.ordering import frequency_index
    return frequency_index(_enriched(spark, sf_dir, materialize=False), "product_id", "product_id_label")


def feature_table(spark, sf_dir, skew_split: bool = True, extra_cols=()):
    """F-2: the full point-in-time feature table."""
    o = _opts(skew_split, ss.SHORT_KEYS)
    lines = ss.placed_lines(ss.order_lines(spark, sf_dir))
    return fx.feature_table(lines, ss.customers(spark, sf_dir), ss.products(spark, sf_dir), ss.dates(spark, sf_dir), o,
                            extra_cols, sizes=ss.order_heads(spark, sf_dir))


QUERIES = {
    "star_orders": star_orders,
    "prior_customer_history": prior_customer_history,
    "customer_recency": customer_recency,
    "product_aggregates": product_aggregates,
    "category_ranking": category_ranking,
    "price_percentile": price_percentile,
    "category_affinity": category_affinity,
    "customer_hash_bucket": customer_hash_bucket,
    "product_label_index": product_label_index,
    "feature_table": feature_table,
}


def feature_table_write_verify(spark, sf_dir):
    """S4 + S6 + S2: write the feature table partitioned by run_date into
    the shared folder, read the run date back (pruned) and compare counts."""
    import uuid
    from kestrel.session import shared_path
    from kestrel.sources.sinks import write_and_verify
    path = shared_path(spark, "tables", f"features-{uuid.uuid4().hex}")
    return write_and_verify(feature_table(spark, sf_dir), path, "run_date", RUN_DATE)


def baseline_scores_write_verify(spark, sf_dir):
    """S5 + S6 (F-3 layout): baseline scores appended under score_date; the
    second, identical run replaces the date instead of duplicating it."""
    import uuid
    from kestrel.operators.windows import prior_last
    from kestrel.session import materialize_if_large, shared_path
    from kestrel.sources.sinks import write_and_verify
    e = _enriched(spark, sf_dir, columns=["customer_id", *ss.ORDER_KEYS, "product_category"])
    p = prior_last(e, ["customer_id"], ss.ORDER_KEYS, "product_category", "prediction")
    # both runs write the same predictions: made once
    p = materialize_if_large(p.select("customer_id", "product_id", "prediction"), "predictions")
    scores = p.select("customer_id", "product_id", F.lit(RUN_DATE).alias("run_date"), "prediction",
                      F.lit(RUN_DATE).cast("date").alias("score_date"),
                      F.lit("last_category_baseline").alias("model_name"), F.current_timestamp().alias("scored_at"))
    path = shared_path(spark, "tables", f"scores-{uuid.uuid4().hex}")
    write_and_verify(scores, path, "score_date", RUN_DATE)
    return write_and_verify(scores, path, "score_date", RUN_DATE)


QUERIES["feature_table_write_verify"] = feature_table_write_verify
QUERIES["baseline_scores_write_verify"] = baseline_scores_write_verify


def sql_segment_revenue(spark, sf_dir):
    """S14 + the SQL API: the given tables as temp views, one Catalyst plan
    from SQL text (revenue and lines per market segment and order year)."""
    from kestrel.sources.tables import register_views
    register_views(spark, sf_dir, ["lineitem", "orders", "customer"])
    return spark.sql("""
        SELECT c.c_mktsegment AS segment, year(o.o_orderdate) AS order_year,
               CAST(sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))))
                    AS DOUBLE) AS revenue,
               count(*) AS lines
        FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
        JOIN customer c ON o.o_custkey = c.c_custkey
        GROUP BY c.c_mktsegment, year(o.o_orderdate)""")


QUERIES["sql_segment_revenue"] = sql_segment_revenue
