"""DuckDB SQL equivalents of the feature queries (the correctness oracle).

Written independently of the Spark code as plain window SQL over the raw
tables; the Spark side uses histograms, split windows and joins instead.
"""

from __future__ import annotations

RUN_DATE = "2002-01-01"

ORDER_BY = ("order_date, order_id, line_number, product_id, supplier_id, quantity, "
            "extended_price, discount, tax, return_flag, line_status, ship_date")

STAR_CTE = f"""
lines AS (
  SELECT l.l_orderkey AS order_id, l.l_linenumber AS line_number, o.o_custkey AS customer_id,
         l.l_partkey AS product_id, l.l_suppkey AS supplier_id,
         CAST(strftime(CAST(o.o_orderdate AS DATE), '%Y%m%d') AS INTEGER) AS date_id,
         l.l_quantity AS quantity,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue,
         l.l_extendedprice AS extended_price, l.l_discount AS discount, l.l_tax AS tax,
         l.l_returnflag AS return_flag, l.l_linestatus AS line_status, l.l_shipdate AS ship_date
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
dates AS (
  SELECT DISTINCT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_id, CAST(year(d) AS INTEGER) AS year,
         CAST(month(d) AS INTEGER) AS month, CAST(quarter(d) AS INTEGER) AS quarter
  FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)
),
cust AS (
  SELECT c_custkey AS customer_id, n_name AS country, c_mktsegment AS segment
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
prod AS (SELECT p_partkey AS product_id, p_type AS product_category, p_retailprice AS product_price FROM part),
star AS (
  SELECT l.*, d.year, d.month, d.quarter, c.country, c.segment, p.product_price, p.product_category,
         CAST(try_strptime(CAST(l.date_id AS VARCHAR), '%Y%m%d') AS DATE) AS order_date,
         CAST(date_diff('day', CAST(try_strptime(CAST(l.date_id AS VARCHAR), '%Y%m%d') AS DATE), DATE '{RUN_DATE}') AS INTEGER) AS days_since_order
  FROM lines l
  LEFT JOIN dates d ON l.date_id = d.date_id
  LEFT JOIN cust c ON l.customer_id = c.customer_id
  LEFT JOIN prod p ON l.product_id = p.product_id
  WHERE l.product_id IS NOT NULL
)"""

LINE_KEYS = "order_id, line_number, customer_id, product_id, supplier_id"


def _dsum(c, w):
    return f"CAST(sum(CAST({c} AS DECIMAL(18,4))) OVER {w} AS DOUBLE)"


def _davg(c, w):
    return f"{_dsum(c, w)} / CAST(count({c}) OVER {w} AS DOUBLE)"


def _dstd(c, w):
    return f"round(stddev_samp({c}) OVER {w}, 6)"


HISTORY_SQL = f"""
WITH {STAR_CTE},
flagged AS (
  SELECT *,
    CASE WHEN row_number() OVER (PARTITION BY customer_id, product_id ORDER BY {ORDER_BY}) = 1 THEN 1 END AS fp,
    CASE WHEN product_category IS NOT NULL
         AND row_number() OVER (PARTITION BY customer_id, product_category ORDER BY {ORDER_BY}) = 1 THEN 1 END AS fc
  FROM star
)
SELECT {LINE_KEYS}, order_date, quantity, revenue,
  count(order_id) OVER wp AS customer_total_orders,
  {_dsum('revenue', 'wp')} AS customer_total_revenue,
  {_dsum('quantity', 'wp')} AS customer_total_quantity,
  {_davg('revenue', 'wp')} AS customer_avg_order_value,
  {_davg('quantity', 'wp')} AS customer_avg_quantity,
  max(quantity) OVER wp AS customer_max_quantity,
  {_dstd('revenue', 'wp')} AS customer_revenue_std,
  count(fp) OVER wp AS customer_unique_products,
  count(fc) OVER wp AS customer_unique_categories,
  {_davg('product_price', 'wp')} AS customer_avg_price_purchased
FROM flagged
WINDOW wp AS (PARTITION BY customer_id ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""

STAR_SQL = f"""
WITH {STAR_CTE}
SELECT order_id, line_number, customer_id, product_id, supplier_id, date_id, order_date,
       quantity, revenue, year, month, quarter, country, segment, product_price,
       product_category, days_since_order
FROM star
"""

RECENCY_SQL = f"""
WITH {STAR_CTE},
fl AS (SELECT customer_id, min(order_date) AS first_order_date, max(order_date) AS last_order_date
       FROM star GROUP BY customer_id)
SELECT s.order_id, s.line_number, s.customer_id, s.product_id, s.supplier_id, s.quantity, s.revenue,
       s.order_date, fl.first_order_date, fl.last_order_date,
       CAST(date_diff('day', fl.first_order_date, s.order_date) AS INTEGER) AS days_since_first_order,
       CAST(date_diff('day', fl.last_order_date, DATE '{RUN_DATE}') AS INTEGER) AS days_since_last_order
FROM star s LEFT JOIN fl ON s.customer_id = fl.customer_id
"""

PRODUCT_SQL = f"""
WITH {STAR_CTE}
SELECT product_id,
       CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS product_total_sales,
       count(order_id) AS product_purchase_count,
       CAST(sum(CAST(quantity AS DECIMAL(18,4))) AS DOUBLE) / CAST(count(quantity) AS DOUBLE) AS product_avg_quantity_per_order
FROM star GROUP BY product_id
"""

CATEGORY_SQL = f"""
WITH {STAR_CTE},
agg AS (
  SELECT product_category,
         CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS category_total_revenue,
         count(order_id) AS category_purchase_count
  FROM star GROUP BY product_category
)
SELECT *, CAST(row_number() OVER (ORDER BY category_total_revenue DESC, product_category ASC NULLS LAST) AS INTEGER)
       AS category_popularity_rank
FROM agg
"""

PERCENTILE_SQL = f"""
WITH {STAR_CTE}
SELECT {LINE_KEYS}, quantity, revenue, product_category, product_price,
       percent_rank() OVER (PARTITION BY product_category ORDER BY product_price) AS price_percentile_in_category
FROM star
"""

AFFINITY_SQL = f"""
WITH {STAR_CTE}
SELECT {LINE_KEYS}, order_date, quantity, revenue, product_category,
       count(order_id) OVER w AS customer_category_purchase_count,
       CASE WHEN count(order_id) OVER w > 0 THEN 1 ELSE 0 END AS customer_purchased_this_category_before
FROM star
WINDOW w AS (PARTITION BY customer_id, product_category ORDER BY {ORDER_BY}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""

HASH_SQL = """
SELECT c_custkey AS customer_id,
       CAST((('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT) % 100 AS INTEGER) AS customer_id_hash
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
"""

LABEL_SQL = f"""
WITH {STAR_CTE}
SELECT product_id,
       CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(product_id AS VARCHAR)) - 1 AS DOUBLE) AS product_id_label
FROM star WHERE product_id IS NOT NULL GROUP BY product_id
"""


def _safe(v: str, family: str) -> str:
    rules = {"country": [(" ", "_"), ("-", "_"), ("(", ""), (")", "")],
             "segment": [(" ", "_"), ("-", "_")],
             "category": [(" ", "_"), ("-", "_"), ("&", "and")]}[family]
    for a, b in rules:
        v = v.replace(a, b)
    return v


# Fixed values of the given test data's dimension vocabularies: nation names
# follow the rule NATION_<n> for n in 0..24; five market segments; six part
# types.
NATIONS = [f"NATION_{i}" for i in range(25)]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def feature_table_sql() -> str:
    onehot = []
    for prefix, src, vals in (("country", "country", NATIONS), ("segment", "segment", SEGMENTS),
                              ("category", "product_category", PART_TYPES)):
        for v in vals:
            onehot.append(f"CASE WHEN {src} = '{v}' THEN 1 ELSE 0 END AS {prefix}_{_safe(v, prefix)}")
    onehot += [f"CASE WHEN month = {m} THEN 1 ELSE 0 END AS month_{m}" for m in range(1, 13)]
    onehot += [f"CASE WHEN quarter = {q} THEN 1 ELSE 0 END AS quarter_{q}" for q in range(1, 5)]
    return f"""
WITH {STAR_CTE},
flagged AS (
  SELECT *,
    CASE WHEN row_number() OVER (PARTITION BY customer_id, product_id ORDER BY {ORDER_BY}) = 1 THEN 1 END AS fp,
    CASE WHEN product_category IS NOT NULL
         AND row_number() OVER (PARTITION BY customer_id, product_category ORDER BY {ORDER_BY}) = 1 THEN 1 END AS fc
  FROM star
),
hist AS (
  SELECT *,
    count(order_id) OVER wp AS customer_total_orders,
    {_dsum('revenue', 'wp')} AS customer_total_revenue,
    {_dsum('quantity', 'wp')} AS customer_total_quantity,
    {_davg('revenue', 'wp')} AS customer_avg_order_value,
    {_davg('quantity', 'wp')} AS customer_avg_quantity,
    max(quantity) OVER wp AS customer_max_quantity,
    {_dstd('revenue', 'wp')} AS customer_revenue_std,
    count(fp) OVER wp AS customer_unique_products,
    count(fc) OVER wp AS customer_unique_categories,
    {_davg('product_price', 'wp')} AS customer_avg_price_purchased,
    count(order_id) OVER wc AS customer_category_purchase_count,
    percent_rank() OVER (PARTITION BY product_category ORDER BY product_price) AS price_percentile_in_category,
    min(order_date) OVER (PARTITION BY customer_id) AS first_order_date,
    max(order_date) OVER (PARTITION BY customer_id) AS last_order_date
  FROM flagged
  WINDOW wp AS (PARTITION BY customer_id ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         wc AS (PARTITION BY customer_id, product_category ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
pagg AS (
  SELECT product_id,
         CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) AS product_total_sales,
         count(order_id) AS product_purchase_count,
         CAST(sum(CAST(quantity AS DECIMAL(18,4))) AS DOUBLE) / CAST(count(quantity) AS DOUBLE) AS product_avg_quantity_per_order
  FROM star GROUP BY product_id
),
cagg AS (
  SELECT product_category,
         CAST(row_number() OVER (ORDER BY CAST(sum(CAST(revenue AS DECIMAL(18,4))) AS DOUBLE) DESC,
                                 product_category ASC NULLS LAST) AS INTEGER) AS category_popularity_rank
  FROM star GROUP BY product_category
),
lab AS (
  SELECT product_id,
         CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(product_id AS VARCHAR)) - 1 AS DOUBLE) AS product_id_label
  FROM star GROUP BY product_id
),
feat AS (
  SELECT h.*, p.product_total_sales, p.product_purchase_count, p.product_avg_quantity_per_order,
         c.category_popularity_rank, lab.product_id_label,
         CAST(date_diff('day', h.first_order_date, h.order_date) AS INTEGER) AS days_since_first_order,
         CAST(date_diff('day', h.last_order_date, DATE '{RUN_DATE}') AS INTEGER) AS days_since_last_order
  FROM hist h
  LEFT JOIN pagg p ON h.product_id = p.product_id
  LEFT JOIN cagg c ON h.product_category IS NOT DISTINCT FROM c.product_category
  LEFT JOIN lab ON h.product_id = lab.product_id
)
SELECT customer_id, product_id, product_id_label, quantity, revenue, year, days_since_order,
  days_since_first_order, days_since_last_order,
  CAST((('0x' || substr(sha256(CAST(customer_id AS VARCHAR)), 1, 8))::BIGINT) % 100 AS INTEGER) AS customer_id_hash,
  product_price, price_percentile_in_category,
  customer_total_orders,
  coalesce(customer_total_revenue, 0) AS customer_total_revenue,
  coalesce(customer_total_quantity, 0) AS customer_total_quantity,
  coalesce(customer_avg_order_value, 0) AS customer_avg_order_value,
  coalesce(customer_avg_quantity, 0) AS customer_avg_quantity,
  coalesce(customer_max_quantity, 0) AS customer_max_quantity,
  coalesce(customer_revenue_std, 0) AS customer_revenue_std,
  customer_unique_products, customer_unique_categories,
  CASE WHEN customer_total_orders > 1 THEN days_since_first_order / customer_total_orders ELSE 0.0 END AS order_frequency_days,
  coalesce(product_total_sales, 0) AS product_total_sales,
  coalesce(product_purchase_count, 0) AS product_purchase_count,
  coalesce(product_avg_quantity_per_order, 0) AS product_avg_quantity_per_order,
  coalesce(category_popularity_rank, 0) AS category_popularity_rank,
  CASE WHEN customer_category_purchase_count > 0 THEN 1 ELSE 0 END AS customer_purchased_this_category_before,
  customer_category_purchase_count,
  CASE WHEN abs(product_price - customer_avg_price_purchased) / nullif(customer_avg_price_purchased, 0) < 0.3
       THEN 1 ELSE 0 END AS customer_purchased_similar_price_range,
  '{RUN_DATE}' AS run_date,
  {", ".join(onehot)}
FROM feat
WHERE product_id_label IS NOT NULL
"""


ORACLES = {
    "star_orders": STAR_SQL,
    "prior_customer_history": HISTORY_SQL,
    "customer_recency": RECENCY_SQL,
    "product_aggregates": PRODUCT_SQL,
    "category_ranking": CATEGORY_SQL,
    "price_percentile": PERCENTILE_SQL,
    "category_affinity": AFFINITY_SQL,
    "customer_hash_bucket": HASH_SQL,
    "product_label_index": LABEL_SQL,
    "feature_table": feature_table_sql(),
}

ORACLES["feature_table_write_verify"] = f"""WITH {STAR_CTE}
SELECT '{RUN_DATE}' AS run_date, count(*) AS written_rows, count(*) AS read_rows, true AS verified FROM star"""
ORACLES["baseline_scores_write_verify"] = f"""WITH {STAR_CTE}
SELECT '{RUN_DATE}' AS score_date, count(*) AS written_rows, count(*) AS read_rows, true AS verified FROM star"""

ORACLES["sql_segment_revenue"] = """
SELECT c.c_mktsegment AS segment, CAST(year(o.o_orderdate) AS INTEGER) AS order_year,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue,
       count(*) AS lines
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY ALL"""
