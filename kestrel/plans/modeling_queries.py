"""Registered modeling queries: splits, class weights, summaries, baseline
metrics, drift, plan transforms, and Spark ML training / scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import modeling as md
from kestrel.operators import profile as pr
from kestrel.operators import quantiles
from kestrel.operators.windows import prior_frame, prior_last
from kestrel.plans import fitted
from kestrel.plans import transforms as tf
from kestrel.plans.feature_oracles import STAR_CTE
from kestrel.plans.feature_queries import LINE, _enriched, feature_table
from kestrel.session import materialize_if_large
from kestrel.sources.starschema import ORDER_KEYS
from kestrel.sources.tables import table

DRIFT_CUT = "1998-01-01"
TRANSFORM_RUN_DATE = "2025-01-01"


def temporal_split(spark, sf_dir):
    s = md.temporal_split(_enriched(spark, sf_dir, columns=[*LINE, "quantity", "revenue", "order_date"]), "order_date")
    return s.select(*LINE, "quantity", "revenue", "order_date", "split_cut", "split")


def stratified_split(spark, sf_dir):
    return md.stratified_split(table(spark, sf_dir, "labels"), "quality", ["doc_id"]).select(
        "doc_id", "quality", "split")


def class_weights(spark, sf_dir):
    return md.balanced_class_weights(_enriched(spark, sf_dir, columns=["product_category"]), "product_category")


def target_distribution(spark, sf_dir):
    return md.value_distribution(_enriched(spark, sf_dir, materialize=False), "product_id", 20)


SUMMARY_COLS = ["quantity", "revenue", "year", "product_price", "days_since_order"]


def numeric_summary(spark, sf_dir):
    return md.numeric_summary(_enriched(spark, sf_dir, materialize=False), SUMMARY_COLS)


def numeric_quartiles(spark, sf_dir):
    """Exact quartiles of every summary column, by value and interpolated."""
    found = quantiles.quantiles(materialize_if_large(_enriched(spark, sf_dir, materialize=False, columns=SUMMARY_COLS), "summary"), SUMMARY_COLS)
    rows = [(c, f"p{int(s * 100)}", *v) for c, q in found.items() if q for s, v in zip((0.25, 0.5, 0.75), q)]
    return spark.createDataFrame(rows, "column_name string, quartile string, value double, interpolated double")


# a plan that learns: the customer as a label, the year as columns (later years
# were not seen), a price with gaps, the status as the target's class
FIT_CUT = "1997-01-01"
FIT_PLAN = [("o_custkey", "label_encode"), ("order_year", "one_hot"), ("price", "impute_median"), ("o_orderpriority", "one_hot"),
            ("o_totalprice", "log_transform"), ("o_orderkey", "drop")]


def _fit_frame(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "*", F.year("o_orderdate").alias("order_year"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("price"),
        (F.to_date("o_orderdate") < F.lit(FIT_CUT).cast("date")).alias("train"))


def fitted_transform(spark, sf_dir):
    """X4, X9, X10, X13 fitted on the orders before ``FIT_CUT``, saved, read back
    and applied to all orders: customers and years that came later are not
    seen, gaps get the training median, the target its training label."""
    import uuid

    from kestrel.session import shared_path
    frame = _fit_frame(spark, sf_dir)
    folder = shared_path(spark, "fits", uuid.uuid4().hex)
    target = ("o_orderstatus", "label_encode")
    fitted.save(fitted.fit(frame.where("train"), FIT_PLAN, target), folder)
    return fitted.apply(frame, fitted.load(spark, folder), FIT_PLAN, TRANSFORM_RUN_DATE, ("o_orderkey", "train"), target)


def fitted_binary_target(spark, sf_dir):
    """X9 binary_0_1 and keep_as_is on the same plan's frame."""
    frame = _fit_frame(spark, sf_dir).withColumn("kept", F.col("o_orderstatus"))
    one = fitted.apply(frame, fitted.fit(frame.where("train"), []), [], TRANSFORM_RUN_DATE, ("o_orderkey", "kept"), ("o_orderpriority", "binary_0_1"), ["1-URGENT", "2-HIGH"])
    return fitted.apply(one.withColumnRenamed("target", "urgent"), fitted.fit(frame.where("train"), []), [], TRANSFORM_RUN_DATE, ("o_orderkey", "urgent"), ("kept", "keep_as_is"))


def baseline_accuracy(spark, sf_dir):
    """M8 + A19: majority class of the train period predicted for the test
    period."""
    s = md.temporal_split(_enriched(spark, sf_dir, columns=["order_date", "product_category"]), "order_date")
    pred = md.majority_baseline(s.where("split = 'train'"), s.where("split = 'test'"), "product_category")
    return md.accuracy(pred, "product_category", "prediction")


def _last_category(spark, sf_dir):
    e = _enriched(spark, sf_dir, columns=["customer_id", *ORDER_KEYS, "product_category"])
    return prior_last(e, ["customer_id"], ORDER_KEYS, "product_category", "prediction")


def baseline_class_report(spark, sf_dir):
    """M8 + A23: 'same category as the customer's previous line'."""
    p = _last_category(spark, sf_dir).where(F.col("prediction").isNotNull())
    return md.class_report(p, "product_category", "prediction")


def baseline_rmse(spark, sf_dir):
    """M8 + A22: quantity predicted by the customer's prior average."""
    e = _enriched(spark, sf_dir, columns=["customer_id", *ORDER_KEYS])
    p = prior_frame(e, ["customer_id"], ORDER_KEYS, {"prior_avg_qty": ("avg", "quantity")}, skew_split=True)
    return md.rmse(p.where(F.col("prior_avg_qty").isNotNull()), "quantity", "prior_avg_qty")


def return_auc(spark, sf_dir):
    """A21 (binary form): how well the discount ranks returned lines."""
    e = table(spark, sf_dir, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"), F.col("l_discount").alias("score"))
    return md.binary_auc(e, "returned", "score")


def revenue_drift_psi(spark, sf_dir):
    """M7: PSI of line revenue, orders before vs from 1998."""
    e = _enriched(spark, sf_dir, columns=["order_date", "revenue"])
    base = e.where(F.col("order_date") < F.lit(DRIFT_CUT).cast("date"))
    new = e.where(F.col("order_date") >= F.lit(DRIFT_CUT).cast("date"))
    return md.psi(base, new, "revenue", 10)


def _plan_transform(spark, sf_dir, name, keep):
    t = table(spark, sf_dir, name)
    plan = pr.plan_from_profile(pr.column_profile(t, name))
    return tf.apply_plan(t, tf.plan_decisions(plan, name), TRANSFORM_RUN_DATE, keep=keep)


def transform_orders(spark, sf_dir):
    return _plan_transform(spark, sf_dir, "orders", ())


def transform_customer(spark, sf_dir):
    return _plan_transform(spark, sf_dir, "customer", ())


def transform_part(spark, sf_dir):
    return _plan_transform(spark, sf_dir, "part", ())


def transform_events(spark, sf_dir):
    return _plan_transform(spark, sf_dir, "events", ("event_id",))


# ---------------------------------------------------------------- Spark ML
ML_EXCLUDE_PREFIX = ("category_", "product_", "price_")
LABEL = "category_label"


ML_KEYS = ["customer_id", "product_id", "run_date"]


def _ml_frame(spark, sf_dir):
    """Feature table + class label (product category, frequency-indexed on
    the enriched fact) + temporal split + balanced weights. The columns that the
    model or its rows' keys need are written once to the shared checkpoint
    folder, before the split and the weights, whose counts read that table
    instead of running the feature plan again. There is a weight a class, so
    they are broadcast and no row moves for them."""
    from kestrel.operators.joins import bounded_broadcast
    from kestrel.operators.ordering import frequency_index
    from kestrel.session import cut_lineage
    f = feature_table(spark, sf_dir, extra_cols=("product_category",))
    idx = frequency_index(_enriched(spark, sf_dir, columns=["product_category"]), "product_category", LABEL)
    f = f.join(bounded_broadcast(idx, 100_000), "product_category", "left")
    feats = [c for c in f.columns if not c.startswith(ML_EXCLUDE_PREFIX)
             and c not in (*ML_KEYS, LABEL, "product_category")]
    f = cut_lineage(f.select(*ML_KEYS, LABEL, *feats), "features")
    f = md.temporal_split(f.withColumn("_d", F.date_sub(F.lit("2002-01-01").cast("date"), F.col("days_since_order"))), "_d")
    weights = cut_lineage(md.balanced_class_weights(f, LABEL).select(LABEL, "weight"), "weights")
    return f.join(bounded_broadcast(weights, 100_000), LABEL, "left"), feats


def _trained(spark, sf_dir, trees=100):
    """The model, the frame's rows with their vectors (what scoring reads), and the features."""
    from kestrel.operators import ml
    f, feats = _ml_frame(spark, sf_dir)
    model, rows = ml.fit_prepared(f, F.col("split") == "train", feats, LABEL, "multiclass", weight="weight",
                                  trees=trees, depth=6, seed=42)
    return model, rows, feats


def model_metrics(spark, sf_dir):
    """M1 + M3 + M5 + A19 + A20 + A21: train on the earlier 80 % of dates,
    evaluate on the rest; metrics as (run_id, key, value) rows."""
    from kestrel.operators import ml
    model, rows, feats = _trained(spark, sf_dir)
    test = ml.score(model.stages[-1], rows.where("split = 'test'"), [LABEL], "category_rf", "2002-01-01")
    acc = md.accuracy(test, LABEL, "prediction").select(F.lit("accuracy").alias("key"), F.col("accuracy").alias("value"))
    top = md.top_k_accuracy(test, (5,), LABEL, "probability").select(F.lit("top5_accuracy").alias("key"),
                                                                     F.col("top5_accuracy").alias("value"))
    auc = md.weighted_ovr_auc(test, LABEL, "probability").select(F.lit("weighted_auc").alias("key"),
                                                                    F.col("weighted_auc").alias("value"))
    params = spark.createDataFrame([("num_trees", 100.0), ("max_depth", 6.0), ("seed", 42.0),
                                    ("features", float(len(feats)))], "key string, value double")
    return acc.unionByName(top).unionByName(auc).unionByName(params).withColumn("run_id", F.lit("category_rf"))


def model_feature_importance(spark, sf_dir):
    """M4 + T4: top 15 feature importances."""
    from kestrel.operators import ml
    model, _rows, feats = _trained(spark, sf_dir)
    return ml.feature_importance(spark, model, feats, 15)


def batch_scores(spark, sf_dir):
    """M6 (F-3): score every row of the feature table with its keys."""
    from kestrel.operators import ml
    from kestrel.sources.tables import require_rows
    model, rows, _feats = _trained(spark, sf_dir)
    require_rows(rows, "feature table")                  # S3: refuse to score nothing
    return ml.score(model.stages[-1], rows, ML_KEYS, "category_rf", "2002-01-01").drop("probability")


QUERIES = {
    "temporal_split": temporal_split,
    "stratified_split": stratified_split,
    "class_weights": class_weights,
    "target_distribution": target_distribution,
    "numeric_summary": numeric_summary,
    "numeric_quartiles": numeric_quartiles,
    "fitted_transform": fitted_transform,
    "fitted_binary_target": fitted_binary_target,
    "baseline_accuracy": baseline_accuracy,
    "baseline_class_report": baseline_class_report,
    "baseline_rmse": baseline_rmse,
    "return_auc": return_auc,
    "revenue_drift_psi": revenue_drift_psi,
    "transform_orders": transform_orders,
    "transform_customer": transform_customer,
    "transform_part": transform_part,
    "transform_events": transform_events,
    "model_metrics": model_metrics,
    "model_feature_importance": model_feature_importance,
    "batch_scores": batch_scores,
}

# ---------------------------------------------------------------- oracles
ORDER_BY = ("order_date, order_id, line_number, product_id, supplier_id, quantity, "
            "extended_price, discount, tax, return_flag, line_status, ship_date")
SPLIT_CTE = f"""{STAR_CTE},
hist AS (SELECT order_date, count(*) AS n FROM star GROUP BY order_date),
cum AS (SELECT order_date, sum(n) OVER (ORDER BY order_date) AS c, sum(n) OVER () AS t FROM hist),
cut AS (SELECT min(order_date) AS split_cut FROM cum WHERE c * 10 >= t * 8),
split AS (SELECT s.*, cut.split_cut, CASE WHEN s.order_date <= cut.split_cut THEN 'train' ELSE 'test' END AS split
          FROM star s, cut)"""


def _oh(col, vals):
    def safe(v):
        return v.replace(" ", "_").replace("-", "_")
    return ", ".join(f"CASE WHEN {col} = '{v}' THEN 1 ELSE 0 END AS {col}_{safe(v)}" for v in vals)


def _lab(col, table_name):
    return f"""(SELECT {col} AS v, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({col} AS VARCHAR)) - 1 AS DOUBLE) AS l
   FROM {table_name} WHERE {col} IS NOT NULL GROUP BY {col})"""


def _hash(col):
    return f"CAST((('0x' || substr(sha256(CAST({col} AS VARCHAR)), 1, 8))::BIGINT) % 100 AS INTEGER)"


ORACLES = {
    "temporal_split": f"WITH {SPLIT_CTE} SELECT {', '.join(LINE)}, quantity, revenue, order_date, split_cut, split FROM split",
    "stratified_split": """
WITH h AS (SELECT doc_id, quality, ('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || '|42'), 1, 15))::BIGINT AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h, doc_id) AS pos, count(*) OVER (PARTITION BY quality) AS n FROM h)
SELECT doc_id, quality, CASE WHEN pos <= floor((n * 8 + 5) / 10) THEN 'train' ELSE 'test' END AS split FROM r""",
    "class_weights": f"""WITH {STAR_CTE},
f AS (SELECT product_category, count(*) AS class_count FROM star GROUP BY product_category)
SELECT product_category, class_count,
       CAST((SELECT sum(class_count) FROM f) AS DOUBLE) / CAST((SELECT count(*) FROM f) * class_count AS DOUBLE) AS weight
FROM f""",
    "target_distribution": f"""WITH {STAR_CTE}
SELECT product_id, count(*) AS count FROM star GROUP BY product_id ORDER BY count DESC, product_id LIMIT 20""",
    "numeric_summary": f"WITH {STAR_CTE} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg(CAST({c} AS DOUBLE)), 6) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 6) AS stddev, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max
FROM star""" for c in SUMMARY_COLS),
    "numeric_quartiles": f"WITH {STAR_CTE} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, 'p{int(s * 100)}' AS quartile, quantile_disc(CAST({c} AS DOUBLE), {s}) AS value,
  quantile_cont(CAST({c} AS DOUBLE), {s}) AS interpolated FROM star""" for c in SUMMARY_COLS for s in (0.25, 0.5, 0.75)),
    "fitted_transform": f"""
WITH o AS (SELECT *, year(o_orderdate) AS order_year, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS price,
                  CAST(o_orderdate AS DATE) < DATE '{FIT_CUT}' AS train FROM orders),
t AS (SELECT * FROM o WHERE train),
cust AS (SELECT o_custkey, row_number() OVER (ORDER BY count(*) DESC, CAST(o_custkey AS VARCHAR)) - 1 AS place FROM t GROUP BY o_custkey),
stat AS (SELECT o_orderstatus, row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1 AS place FROM t GROUP BY o_orderstatus)
SELECT o.o_orderkey, o.train, CAST(coalesce(cust.place, (SELECT count(*) FROM cust)) AS DOUBLE) AS o_custkey_label,
       {", ".join(f"CASE WHEN order_year = {y} THEN 1 ELSE 0 END AS order_year_{y}" for y in (1995, 1996))},
       coalesce(price, (SELECT quantile_cont(price, 0.5) FROM t)) AS price,
       {", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END AS o_orderpriority_{v.replace(' ', '_').replace('-', '_')}" for v in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'))},
       round(ln(1.0 + o_totalprice), 9) AS o_totalprice_log, CAST(stat.place AS DOUBLE) AS target
FROM o LEFT JOIN cust ON cust.o_custkey = o.o_custkey LEFT JOIN stat ON stat.o_orderstatus = o.o_orderstatus""",
    "fitted_binary_target": """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS urgent, o_orderstatus AS target FROM orders""",
    "baseline_accuracy": f"""WITH {SPLIT_CTE},
maj AS (SELECT product_category AS p FROM split WHERE split = 'train' GROUP BY product_category
        ORDER BY count(*) DESC, product_category LIMIT 1)
SELECT avg(CASE WHEN s.product_category = maj.p THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS rows
FROM split s, maj WHERE s.split = 'test'""",
    "baseline_class_report": f"""WITH {STAR_CTE},
p AS (SELECT product_category AS y, lag(product_category) OVER (PARTITION BY customer_id ORDER BY {ORDER_BY}) AS yhat FROM star),
cm AS (SELECT y, yhat, count(*) AS c FROM p WHERE yhat IS NOT NULL GROUP BY y, yhat),
sup AS (SELECT y AS cls, CAST(sum(c) AS BIGINT) AS support FROM cm GROUP BY y),
prd AS (SELECT yhat AS cls, CAST(sum(c) AS BIGINT) AS predicted FROM cm GROUP BY yhat),
tp AS (SELECT y AS cls, c AS tp FROM cm WHERE y = yhat),
r AS (SELECT coalesce(sup.cls, prd.cls) AS cls, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted
      FROM sup FULL JOIN prd ON sup.cls = prd.cls),
r2 AS (SELECT r.*, coalesce(tp.tp, 0) AS tp,
              CASE WHEN predicted = 0 THEN NULL ELSE CAST(coalesce(tp.tp, 0) AS DOUBLE) / CAST(predicted AS DOUBLE) END AS precision,
              CASE WHEN support = 0 THEN NULL ELSE CAST(coalesce(tp.tp, 0) AS DOUBLE) / CAST(support AS DOUBLE) END AS recall
       FROM r LEFT JOIN tp ON r.cls = tp.cls)
SELECT cls, support, predicted, tp, precision, recall,
       round(CASE WHEN precision + recall = 0 THEN NULL ELSE 2.0 * precision * recall / (precision + recall) END, 6) AS f1
FROM r2""",
    "baseline_rmse": f"""WITH {STAR_CTE},
p AS (SELECT quantity,
             CAST(sum(CAST(quantity AS DECIMAL(18,4))) OVER w AS DOUBLE) / CAST(count(quantity) OVER w AS DOUBLE) AS q
      FROM star WINDOW w AS (PARTITION BY customer_id ORDER BY {ORDER_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT round(sqrt(avg((q - quantity) * (q - quantity))), 6) AS rmse, count(q - quantity) AS rows FROM p WHERE q IS NOT NULL""",
    "return_auc": """
WITH h AS (SELECT l_discount AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS p,
                  count(*) FILTER (WHERE l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_discount),
c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM h)
SELECT CAST(sum(p * (nb * 2 + n)) AS DOUBLE) / CAST(sum(p) * sum(n) * 2 AS DOUBLE) AS auc, CAST(sum(p) AS BIGINT) AS "P", CAST(sum(n) AS BIGINT) AS "N" FROM c""",
    "revenue_drift_psi": f"""WITH {STAR_CTE},
rng AS (SELECT min(revenue) AS lo, max(revenue) AS hi FROM star WHERE order_date < DATE '{DRIFT_CUT}'),
b AS (SELECT CASE WHEN order_date < DATE '{DRIFT_CUT}' THEN 'e' ELSE 'a' END AS side,
             CAST(CASE WHEN (hi - lo) / 10 <= 0 THEN 0 ELSE least(greatest(floor((revenue - lo) / ((hi - lo) / 10)), 0), 9) END AS INTEGER) AS bucket
      FROM star, rng WHERE revenue IS NOT NULL),
sh AS (SELECT side, bucket, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY side) AS share FROM b GROUP BY side, bucket),
allb AS (SELECT CAST(range AS INTEGER) AS bucket FROM range(10)),
j AS (SELECT greatest(coalesce((SELECT share FROM sh WHERE side = 'e' AND sh.bucket = allb.bucket), 0.0), 0.0001) AS e,
             greatest(coalesce((SELECT share FROM sh WHERE side = 'a' AND sh.bucket = allb.bucket), 0.0), 0.0001) AS a
      FROM allb)
SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM j""",
    "transform_orders": f"""
SELECT CAST(o_custkey AS DOUBLE) AS o_custkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{TRANSFORM_RUN_DATE}') AS INTEGER) AS o_orderdate_days_since,
       CAST(o_orderkey AS DOUBLE) AS o_orderkey, {_oh('o_orderpriority', ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'])},
       {_oh('o_orderstatus', ['F', 'O', 'P'])}, coalesce(o_totalprice, 0.0) AS o_totalprice
FROM orders""",
    "transform_customer": f"""
SELECT coalesce(c_acctbal, 0.0) AS c_acctbal, CAST(c_custkey AS DOUBLE) AS c_custkey,
       {_oh('c_mktsegment', ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])},
       {_hash('c_name')} AS c_name_hash, CAST(c_nationkey AS DOUBLE) AS c_nationkey
FROM customer""",
    "transform_part": f"""
SELECT b.l AS p_brand_label, n.l AS p_name_label, CAST(p_partkey AS DOUBLE) AS p_partkey,
       coalesce(p_retailprice, 0.0) AS p_retailprice, CAST(p_size AS DOUBLE) AS p_size,
       {_oh('p_type', ['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'])}
FROM part LEFT JOIN {_lab('p_brand', 'part')} b ON part.p_brand = b.v LEFT JOIN {_lab('p_name', 'part')} n ON part.p_name = n.v""",
    "transform_events": f"""
SELECT event_id, {_oh('event_type', ['click', 'error', 'purchase', 'signup', 'view'])},
       pl.l AS props_label, CAST(date_diff('day', CAST(ts AS DATE), DATE '{TRANSFORM_RUN_DATE}') AS INTEGER) AS ts_days_since,
       coalesce(value, 0.0) AS value
FROM events LEFT JOIN {_lab('props', 'events')} pl ON events.props = pl.v""",
}
