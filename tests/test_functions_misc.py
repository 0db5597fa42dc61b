"""Scalar helpers, catalog browsing, model persistence and governance joins."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF0001
from kestrel.functions import scalars as sc
from kestrel.operators import governance as gv
from kestrel.sources import catalog as cat
from kestrel.sources import sinks


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(20240229, "```json\n{\"a\": 1}\n```", "x ANALYSIS: deep dive ", "c.s.t",
                                 None, "2024-01-15T10:30:45.123+00:00")],
                               "d int, j string, m string, n string, y string, ts string")
    r = df.select(sc.date_from_id("d").alias("d"), sc.parse_json_text("j", "a int").alias("j"),
                  sc.after_marker("m", "ANALYSIS:").alias("m"), sc.name_part("n", 3).alias("n"),
                  sc.nullable_flag("y").alias("y"), sc.clock_time("ts").alias("t"),
                  sc.date_from_id(F.lit(20241340)).alias("bad")).first()
    assert str(r.d) == "2024-02-29" and r.j.a == 1 and r.m == "deep dive" and r.n == "t"
    assert r.y is True and r.t == "10:30:45" and r.bad is None


def test_status_and_name_rules(spark):
    df = spark.createDataFrame([(True, None), (True, "human_checkpoint"), (False, None), (True, "other")],
                               "v boolean, n string")
    assert [r.s for r in df.select(sc.status_of_next("v", "n").alias("s")).collect()] == \
        ["completed", "awaiting_approval", "not_found", "running"]
    names = spark.createDataFrame([("customer_id",), ("is_churned",), ("amount",)], "c string")
    got = names.select(sc.is_key_name("c").alias("k"), sc.is_binary_target_name("c").alias("b")).collect()
    assert [(r.k, r.b) for r in got] == [(True, False), (False, True), (False, False)]


def test_hash_bucket_is_stable_and_bounded(spark):
    df = spark.range(1000).select(sc.hash_bucket("id", 7).alias("b"), sc.spark_hash_bucket("id", 7).alias("s"))
    assert df.where((F.col("b") < 0) | (F.col("b") >= 7) | (F.col("s") < 0) | (F.col("s") >= 7)).count() == 0


def test_catalog_browse_and_lookup(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kestrel_t")
    spark.range(3).write.mode("overwrite").saveAsTable("kestrel_t.nums")
    t = cat.catalog_tables(spark, "kestrel_t")
    assert [r.name for r in t.collect()] == ["nums"] and t.first().table_type == "MANAGED"
    assert cat.catalog_columns(spark, "kestrel_t").first().column_name == "id"
    assert cat.table_lookup(t, "spark_catalog.kestrel_t.nums").count() == 1
    assert cat.database_exists(spark, "kestrel_t") and cat.table_exists(spark, "nums", "kestrel_t")
    cats, dbs = cat.browse(spark)
    assert "kestrel_t" in [r.database for r in dbs.collect()]
    cols = cat.with_nullable(cat.parquet_columns(spark, SF0001, ["region"]))
    assert [r.nullable for r in cols.collect()] == [True, True]


def test_csv_export(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="kestrel-csv-"), "imp")
    sinks.export_csv(spark.createDataFrame([("f", 0.5)], "feature string, importance double"), path)
    assert spark.read.option("header", True).csv(path).first().feature == "f"


def test_model_registry_and_regression(spark):
    from pyspark.ml import PipelineModel

    from kestrel.operators import ml
    from kestrel.operators.model_registry import ModelRegistry
    rows = [(float(i), float(i % 7), 2.0 * i + (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = ml.fit(df, ["a", "b"], "y", "regression", trees=5, depth=3)
    base = tempfile.mkdtemp(prefix="kestrel-model-")
    models = ModelRegistry(spark, base)
    models.promote("m", models.register("m", lambda folder: model.write().save(folder)))
    loaded = PipelineModel.load(models.resolve("m")[1])
    scored = ml.score(loaded, df.withColumn("k", F.col("a")), ["k"], "m", "2024-01-01")
    assert scored.count() == 200 and set(scored.columns) >= {"k", "prediction", "score_date", "model_name"}
    # every score row keeps its key (no row-id join)
    assert scored.select("k").exceptAll(df.select(F.col("a").alias("k"))).count() == 0


def test_impute_median(spark):
    from kestrel.plans.transforms import impute_median
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (10.0,)], "x double")
    got = sorted(r.x_imputed for r in impute_median(df, ["x"]).collect())
    assert got == [1.0, 3.0, 3.0, 10.0]


def test_dated_tables_and_missing_grants(spark):
    plans = spark.createDataFrame([("r1", "random", ["orders", "customer"]), ("r2", "temporal", ["orders"])],
                                  "run_id string, split_strategy string, feature_tables array<string>")
    cols = spark.createDataFrame([("orders", "o_orderdate", "timestamp_ntz"), ("customer", "c_name", "string")],
                                 "table_name string, column_name string, data_type string")
    w = gv.random_split_on_dated_tables(plans, cols).collect()
    assert [(r.run_id, r.dated_tables) for r in w] == [("r1", ["orders"])]
    jobs = spark.createDataFrame([("r1", "cat.s.orders"), ("r1", "cat.s.customer")], "run_id string, table_name string")
    art = spark.createDataFrame([("r1", "a.py", "GRANT SELECT ON TABLE cat.s.orders TO x")],
                                "run_id string, filename string, content string")
    assert [r.table_name for r in gv.missing_grants(jobs, art).collect()] == ["cat.s.customer"]
