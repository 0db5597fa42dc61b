"""Run history upsert, scorecard status rules and text predicates."""

import re

from pyspark.sql import functions as F

from kestrel.functions.scalars import OFF_TOPIC_PATTERNS, off_topic, slugify
from kestrel.operators import governance as gv
from kestrel.operators import history as hs

UPD = "run_id string, catalog string, schema_name string, use_case string, status string, at string, tie long"


def test_history_round_trip_and_upsert_rules(spark):
    first = spark.createDataFrame([("r1", "cat", "sch", "uc", "running", "2024-01-01T00:00:00", 1)], UPD)
    h1 = hs.history_from_updates(first).collect()[0]
    assert (h1.catalog, h1.schema_name, h1.use_case, h1.status) == ("cat", "sch", "uc", "running")
    later = spark.createDataFrame([("r1", "", "", "", "completed", "2024-01-02T00:00:00", 2),
                                   ("r2", "c2", "", "", "running", "2024-01-03T00:00:00", 3)], UPD)
    h = {r.run_id: r for r in hs.merge_history(hs.history_from_updates(first), later).collect()}
    # empty catalog keeps the old value, status always replaced, created_at kept
    assert h["r1"].catalog == "cat" and h["r1"].status == "completed"
    assert h["r1"].created_at == "2024-01-01T00:00:00" and h["r1"].updated_at == "2024-01-02T00:00:00"
    assert h["r2"].catalog == "c2" and h["r2"].schema_name == ""
    recent = hs.latest_runs(hs.merge_history(hs.history_from_updates(first), later), 1).collect()
    assert [r.run_id for r in recent] == ["r2"]


def _plans(spark, run_ids):
    rows = [(r, "temporal", "order_date", "classification", "balanced", "none", "50:50", [], "$4")
            for r in run_ids]
    return spark.createDataFrame(rows, "run_id string, split_strategy string, split_column string, ml_type string, "
                                       "balance_type string, balance_strategy string, estimated_ratio string, "
                                       "high_cardinality_cols array<string>, estimated_cost string")


def test_scorecard_overall_rules(spark):
    art = spark.createDataFrame([
        # ready: every needle present
        ("ready", "a.py", "GRANT SELECT ... import mlflow ... databricks-uc ... dbutils.widgets ... Champion"),
        # review_needed: tracking + registry + widgets, no grant, no alias -> warns only
        ("review", "a.py", "mlflow databricks-uc dbutils.widgets"),
        # blocked: nothing -> tracking and widgets fail
        ("blocked", "a.py", "print(1)"),
        ("blocked", "b.yml", "GRANT SELECT mlflow dbutils.widgets"),   # not a .py file
    ], "run_id string, filename string, content string")
    items = gv.scorecard_items(_plans(spark, ["ready", "review", "blocked"]), gv.artifact_flags(art))
    assert items.count() == 24
    overall = {r.run_id: r for r in gv.scorecard_overall(items).collect()}
    assert overall["ready"].overall == "ready"
    assert overall["review"].overall == "review_needed" and overall["review"].warn_count == 2
    assert overall["blocked"].overall == "blocked" and overall["blocked"].fail_count == 2
    split = items.where((F.col("run_id") == "ready") & (F.col("check_order") == 1)).first()
    assert split.detail == "Temporal split on 'order_date' — no data leakage"


def test_class_balance_flags_rare_positive(spark):
    rows = [("a", 1)] * 5 + [("a", 0)] * 95 + [("b", 1)] * 50 + [("b", 0)] * 50
    b = {r.g: r for r in gv.class_balance(spark.createDataFrame(rows, "g string, y int"), "g", "y").collect()}
    assert b["a"].balance_type == "imbalanced" and b["a"].estimated_ratio == "95:5"
    assert b["a"].scale_pos_weight == 19.0 and b["b"].balance_type == "balanced"


def test_off_topic_matches_python_semantics(spark):
    rx = re.compile("|".join(OFF_TOPIC_PATTERNS), re.IGNORECASE)
    texts = ["What's the weather like?", "hi", "   short  ", "Why did feature X drop in the plan?",
             "who is the CEO of databricks", "who is the ceo of acme corp", "Tell me about neural networks",
             "tell me about neural network design", "How do I install the cli?", "movies", "what day is today",
             "stock price of acme", "Explain the class imbalance check", "café music playlist"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.o for r in df.select(off_topic("t").alias("o")).collect()]
    exp = [len(t.strip()) < 8 or bool(rx.search(t.strip())) for t in texts]
    assert got == exp


def test_slugify(spark):
    df = spark.createDataFrame([("  Next Product -- Purchase!! ",), ("__A&B__",)], "s string")
    assert [r.x for r in df.select(slugify("s").alias("x")).collect()] == ["next_product_purchase", "a_b"]
