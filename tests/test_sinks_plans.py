"""Sinks and physical-plan properties (pruning, pushdown, no cartesian)."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from kestrel.plans import feature_queries as fq
from kestrel.sources import sinks
from kestrel.sources.tables import table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partition_overwrite_is_per_date_and_verified(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="kestrel-sink-"), "t")
    a = spark.createDataFrame([(1, "d1"), (2, "d1"), (3, "d2")], "x int, d string")
    sinks.write_partitioned(a, path, "d")
    b = spark.createDataFrame([(9, "d1")], "x int, d string")
    v = sinks.write_and_verify(b, path, "d", "d1").first()
    assert v.written_rows == 1 and v.read_rows == 1 and v.verified
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [3, 9]   # d2 kept
    back = sinks.read_partition(spark, path, "d", "d2")
    assert "PartitionFilters: [isnotnull(d" in _plan(back)


def test_append_audit_ignores_duplicates(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="kestrel-audit-"), "a")
    cols = "event_id string, run_id string, sequence_number long, x string"
    b1 = spark.createDataFrame([("e1", "r", 1, "a"), ("e2", "r", 2, "b")], cols)
    assert sinks.append_audit(spark, path, b1).first().appended == 2
    b2 = spark.createDataFrame([("e2", "r", 2, "b"), ("e3", "r", 3, "c"), ("e3", "r", 3, "c")], cols)
    assert sinks.append_audit(spark, path, b2).first().appended == 1
    assert spark.read.parquet(path).count() == 3


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = table(spark, SF0001, "lineitem").where(F.col("l_quantity") > 10).select("l_orderkey")
    plan = _plan(df)
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_feature_plan_has_no_cartesian_product(spark):
    plan = _plan(fq.feature_table(spark, SF0001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


NO_CROSS = ["feature_table", "prior_customer_history", "temporal_split", "class_weights", "revenue_drift_psi",
            "baseline_accuracy", "relationship_candidates", "audit_verify", "audit_insert_or_ignore",
            "stratified_split", "event_sessions", "opportunity_ranking"]


@pytest.mark.parametrize("name", NO_CROSS)
def test_registered_plans_have_no_cross_joins(spark, name):
    import __spark_entry__ as entry
    plan = _plan(entry.queries()[name](spark, SF0001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
