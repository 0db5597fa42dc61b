"""Rule scorecard and text rules (SURVEY G6–G9, P11, P13, P14, A13, A18,
A25, F24).

Artifacts are rows (run_id, filename, content). The reference joins the text
of a run's ``.py`` files and searches it; here each presence rule is a
``contains`` per artifact row folded with ``bool_or`` per run, so a run with
many or very long artifacts is aggregated map-side, whole texts included.
(A needle split across two artifacts' joint is not matched; the reference's
join space would rarely create one.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.scalars import readiness

# The scorecard checks in report order, and every text the
# checks and the overall summary produce ("{}" marks an inserted value).
CHECKS = [
    "Train/test split", "Class imbalance", "High-cardinality features", "UC access grants",
    "MLflow + UC registry", "Job-safe parameters", "Rollback path", "Estimated compute cost",
]
TEXTS = {
    "split_temporal": "Temporal split on '{}' — no data leakage",
    "split_random_series": "Random split on time-series data — consider temporal split",
    "split_applied": "{} split applied",
    "imbalance_weighted": "Imbalance detected ({}), handled via class_weight",
    "imbalance_unhandled": "Imbalance detected ({}) but no strategy set — model may predict majority class",
    "balanced": "Dataset appears balanced",
    "high_card": "Detected and handled: {}",
    "high_card_none": "None detected",
    "grants_yes": "GRANT SELECT statements included in notebooks",
    "grants_no": "No GRANT statements found — downstream consumers may lack access",
    "tracking_full": "MLflow tracking enabled, model registered in Unity Catalog",
    "tracking_partial": "MLflow present but UC registry not confirmed",
    "tracking_none": "MLflow tracking not found in generated code",
    "widgets_yes": "dbutils.widgets used — notebooks safe for both interactive and job runs",
    "widgets_no": "Hardcoded values detected — notebooks may fail as scheduled jobs",
    "alias_yes": "Champion alias set in UC Model Registry — reassign alias to roll back",
    "alias_no": "No Champion alias found — rollback requires manual version management",
    "cost": "{} per full run (feature + training + inference)",
    "summary_blocked": "{} critical issue(s) must be resolved before deployment.",
    "summary_review": "{} warning(s) to review — deployment can proceed with awareness.",
    "summary_ready": "All checks passed. Code is ready to deploy.",
}
GRANT_NEEDLE = "GRANT SELECT"
TRACKING_NEEDLE = "mlflow"            # matched on lower-cased text
REGISTRY_NEEDLE = "databricks-uc"
WIDGETS_NEEDLE = "dbutils.widgets"
ALIAS_NEEDLE = "Champion"
IMBALANCE_RATE = 0.1                  # positive share below this warns (A25)


def artifact_flags(artifacts: DataFrame) -> DataFrame:
    """P11 + P14: per run, which needles occur in its ``.py`` artifacts."""
    py = artifacts.where(F.col("filename").endswith(".py"))
    c = F.col("content")
    return py.groupBy("run_id").agg(
        F.bool_or(c.contains(GRANT_NEEDLE)).alias("has_grants"),
        F.bool_or(F.lower(c).contains(TRACKING_NEEDLE)).alias("has_tracking"),
        F.bool_or(c.contains(REGISTRY_NEEDLE)).alias("has_registry"),
        F.bool_or(c.contains(WIDGETS_NEEDLE)).alias("has_widgets"),
        F.bool_or(c.contains(ALIAS_NEEDLE)).alias("has_alias"),
        F.count(F.lit(1)).alias("py_files"))


def class_balance(labels: DataFrame, group: str, label: str, rate: float = IMBALANCE_RATE) -> DataFrame:
    """A25 + A18: per group, positive share, imbalance type, ratio text
    ("90:10") and the binary ``scale_pos_weight`` = negatives / positives."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    agg = labels.groupBy(group).agg(pos.alias("positives"), neg.alias("negatives"))
    n = F.col("positives") + F.col("negatives")
    share = F.try_divide(F.col("positives").cast("double"), n.cast("double"))
    return agg.select(
        group, "positives", "negatives", share.alias("positive_share"),
        F.when(share < rate, "imbalanced").otherwise("balanced").alias("balance_type"),
        F.concat(F.round(F.lit(100.0) * (1 - share)).cast("int").cast("string"), F.lit(":"),
                 F.round(F.lit(100.0) * share).cast("int").cast("string")).alias("estimated_ratio"),
        F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")).alias("scale_pos_weight"))


def _text(key: str, *values: Column) -> Column:
    """A fixed text with its ``{}`` slots filled by columns."""
    pieces = TEXTS[key].split("{}")
    out = [F.lit(pieces[0])]
    for v, rest in zip(values, pieces[1:]):
        out += [v, F.lit(rest)]
    return F.concat(*out) if len(out) > 1 else out[0]


def _item(order: int, check: str, status: Column, detail: Column) -> Column:
    return F.struct(F.lit(order).alias("check_order"), F.lit(check).alias("check"),
                    status.alias("status"), detail.alias("detail"))


def scorecard_items(plans: DataFrame, flags: DataFrame) -> DataFrame:
    """Eight rule checks per run as a long table (run_id, check_order,
    check, status, detail). ``plans``: run_id, split_strategy, split_column,
    ml_type, balance_type, balance_strategy, estimated_ratio,
    high_cardinality_cols (array<string>), estimated_cost."""
    p = plans.join(flags, "run_id", "left")
    has = {k: F.coalesce(F.col(k), F.lit(False)) for k in
           ("has_grants", "has_tracking", "has_registry", "has_widgets", "has_alias")}
    split = F.col("split_strategy")
    ratio = F.coalesce(F.col("estimated_ratio"), F.lit("?"))
    hc = F.coalesce(F.col("high_cardinality_cols"), F.array().cast("array<string>"))
    items = F.array(
        _item(1, CHECKS[0],
              F.when((split == "random") & (F.col("ml_type") == "forecasting"), "warn").otherwise("pass"),
              F.when((split == "temporal") & F.col("split_column").isNotNull(),
                     _text("split_temporal", F.col("split_column")))
               .when((split == "random") & (F.col("ml_type") == "forecasting"), _text("split_random_series"))
               .otherwise(_text("split_applied", F.initcap(F.coalesce(split, F.lit("random")))))),
        _item(2, CHECKS[1],
              F.when((F.col("balance_type") == "imbalanced") & (F.col("balance_strategy") == "none"), "warn")
               .otherwise("pass"),
              F.when((F.col("balance_type") == "imbalanced") & (F.col("balance_strategy") == "class_weight"),
                     _text("imbalance_weighted", ratio))
               .when((F.col("balance_type") == "imbalanced") & (F.col("balance_strategy") == "none"),
                     _text("imbalance_unhandled", ratio))
               .otherwise(_text("balanced"))),
        _item(3, CHECKS[2], F.lit("pass"),
              F.when(F.size(hc) > 0, _text("high_card", F.array_join(hc, ", "))).otherwise(_text("high_card_none"))),
        _item(4, CHECKS[3], F.when(has["has_grants"], "pass").otherwise("warn"),
              F.when(has["has_grants"], _text("grants_yes")).otherwise(_text("grants_no"))),
        _item(5, CHECKS[4],
              F.when(has["has_tracking"] & has["has_registry"], "pass")
               .when(has["has_tracking"], "warn").otherwise("fail"),
              F.when(has["has_tracking"] & has["has_registry"], _text("tracking_full"))
               .when(has["has_tracking"], _text("tracking_partial")).otherwise(_text("tracking_none"))),
        _item(6, CHECKS[5], F.when(has["has_widgets"], "pass").otherwise("fail"),
              F.when(has["has_widgets"], _text("widgets_yes")).otherwise(_text("widgets_no"))),
        _item(7, CHECKS[6], F.when(has["has_alias"], "pass").otherwise("warn"),
              F.when(has["has_alias"], _text("alias_yes")).otherwise(_text("alias_no"))),
        _item(8, CHECKS[7], F.lit("pass"),
              _text("cost", F.coalesce(F.col("estimated_cost"), F.lit("Unknown")))),
    )
    return p.select("run_id", F.inline(items))


def scorecard_overall(items: DataFrame) -> DataFrame:
    """A13 + F24: per run counts of fail / warn / pass and the overall
    status with its summary text."""
    agg = items.groupBy("run_id").agg(
        F.count_if(F.col("status") == "fail").alias("fail_count"),
        F.count_if(F.col("status") == "warn").alias("warn_count"),
        F.count_if(F.col("status") == "pass").alias("pass_count"))
    overall = readiness("fail_count", "warn_count")
    summary = (F.when(F.col("fail_count") > 0, _text("summary_blocked", F.col("fail_count").cast("string")))
               .when(F.col("warn_count") > 0, _text("summary_review", F.col("warn_count").cast("string")))
               .otherwise(_text("summary_ready")))
    return agg.select("*", overall.alias("overall"), summary.alias("summary"))


# Fixed values — column-name patterns that suggest target leakage.
LEAKAGE_NAME_RE = r"(?i)(status|result|outcome|final|_after$|^post_)"


def leakage_name_check(columns: DataFrame) -> DataFrame:
    """Columns of the column table (table_name, column_name, ...) whose
    names suggest information only known after the target event."""
    return columns.where(F.col("column_name").rlike(LEAKAGE_NAME_RE)).select(
        "table_name", "column_name", F.lit("warn").alias("status"),
        F.concat(F.lit("Column '"), F.col("column_name"),
                 F.lit("' may leak the target")).alias("detail"))


def random_split_on_dated_tables(plans: DataFrame, columns: DataFrame) -> DataFrame:
    """Runs with a random split whose feature tables have a date column
    warn (plans carry feature_tables array<string>)."""
    dated = (columns.where(F.col("data_type").isin("date", "timestamp", "timestamp_ntz")
                           | F.col("column_name").contains("date"))
             .select("table_name").distinct())
    p = plans.where(F.col("split_strategy") == "random").select(
        "run_id", F.explode("feature_tables").alias("table_name"))
    hits = p.join(dated, "table_name", "left_semi")
    return hits.groupBy("run_id").agg(F.sort_array(F.collect_set("table_name")).alias("dated_tables")) \
               .withColumn("status", F.lit("warn"))


def missing_grants(job_tables: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Tables a run's jobs read without a GRANT for them in its code
    (status ``warn`` as the code has it). job_tables: run_id, table_name."""
    py = artifacts.where(F.col("filename").endswith(".py"))
    # the names that the texts grant, then a join on them: no table meets every text of its run
    names = F.regexp_extract_all("content", F.lit(r"GRANT SELECT ON TABLE ([\w.`]+)"), F.lit(1))
    granted = py.select("run_id", F.explode(names).alias("table_name"))
    g = granted.select("run_id", F.regexp_replace("table_name", r"`|\.$", "").alias("table_name")).distinct()
    return job_tables.join(g, ["run_id", "table_name"], "left_anti").withColumn("status", F.lit("warn"))
