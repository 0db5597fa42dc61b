"""Registered queries: run history, text rules, class balance, scorecard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.scalars import off_topic
from kestrel.operators import governance as gv
from kestrel.operators import history as hs
from kestrel.sources.tables import table

SPLIT_AT = "2024-01-20"


# ---------------------------------------------------------------- history
def _updates(spark, sf_dir) -> DataFrame:
    """One upsert call per event: signup sets the catalog, view the schema,
    purchase the use case; others send empty strings; status = event type."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))

    def pick(t, prefix):
        return F.when(F.col("event_type") == t, F.concat(F.lit(prefix), k)).otherwise(F.lit(""))
    return e.select(F.col("user_id").cast("string").alias("run_id"),
                    pick("signup", "catalog_").alias("catalog"),
                    pick("view", "schema_").alias("schema_name"),
                    pick("purchase", "use_case_").alias("use_case"),
                    F.col("event_type").alias("status"), at.alias("at"),
                    F.col("event_id").alias("tie"))


def run_history(spark, sf_dir):
    """S13 + A9: run history from a log of upserts."""
    return hs.history_from_updates(_updates(spark, sf_dir))


def run_history_merge(spark, sf_dir):
    """Updates merged into a stored history (one aggregation)."""
    u = _updates(spark, sf_dir)
    stored = hs.history_from_updates(u.where(F.col("at") < SPLIT_AT))
    return hs.merge_history(stored, u.where(F.col("at") >= SPLIT_AT))


def run_history_recent(spark, sf_dir):
    """Newest runs first, limit 20."""
    return hs.latest_runs(hs.history_from_updates(_updates(spark, sf_dir)), 20)


# ---------------------------------------------------------------- text rules
def offtopic_questions(spark, sf_dir):
    """Off-topic predicate over user turns."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    return c.select("conv_id", "turn", off_topic("text").alias("off_topic"))


def _artifacts(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("run_id"),
                    F.concat(F.col("doc_id").cast("string"),
                             F.when(F.col("lang") == "en", ".py").otherwise(".yml")).alias("filename"),
                    F.col("text").alias("content"))


def artifact_flags(spark, sf_dir):
    """P11 + P14: presence rules over each run's .py artifacts."""
    return gv.artifact_flags(_artifacts(spark, sf_dir))


def _labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "inner")


def class_balance(spark, sf_dir):
    """A25 + A18: class share, imbalance flag, scale_pos_weight."""
    return gv.class_balance(_labelled(spark, sf_dir), "source", "toxic")


def _plans(spark, sf_dir) -> DataFrame:
    b = gv.class_balance(_labelled(spark, sf_dir), "source", "toxic")
    return b.select(
        F.col("source").alias("run_id"), F.lit("random").alias("split_strategy"),
        F.lit(None).cast("string").alias("split_column"), F.lit("classification").alias("ml_type"),
        "balance_type",
        F.when(F.col("positives") > 0, "class_weight").otherwise("none").alias("balance_strategy"),
        "estimated_ratio", F.array().cast("array<string>").alias("high_cardinality_cols"),
        F.lit("Unknown").alias("estimated_cost"))


def scorecard(spark, sf_dir):
    """The eight rule checks per run."""
    return gv.scorecard_items(_plans(spark, sf_dir), gv.artifact_flags(_artifacts(spark, sf_dir)))


def scorecard_overall(spark, sf_dir):
    """A13 + F24: counts per status and the overall readiness."""
    return gv.scorecard_overall(scorecard(spark, sf_dir))


QUERIES = {
    "run_history": run_history,
    "run_history_merge": run_history_merge,
    "run_history_recent": run_history_recent,
    "offtopic_questions": offtopic_questions,
    "artifact_flags": artifact_flags,
    "class_balance": class_balance,
    "scorecard": scorecard,
    "scorecard_overall": scorecard_overall,
}

# ---------------------------------------------------------------- oracles
UPD_CTE = """
u AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id,
         CASE WHEN event_type = 'signup' THEN 'catalog_' || json_extract_string(props, '$.k') ELSE '' END AS catalog,
         CASE WHEN event_type = 'view' THEN 'schema_' || json_extract_string(props, '$.k') ELSE '' END AS schema_name,
         CASE WHEN event_type = 'purchase' THEN 'use_case_' || json_extract_string(props, '$.k') ELSE '' END AS use_case,
         event_type AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS upd_at, event_id AS tie
  FROM events
)"""

HISTORY_SQL = f"""WITH {UPD_CTE},
h AS (
  SELECT run_id,
         coalesce(arg_max(catalog, row(upd_at, tie)) FILTER (WHERE catalog <> ''), '') AS catalog,
         coalesce(arg_max(schema_name, row(upd_at, tie)) FILTER (WHERE schema_name <> ''), '') AS schema_name,
         coalesce(arg_max(use_case, row(upd_at, tie)) FILTER (WHERE use_case <> ''), '') AS use_case,
         arg_max(status, row(upd_at, tie)) AS status, min(upd_at) AS created_at, max(upd_at) AS updated_at
  FROM u GROUP BY run_id
)"""


def _regex_oracle() -> str:
    """The off-topic patterns for RE2 (no look-ahead): 'ceo of' followed by
    a word that does not start with 'databricks' is spelled out."""
    from kestrel.functions.scalars import OFF_TOPIC_PATTERNS
    word = "databricks"
    # r(i): the text here does not continue with word[i:] (after word[:i]).
    r = f"(?:$|[^{word[-1]}])"
    for i in range(len(word) - 2, 0, -1):
        r = f"(?:$|[^{word[i]}]|{word[i]}{r})"
    # first char: a word character (for the trailing \b), not the start of word
    not_db = f"(?:[0-9a-ce-z_]|d{r})"
    pats = []
    for p in OFF_TOPIC_PATTERNS:
        if "(?!" in p:
            p = (r"\b(who\s+is\s+(the\s+)?(president|prime\s+minister))\b"
                 + "|" + r"\bwho\s+is\s+(the\s+)?ceo\s+of\s+" + not_db)
        pats.append(p)
    return "(?i)" + "|".join(pats)


OFFTOPIC_SQL = f"""
SELECT conv_id, turn,
       (length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 8
        OR regexp_matches(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '{_regex_oracle().replace("'", "''")}')) AS off_topic
FROM conversations WHERE role = 'user'
"""

ART_CTE = """
art AS (
  SELECT source AS run_id, CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'en' THEN '.py' ELSE '.yml' END AS filename,
         text AS content
  FROM documents
),
flags AS (
  SELECT run_id, bool_or(contains(content, 'GRANT SELECT')) AS has_grants,
         bool_or(contains(lower(content), 'mlflow')) AS has_tracking,
         bool_or(contains(content, 'databricks-uc')) AS has_registry,
         bool_or(contains(content, 'dbutils.widgets')) AS has_widgets,
         bool_or(contains(content, 'Champion')) AS has_alias,
         count(*) AS py_files
  FROM art WHERE suffix(filename, '.py') GROUP BY run_id
)"""

BAL_CTE = """
bal AS (
  SELECT d.source, count(*) FILTER (WHERE l.toxic = 1) AS positives, count(*) FILTER (WHERE l.toxic = 0) AS negatives
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source
),
balx AS (
  SELECT source, positives, negatives,
         CAST(positives AS DOUBLE) / CAST(positives + negatives AS DOUBLE) AS positive_share
  FROM bal
),
balance AS (
  SELECT source, positives, negatives, positive_share,
         CASE WHEN positive_share < 0.1 THEN 'imbalanced' ELSE 'balanced' END AS balance_type,
         CAST(CAST(round(100.0 * (1 - positive_share)) AS INTEGER) AS VARCHAR) || ':' ||
           CAST(CAST(round(100.0 * positive_share) AS INTEGER) AS VARCHAR) AS estimated_ratio,
         CASE WHEN positives = 0 THEN NULL ELSE CAST(negatives AS DOUBLE) / CAST(positives AS DOUBLE) END AS scale_pos_weight
  FROM balx
)"""


def _scorecard_sql() -> str:
    return f"""WITH {ART_CTE}, {BAL_CTE},
p AS (
  SELECT b.source AS run_id, b.balance_type,
         CASE WHEN b.positives > 0 THEN 'class_weight' ELSE 'none' END AS balance_strategy,
         b.estimated_ratio,
         coalesce(f.has_grants, false) AS g, coalesce(f.has_tracking, false) AS t,
         coalesce(f.has_registry, false) AS r, coalesce(f.has_widgets, false) AS w,
         coalesce(f.has_alias, false) AS a
  FROM balance b LEFT JOIN flags f ON b.source = f.run_id
),
items AS (
  SELECT run_id, 1 AS check_order, 'Train/test split' AS "check", 'pass' AS status, 'Random split applied' AS detail FROM p
  UNION ALL
  SELECT run_id, 2, 'Class imbalance',
         CASE WHEN balance_type = 'imbalanced' AND balance_strategy = 'none' THEN 'warn' ELSE 'pass' END,
         CASE WHEN balance_type = 'imbalanced' AND balance_strategy = 'class_weight'
                THEN 'Imbalance detected (' || coalesce(estimated_ratio, '?') || '), handled via class_weight'
              WHEN balance_type = 'imbalanced' AND balance_strategy = 'none'
                THEN 'Imbalance detected (' || coalesce(estimated_ratio, '?') || ') but no strategy set — model may predict majority class'
              ELSE 'Dataset appears balanced' END FROM p
  UNION ALL
  SELECT run_id, 3, 'High-cardinality features', 'pass', 'None detected' FROM p
  UNION ALL
  SELECT run_id, 4, 'UC access grants', CASE WHEN g THEN 'pass' ELSE 'warn' END,
         CASE WHEN g THEN 'GRANT SELECT statements included in notebooks'
              ELSE 'No GRANT statements found — downstream consumers may lack access' END FROM p
  UNION ALL
  SELECT run_id, 5, 'MLflow + UC registry', CASE WHEN t AND r THEN 'pass' WHEN t THEN 'warn' ELSE 'fail' END,
         CASE WHEN t AND r THEN 'MLflow tracking enabled, model registered in Unity Catalog'
              WHEN t THEN 'MLflow present but UC registry not confirmed'
              ELSE 'MLflow tracking not found in generated code' END FROM p
  UNION ALL
  SELECT run_id, 6, 'Job-safe parameters', CASE WHEN w THEN 'pass' ELSE 'fail' END,
         CASE WHEN w THEN 'dbutils.widgets used — notebooks safe for both interactive and job runs'
              ELSE 'Hardcoded values detected — notebooks may fail as scheduled jobs' END FROM p
  UNION ALL
  SELECT run_id, 7, 'Rollback path', CASE WHEN a THEN 'pass' ELSE 'warn' END,
         CASE WHEN a THEN 'Champion alias set in UC Model Registry — reassign alias to roll back'
              ELSE 'No Champion alias found — rollback requires manual version management' END FROM p
  UNION ALL
  SELECT run_id, 8, 'Estimated compute cost', 'pass', 'Unknown per full run (feature + training + inference)' FROM p
)"""


ORACLES = {
    "run_history": f"{HISTORY_SQL} SELECT * FROM h",
    "run_history_merge": f"{HISTORY_SQL} SELECT * FROM h",
    "run_history_recent": f"{HISTORY_SQL} SELECT * FROM h ORDER BY updated_at DESC, run_id ASC LIMIT 20",
    "offtopic_questions": OFFTOPIC_SQL,
    "artifact_flags": f"WITH {ART_CTE} SELECT * FROM flags",
    "class_balance": f"WITH {BAL_CTE} SELECT * FROM balance",
    "scorecard": _scorecard_sql() + " SELECT * FROM items",
    "scorecard_overall": _scorecard_sql() + """
SELECT run_id, count(*) FILTER (WHERE status = 'fail') AS fail_count,
       count(*) FILTER (WHERE status = 'warn') AS warn_count,
       count(*) FILTER (WHERE status = 'pass') AS pass_count,
       CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0 THEN 'blocked'
            WHEN count(*) FILTER (WHERE status = 'warn') > 0 THEN 'review_needed' ELSE 'ready' END AS overall,
       CASE WHEN count(*) FILTER (WHERE status = 'fail') > 0
              THEN CAST(count(*) FILTER (WHERE status = 'fail') AS VARCHAR) || ' critical issue(s) must be resolved before deployment.'
            WHEN count(*) FILTER (WHERE status = 'warn') > 0
              THEN CAST(count(*) FILTER (WHERE status = 'warn') AS VARCHAR) || ' warning(s) to review — deployment can proceed with awareness.'
            ELSE 'All checks passed. Code is ready to deploy.' END AS summary
FROM items GROUP BY run_id""",
}
