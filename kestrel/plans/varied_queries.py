"""Registered queries in which every branch of a rule occurs: rows derived from
the given tables carry the phrases, plans, names and times that the tables
themselves lack (SURVEY P7, P13, P14, G6–G9, F12, F16, F18–F23, S7–S11, S15, T6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kestrel.functions import scalars as sc
from kestrel.operators import asof, governance as gv
from kestrel.plans import governance_queries as gq
from kestrel.plans.feature_oracles import STAR_CTE
from kestrel.plans.feature_queries import STAR_COLS, star_orders
from kestrel.plans.modeling_queries import class_weights
from kestrel.plans.profile_queries import SCHEMA
from kestrel.session import shared_path
from kestrel.sources import catalog as cat
from kestrel.sources import sinks
from kestrel.sources import starschema as ss
from kestrel.sources.tables import TABLES, table

# One phrase for every off-topic pattern, then some that none matches.
PHRASES = ["will the weather hold", "the price of bitcoin", "a recipe for soup", "who won at football", "which movie is best", "tell a joke",
           "how to install it", "set up the vpn", "open the aws console", "what is machine learning", "who is the president", "who is ceo of acme",
           "what time is it", "which columns are keys", "who is ceo of databricks", "storyboards of sales"]


# ---------------------------------------------------------------- P13
def offtopic_mixed(spark, sf_dir):
    """P13 on questions of every kind: each turn opens with one of ``PHRASES``,
    every seventeenth is cut to a few characters."""
    c = table(spark, sf_dir, "conversations")
    n = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(PHRASES) + 1)).cast("int")
    phrase = F.try_element_at(F.array(*map(F.lit, PHRASES)), n + 1)
    q = F.when(n == len(PHRASES), F.substring("text", 1, 6)).otherwise(F.concat(phrase, F.lit(" "), F.col("text")))
    return c.select("conv_id", "turn", n.alias("kind"), sc.off_topic(q).alias("off_topic"))


# ---------------------------------------------------------------- P14, G6
NEEDLES = ["GRANT SELECT ON TABLE files.testdata.", "import mlflow", "databricks-uc", "dbutils.widgets.get", "@Champion"]


def _mixed_artifacts(spark, sf_dir):
    """Documents as artifacts; a source's number decides, bit by bit, which texts
    its artifacts end with (a grant names a table)."""
    d = table(spark, sf_dir, "documents")
    s = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    names = F.element_at(F.array(*map(F.lit, TABLES)), F.pmod("doc_id", F.lit(len(TABLES))).cast("int") + 1)
    texts = [F.when(F.shiftright(s, b).bitwiseAND(1) == 1, F.concat(F.lit("\n" + t), names if b == 0 else F.lit(""))).otherwise(F.lit("")) for b, t in enumerate(NEEDLES)]
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.pmod("doc_id", F.lit(3)) > 0, ".py").otherwise(".yml"))
    return d.select(F.col("source").alias("run_id"), name.alias("filename"), F.concat(F.coalesce("text", F.lit("")), *texts).alias("content"))


def _mixed_plans(spark, sf_dir):
    """A plan for every source, of settings that its number picks."""
    s = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    pick = lambda by, *values: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(s, F.lit(by)).cast("int") + 1)
    b = table(spark, sf_dir, "documents").select("source").distinct()
    return b.select(
        F.col("source").alias("run_id"), pick(3, "temporal", "random", "stratified").alias("split_strategy"),
        F.when(F.pmod(s, F.lit(2)) == 0, "order_date").alias("split_column"), pick(4, "classification", "forecasting", "forecasting", "regression").alias("ml_type"),
        pick(2, "imbalanced", "balanced").alias("balance_type"), pick(5, "none", "class_weight", "none", "class_weight", "none").alias("balance_strategy"),
        F.when(F.pmod(s, F.lit(7)) > 0, F.concat(s.cast("string"), F.lit(":1"))).alias("estimated_ratio"),
        F.when(F.pmod(s, F.lit(2)) == 1, F.array(F.lit("user_id"), F.lit("url"))).alias("high_cardinality_cols"),
        F.when(F.pmod(s, F.lit(3)) == 1, F.lit("$4.20")).alias("estimated_cost"),
        F.array(pick(2, "orders", "nation"), pick(5, "events", "part", "lineitem", "region", "labels")).alias("feature_tables"))


def artifact_flags_mixed(spark, sf_dir):
    """P11 + P14: runs with and without each text."""
    return gv.artifact_flags(_mixed_artifacts(spark, sf_dir))


def scorecard_mixed(spark, sf_dir):
    """Every status and text of the eight checks."""
    return gv.scorecard_items(_mixed_plans(spark, sf_dir), gv.artifact_flags(_mixed_artifacts(spark, sf_dir)))


def scorecard_overall_mixed(spark, sf_dir):
    """A13 + F24: blocked, to review and ready."""
    return gv.scorecard_overall(scorecard_mixed(spark, sf_dir))


def governance_findings(spark, sf_dir):
    """G7 by name, G8 and G9 as rows (rule, subject, detail, status)."""
    columns = cat.parquet_columns(spark, sf_dir)
    plans = _mixed_plans(spark, sf_dir)
    names = gv.leakage_name_check(columns).select(F.lit("leakage_name").alias("rule"), F.col("table_name").alias("subject"), F.col("column_name").alias("detail"), "status")
    dated = gv.random_split_on_dated_tables(plans, columns).select(F.lit("random_split").alias("rule"), F.col("run_id").alias("subject"), F.array_join("dated_tables", ",").alias("detail"), "status")
    read = plans.select("run_id", F.explode("feature_tables").alias("t")).select("run_id", F.concat(F.lit("files.testdata."), F.col("t")).alias("table_name"))
    grants = gv.missing_grants(read, _mixed_artifacts(spark, sf_dir)).select(F.lit("missing_grant").alias("rule"), F.col("run_id").alias("subject"), F.col("table_name").alias("detail"), "status")
    return names.unionByName(dated).unionByName(grants)


def feature_time_leaks(spark, sf_dir):
    """G7 on the data: purchases are labels, a user's latest view is the feature.
    Every tenth purchase was given the next view instead (a leak), every tenth
    one of three days before, every tenth another value. Counts by what was done
    and what the check says."""
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("feature_time"), "value")
    labels = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("label_time"), "event_id", F.pmod("event_id", F.lit(10)).cast("int").alias("digit"))
    given = lambda df, time, **kw: asof.asof_join(df, views, "user_id", time, "feature_time", ["value"], **kw).withColumnsRenamed({"feature_time": "used_time", "value": "used_value"})
    right = given(labels.where("digit > 1"), "label_time").withColumn("used_value", F.when(F.col("digit") == 2, F.col("used_value") + 1).otherwise(F.col("used_value")))
    later = given(labels.where("digit = 0"), "label_time", strict=False, forward=True)
    early = given(labels.where("digit = 1").withColumn("_before", F.col("label_time") - F.expr("INTERVAL 3 DAYS")), "_before").drop("_before")
    used = right.unionByName(later).unionByName(early)
    checked = asof.feature_time_check(used, views, "user_id", "label_time", "feature_time", "value")
    done = F.when(F.col("digit") == 0, "future").when(F.col("digit") == 1, "old").when(F.col("digit") == 2, "altered").otherwise("clean")
    return checked.groupBy(done.alias("given"), "status").agg(F.count(F.lit(1)).alias("labels"))


# ---------------------------------------------------------------- F12, F16, F18–F23
def text_functions(spark, sf_dir):
    """F12, F18–F22 on every turn."""
    c = table(spark, sf_dir, "conversations")
    nodes = F.element_at(F.array(*map(F.lit, ["human_checkpoint", "dry_run_checkpoint", "human_checkpoint_code", "write_bundle", "", "rank"])), F.pmod("turn", F.lit(6)).cast("int") + 1)
    marked = F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.col("text"), F.lit(" ANALYSIS: "), F.col("role"), F.lit(" ANALYSIS: again "))).otherwise(F.col("text"))
    full = F.concat(F.lit("cat."), F.col("role"), F.lit(".t"), F.col("conv_id").cast("string"))
    c = c.withColumns({"_marked": marked, "_full": full, "_flag": F.element_at(F.array(F.lit("YES"), F.lit("NO"), F.lit(None).cast("string")), F.pmod("conv_id", F.lit(3)).cast("int") + 1)})
    return c.select("conv_id", "turn", sc.slugify(F.substring("text", 1, 30)).alias("slug"), sc.preview("text", 80).alias("preview"),
                    sc.after_marker("_marked", "ANALYSIS:").alias("analysis"), sc.name_part("_full", 2).alias("schema_part"), sc.name_part("_full", 3).alias("table_part"),
                    sc.nullable_flag("_flag").alias("nullable"), sc.status_of_next(F.pmod("conv_id", F.lit(5)) > 0, F.when(F.pmod("turn", F.lit(7)) < 6, nodes)).alias("status"))


def json_functions(spark, sf_dir):
    """F16 and F23 on every event: fenced, bare and broken JSON texts."""
    e = table(spark, sf_dir, "events")
    k = F.pmod("event_id", F.lit(4))
    text = (F.when(k == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(k == 1, F.concat(F.lit("  ```"), F.col("props"), F.lit("```  ")))
            .when(k == 2, F.col("props")).otherwise(F.concat(F.lit("{"), F.col("props"))))
    e = e.withColumn("_text", text).withColumn("_at", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    return e.select("event_id", sc.strip_code_fences("_text").alias("stripped"), sc.parse_json_text("_text", "k long")["k"].alias("k"), sc.clock_time("_at").alias("clock"))


# ---------------------------------------------------------------- S7–S11, P7
def session_catalog(spark, sf_dir):
    """S7–S11, P7, F20, F22 on the session's own catalog: all given tables as
    external ones of a scratch database, two managed ones and a view, read back.
    A row for each column of what P7 keeps and of the view, which it does not."""
    db = f"kestrel_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {db} LOCATION '{shared_path(spark, 'catalog', db)}'")
    try:
        for n in TABLES:
            spark.catalog.createTable(f"{db}.{n}", path=f"{sf_dir.rstrip('/')}/{n}.parquet", source="parquet")
        for n in ("region", "nation"):
            table(spark, sf_dir, n).write.saveAsTable(f"{db}.{n}_copy")
        spark.sql(f"CREATE VIEW {db}.supplier_names AS SELECT s_suppkey, s_name FROM {db}.supplier")
        every = cat.split_full_name(cat.catalog_tables(spark, db, types=(*cat.KEPT_TABLE_TYPES, "VIEW")))
        kept = cat.catalog_tables(spark, db).select("name", F.lit(True).alias("kept"))
        looked_up = [r.name for n in ("nation", "absent") for r in cat.table_lookup(every, f"spark_catalog.{db}.{n}").collect()]
        exist = [n for n in (*TABLES, "absent", "supplier_names") if cat.table_exists(spark, n, db)]
        browsed = cat.browse(spark)[1].where(F.col("database") == db).count() == 1 and cat.database_exists(spark, db) and not cat.database_exists(spark, db + "_absent")
        columns = cat.with_nullable(cat.catalog_columns(spark, db)).withColumnRenamed("table_name", "name")
        out = every.join(columns, "name").join(kept, "name", "left")
        return out.select("name", "table_type", "ordinal_position", "column_name", "data_type", "nullable", F.coalesce("kept", F.lit(False)).alias("kept"),
                          "catalog_part", (F.col("schema_part") == db).alias("schema_matches"), F.col("table_part").alias("table_part"),
                          F.col("name").isin(looked_up).alias("looked_up"), F.col("name").isin(exist).alias("exists"), F.lit(browsed).alias("database_found"))
    finally:
        spark.sql(f"DROP DATABASE {db} CASCADE")


# ---------------------------------------------------------------- S15, T6
def csv_round_trip(spark, sf_dir):
    """Class weights exported as CSV and read back."""
    path = shared_path(spark, "csv", uuid.uuid4().hex)
    sinks.export_csv(class_weights(spark, sf_dir), path)
    return spark.read.option("header", True).schema("product_category string, class_count long, weight double").csv(path)


def sample_head(spark, sf_dir):
    """The first ten lines in a total order (the limit is the feature)."""
    return star_orders(spark, sf_dir).orderBy(*[c for c in ss.ORDER_KEYS if c in STAR_COLS], "revenue").limit(10)


QUERIES = {f.__name__: f for f in (offtopic_mixed, artifact_flags_mixed, scorecard_mixed, scorecard_overall_mixed, governance_findings, feature_time_leaks,
                                   text_functions, json_functions, session_catalog, csv_round_trip, sample_head)}


# ---------------------------------------------------------------- oracles
def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_S = "CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER)"
_NEEDLE_SQL = " || ".join(f"CASE WHEN ({_S} >> {b}) & 1 = 1 THEN chr(10) || '{t}'" + (f" || {_quoted(TABLES)}[doc_id % {len(TABLES)} + 1]" if b == 0 else "") + " ELSE '' END"
                          for b, t in enumerate(NEEDLES))
MIXED_CTE = f"""
art AS (SELECT source AS run_id, CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 > 0 THEN '.py' ELSE '.yml' END AS filename,
               coalesce(text, '') || {_NEEDLE_SQL} AS content FROM documents),
flags AS (
  SELECT run_id, bool_or(contains(content, 'GRANT SELECT')) AS has_grants, bool_or(contains(lower(content), 'mlflow')) AS has_tracking,
         bool_or(contains(content, 'databricks-uc')) AS has_registry, bool_or(contains(content, 'dbutils.widgets')) AS has_widgets,
         bool_or(contains(content, 'Champion')) AS has_alias, count(*) AS py_files
  FROM art WHERE suffix(filename, '.py') GROUP BY run_id),
plans AS (
  SELECT source AS run_id, ['temporal', 'random', 'stratified'][s % 3 + 1] AS split_strategy, CASE WHEN s % 2 = 0 THEN 'order_date' END AS split_column,
         ['classification', 'forecasting', 'forecasting', 'regression'][s % 4 + 1] AS ml_type, ['imbalanced', 'balanced'][s % 2 + 1] AS balance_type,
         ['none', 'class_weight', 'none', 'class_weight', 'none'][s % 5 + 1] AS balance_strategy, CASE WHEN s % 7 > 0 THEN CAST(s AS VARCHAR) || ':1' END AS ratio,
         s % 2 = 1 AS high, CASE WHEN s % 3 = 1 THEN '$4.20' END AS cost,
         [['orders', 'nation'][s % 2 + 1], ['events', 'part', 'lineitem', 'region', 'labels'][s % 5 + 1]] AS feature_tables
  FROM (SELECT DISTINCT source, {_S} AS s FROM documents)),
p AS (SELECT plans.*, coalesce(has_grants, false) AS g, coalesce(has_tracking, false) AS t, coalesce(has_registry, false) AS r,
             coalesce(has_widgets, false) AS w, coalesce(has_alias, false) AS a FROM plans LEFT JOIN flags USING (run_id))"""


def _items_sql() -> str:
    t = {k: v.replace("'", "''") for k, v in gv.TEXTS.items()}
    fill = lambda key, value: "'" + t[key].replace("{}", f"' || {value} || '") + "'"
    rows = [
        ("CASE WHEN split_strategy = 'random' AND ml_type = 'forecasting' THEN 'warn' ELSE 'pass' END",
         f"CASE WHEN split_strategy = 'temporal' AND split_column IS NOT NULL THEN {fill('split_temporal', 'split_column')} WHEN split_strategy = 'random' AND ml_type = 'forecasting' THEN '{t['split_random_series']}' ELSE {fill('split_applied', 'upper(split_strategy[1]) || split_strategy[2:]')} END"),
        ("CASE WHEN balance_type = 'imbalanced' AND balance_strategy = 'none' THEN 'warn' ELSE 'pass' END",
         f"CASE WHEN balance_type = 'imbalanced' AND balance_strategy = 'class_weight' THEN {fill('imbalance_weighted', 'coalesce(ratio, chr(63))')} WHEN balance_type = 'imbalanced' AND balance_strategy = 'none' THEN {fill('imbalance_unhandled', 'coalesce(ratio, chr(63))')} ELSE '{t['balanced']}' END"),
        ("'pass'", f"CASE WHEN high THEN {fill('high_card', chr(39) + 'user_id, url' + chr(39))} ELSE '{t['high_card_none']}' END"),
        ("CASE WHEN g THEN 'pass' ELSE 'warn' END", f"CASE WHEN g THEN '{t['grants_yes']}' ELSE '{t['grants_no']}' END"),
        ("CASE WHEN t AND r THEN 'pass' WHEN t THEN 'warn' ELSE 'fail' END", f"CASE WHEN t AND r THEN '{t['tracking_full']}' WHEN t THEN '{t['tracking_partial']}' ELSE '{t['tracking_none']}' END"),
        ("CASE WHEN w THEN 'pass' ELSE 'fail' END", f"CASE WHEN w THEN '{t['widgets_yes']}' ELSE '{t['widgets_no']}' END"),
        ("CASE WHEN a THEN 'pass' ELSE 'warn' END", f"CASE WHEN a THEN '{t['alias_yes']}' ELSE '{t['alias_no']}' END"),
        ("'pass'", fill("cost", "coalesce(cost, 'Unknown')")),
    ]
    return " UNION ALL ".join(f"SELECT run_id, {i + 1} AS check_order, '{c}' AS \"check\", {status} AS status, {detail} AS detail FROM p" for i, (c, (status, detail)) in enumerate(zip(gv.CHECKS, rows)))


_OVERALL = gq.ORACLES["scorecard_overall"][gq.ORACLES["scorecard_overall"].rindex("SELECT run_id, count(*) FILTER"):]
_TYPES = {t: [(c, ty) for c, ty in cols] for t, cols in SCHEMA.items()}


def _catalog_sql() -> str:
    given = [(t, "EXTERNAL", t) for t in TABLES] + [(f"{t}_copy", "MANAGED", t) for t in ("region", "nation")] + [("supplier_names", "VIEW", None)]
    rows = []
    for name, kind, of in given:
        cols = _TYPES[of] if of else [("s_suppkey", "bigint"), ("s_name", "string")]
        rows += [f"('{name}', '{kind}', {i + 1}, '{c}', '{ty}', true, {str(kind != 'VIEW').lower()}, 'spark_catalog', true, '{name}', {str(name == 'nation').lower()}, {str(of == name or kind == 'VIEW').lower()}, true)" for i, (c, ty) in enumerate(cols)]
    names = "name, table_type, ordinal_position, column_name, data_type, nullable, kept, catalog_part, schema_matches, table_part, looked_up, \"exists\", database_found"
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t({names})"


_RX = gq._regex_oracle().replace("'", "''")
ORACLES = {
    "offtopic_mixed": f"""
WITH q AS (SELECT conv_id, turn, CAST((conv_id * 7 + turn) % {len(PHRASES) + 1} AS INTEGER) AS kind, text FROM conversations),
t AS (SELECT conv_id, turn, kind, regexp_replace(CASE WHEN kind = {len(PHRASES)} THEN substr(text, 1, 6) ELSE {_quoted(PHRASES)}[kind + 1] || ' ' || text END, '^\\s+|\\s+$', '', 'g') AS t FROM q)
SELECT conv_id, turn, kind, length(t) < 8 OR regexp_matches(t, '{_RX}') AS off_topic FROM t""",
    "artifact_flags_mixed": f"WITH {MIXED_CTE} SELECT * FROM flags",
    "scorecard_mixed": f"WITH {MIXED_CTE} {_items_sql()}",
    "scorecard_overall_mixed": f"WITH {MIXED_CTE}, items AS ({_items_sql()}) {_OVERALL}",
    "governance_findings": f"""WITH {MIXED_CTE},
cols(t, c, ty) AS (VALUES {", ".join(f"('{t}', '{c}', '{ty}')" for t, cols in SCHEMA.items() for c, ty in cols)}),
dated AS (SELECT DISTINCT t FROM cols WHERE ty IN ('date', 'timestamp', 'timestamp_ntz') OR contains(c, 'date')),
reads AS (SELECT run_id, unnest(feature_tables) AS t FROM plans),
granted AS (SELECT DISTINCT run_id, unnest(regexp_extract_all(content, 'GRANT SELECT ON TABLE ([\\w.]+)', 1)) AS t FROM art WHERE suffix(filename, '.py'))
SELECT 'leakage_name' AS rule, t AS subject, c AS detail, 'warn' AS status FROM cols WHERE regexp_matches(c, '{gv.LEAKAGE_NAME_RE}')
UNION ALL SELECT 'random_split', run_id, string_agg(t, ',' ORDER BY t), 'warn'
  FROM (SELECT DISTINCT run_id, t FROM reads JOIN plans USING (run_id) JOIN dated USING (t) WHERE split_strategy = 'random') GROUP BY run_id
UNION ALL SELECT 'missing_grant', run_id, 'files.testdata.' || t, 'warn' FROM reads
  WHERE NOT EXISTS (SELECT 1 FROM granted WHERE granted.run_id = reads.run_id AND granted.t = 'files.testdata.' || reads.t)""",
    "feature_time_leaks": """
WITH v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
l AS (SELECT user_id, ts AS label_time, event_id, CAST(event_id % 10 AS INTEGER) AS digit FROM events WHERE event_type = 'purchase'),
g AS (SELECT l.*,
        (SELECT max(row(v.ts, v.value)) FROM v WHERE v.user_id = l.user_id AND v.ts < l.label_time) AS latest,
        (SELECT max(row(v.ts, v.value)) FROM v WHERE v.user_id = l.user_id AND v.ts < l.label_time - INTERVAL 3 DAY) AS old,
        (SELECT min(v.ts) FROM v WHERE v.user_id = l.user_id AND v.ts >= l.label_time) AS next FROM l),
u AS (SELECT digit, label_time, latest[1] AS lt, latest[2] AS lv,
             CASE digit WHEN 0 THEN next WHEN 1 THEN old[1] ELSE latest[1] END AS ut,
             CASE digit WHEN 1 THEN old[2] WHEN 2 THEN latest[2] + 1 ELSE latest[2] END AS uv FROM g),
s AS (SELECT CASE digit WHEN 0 THEN 'future' WHEN 1 THEN 'old' WHEN 2 THEN 'altered' ELSE 'clean' END AS given,
             CASE WHEN ut >= label_time THEN 'leak' WHEN ut IS NULL THEN CASE WHEN lt IS NULL THEN 'none' ELSE 'missing' END
                  WHEN lt IS NULL OR ut <> lt THEN 'stale' WHEN uv IS DISTINCT FROM lv THEN 'changed' ELSE 'ok' END AS status FROM u)
SELECT given, status, count(*) AS labels FROM s GROUP BY given, status""",
    "text_functions": """
WITH c AS (SELECT *, CASE WHEN turn % 2 = 0 THEN text || ' ANALYSIS: ' || role || ' ANALYSIS: again ' ELSE text END AS marked,
                  CASE WHEN turn % 7 < 6 THEN ['human_checkpoint', 'dry_run_checkpoint', 'human_checkpoint_code', 'write_bundle', '', 'rank'][turn % 6 + 1] END AS node FROM conversations)
SELECT conv_id, turn, regexp_replace(regexp_replace(lower(trim(substr(text, 1, 30))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
       substr(text, 1, 80) AS preview, CASE WHEN contains(marked, 'ANALYSIS:') THEN trim(substr(marked, strpos(marked, 'ANALYSIS:') + 9)) END AS analysis,
       role AS schema_part, 't' || CAST(conv_id AS VARCHAR) AS table_part, conv_id % 3 <> 1 AS nullable,
       CASE WHEN conv_id % 5 = 0 THEN 'not_found' WHEN node IS NULL OR node = '' THEN 'completed' WHEN node = 'human_checkpoint' THEN 'awaiting_approval'
            WHEN node = 'dry_run_checkpoint' THEN 'awaiting_dry_run_confirmation' WHEN node = 'human_checkpoint_code' THEN 'awaiting_code_review' ELSE 'running' END AS status
FROM c""",
    "json_functions": """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN '{' || props ELSE props END AS stripped,
       CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, strftime(ts, '%H:%M:%S') AS clock FROM events""",
    "session_catalog": _catalog_sql(),
    "sample_head": f"WITH {STAR_CTE} SELECT {', '.join(STAR_COLS)} FROM star ORDER BY {', '.join(c for c in ss.ORDER_KEYS if c in STAR_COLS)}, revenue LIMIT 10",
}


def _csv_oracle() -> str:
    from kestrel.plans.modeling_queries import ORACLES as MODELING
    return MODELING["class_weights"]


ORACLES["csv_round_trip"] = _csv_oracle()
