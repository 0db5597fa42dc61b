"""Registered schema-profiling queries and their DuckDB oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import profile as pr
from kestrel.operators import sketches as sk
from kestrel.session import cut_lineage
from kestrel.sources import catalog as cat
from kestrel.sources.tables import TABLES, table

HEADER = "Catalog: files.testdata"


def table_inventory(spark, sf_dir):
    """S7 + S8 + J8 + A12 + A15: tables with row/column counts and summary lines."""
    return pr.table_inventory(spark, sf_dir, cat.parquet_tables(spark, sf_dir), cat.parquet_columns(spark, sf_dir))


def estate_metrics(spark, sf_dir):
    """Tables, managed, external, columns, rows."""
    return pr.estate_metrics(table_inventory(spark, sf_dir))


def estate_summary(spark, sf_dir):
    """The rendered estate summary as one text."""
    return pr.estate_summary(table_inventory(spark, sf_dir), HEADER)


def column_profile(spark, sf_dir):
    """A24 + A6 + P9 + P12 + F26 + G7: one-pass per-column profile."""
    return pr.profile_tables(spark, sf_dir, TABLES)


def column_estimates(spark, sf_dir):
    """A24 + A6 by sketches that merge: every table is sketched in two halves, the
    halves are merged, and the estimates compared with the exact counts: within
    five standard errors, or not."""
    half = lambda df: F.pmod(F.xxhash64(df.columns[0]), F.lit(2))
    halves = [sk.column_sketches(df, n, part=half(df)) for n in TABLES for df in (table(spark, sf_dir, n),)]
    est = sk.estimates(sk.merged(cut_lineage(reduce(DataFrame.unionByName, halves), "sketches")))
    exact = cut_lineage(pr.profile_tables(spark, sf_dir, TABLES).select("table_name", "column_name", "distinct_count"), "profile")
    error = F.abs(F.col("distinct_estimate") - F.col("distinct_count"))
    bound = F.greatest(F.lit(1.0), 5 * F.lit(1.04 / 2 ** (sk.HLL_BITS / 2)) * F.col("distinct_count"))
    return est.join(exact, ["table_name", "column_name"]).select("table_name", "column_name", "kind", "row_count", "null_count", "distinct_count", (error <= bound).alias("within_bound"))


def inclusion_dependencies(spark, sf_dir):
    """J9 from the data alone: whole-number columns of all tables whose values are
    all in a column of unique values, by theta sketches and an exact check."""
    sketches = reduce(DataFrame.unionByName, [sk.column_sketches(table(spark, sf_dir, n), n, ("integer",)) for n in TABLES])
    return sk.inclusion_dependencies(spark, lambda n: table(spark, sf_dir, n), cut_lineage(sketches, "sketches"))


def relationship_candidates(spark, sf_dir):
    """FK candidates by name, checked on the data in one aggregation."""
    return pr.relationship_candidates(spark, sf_dir, cat.parquet_columns(spark, sf_dir))


def feature_plan(spark, sf_dir):
    """A transform per column chosen from its profile."""
    return pr.plan_from_profile(pr.profile_tables(spark, sf_dir, TABLES))


QUERIES = {
    "table_inventory": table_inventory,
    "estate_metrics": estate_metrics,
    "estate_summary": estate_summary,
    "column_profile": column_profile,
    "column_estimates": column_estimates,
    "inclusion_dependencies": inclusion_dependencies,
    "relationship_candidates": relationship_candidates,
    "feature_plan": feature_plan,
}

# ---------------------------------------------------------------- oracles
# The given test tables' schemas (column, Spark type name).
SCHEMA = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"),
               ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")],
    "embeddings": [("vec_id", "bigint"), ("embedding", "array<float>"), ("label", "int")],
    "pages": [("page_id", "bigint"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "bigint"), ("text", "string")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}
NUMERIC = {"int", "bigint", "double"}
KEY_RE = "(?i)(^id$|^uuid$|_id$)"
BIN_RE = "(?i)(churn|^is_|^flag_|active)"
LEAK_RE = "(?i)(status|result|outcome|final|_after$|^post_)"

# The foreign-key candidate pairs the name rule proposes on
# this schema (child table, child column, parent table, parent column).
PAIRS = [
    ("customer", "c_custkey", "orders", "o_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("customer", "c_nationkey", "supplier", "s_nationkey"), ("documents", "doc_id", "labels", "doc_id"),
    ("labels", "doc_id", "documents", "doc_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("nation", "n_nationkey", "customer", "c_nationkey"), ("nation", "n_nationkey", "supplier", "s_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("part", "p_partkey", "lineitem", "l_partkey"),
    ("region", "r_regionkey", "nation", "n_regionkey"), ("supplier", "s_nationkey", "customer", "c_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
]


def _inventory_cte() -> str:
    rows = []
    for t, cols in SCHEMA.items():
        summ = ", ".join(f"{c} ({ty})" for c, ty in cols)
        line_head = f"TABLE: files.testdata.{t} [EXTERNAL]"
        rows.append(f"""SELECT 'files' AS catalog, 'testdata' AS schema, '{t}' AS name,
  'files.testdata.{t}' AS full_name, 'EXTERNAL' AS table_type, (SELECT count(*) FROM {t}) AS row_count,
  {len(cols)} AS column_count, '{summ}' AS column_summary, '{line_head}' AS head""")
    body = "\nUNION ALL\n".join(rows)
    return f"""inv0 AS ({body}),
inv AS (
  SELECT catalog, schema, name, full_name, table_type, row_count, column_count, column_summary,
         head || CASE WHEN row_count > 0 THEN chr(10) || '  Row count (approx): ' || CAST(row_count AS VARCHAR) ELSE '' END
              || CASE WHEN column_count > 0 THEN chr(10) || '  Columns (' || CAST(column_count AS VARCHAR) || '): ' || column_summary ELSE '' END
           AS summary_line
  FROM inv0
)"""


def _profile_cte() -> str:
    parts = []
    for t in TABLES:
        for i, (c, ty) in enumerate(SCHEMA[t], start=1):
            num = ty in NUMERIC
            txt = ty == "string" or ty.startswith("array")
            parts.append(f"""SELECT '{t}' AS table_name, {i} AS ordinal_position, '{c}' AS column_name,
  '{ty}' AS data_type, {str(num).lower()} AS is_numeric, count(*) AS row_count,
  count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count,
  {f"CAST(min({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"} AS min_value,
  {f"CAST(max({c}) AS DOUBLE)" if num else "CAST(NULL AS DOUBLE)"} AS max_value,
  {f"CAST(min(len({c})) AS INTEGER)" if txt else "CAST(NULL AS INTEGER)"} AS min_length,
  {f"CAST(max(len({c})) AS INTEGER)" if txt else "CAST(NULL AS INTEGER)"} AS max_length
FROM {t}""")
    body = "\nUNION ALL\n".join(parts)
    return f"""prof0 AS ({body}),
prof AS (
  SELECT *, distinct_count = row_count AS "unique",
         regexp_matches(column_name, '{KEY_RE}') AS key_name,
         (contains(column_name, 'date') OR contains(column_name, 'days_since')) AS date_name,
         regexp_matches(column_name, '{BIN_RE}') AS binary_target_name,
         regexp_matches(column_name, '{LEAK_RE}') AS leakage_name
  FROM prof0
)"""


def _pairs_sql() -> str:
    parts = []
    for ct, cc, pt, pc in PAIRS:
        parts.append(f"""SELECT '{ct}' AS child_table, '{cc}' AS child_column, '{pt}' AS parent_table,
  '{pc}' AS parent_column, (SELECT count(*) FROM {ct}) AS child_rows,
  (SELECT count(*) FROM {ct} c WHERE c.{cc} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {pt} p WHERE p.{pc} = c.{cc})) AS orphans,
  (SELECT count(*) FROM {pt}) AS parent_rows, (SELECT count(DISTINCT {pc}) FROM {pt}) AS parent_distinct""")
    return "SELECT *, orphans = 0 AND parent_rows = parent_distinct AS is_foreign_key FROM (\n" + \
        "\nUNION ALL\n".join(parts) + "\n)"


def _kind(ty: str) -> str:
    return {"int": "integer", "bigint": "integer", "double": "number", "timestamp_ntz": "timestamp", "string": "string"}.get(ty, "nested")


def _inclusion_sql() -> str:
    values = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, CAST({c} AS BIGINT) AS x FROM {t} WHERE {c} IS NOT NULL"
                                for t, cols in SCHEMA.items() for c, ty in cols if _kind(ty) == "integer")
    return f"""WITH v AS ({values}),
d AS (SELECT t, c, x, count(*) AS n FROM v GROUP BY t, c, x),
s AS (SELECT t, c, CAST(sum(n) AS BIGINT) AS n, count(*) AS nd FROM d GROUP BY t, c),
hit AS (SELECT a.t AS ct, a.c AS cc, b.t AS pt, b.c AS pc, count(*) AS hits
        FROM d a JOIN d b ON a.x = b.x AND (a.t <> b.t OR a.c <> b.c) GROUP BY a.t, a.c, b.t, b.c)
SELECT ct AS child_table, cc AS child_column, pt AS parent_table, pc AS parent_column,
       a.n AS child_rows, a.nd AS child_distinct, b.nd AS parent_distinct
FROM hit JOIN s a ON a.t = ct AND a.c = cc JOIN s b ON b.t = pt AND b.c = pc WHERE hits = a.nd AND b.n = b.nd"""


ORACLES = {
    "inclusion_dependencies": _inclusion_sql(),
    "column_estimates": f"WITH {_profile_cte()} SELECT table_name, column_name, CASE " + " ".join(
        f"WHEN data_type = '{ty}' THEN '{_kind(ty)}'" for ty in sorted({ty for cols in SCHEMA.values() for _, ty in cols}))
        + " END AS kind, row_count, null_count, distinct_count, true AS within_bound FROM prof",
    "table_inventory": f"WITH {_inventory_cte()} SELECT * FROM inv",
    "estate_metrics": f"""WITH {_inventory_cte()}
SELECT count(*) AS tables, count(*) FILTER (WHERE table_type = 'MANAGED') AS managed,
       count(*) FILTER (WHERE table_type = 'EXTERNAL') AS external,
       CAST(sum(column_count) AS BIGINT) AS total_columns, CAST(sum(row_count) AS BIGINT) AS total_rows
FROM inv""",
    "estate_summary": f"""WITH {_inventory_cte()}
SELECT '{HEADER}' || chr(10) || 'Total tables discovered: ' || CAST(count(*) AS VARCHAR) || chr(10) || chr(10) ||
       string_agg(summary_line || chr(10), chr(10) ORDER BY name) AS estate_summary
FROM inv""",
    "column_profile": f"WITH {_profile_cte()} SELECT * FROM prof",
    "relationship_candidates": _pairs_sql(),
    "feature_plan": f"""WITH {_profile_cte()}
SELECT table_name, column_name,
       CASE WHEN key_name OR regexp_matches(data_type, '^(array|map|struct)<') THEN 'drop'
            WHEN data_type IN ('date', 'timestamp', 'timestamp_ntz') THEN 'extract_days_since'
            WHEN data_type = 'boolean' THEN 'binary_encode'
            WHEN is_numeric THEN 'keep_numeric'
            WHEN distinct_count < 20 THEN 'one_hot'
            WHEN distinct_count > 500 THEN 'hash_encode'
            ELSE 'label_encode' END AS transform,
       'distinct=' || CAST(distinct_count AS VARCHAR) || ', type=' || data_type AS note,
       distinct_count > 500 AS high_cardinality
FROM prof""",
}
