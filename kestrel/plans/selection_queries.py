"""Registered selection and explicit-plan queries with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.operators import profile as pr
from kestrel.operators import selection as sel
from kestrel.plans import transforms as tf
from kestrel.plans.profile_queries import _inventory_cte, _profile_cte, table_inventory
from kestrel.sources.tables import TABLES, table

EXPLICIT_PLAN = [("l_discount", "binary_encode"), ("l_extendedprice", "log_transform"),
                 ("l_quantity", "keep_numeric"), ("l_returnflag", "one_hot"), ("l_suppkey", "hash_encode"),
                 ("l_tax", "drop")]


def recent_turns(spark, sf_dir):
    """The last 5 turns of every conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return sel.last_k_per_group(c, "conv_id", ["turn"], 5)


def chosen_turn(spark, sf_dir):
    """Per conversation, turn 3 when it exists, else the first turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    return sel.chosen_or_first(c, "conv_id", "turn", 3, ["turn"])


def opportunity_ranking(spark, sf_dir):
    """Tables ranked as use-case candidates from their profile."""
    inv = table_inventory(spark, sf_dir)
    return sel.rank_opportunities(inv, pr.profile_tables(spark, sf_dir, TABLES))


def first_tables(spark, sf_dir):
    """The first 20 tables of the inventory by name (limit is the feature)."""
    return table_inventory(spark, sf_dir).orderBy("name").limit(20).select("name", "row_count", "column_count")


def explicit_plan_transform(spark, sf_dir):
    """X1, X2, X4–X7, X9 from an explicit plan on lineitem, with a binary
    target (returned lines)."""
    li = table(spark, sf_dir, "lineitem")
    li = li.withColumn("target", tf.encode_target("l_returnflag", "binary_0_1", ["R"]))
    return tf.apply_plan(li, EXPLICIT_PLAN, "2025-01-01", keep=("l_orderkey", "l_linenumber", "target"))


QUERIES = {
    "recent_turns": recent_turns,
    "chosen_turn": chosen_turn,
    "opportunity_ranking": opportunity_ranking,
    "first_tables": first_tables,
    "explicit_plan_transform": explicit_plan_transform,
}

ORACLES = {
    "recent_turns": """
SELECT conv_id, turn, role, rn AS position_from_end FROM (
  SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 5""",
    "chosen_turn": """
SELECT conv_id,
       arg_max(turn, row(turn = 3, -turn)) AS turn,
       arg_max(role, row(turn = 3, -turn)) AS role,
       CAST(arg_max(length(text), row(turn = 3, -turn)) AS INTEGER) AS chars,
       max(CASE WHEN turn = 3 THEN 1 ELSE 0 END) = 1 AS was_chosen
FROM conversations GROUP BY conv_id""",
    "opportunity_ranking": f"""WITH {_inventory_cte()}, {_profile_cte()},
r AS (SELECT table_name, avg(1 - null_count / greatest(row_count, 1)) AS fill,
             max(CASE WHEN data_type IN ('date', 'timestamp', 'timestamp_ntz') THEN 1 ELSE 0 END) AS has_date,
             max(CASE WHEN distinct_count <= 20 AND distinct_count >= 2 THEN 1 ELSE 0 END) AS has_label
      FROM prof GROUP BY table_name),
t AS (SELECT i.name, i.row_count, i.column_count, round(r.fill, 9) AS readiness_fill, r.has_date, r.has_label,
             round(log10(CAST(i.row_count AS DOUBLE) + 1) * (r.fill * (1 + r.has_date * r.has_label))
                   / CAST(i.column_count AS DOUBLE), 9) AS score
      FROM inv i JOIN r ON i.name = r.table_name)
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, name ASC) AS INTEGER) AS rank FROM t""",
    "first_tables": f"WITH {_inventory_cte()} SELECT name, row_count, column_count FROM inv ORDER BY name LIMIT 20",
    "explicit_plan_transform": """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('R') THEN 1 ELSE 0 END AS target,
       CASE WHEN l_discount > 0 THEN 1 ELSE 0 END AS l_discount_flag,
       CASE WHEN CAST(l_extendedprice AS DOUBLE) > -1 THEN round(ln(1.0 + CAST(l_extendedprice AS DOUBLE)), 9) END
         AS l_extendedprice_log,
       coalesce(CAST(l_quantity AS DOUBLE), 0.0) AS l_quantity,
       CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS l_returnflag_A,
       CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS l_returnflag_N,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS l_returnflag_R,
       CAST((('0x' || substr(sha256(CAST(l_suppkey AS VARCHAR)), 1, 8))::BIGINT) % 100 AS INTEGER) AS l_suppkey_hash
FROM lineitem""",
}
