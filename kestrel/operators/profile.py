"""Schema profiling (SURVEY A6, A12, A14, A15, A24, J8, J9, P9, P12, F26,
G7, X8).

* ``column_profile`` — one aggregation pass per table computes, for every
  column, non-null counts, numeric min/max and text lengths; the single wide
  result row is unpivoted into one row per column with ``inline``, and the
  exact distinct counts, one aggregation a column, join it — nothing is
  collected.
* ``relationship_candidates`` — foreign-key pairs proposed from column names
  (metadata, bounded by the column count) and checked on the data: orphans
  by ``left_anti`` join and parent uniqueness by distinct count, each a
  distributed job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.scalars import is_binary_target_name, is_date_name, is_key_name
from kestrel.operators.governance import LEAKAGE_NAME_RE
from kestrel.sources.tables import table

# Cardinality thresholds of the transform choice.
ONE_HOT_MAX = 20
HASH_MIN = 500


def _numeric(dt) -> bool:
    return isinstance(dt, T.NumericType)


def _distinct_counts(df: DataFrame, values: list) -> DataFrame:
    """(ordinal_position, distinct_count): each column by a scan of itself and an
    aggregation keyed by its value alone. Several ``count_distinct`` in one
    aggregation would give every row once for each column, keyed by all."""
    counts = [df.select(v.alias("v")).where("v IS NOT NULL").distinct().agg(F.count(F.lit(1)).alias("distinct_count"))
              .select(F.lit(i + 1).alias("ordinal_position"), "distinct_count") for i, v in enumerate(values)]
    return F.broadcast(reduce(DataFrame.unionByName, counts))  # a row for a column


def column_profile(df: DataFrame, table_name: str, exact: bool = True) -> DataFrame:
    """Per column of ``df``: rows, nulls, distinct values (exact, or
    HyperLogLog++ when ``exact=False``; ``sketches`` has those that merge),
    numeric min/max, min/max length of texts and lists; plus name and type
    flags (P9, P12, F22, F26, G7). Nested columns have their row as well."""
    fields = df.schema.fields
    aggs, values = [F.count(F.lit(1)).alias("_rows")], []
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        aggs.append(F.count(c).alias(f"_nn{i}"))
        v = F.to_json(F.struct(c)) if isinstance(f.dataType, (T.MapType, T.StructType)) else c  # a map has no order
        v = F.when(c.isNotNull(), v)
        values.append(v)
        if not exact:
            aggs.append(F.approx_count_distinct(v).alias(f"_nd{i}"))
        num = _numeric(f.dataType)
        aggs.append((F.min(c).cast("double") if num else F.lit(None).cast("double")).alias(f"_mn{i}"))
        aggs.append((F.max(c).cast("double") if num else F.lit(None).cast("double")).alias(f"_mx{i}"))
        size = (F.length(c) if isinstance(f.dataType, T.StringType)
                else F.when(c.isNotNull(), F.size(c)) if isinstance(f.dataType, (T.ArrayType, T.MapType)) else None)
        aggs.append((F.min(size) if size is not None else F.lit(None).cast("int")).alias(f"_ln{i}"))
        aggs.append((F.max(size) if size is not None else F.lit(None).cast("int")).alias(f"_lx{i}"))
    one = df.agg(*aggs)
    items = F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal_position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"),
                 F.lit(_numeric(f.dataType)).alias("is_numeric"),
                 F.col(f"_nn{i}").alias("non_null"), (F.lit(None).cast("long") if exact else F.col(f"_nd{i}")).alias("distinct_count"),
                 F.col(f"_mn{i}").alias("min_value"), F.col(f"_mx{i}").alias("max_value"),
                 F.col(f"_ln{i}").alias("min_length"), F.col(f"_lx{i}").alias("max_length"))
        for i, f in enumerate(fields)])
    long = one.select(F.col("_rows").alias("row_count"), F.inline(items))
    if exact and fields:
        long = long.drop("distinct_count").join(_distinct_counts(df, values), "ordinal_position")
    name = F.col("column_name")
    return long.select(
        F.lit(table_name).alias("table_name"), "ordinal_position", "column_name", "data_type",
        "is_numeric", "row_count", (F.col("row_count") - F.col("non_null")).alias("null_count"),
        "distinct_count", "min_value", "max_value", "min_length", "max_length",
        (F.col("distinct_count") == F.col("row_count")).alias("unique"),
        is_key_name(name).alias("key_name"), is_date_name(name).alias("date_name"),
        is_binary_target_name(name).alias("binary_target_name"),
        name.rlike(LEAKAGE_NAME_RE).alias("leakage_name"))


def profile_tables(spark: SparkSession, sf_dir: str, names, exact: bool = True) -> DataFrame:
    """A24 over several tables, one union (each table one scan)."""
    return reduce(DataFrame.unionByName,
                  [column_profile(table(spark, sf_dir, n), n, exact) for n in names])


def table_inventory(spark: SparkSession, sf_dir: str, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """S7 + J8 + A12 + A15: each table with its row count, column count and
    the rendered summary line; tables without columns keep an empty list."""
    counts = reduce(DataFrame.unionByName, [
        table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(n).alias("name"), "row_count")
        for n in [r[0] for r in tables.select("name").collect()]])  # table names: bounded metadata
    cols = columns.groupBy("table_name").agg(
        F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name", "data_type", "comment")))
        .alias("_cols"))
    t = tables.join(cols, tables.name == cols.table_name, "left").drop("table_name")
    t = t.withColumn("_cols", F.coalesce(F.col("_cols"), F.array().cast(cols.schema["_cols"].dataType)))
    summary = F.array_join(F.transform("_cols", lambda c: F.concat(
        c["column_name"], F.lit(" ("), c["data_type"], F.lit(")"),
        F.when(c["comment"].isNotNull(), F.concat(F.lit(" — "), c["comment"])).otherwise(F.lit("")))), ", ")
    t = t.join(counts, "name", "left")
    line = F.concat_ws("\n",
                       F.concat(F.lit("TABLE: "), F.col("full_name"), F.lit(" ["), F.col("table_type"), F.lit("]")),
                       F.when(F.col("comment").isNotNull(), F.concat(F.lit("  Description: "), F.col("comment"))),
                       F.when(F.col("row_count") > 0, F.concat(F.lit("  Row count (approx): "),
                                                             F.col("row_count").cast("string"))),
                       F.when(F.size("_cols") > 0, F.concat(F.lit("  Columns ("), F.size("_cols").cast("string"),
                                                          F.lit("): "), summary)))
    return t.select("catalog", "schema", "name", "full_name", "table_type", "row_count",
                    F.size("_cols").alias("column_count"), summary.alias("column_summary"),
                    line.alias("summary_line"))


def estate_metrics(inventory: DataFrame) -> DataFrame:
    """Tables, managed, external, total columns (and rows)."""
    return inventory.agg(
        F.count(F.lit(1)).alias("tables"),
        F.count_if(F.col("table_type") == "MANAGED").alias("managed"),
        F.count_if(F.col("table_type") == "EXTERNAL").alias("external"),
        F.sum("column_count").cast("long").alias("total_columns"),
        F.sum("row_count").cast("long").alias("total_rows"))


def estate_summary(inventory: DataFrame, header: str) -> DataFrame:
    """The whole rendered summary as one text, lines ordered by table
    name (one row per table in, one row out: bounded by the table count)."""
    lines = inventory.agg(F.sort_array(F.collect_list(F.struct("name", "summary_line"))).alias("_l"),
                          F.count(F.lit(1)).alias("_n"))
    body = F.array_join(F.transform("_l", lambda x: F.concat(x["summary_line"], F.lit("\n"))), "\n")
    return lines.select(F.concat(F.lit(header + "\n"), F.lit("Total tables discovered: "),
                                 F.col("_n").cast("string"), F.lit("\n\n"), body).alias("estate_summary"))


def _base_name(col_name: str) -> str:
    """Column name without a one-letter table prefix (``o_custkey`` ->
    ``custkey``)."""
    return col_name.split("_", 1)[1] if len(col_name) > 2 and col_name[1] == "_" else col_name


def relationship_candidates(spark: SparkSession, sf_dir: str, columns: DataFrame) -> DataFrame:
    """(child.col -> parent.col) pairs whose names share a key base name
    (``*key`` / ``*_id``), checked on the data: child rows, orphans (child
    values missing in the parent), parent rows and parent distinct values."""
    meta = [(r.table_name, r.column_name) for r in
            columns.select("table_name", "column_name").collect()]  # bounded metadata
    keyish = [(t, c, _base_name(c)) for t, c in meta if c.endswith("key") or c.endswith("_id")]
    pairs = []
    for pt, pc, pb in keyish:
        for ct, cc, cb in keyish:
            if pt != ct and pb == cb and (pc.startswith(pt[0] + "_") or pc == cc):
                pairs.append((ct, cc, pt, pc))
    pairs = sorted(set(pairs))
    if not pairs:
        return spark.createDataFrame([], "child_table string, child_column string, parent_table string, parent_column string, "
                                         "child_rows long, orphans long, parent_rows long, parent_distinct long, is_foreign_key boolean")
    # Every pair's child and parent values in ONE union, tagged with the pair
    # id; one aggregation per (pair, value) then one per pair gives child rows,
    # orphans, parent rows and parent distinct values — one shuffle in all.
    by_table: dict[str, list] = {}
    for i, (ct, cc, pt, pc) in enumerate(pairs):
        by_table.setdefault(ct, []).append((i, cc, 1, 0))
        by_table.setdefault(pt, []).append((i, pc, 0, 1))
    sides = []
    for t, entries in sorted(by_table.items()):
        # one scan per table: its key columns exploded into (pair, value, side)
        items = F.array(*[F.struct(F.lit(i).alias("pair"), F.col(col).cast("string").alias("v"),
                                   F.lit(ch).alias("c"), F.lit(pa).alias("p")) for i, col, ch, pa in entries])
        sides.append(table(spark, sf_dir, t).select(F.inline(items)))
    per_value = reduce(DataFrame.unionByName, sides).groupBy("pair", "v").agg(
        F.sum("c").alias("nc"), F.sum("p").alias("np"))
    per_pair = per_value.groupBy("pair").agg(
        F.sum("nc").cast("long").alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull() & (F.col("np") == 0), F.col("nc"))), F.lit(0))
        .cast("long").alias("orphans"),
        F.sum("np").cast("long").alias("parent_rows"),
        F.count_if(F.col("v").isNotNull() & (F.col("np") > 0)).alias("parent_distinct"))
    names = F.array(*[F.array(*[F.lit(x) for x in pr_]) for pr_ in pairs])
    nm = F.element_at(names, F.col("pair") + 1)
    out = per_pair.select(nm[0].alias("child_table"), nm[1].alias("child_column"),
                          nm[2].alias("parent_table"), nm[3].alias("parent_column"),
                          "child_rows", "orphans", "parent_rows", "parent_distinct")
    return out.withColumn("is_foreign_key", (F.col("orphans") == 0)
                          & (F.col("parent_rows") == F.col("parent_distinct")))


def plan_from_profile(profile: DataFrame) -> DataFrame:
    """A transform per column from its profile: keys dropped (X7),
    dates to days-since (X3), numbers kept (X1), booleans binary (X6), text
    by cardinality: < 20 one-hot (X4), > 500 hash (X5), between: label
    encode (the reference leaves this gap undefined). No transform of the
    vocabulary takes a nested column: dropped."""
    t = F.col("data_type")
    nd = F.col("distinct_count")
    transform = (F.when(F.col("key_name") | t.rlike("^(array|map|struct)<"), "drop")
                 .when(t.isin("date", "timestamp", "timestamp_ntz"), "extract_days_since")
                 .when(t == "boolean", "binary_encode")
                 .when(F.col("is_numeric"), "keep_numeric")
                 .when(nd < ONE_HOT_MAX, "one_hot")
                 .when(nd > HASH_MIN, "hash_encode")
                 .otherwise("label_encode"))
    note = F.concat(F.lit("distinct="), nd.cast("string"), F.lit(", type="), t)
    return profile.select("table_name", "column_name", transform.alias("transform"), note.alias("note"),
                          (nd > HASH_MIN).alias("high_cardinality"))
