"""Mergeable column sketches.

One scan of a table gives a row for each column with its counts and two
sketches of its values: a HyperLogLog for distinct counts and a theta sketch
for comparing columns. Sketches of parts (files, dates, tables read at other
times) merge into those of the whole, so a profile can be kept up to date
without reading old data again.

Inclusion of one column's values in another's is found without comparing the
columns: a theta sketch keeps the smallest hashes, so if every value of a child
is in the parent, every kept hash of the child below both thresholds is kept by
the parent too, and the sketches' difference is empty. The sketches thus never
lose an inclusion; the few pairs that they leave are checked exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Log2 of the registers and of the kept hashes: a standard error of 0.8 % and 1.6 %.
HLL_BITS, THETA_BITS = 14, 12

#: A parent's values are unique if their estimate is above this part of its rows.
UNIQUE_ABOVE = 0.9

SKETCH = "table_name string, column_name string, kind string, row_count long, non_null long, hll binary, theta binary"


def kind_of(dt: T.DataType) -> str:
    """Columns of one kind have comparable values."""
    if isinstance(dt, T.IntegralType):
        return "integer"
    if isinstance(dt, (T.StringType, T.DateType, T.BooleanType, T.BinaryType)):
        return dt.typeName().split("(")[0]
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    return "number" if isinstance(dt, T.NumericType) else "nested"


def column_sketches(df: DataFrame, table_name: str, kinds: tuple[str, ...] | None = None, part=None) -> DataFrame:
    """The sketches of every column (of these kinds), in one aggregation; with
    ``part`` (an expression of few values) a row for each part."""
    fields = [f for f in df.schema.fields if kinds is None or kind_of(f.dataType) in kinds]
    if not fields:
        return df.sparkSession.createDataFrame([], SKETCH)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        c = F.col(f"`{f.name}`")
        kind = kind_of(f.dataType)
        if kind == "integer":
            x = c.cast("long")
        elif kind == "nested":
            x = F.when(c.isNotNull(), F.xxhash64(F.to_json(F.struct(c))))
        else:
            x = c.cast("string")
        aggs += [F.count(c).alias(f"n{i}"), F.hll_sketch_agg(x, HLL_BITS).alias(f"h{i}"), F.theta_sketch_agg(x, THETA_BITS).alias(f"t{i}")]
    items = [F.struct(F.lit(f.name).alias("column_name"), F.lit(kind_of(f.dataType)).alias("kind"), F.col(f"n{i}").alias("non_null"),
                      F.col(f"h{i}").alias("hll"), F.col(f"t{i}").alias("theta")) for i, f in enumerate(fields)]
    one = (df.groupBy(part) if part is not None else df).agg(*aggs).select(F.col("rows").alias("row_count"), F.inline(F.array(*items)))
    return one.select(F.lit(table_name).alias("table_name"), "column_name", "kind", "row_count", "non_null", "hll", "theta")


def merged(sketches: DataFrame) -> DataFrame:
    """The sketches of whole tables from those of their parts."""
    return sketches.groupBy("table_name", "column_name", "kind").agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null").alias("non_null"),
        F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", THETA_BITS).alias("theta"))


def estimates(sketches: DataFrame) -> DataFrame:
    """Rows, nulls and estimated distinct values of every column."""
    return sketches.select("table_name", "column_name", "kind", "row_count", (F.col("row_count") - F.col("non_null")).alias("null_count"),
                           F.hll_sketch_estimate("hll").alias("distinct_estimate"))


def inclusion_candidates(sketches: DataFrame) -> DataFrame:
    """The pairs of columns that may be (child, parent): of one kind, the
    parent's values unique, no kept hash of the child missing in the parent. A
    join of rows of columns."""
    side = lambda p: sketches.where("non_null > 0").select(*[F.col(c).alias(f"{p}_{c}" if c != "kind" else c) for c in ("table_name", "column_name", "kind", "non_null", "hll", "theta")])
    child = side("child").drop("child_hll")
    parent = side("parent").where(F.hll_sketch_estimate("parent_hll") >= UNIQUE_ABOVE * F.col("parent_non_null")).drop("parent_hll")
    same = (F.col("child_table_name") == F.col("parent_table_name")) & (F.col("child_column_name") == F.col("parent_column_name"))
    missing = F.theta_sketch_estimate(F.theta_difference("child_theta", "parent_theta"))
    return child.join(parent, "kind").where(~same & (missing == 0)).select(
        *[F.col(f"{p}_{c}_name").alias(f"{p}_{c}") for p in ("child", "parent") for c in ("table", "column")])


def inclusion_dependencies(spark: SparkSession, read: Callable[[str], DataFrame], sketches: DataFrame) -> DataFrame:
    """The candidates that hold exactly: every value of the child is in the
    parent, whose values are unique. One scan a table of the columns that are
    left, one aggregation by (column, value) and one by pair."""
    columns = ["child_table", "child_column", "parent_table", "parent_column"]
    pairs = sorted(tuple(r) for r in inclusion_candidates(sketches).select(*columns).collect())  # names of columns
    schema = ", ".join(f"{c} string" for c in columns) + ", child_rows long, child_distinct long, parent_distinct long"
    if not pairs:
        return spark.createDataFrame([], schema)
    number = {c: i for i, c in enumerate(sorted({p[:2] for p in pairs} | {p[2:] for p in pairs}))}
    parts = []
    for t in sorted({t for t, _ in number}):
        items = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{name}`").cast("string").alias("v")) for (table, name), i in number.items() if table == t])
        parts.append(read(t).select(F.inline(items)))
    values = reduce(DataFrame.unionByName, parts).where("v IS NOT NULL").groupBy("v", "c").agg(F.count(F.lit(1)).alias("n"))
    # of each value: the columns that hold it; of each pair: the child's values and those with the parent
    held = values.groupBy("v").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("held"))  # a column once
    each = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(number[p[:2]]).alias("a"), F.lit(number[p[2:]]).alias("b")) for i, p in enumerate(pairs)])
    n = lambda c: F.coalesce(F.try_element_at("held", c), F.lit(0))
    seen = held.select("held", F.inline(F.filter(each, lambda x: F.map_contains_key("held", x["a"]) | F.map_contains_key("held", x["b"]))))
    sums = seen.groupBy("p").agg(F.sum(n(F.col("a"))).alias("child_rows"), F.count_if(n(F.col("a")) > 0).alias("child_distinct"),
                                 F.count_if((n(F.col("a")) > 0) & (n(F.col("b")) == 0)).alias("orphans"),
                                 F.sum(n(F.col("b"))).alias("parent_rows"), F.count_if(n(F.col("b")) > 0).alias("parent_distinct"))
    names = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in pairs]), F.col("p") + 1)
    return sums.where("orphans = 0 AND parent_rows = parent_distinct").select(
        *[names[i].alias(c) for i, c in enumerate(columns)], "child_rows", "child_distinct", "parent_distinct")
