"""Transforms that learn something from data: fitted on
one table, stored, and applied to others.

A fit is a table (column, transform, value, place, number): the values of a
one-hot or label column with their place, or a median. It is built by partial
aggregation and a distributed sort, saved as Parquet and read back, so that
test and score tables get the numbers of the training rows:

* ``one_hot``: a 0/1 column for each fitted value; a value not seen has 0 in all;
* ``label_encode``: places by falling frequency, ties by the value's text; a
  value not seen, and NULL, has the next number after the last;
* ``impute_median``: NULL and NaN become the fitted median (exact);
* a target: ``binary_0_1``, ``keep_as_is`` or ``label_encode`` (a row whose
  target was not seen has NULL: it has no class).

The values of label columns are joined, never collected; those of one-hot
columns become columns, so they are read, up to ``max_values``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.scalars import safe_name, unique_names
from kestrel.operators import quantiles
from kestrel.operators.ordering import frequency_index
from kestrel.plans import transforms as tf
from kestrel.session import cut_lineage

FIT = "column_name string, transform string, value string, place long, number double"
LEARNED = ("one_hot", "label_encode", "impute_median", "target_label")


def fit(train: DataFrame, decisions: list[tuple[str, str]], target: tuple[str, str] | None = None) -> DataFrame:
    """The fit table of the decisions (column, transform) that learn, and of a
    label-encoded target (column, "label_encode")."""
    parts = [train.sparkSession.createDataFrame([], FIT)]
    learned = [(c, t) for c, t in decisions if t in LEARNED]
    if target and target[1] == "label_encode":
        learned.append((target[0], "target_label"))
    for c, t in learned:
        if t == "impute_median":
            continue
        index = frequency_index(train.select(F.col(c).cast("string").alias(c)), c, "_place")
        parts.append(index.select(F.lit(c).alias("column_name"), F.lit(t).alias("transform"), F.col(c).alias("value"),
                                  F.col("_place").cast("long").alias("place"), F.lit(None).cast("double").alias("number")))
    medians = quantiles.median(train, [c for c, t in learned if t == "impute_median"])
    if medians:
        parts.append(train.sparkSession.createDataFrame([(c, "impute_median", None, None, m) for c, m in medians.items()], FIT))
    return cut_lineage(reduce(DataFrame.unionByName, parts), "fit")


def save(fitted: DataFrame, folder: str) -> None:
    fitted.write.partitionBy("transform").parquet(folder)


def load(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select("column_name", "transform", "value", "place", "number")


def one_hot_columns(fitted: DataFrame, column: str, max_values: int = 10_000) -> list[Column]:
    """A column for each fitted value, in the order of the values."""
    rows = fitted.where((F.col("column_name") == column) & (F.col("transform") == "one_hot")).select("value").limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(f"{column}: more than {max_values} values would become columns; use hash_encode or label_encode")
    values = sorted(r.value for r in rows)
    names = unique_names([f"{column}_{safe_name(v, '')}" for v in values])
    text = F.col(column).cast("string")
    return [F.when(text == F.lit(v), 1).otherwise(0).alias(n) for v, n in zip(values, names)]


def _encoded(df: DataFrame, fitted: DataFrame, column: str, transform: str, name: str, unseen: bool) -> DataFrame:
    """df with ``name``: the place of the column's value; ``unseen``: the next
    number for values without one, else NULL."""
    places = fitted.where((F.col("column_name") == column) & (F.col("transform") == transform)).select(F.col("value").alias("_value"), F.col("place").alias("_place"))
    out = df.join(places, F.col(column).cast("string") == F.col("_value"), "left").drop("_value")
    if unseen:
        count = places.agg(F.count(F.lit(1))).first()[0]
        return out.withColumn(name, F.coalesce("_place", F.lit(count)).cast("double")).drop("_place")
    return out.withColumn(name, F.col("_place").cast("double")).drop("_place")


def apply(df: DataFrame, fitted: DataFrame, decisions: list[tuple[str, str]], run_date: str, keep=(),
          target: tuple[str, str] | None = None, positive=None) -> DataFrame:
    """The table with every decision applied, those that learn by the fit. The
    other transforms are those of ``transforms.apply_plan``."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    medians = {r.column_name: r.number for r in fitted.where("transform = 'impute_median'").collect()}  # one a column
    out, cols = df, [F.col(k) for k in keep]
    for c, t in decisions:
        if t == "one_hot":
            cols += one_hot_columns(fitted, c)
        elif t == "label_encode":
            out = _encoded(out, fitted, c, t, f"{c}_label", True)
            cols.append(F.col(f"{c}_label"))
        elif t == "impute_median":
            x = F.col(c).cast("double")
            cols.append(F.coalesce(F.when(~F.isnan(x), x), F.lit(medians[c])).alias(c))
        else:
            cols += tf.plain_columns(c, t, fields[c], run_date)
    if target:
        if target[1] == "label_encode":
            out = _encoded(out, fitted, target[0], "target_label", "target", False)
            cols.append(F.col("target"))
        else:
            cols.append(tf.encode_target(target[0], target[1], positive))
    return out.select(*cols)
