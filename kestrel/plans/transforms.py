"""Feature-plan transforms.

A plan is a small table of decisions (column, transform, note) — at most one
row per column, so it is read on the driver to build ONE ``select``; the
data itself is transformed on the cluster. One-hot values are read with a
hard bound, label encodings are joined from a distributed frequency index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.scalars import hash_bucket, safe_name, unique_names
from kestrel.operators.features import onehot_values
from kestrel.operators.ordering import frequency_index

LOG_DIGITS = 9          # log1p output rounded so every engine gives the same value
HASH_BUCKETS = 100
ONE_HOT_LIMIT = 10_000  # values that become columns, at most; X8 chooses one_hot below 20


def keep_numeric(c: str) -> Column:                                       # X1
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)


def log_transform(c: str) -> Column:                                      # X2
    x = F.col(c).cast("double")
    return F.when(x > -1, F.round(F.log(F.lit(1.0) + x), LOG_DIGITS)).alias(f"{c}_log")


def extract_days_since(c: str, run_date: str) -> Column:                  # X3
    return F.datediff(F.lit(run_date).cast("date"), F.to_date(F.col(c))).alias(f"{c}_days_since")


def hash_encode(c: str, n: int = HASH_BUCKETS) -> Column:                 # X5
    return hash_bucket(c, n).alias(f"{c}_hash")


def binary_encode(c: str, dtype) -> Column:                               # X6
    if isinstance(dtype, T.BooleanType):
        v = F.col(c).cast("int")
    elif isinstance(dtype, T.NumericType):
        v = F.when(F.col(c) > 0, 1).otherwise(0)
    else:
        v = F.when(F.coalesce(F.col(c), F.lit("")) != "", 1).otherwise(0)
    return v.alias(f"{c}_flag")


def encode_target(c: str, encoding: str, positive=None) -> Column:        # X9
    if encoding == "binary_0_1":
        return F.when(F.col(c).isin(*(positive or [1, "1", True, "yes", "true"])), 1).otherwise(0).alias("target")
    if encoding == "keep_as_is":
        return F.col(c).alias("target")
    raise ValueError("label_encode targets go through frequency_index")


def plain_columns(c: str, t: str, dtype, run_date: str) -> list[Column]:
    """The columns of a transform that learns nothing (none for ``drop``, X7)."""
    if t == "drop":
        return []
    if t == "keep_numeric":
        return [keep_numeric(c)]
    if t == "log_transform":
        return [log_transform(c)]
    if t == "extract_days_since":
        return [extract_days_since(c, run_date)]
    if t == "hash_encode":
        return [hash_encode(c)]
    if t == "binary_encode":
        return [binary_encode(c, dtype)]
    raise ValueError(f"unknown transform {t} for {c}")


def apply_plan(df: DataFrame, decisions: list[tuple[str, str]], run_date: str,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply (column, transform) decisions in one projection. ``keep``
    columns pass through unchanged (keys)."""
    schema = {f.name: f.dataType for f in df.schema.fields}
    out = df
    cols: list[Column] = [F.col(k) for k in keep]
    for c, t in decisions:
        if t == "one_hot":                                                # X4
            values = onehot_values(df, c, ONE_HOT_LIMIT)
            names = unique_names([f"{c}_{safe_name(str(v), '')}" for v in values])
            cols += [F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(n) for v, n in zip(values, names)]
        elif t == "label_encode":                                         # X10
            idx = frequency_index(df, c, f"{c}_label")
            out = out.join(idx, c, "left")
            cols.append(F.col(f"{c}_label"))
        else:
            cols += plain_columns(c, t, schema[c], run_date)
    return out.select(*cols)


def plan_decisions(plan: DataFrame, table_name: str) -> list[tuple[str, str]]:
    """The plan rows of one table (bounded by its column count)."""
    rows = plan.where(F.col("table_name") == table_name).select("column_name", "transform").collect()  # ≤ columns
    return sorted((r[0], r[1]) for r in rows)


def impute_median(df: DataFrame, cols: list[str], relative_error: float = 0.0) -> DataFrame:
    """NULLs replaced by the column median (Spark ML ``Imputer``;
    ``relative_error`` > 0 bounds the quantile sketch's memory at scale)."""
    from pyspark.ml.feature import Imputer
    outs = [f"{c}_imputed" for c in cols]
    imp = Imputer(strategy="median", inputCols=cols, outputCols=outs, relativeError=relative_error)
    return imp.fit(df).transform(df)
