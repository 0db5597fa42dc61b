"""As-of joins and the check that features are older than labels.

Each left row gets the latest right row of its key before its time. Both sides
are one table sorted by time, and the last right row seen is what a left row
gets. The window runs inside (key, bucket of time); what earlier buckets leave
comes from a table with one row for each of them. A key with a third of all
rows is thus spread over its days, and no pair of rows is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str],
              strict: bool = True, forward: bool = False, bucket: str = "day") -> DataFrame:
    """left with ``right_time`` and ``values`` of the key's latest right row before
    the left row's time (at it as well, if not ``strict``); ``forward``: of its
    first row after. NULL is a key like any other; without a time there is no
    match. Of right rows of one time the one of the largest values counts. The
    added columns must not be among left's."""
    held = F.struct(F.col(right_time).alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    sides = (0, 1) if strict else (1, 0)  # (left, right): strict rows come before those of their own time
    r = right.where(F.col(right_time).isNotNull()).select(F.struct(F.col(key).alias("k")).alias("_k"), F.col(right_time).alias("_t"), F.lit(sides[1]).alias("_side"), held.alias("_held"))
    own = F.struct(*[F.col(c) for c in left.columns])
    rows = left.select(F.struct(F.col(key).alias("k")).alias("_k"), F.col(left_time).alias("_t"), F.lit(sides[0]).alias("_side"), own.alias("_row")) \
        .unionByName(r, allowMissingColumns=True).withColumn("_b", F.coalesce(F.date_trunc(bucket, "_t").cast("string"), F.lit("")))
    way = (lambda c: F.desc(c)) if forward else (lambda c: F.asc(c))
    # the best of one time stands last in either direction
    w = Window.partitionBy("_k", "_b").orderBy(way("_t"), F.asc("_side"), F.asc("_held")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_last", F.last("_held", ignorenulls=True).over(w))
    if forward:
        best = rows.where("_held IS NOT NULL").groupBy("_k", "_b", "_t").agg(F.max("_held").alias("_held")).groupBy("_k", "_b").agg(F.min_by("_held", "_t").alias("_end"))
    else:
        best = rows.where("_held IS NOT NULL").groupBy("_k", "_b").agg(F.max("_held").alias("_end"))
    ends = rows.select("_k", "_b").distinct().join(best, ["_k", "_b"], "left")
    earlier = Window.partitionBy("_k").orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_k", "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    found = rows.where("_row IS NOT NULL").join(carry, ["_k", "_b"]).withColumn("_got", F.when(F.col("_t").isNotNull(), F.coalesce("_last", "_carry")))
    return found.select("_row.*", F.col("_got.t").alias(right_time), *[F.col(f"_got.v{i}").alias(c) for i, c in enumerate(values)])


def feature_time_check(used: DataFrame, history: DataFrame, key: str, label_time: str, feature_time: str, value: str) -> DataFrame:
    """G7 on the data: each row of ``used`` (key, label_time, ``used_time``,
    ``used_value``) is a label and the feature it was given. status: ``leak`` if
    the feature is not older than the label; ``stale`` if the history had a later
    one; ``changed`` if the value is not the history's; ``none`` if there is no
    feature and none was to be had, ``missing`` if there was; else ``ok``."""
    got = asof_join(used, history.select(key, feature_time, value), key, label_time, feature_time, [value])
    t = F.col("used_time")
    status = (F.when(t >= F.col(label_time), "leak")
              .when(t.isNull(), F.when(F.col(feature_time).isNull(), "none").otherwise("missing"))
              .when(F.col(feature_time).isNull() | (t != F.col(feature_time)), "stale")
              .when(~F.col("used_value").eqNullSafe(F.col(value)), "changed").otherwise("ok"))
    return got.withColumn("status", status)
