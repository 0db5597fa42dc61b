"""Running aggregates over a group's earlier rows.

``prior_frame(df, part, order, specs)`` adds, for every row, aggregates over
the rows of the same ``part`` group that come strictly before it in the
total order ``order`` (frame ROWS UNBOUNDED PRECEDING .. 1 PRECEDING).

Specs are a small declarative table, ``name -> (kind, column[, scale])``,
kinds ``count | sum | avg | std | max | min``, so they can be evaluated two
ways:

* ``skew_split=False`` — one window per group: the plain Spark idiom; one
  shuffle on ``part``, but a group with a third of all rows lands in one task.
* ``skew_split=True`` — two levels. The first order column (``order[0]``,
  e.g. the order date) cuts each group into buckets. The rows are shuffled
  once, on (part, bucket), and a window inside each bucket gives the local
  prefix. A (part, bucket) histogram — map-side partially aggregated, one row
  per bucket — gives the carry from all earlier buckets with a window over the
  histogram; its size per group is bounded by the number of distinct buckets
  (for dates: the calendar), not by the row count. The carry joins back on
  (part, bucket), which reuses the rows' partitioning. A hot customer is thus
  spread over as many tasks as it has order dates, for the same single
  shuffle of the rows.

Sums are exact (DECIMAL) so both strategies give identical bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.exact import STD_DIGITS, dec
from kestrel.operators.joins import null_safe_left_join

_UNB = Window.unboundedPreceding


def _window_value(kind, c, scale, w):
    if kind == "count":
        return F.count(c).over(w)
    if kind == "max":
        return F.max(c).over(w)
    if kind == "min":
        return F.min(c).over(w)
    if kind == "sum":
        return F.sum(dec(c, scale)).over(w).cast("double")
    n = F.count(c).over(w)
    s = F.sum(dec(c, scale)).over(w).cast("double")
    if kind == "avg":
        return F.try_divide(s, n.cast("double"))
    if kind == "std":
        return _std(n, F.sum(dec(c, scale)).over(w), F.sum(dec(c, scale) * dec(c, scale)).over(w))
    raise ValueError(kind)


def _std(n, s, ss):
    """Sample standard deviation from the exact (decimal) sums of x and x².
    The squares are taken about m, the mean to four decimals, before anything
    becomes a double, so a large mean loses no digits: Σ(x-m)² = Σx² - 2mΣx +
    nm² exactly. Sums too large for that (over 10^14) use doubles."""
    m = F.try_divide(s, n).try_cast("decimal(18,4)")
    sd, nd = s.try_cast("decimal(19,4)"), n.try_cast("decimal(19,0)")
    about = ss.try_cast("decimal(38,8)") - F.lit(2) * (m * sd).cast("decimal(38,8)") + (m * m).cast("decimal(38,8)") * nd
    off = (sd - (m * nd).cast("decimal(38,4)")).cast("double")
    exact = about.cast("double") - F.try_divide(off * off, n.cast("double"))
    rough = ss.cast("double") - F.try_divide(s.cast("double") * s.cast("double"), n.cast("double"))
    var = F.try_divide(F.coalesce(exact, rough), n.cast("double") - F.lit(1.0))
    return F.when(n > 1, F.round(F.sqrt(F.greatest(var, F.lit(0.0))), STD_DIGITS))


def _parse(spec):
    kind, c = spec[0], spec[1]
    scale = spec[2] if len(spec) > 2 else 4
    return kind, c, scale


def prior_frame(df: DataFrame, part, order, specs: dict, skew_split: bool = False,
                include_current: bool = False) -> DataFrame:
    part = [part] if isinstance(part, str) else list(part)
    order = list(order)
    end = 0 if include_current else -1
    if not skew_split:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(_UNB, end)
        return df.select("*", *[_window_value(*_parse(s), w).alias(n) for n, s in specs.items()])
    return _prior_frame_split(df, part, order, specs, end)


def _prior_frame_split(df, part, order, specs, end):
    bucket = order[0]
    keys = part + [bucket]
    # Local prefix inside (part, bucket); partial sums kept separately.
    w_loc = Window.partitionBy(*keys).orderBy(*order[1:] or [bucket]).rowsBetween(_UNB, end)
    parts = {}
    loc_cols, hist_aggs = [], []
    for name, spec in specs.items():
        kind, c, scale = _parse(spec)
        cols = {"n": F.count(c)}
        if kind in ("sum", "avg", "std"):
            cols["s"] = F.sum(dec(c, scale))
        if kind == "std":
            cols["ss"] = F.sum(dec(c, scale) * dec(c, scale))
        if kind in ("max", "min"):
            cols["m"] = F.max(c) if kind == "max" else F.min(c)
        parts[name] = (kind, list(cols))
        for k, agg in cols.items():
            loc_cols.append(agg.over(w_loc).alias(f"_l_{name}_{k}"))
            hist_aggs.append(agg.alias(f"_h_{name}_{k}"))
    local = df.select("*", *loc_cols)

    # Carry: histogram per (part, bucket), prefix over earlier buckets.
    hist = df.groupBy(*keys).agg(*hist_aggs)
    w_hist = Window.partitionBy(*part).orderBy(bucket).rowsBetween(_UNB, -1)
    carry_cols = []
    for name, (kind, ks) in parts.items():
        for k in ks:
            h = F.col(f"_h_{name}_{k}")
            if k == "m":
                v = (F.max(h) if kind == "max" else F.min(h)).over(w_hist)
            else:
                v = F.sum(h).over(w_hist)
            carry_cols.append(v.alias(f"_c_{name}_{k}"))
    carry = hist.select(*keys, *carry_cols)
    joined = null_safe_left_join(local, carry, keys)

    out_cols = []
    for name, (kind, ks) in parts.items():
        def both(k):
            return F.col(f"_l_{name}_{k}"), F.col(f"_c_{name}_{k}")
        ln, cn = both("n")
        n = ln + F.coalesce(cn, F.lit(0))
        if kind == "count":
            v = n
        elif kind in ("max", "min"):
            lm, cm = both("m")
            v = (F.greatest if kind == "max" else F.least)(lm, cm)
        else:
            ls, cs = both("s")
            s_dec = F.when(n > 0, F.coalesce(ls, F.lit(0)) + F.coalesce(cs, F.lit(0)))
            s = s_dec.cast("double")
            if kind == "sum":
                v = s
            elif kind == "avg":
                v = F.try_divide(s, n.cast("double"))
            else:
                lss, css = both("ss")
                ss = F.when(n > 0, F.coalesce(lss, F.lit(0)) + F.coalesce(css, F.lit(0)))
                v = _std(n, s_dec, ss)
        out_cols.append(v.alias(name))
    tmp = [c for c in joined.columns if c.startswith(("_l_", "_c_"))]
    return joined.select(*[c for c in joined.columns if c not in tmp], *out_cols)


def prior_last(df: DataFrame, part, order, value: str, out: str, skew_split: bool = True) -> DataFrame:
    """``lag(value)`` over (PARTITION BY part ORDER BY order): the value of
    the group's previous row in the total order.

    With ``skew_split`` the rows are windowed inside (part, order[0]) and
    the first row of each bucket takes the last value of the nearest earlier
    bucket from a per-bucket table (``max_by`` over the order, map-side
    partial), so a hot group is spread over its buckets."""
    part = [part] if isinstance(part, str) else list(part)
    order = list(order)
    if not skew_split:
        w = Window.partitionBy(*part).orderBy(*order)
        return df.withColumn(out, F.lag(value).over(w))
    bucket = order[0]
    keys = part + [bucket]
    w = Window.partitionBy(*keys).orderBy(*order[1:] or [bucket])
    d = (df.withColumn("_lag", F.lag(value).over(w))
           .withColumn("_first", F.row_number().over(w) == 1))
    okey = F.struct(*[F.col(c) for c in order[1:] or [bucket]])
    last = d.groupBy(*keys).agg(F.max_by(value, okey).alias("_last"))
    carry = last.select(*keys, F.lag("_last").over(Window.partitionBy(*part).orderBy(bucket)).alias("_carry"))
    d = null_safe_left_join(d, carry, keys)
    return d.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag"))) \
            .drop("_lag", "_first", "_carry")


def sessionize(df: DataFrame, part, ts: str, gap_seconds: int, day_col: str = "_hour") -> DataFrame:
    """Per-``part`` sessions of ``ts`` with an inactivity gap (a new session
    starts when the previous event is ``gap_seconds`` or more earlier), as
    ``session_window`` defines them, without holding a whole key in one
    task: the previous timestamp comes from the split lag, the session
    number from the split running count of session starts (both bucketed
    by hour, which keeps the time order), and sessions are then aggregated
    map-side. Adds ``session_no``."""
    part = [part] if isinstance(part, str) else list(part)
    d = df.withColumn(day_col, F.date_trunc("hour", ts)).withColumn("_tsl", F.col(ts).cast("timestamp"))
    d = prior_last(d, part, [day_col, "_tsl"], "_tsl", "_prev_ts", skew_split=True)
    start = F.col("_prev_ts").isNull() | (
        F.unix_micros("_tsl") - F.unix_micros("_prev_ts") >= F.lit(gap_seconds * 1_000_000))
    d = d.withColumn("_start", F.when(start, F.lit(1)))
    d = prior_frame(d, part, [day_col, "_tsl"], {"session_no": ("count", "_start")},
                    skew_split=True, include_current=True)
    return d.drop(day_col, "_tsl", "_prev_ts", "_start")
