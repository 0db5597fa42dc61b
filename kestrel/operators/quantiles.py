"""Exact order statistics without a sort.

A wanted rank lies in an interval of values; every round cuts the interval of
each rank into ``BUCKETS`` equal parts, counts the values of each part (with
their least and largest) in one aggregation over all columns and ranks, and
goes on with the part that holds the rank. It ends when that part holds a
single value, which takes a few rounds; a value of a third of all rows is a
count like any other. Only counts are shuffled, and one row a rank is read by
the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """(column, rank) -> the value at that rank (from 0) of the column's non-null
    values (NaN not counted) in ascending order. Every rank must be there."""
    wanted = [(c, r) for c in ranks for r in sorted(set(ranks[c]))]
    x = {c: F.col(f"`{c}`").cast("double") for c in ranks}
    known = {c: F.when(~F.isnan(x[c]), x[c]) for c in ranks}
    ends = df.agg(*[f(known[c]).alias(f"{n}{i}") for i, c in enumerate(ranks) for n, f in (("a", F.min), ("b", F.max))]).first() if ranks else None  # one row
    place = {c: i for i, c in enumerate(ranks)}
    # of each rank: the interval, and how many values are below it
    state = {(c, r): (ends[f"a{place[c]}"], ends[f"b{place[c]}"], 0) for c, r in wanted}
    out: dict[tuple[str, int], float] = {}
    while True:
        for k, (low, high, _) in state.items():
            if low is None:
                raise ValueError(f"{k[0]} has no value")
            if low == high:
                out[k] = low
        state = {k: s for k, s in state.items() if k not in out}
        if not state:
            return out
        keys = list(state)
        parts = []
        for i, (c, _) in enumerate(keys):
            low, high, _ = state[keys[i]]
            scale = 1.0 if math.isfinite(high - low) else 0.5  # the width may be beyond a double
            share = (x[c] * scale - F.lit(low * scale)) / F.lit(high * scale - low * scale)
            bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
            parts.append(F.when((x[c] >= F.lit(low)) & (x[c] <= F.lit(high)), F.struct(F.lit(i).alias("k"), bucket.alias("b"), x[c].alias("v"))))
        rows = df.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).select("p.*")
        counts = rows.groupBy("k", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
        rest = F.element_at(F.array(*[F.lit(k[1] - state[k][2]) for k in keys]), F.col("k") + 1)
        for r in counts.where((F.col("below") <= rest) & (rest < F.col("below") + F.col("n"))).collect():  # one a rank
            k = keys[r.k]
            state[k] = (r.low, r.high, state[k][2] + r.below)


def counts_of(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """Values of each column that have an order (not null, not NaN)."""
    if not cols:
        return {}
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    row = df.agg(*[F.count(F.when(~F.isnan(v), v)).alias(f"n{i}") for i, v in enumerate(x)]).first()
    return {c: row[f"n{i}"] for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: list[str], shares=(0.25, 0.5, 0.75)) -> dict[str, list[tuple[float, float]] | None]:
    """Of each column and share, the value at it (the first whose part of all
    values reaches the share) and the value interpolated between neighbours;
    None for a column without values."""
    counts = counts_of(df, cols)
    ranks: dict[str, list[int]] = {}
    places = {}
    for c, n in counts.items():
        if n:
            for s in shares:
                at = s * (n - 1)
                disc = max(0, -int(-(n * s) // 1) - 1)
                places[c, s] = (disc, int(at), min(int(at) + 1, n - 1), at - int(at))
            ranks[c] = [r for s in shares for r in places[c, s][:3]]
    value = order_statistics(df, ranks)
    out: dict[str, list[tuple[float, float]] | None] = {}
    for c in cols:
        if not counts[c]:
            out[c] = None
            continue
        out[c] = []
        for s in shares:
            disc, low, high, part = places[c, s]
            a, b = value[c, low], value[c, high]
            out[c].append((value[c, disc], a if a == b else a * (1.0 - part) + b * part))
    return out


def median(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """The exact median of each column."""
    return {c: q[0][1] if q else None for c, q in quantiles(df, cols, (0.5,)).items()}
