"""Column sketches: error bound, merging, and inclusions against brute force."""

import random

from pyspark.sql import functions as F

from kestrel.operators import profile as pr
from kestrel.operators import selection as sel
from kestrel.operators import sketches as sk


def test_estimates_keep_their_bound_and_merge(spark):
    n = 60_000
    df = spark.range(n).select("id", (F.col("id") % 977).alias("few"), F.when(F.col("id") % 3 > 0, F.col("id") % 20_011).alias("gaps"),
                               F.concat(F.lit("é"), F.col("id") % 5000).alias("text"), F.array(F.col("id") % 300).alias("list"), F.lit(None).cast("string").alias("none"))
    whole = {r.column_name: r for r in sk.estimates(sk.column_sketches(df, "t")).collect()}
    parts = sk.column_sketches(df.where("id % 7 < 3"), "t").union(sk.column_sketches(df.where("id % 7 >= 3"), "t"))
    for found in (whole, {r.column_name: r for r in sk.estimates(sk.merged(parts)).collect()}):
        for c, want in (("id", n), ("few", 977), ("gaps", 20_011), ("text", 5000), ("list", 300), ("none", 0)):
            assert abs(found[c].distinct_estimate - want) <= 5 * 1.04 / 2 ** (sk.HLL_BITS / 2) * want, c
            assert found[c].row_count == n
        assert found["gaps"].null_count == n // 3 and found["none"].null_count == n


def test_inclusions_equal_brute_force(spark):
    rng = random.Random(5)
    parent = list(range(0, 30_000, 3))
    tables = {
        "a": {"key": parent, "other": [rng.randrange(50) for _ in parent]},
        "b": {"inside": [rng.choice(parent) for _ in range(9000)], "one_off": [*[rng.choice(parent) for _ in range(8999)], 1], "gaps": [None if i % 2 else parent[i] for i in range(9000)]},
        "c": {"small": list(range(40)), "none": [None] * 40},
    }
    frames = {t: spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} {'int' if t == 'c' else 'long'}" for c in cols)) for t, cols in tables.items()}
    parts = [sk.column_sketches(df, t, ("integer",)) for t, df in frames.items()]
    sketches = parts[0].union(parts[1]).union(parts[2])
    got = {tuple(r) for r in sk.inclusion_dependencies(spark, frames.__getitem__, sketches).collect()}
    want, columns = set(), {(t, c): [x for x in v if x is not None] for t, cols in tables.items() for c, v in cols.items()}
    for a, x in columns.items():
        for b, y in columns.items():
            if a != b and x and set(x) <= set(y) and len(set(y)) == len(y):
                want.add((*a, *b, len(x), len(set(x)), len(set(y))))
    assert got == want and ("b", "inside", "a", "key", 9000, len(set(tables["b"]["inside"])), 10_000) in got
    left = {tuple(r) for r in sk.inclusion_candidates(sketches).collect()}
    assert {w[:4] for w in want} <= left  # the sketches lose none
    assert sk.inclusion_dependencies(spark, frames.__getitem__, sketches.limit(0)).collect() == []


def test_nested_columns_are_profiled_and_unprofiled_tables_ranked(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], {"k": "v"}), (2, [], None), (3, None, {"k": "v"})], "i int, a array<double>, m map<string,string>")
    got = {r.column_name: r for r in pr.column_profile(df, "t").collect()}
    assert (got["a"].null_count, got["a"].distinct_count, got["a"].min_length, got["a"].max_length) == (1, 2, 0, 2)
    assert (got["m"].null_count, got["m"].distinct_count, got["m"].max_length) == (1, 1, 1)
    assert {r.column_name: r.transform for r in pr.plan_from_profile(pr.column_profile(df, "t")).collect()} == {"i": "keep_numeric", "a": "drop", "m": "drop"}
    inventory = spark.createDataFrame([("t", 3, 3), ("unknown", 9, 2)], "name string, row_count long, column_count int")
    ranked = {r.name: r for r in sel.rank_opportunities(inventory, pr.column_profile(df, "t")).collect()}
    assert ranked["unknown"].rank == 2 and ranked["unknown"].score == 0.0
