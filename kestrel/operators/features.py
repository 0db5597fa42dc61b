"""Point-in-time feature table over a star schema.

Every function takes and returns DataFrames. The plan is declared once and
written once; nothing is counted or collected between steps except the
bounded lists of one-hot values.

Fixed relative to the reference (SURVEY 2.13): a total order inside every
ordered frame (B8); distinct counts over prior rows via first-seen flags
(B1); the popularity rank is selected once (B2). Customer, product and
category totals over all rows (B6) are kept for parity and are what the
column names say.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.exact import dec, exact_avg, exact_sum
from kestrel.functions.scalars import (date_from_id, hash_bucket, ratio_or_zero,
                                       relative_gap_below, safe_name, unique_names)
from kestrel.operators.joins import (bounded_broadcast, has_repeats, left_dimension_join,
                                     left_dimension_repeats, null_safe_left_join)
from kestrel.operators.ordering import frequency_index_from_counts
from kestrel.operators.windows import _std, prior_frame

# Aggregate feature columns filled with 0 when NULL.
FILL_ZERO_COLS = [
    "customer_total_orders", "customer_total_revenue", "customer_total_quantity",
    "customer_avg_order_value", "customer_avg_quantity", "customer_max_quantity",
    "customer_revenue_std", "customer_unique_products", "customer_unique_categories",
    "order_frequency_days", "product_total_sales", "product_purchase_count",
    "product_avg_quantity_per_order", "category_popularity_rank",
    "customer_category_purchase_count", "customer_purchased_this_category_before",
    "customer_purchased_similar_price_range",
]

# Named feature columns of the output table, in order (one-hot columns follow).
FEATURE_COLS = [
    "product_id_label", "quantity", "revenue", "year", "days_since_order",
    "days_since_first_order", "days_since_last_order", "customer_id_hash",
    "product_price", "price_percentile_in_category", "customer_total_orders",
    "customer_total_revenue", "customer_total_quantity", "customer_avg_order_value",
    "customer_avg_quantity", "customer_max_quantity", "customer_revenue_std",
    "customer_unique_products", "customer_unique_categories", "order_frequency_days",
    "product_total_sales", "product_purchase_count", "product_avg_quantity_per_order",
    "category_popularity_rank", "customer_purchased_this_category_before",
    "customer_category_purchase_count", "customer_purchased_similar_price_range",
    "run_date",
]

# Columns of the enriched fact that the feature table is made of, besides the
# order keys and the columns of customers and dates.
BASE_COLS = ["customer_id", "product_id", "order_id", "order_date", "quantity", "revenue", "product_price", "product_category"]

# One-hot families: (output prefix, source column). Values are read from the
# data and bounded by ``FeatureOptions.max_onehot_values``.
ONEHOT_FAMILIES = [("country", "country"), ("segment", "segment"), ("category", "product_category")]


@dataclass
class FeatureOptions:
    run_date: str = "2002-01-01"
    order_keys: list = field(default_factory=list)   # total order inside a customer
    hash_buckets: int = 100
    similar_price_limit: float = 0.3
    max_onehot_values: int = 10_000                   # columns a table can well have
    skew_split: bool = False                          # see windows.prior_frame
    order_bucket_bits: int = 20                       # order-id block size inside a (customer, day)


CUSTOMER_COLS = ["country", "segment"]
DATE_COLS = ["year", "month", "quarter"]


def enrich_orders(orders: DataFrame, customers: DataFrame | None, products: DataFrame,
                  dates: DataFrame, run_date: str, columns=None) -> DataFrame:
    """P1 + J1–J3 + F1 + F2: clean fact joined to its three dimensions.

    ``customers`` is None when the orders came with their customer's columns.
    ``columns``: those wanted; a dimension of which none is wanted moves no fact
    row, it only repeats rows as its repeated keys would."""
    f = orders.where(F.col("product_id").isNotNull())
    names = {"price": "product_price", "category": "product_category"}
    # the calendar is broadcast: last, so that the others' shuffles do not carry its columns
    for dim, key, take in ((customers, "customer_id", CUSTOMER_COLS), (products, "product_id", ["price", "category"]),
                           (dates, "date_id", DATE_COLS)):
        if dim is None:
            continue
        take = [c for c in take if columns is None or names.get(c, c) in columns]
        f = left_dimension_join(f, dim, key, take, renames=names) if take else left_dimension_repeats(f, dim, key)
    ref = F.lit(run_date).cast("date")
    f = (f.withColumn("order_date", date_from_id("date_id"))
          .withColumn("days_since_order", F.datediff(ref, F.col("order_date"))))
    return f if columns is None else f.select(*dict.fromkeys(columns))


def prior_customer_history(df: DataFrame, order_keys, skew_split: bool = False) -> DataFrame:
    """W1–W6 (+ prior average price): aggregates over the customer's earlier
    rows only (frame UNBOUNDED PRECEDING .. 1 PRECEDING in a total order)."""
    # A row is the first of its (customer, product) when its order key is
    # the minimum of the pair; found by aggregation + join (skew-tolerant),
    # the flag (1 or NULL) is then counted over the prior frame.
    key = F.struct(*[F.col(c) for c in order_keys])
    df = df.withColumn("_ok", key)
    for grp, flag in (("product_id", "_first_product"), ("product_category", "_first_category")):
        firsts = df.groupBy("customer_id", grp).agg(F.min("_ok").alias(f"_min{flag}"))
        # NULL values do not count as a distinct value (countDistinct semantics)
        df = (null_safe_left_join(df, firsts, ["customer_id", grp])
                .withColumn(flag, F.when(F.col(grp).isNotNull() & (F.col("_ok") == F.col(f"_min{flag}")), F.lit(1)))
                .drop(f"_min{flag}"))
    df = df.drop("_ok")

    specs = {
        "customer_total_orders": ("count", "order_id"),
        "customer_total_revenue": ("sum", "revenue"),
        "customer_total_quantity": ("sum", "quantity"),
        "customer_avg_order_value": ("avg", "revenue"),
        "customer_avg_quantity": ("avg", "quantity"),
        "customer_max_quantity": ("max", "quantity"),
        "customer_revenue_std": ("std", "revenue"),
        "customer_unique_products": ("count", "_first_product"),
        "customer_unique_categories": ("count", "_first_category"),
        "customer_avg_price_purchased": ("avg", "product_price"),
    }
    out = prior_frame(df, ["customer_id"], order_keys, specs, skew_split=skew_split)
    return out.drop("_first_product", "_first_category")


def customer_recency(df: DataFrame, run_date: str) -> DataFrame:
    """A1 + J4 + F2 + F6: first/last order date per customer joined back."""
    ref = F.lit(run_date).cast("date")
    fl = df.groupBy("customer_id").agg(F.min("order_date").alias("first_order_date"),
                                       F.max("order_date").alias("last_order_date"))
    out = null_safe_left_join(df, fl, ["customer_id"])
    out = (out.withColumn("days_since_first_order", F.datediff("order_date", "first_order_date"))
              .withColumn("days_since_last_order", F.datediff(ref, F.col("last_order_date"))))
    if "customer_total_orders" in out.columns:
        out = out.withColumn("order_frequency_days", ratio_or_zero(
            F.col("customer_total_orders") > 1, "days_since_first_order", "customer_total_orders"))
    return out


def product_aggregates(df: DataFrame) -> DataFrame:
    """A2: per product sales, purchase count, average quantity."""
    return df.groupBy("product_id").agg(
        exact_sum("revenue").alias("product_total_sales"),
        F.count("order_id").alias("product_purchase_count"),
        exact_avg("quantity").alias("product_avg_quantity_per_order"))


def category_ranking(df: DataFrame) -> DataFrame:
    """A3 + W7: category totals and popularity rank by revenue (ties by name).
    The rank window runs over the aggregate — one row per category."""
    agg = df.groupBy("product_category").agg(
        exact_sum("revenue").alias("category_total_revenue"),
        F.count("order_id").alias("category_purchase_count"))
    w = Window.orderBy(F.desc("category_total_revenue"), F.asc_nulls_last("product_category"))
    return agg.withColumn("category_popularity_rank", F.row_number().over(w))


def price_percentile_table(df: DataFrame, part: str = "product_category", value: str = "product_price",
                           name: str = "price_percentile_in_category") -> DataFrame:
    """``percent_rank()`` over (PARTITION BY part ORDER BY value), computed
    on the (part, value) histogram instead of the rows: rank-1 = rows with a
    smaller value, n = rows in the partition. A category holding a third of
    all rows then costs one histogram row per distinct price, not a hot task.
    Returns one row per (part, value)."""
    hist = df.groupBy(part, value).agg(F.count(F.lit(1)).alias("_c"))
    w_before = Window.partitionBy(part).orderBy(F.asc_nulls_first(value)).rowsBetween(
        Window.unboundedPreceding, -1)
    w_all = Window.partitionBy(part)
    hist = hist.select(part, value,
                       F.coalesce(F.sum("_c").over(w_before), F.lit(0)).alias("_lt"),
                       F.sum("_c").over(w_all).alias("_n"))
    return hist.select(part, value, F.when(F.col("_n") <= 1, F.lit(0.0)).otherwise(
        F.col("_lt").cast("double") / (F.col("_n") - 1).cast("double")).alias(name))


def price_percentile(df: DataFrame, part: str = "product_category",
                     value: str = "product_price", name: str = "price_percentile_in_category") -> DataFrame:
    """W8 joined back to the rows."""
    hist = price_percentile_table(df, part, value, name)
    return df.join(hist, df[part].eqNullSafe(hist[part]) & df[value].eqNullSafe(hist[value]), "left") \
             .drop(hist[part]).drop(hist[value])


def product_features(e: DataFrame) -> DataFrame:
    """Everything keyed by product in one table (one row per product):
    A2 totals, W8 price percentile (the product's price within its category,
    weighted by rows) and the X10 label by frequency. The fact then needs a
    single join on product_id for all of them."""
    agg = e.groupBy("product_id", "product_category", "product_price").agg(
        exact_sum("revenue").alias("product_total_sales"),
        F.count("order_id").alias("product_purchase_count"),
        exact_avg("quantity").alias("product_avg_quantity_per_order"),
        F.count(F.lit(1)).alias("_rows"))
    pp = price_percentile_table(e)
    t = agg.join(pp, agg.product_category.eqNullSafe(pp.product_category)
                 & agg.product_price.eqNullSafe(pp.product_price), "left") \
           .drop(pp.product_category).drop(pp.product_price)
    labels = frequency_index_from_counts(t.where(F.col("product_id").isNotNull()), "product_id", "_rows",
                                         "product_id_label")
    return t.join(labels, "product_id", "left").drop("_rows", "product_category", "product_price")


def category_affinity(df: DataFrame, order_keys, skew_split: bool = False) -> DataFrame:
    """Earlier purchases of this category by this customer, and a flag."""
    specs = {"customer_category_purchase_count": ("count", "order_id")}
    out = prior_frame(df, ["customer_id", "product_category"], order_keys, specs, skew_split=skew_split)
    return out.withColumn("customer_purchased_this_category_before",
                          F.when(F.col("customer_category_purchase_count") > 0, 1).otherwise(0))


def onehot_values(df: DataFrame, col: str, max_values: int) -> list:
    """Bounded distinct values for one-hot columns (X4). Fails loudly when
    the column has more than ``max_values`` values rather than pulling an
    unbounded list to the driver."""
    vals = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct()
            .limit(max_values + 1).collect()]
    if len(vals) > max_values:
        raise ValueError(f"{col}: more than {max_values} distinct values; use hash_encode")
    return sorted(vals)


def onehot_columns(df: DataFrame, families, max_values: int, customers: DataFrame | None = None) -> list[Column]:
    """one 0/1 column per value, plus month_1..12 and quarter_1..4.
    ``customers``: if ``df`` has none of their columns, those of its customers count.

    The values of every family are read in ONE job: (family, value) pairs,
    distinct, at most ``len(families) * (max_values + 1)`` rows collected;
    a family with more than ``max_values`` values fails loudly."""
    types, found = {}, None
    if customers is not None:
        customers = customers.join(df.select("customer_id").distinct(), "customer_id", "left_semi")
    for of in (df, customers):
        there = [(prefix, src) for prefix, src in families if of is not None and src in of.columns and src not in types]
        if there:
            types |= dict(of.dtypes)
            pairs = F.explode(F.array(*[F.struct(F.lit(prefix).alias("f"), F.col(src).cast("string").alias("v"))
                                        for prefix, src in there])).alias("x")
            pairs = of.select(pairs).select("x.f", "x.v").where(F.col("v").isNotNull()).distinct()
            found = pairs if found is None else found.unionByName(pairs)
    rows = found.limit(len(families) * (max_values + 1)).collect()
    values: dict[str, list[str]] = {}
    for r in rows:
        values.setdefault(r.f, []).append(r.v)
    cols = []
    for prefix, src in families:
        vals = sorted(values.get(prefix, []))
        if len(vals) > max_values:
            raise ValueError(f"{src}: more than {max_values} distinct values; use hash_encode")
        for v, name in zip(vals, unique_names([f"{prefix}_{safe_name(v, prefix)}" for v in vals])):
            cols.append(F.when(F.col(src) == F.lit(v).cast(types[src]), 1).otherwise(0).alias(name))
    cols += [F.when(F.col("month") == m, 1).otherwise(0).alias(f"month_{m}") for m in range(1, 13)]
    cols += [F.when(F.col("quarter") == q, 1).otherwise(0).alias(f"quarter_{q}") for q in range(1, 5)]
    return cols


def feature_frame(orders: DataFrame, customers: DataFrame, products: DataFrame,
                  dates: DataFrame, opts: FeatureOptions, enriched: DataFrame | None = None,
                  sizes: DataFrame | None = None, late: bool = False) -> DataFrame:
    """All per-row features before one-hot, label encoding and selection. ``late``:
    ``enriched`` has no columns of customers and dates, they join at the end."""
    e = enriched if enriched is not None else enrich_orders(orders, customers, products, dates, opts.run_date)
    # product and category totals are over the enriched rows (the windows
    # add columns, never rows), so they aggregate the cheap frame.
    of_product = product_features(e)
    # a product's few numbers join the rows before they have the customer's many;
    # but repeated products repeat rows, which must not be counted as purchases
    first = late or opts.skew_split and not has_repeats(products, "product_id")
    f = e.join(of_product, "product_id", "left") if first else e

    def with_dimensions(df):
        """Rows lie by customer: only the dimensions' rows move."""
        df = left_dimension_join(df, customers, "customer_id", CUSTOMER_COLS)
        df = left_dimension_join(df, dates, "date_id", DATE_COLS)
        return df.withColumn("days_since_order", F.datediff(F.lit(opts.run_date).cast("date"), F.col("order_date")))

    if opts.skew_split:
        f = customer_features(f, opts.order_keys, opts.run_date, order_bucket_bits=opts.order_bucket_bits,
                              sizes=e if sizes is None else sizes, finish=with_dimensions if late else None)
    else:
        f = prior_customer_history(f, opts.order_keys, False)
        f = customer_recency(f, opts.run_date)
    if not first:
        f = f.join(of_product, "product_id", "left")
    ranks = bounded_broadcast(category_ranking(e).select("product_category", "category_popularity_rank"))
    f = f.join(ranks, f.product_category.eqNullSafe(ranks.product_category), "left").drop(ranks.product_category)
    if not opts.skew_split:
        f = category_affinity(f, opts.order_keys, False)
    f = f.withColumn("customer_purchased_similar_price_range", relative_gap_below(
        "product_price", "customer_avg_price_purchased", opts.similar_price_limit))
    f = f.withColumn("customer_id_hash", hash_bucket("customer_id", opts.hash_buckets))
    return f.na.fill(0, subset=FILL_ZERO_COLS)


def feature_table(orders: DataFrame, customers: DataFrame, products: DataFrame,
                  dates: DataFrame, opts: FeatureOptions, extra_cols=(), materialize: bool = True,
                  sizes: DataFrame | None = None) -> DataFrame:
    """F-2: the full feature table, keys (customer_id, product_id) kept.
    ``sizes``: see ``customer_features``.

    The enriched fact (fact ⋈ three dimensions) feeds a dozen aggregations
    and windows; it is written once to the shared checkpoint folder
    (``materialize``) so each of them scans that table instead of redoing
    the fact join and dimension joins. The bounded driver read (one-hot
    values) is taken from it too."""
    # customers and dates that repeat no row may join when the rows lie by customer
    late = opts.skew_split and customers is not None and not any(
        has_repeats(d, k) for d, k in ((customers, "customer_id"), (products, "product_id"), (dates, "date_id")))
    own = [*opts.order_keys, *[c for c in extra_cols if c not in FEATURE_COLS]]
    base = enrich_orders(orders, customers, products, dates, opts.run_date,
                         [*BASE_COLS, *own, *(["date_id"] if late else [*CUSTOMER_COLS, *DATE_COLS, "days_since_order"])])
    if materialize:
        # about ten branches read it: materialising pays off at any size
        from kestrel.session import cut_lineage
        base = cut_lineage(base, "enriched", "zstd")
    onehots = onehot_columns(base, ONEHOT_FAMILIES, opts.max_onehot_values, customers if late else None)
    f = feature_frame(orders, customers, products, dates, opts, enriched=base, sizes=sizes, late=late)
    f = f.withColumn("run_date", F.lit(opts.run_date))
    out = f.select("customer_id", "product_id", *FEATURE_COLS, *onehots, *extra_cols)
    return out.where(F.col("product_id_label").isNotNull())


#: Customers are counted in so many slots to find the large ones.
SLOTS = 1 << 14


def large_slots(df: DataFrame, rows: int) -> list[int]:
    """The slots of customers that hold more than ``rows`` rows and twice the mean:
    what a customer with as many rows must lie in. One number a slot is collected."""
    n = {r[0]: r[1] for r in df.groupBy(_slot()).count().collect()}
    least = rows + 2 * sum(n.values()) // SLOTS
    return sorted(k for k, v in n.items() if v > least)


def _slot() -> Column:
    return F.pmod(F.xxhash64("customer_id"), F.lit(SLOTS)).cast("int")


def customer_features(e: DataFrame, order_keys, run_date: str, affinity: bool = True,
                      order_bucket_bits: int = 20, sizes: DataFrame | None = None, finish=None) -> DataFrame:
    """W1–W6, W9, A1, F2, F6 and the prior average price in one shuffle of the
    fact, by customer. Customers of more than ``2**order_bucket_bits`` rows, and
    those that share a slot with one, are spread over their days
    (``split_customer_features``). ``sizes``: rows with the customers whose
    number tells the large ones, ``e`` itself if None; orders do as well.
    ``finish`` (DataFrame -> DataFrame) gets the rows where they lie by customer."""
    finish = finish or (lambda df: df)
    large = large_slots(e if sizes is None else sizes, 1 << order_bucket_bits)
    if not large:
        return finish(whole_customer_features(e, order_keys, run_date, affinity))
    here = _slot().isin(large)
    whole = whole_customer_features(e.where(~here), order_keys, run_date, affinity)
    split = split_customer_features(e.where(here), order_keys, run_date, affinity, order_bucket_bits)
    return finish(whole).unionByName(finish(split))


def whole_customer_features(e: DataFrame, order_keys, run_date: str, affinity: bool = True) -> DataFrame:
    """``customer_features`` of customers whose rows one task can sort: the rows
    are dealt by customer, and every window below is partitioned by the customer
    and more, so that none of them moves a row or joins a table."""
    c, d_col = "customer_id", order_keys[0]
    rev, qty, price = F.col("revenue"), F.col("quantity"), F.col("product_price")

    def by(*more):
        return Window.partitionBy(c, *more).orderBy(*order_keys)

    def new(of):  # NULL is not a distinct value
        return F.when((F.row_number().over(by(of)) == 1) & F.col(of).isNotNull(), 1)

    before = (Window.unboundedPreceding, -1)
    w, every = by().rowsBetween(*before), by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    r = e.repartition(c).select("*", new("product_id").alias("_new_p"))
    in_category = F.count("order_id").over(by("product_category").rowsBetween(*before))
    r = r.select("*", new("product_category").alias("_new_c"), *([in_category.alias("_cat")] if affinity else []))
    r = r.select("*", F.count("order_id").over(w).alias("_n"), F.count(rev).over(w).alias("_nr"),
                 F.sum(dec(rev)).over(w).alias("_sr"), F.sum(dec(rev) * dec(rev)).over(w).alias("_ssr"),
                 F.count(qty).over(w).alias("_nq"), F.sum(dec(qty)).over(w).alias("_sq"),
                 F.max(qty).over(w).alias("_mq"), F.count(price).over(w).alias("_np"),
                 F.sum(dec(price)).over(w).alias("_sp"), F.count("_new_p").over(w).alias("_up"),
                 F.count("_new_c").over(w).alias("_uc"),
                 F.min(d_col).over(every).alias("first_order_date"), F.max(d_col).over(every).alias("last_order_date"))
    if affinity:
        r = r.withColumn("_cat", F.col("_cat").cast("long"))
    sums = {x: F.col(f"_{x}") for x in ("n", "nr", "sr", "ssr", "nq", "sq", "mq", "np", "sp", "up", "uc")}
    sums["ssr"] = sums["ssr"].cast("decimal(38,7)")  # as the sum of a day's and the earlier days' squares
    return _customer_columns(r, e.columns, d_col, run_date, sums, F.col("_cat") if affinity else None)


def _customer_columns(r: DataFrame, columns, d_col: str, run_date: str, sums: dict, cat_count: Column | None) -> DataFrame:
    """The features from the counts and exact sums over the customer's earlier rows."""
    n, nr, nq, np_ = (sums[x] for x in ("n", "nr", "nq", "np"))
    sr, sq, sp = (F.when(sums[k] > 0, sums[x]).cast("double") for k, x in (("nr", "sr"), ("nq", "sq"), ("np", "sp")))
    affinity_cols = []
    if cat_count is not None:
        affinity_cols = [cat_count.alias("customer_category_purchase_count"),
                         F.when(cat_count > 0, 1).otherwise(0).alias("customer_purchased_this_category_before")]
    out = r.select(
        *columns,
        n.cast("long").alias("customer_total_orders"),
        sr.alias("customer_total_revenue"), sq.alias("customer_total_quantity"),
        F.try_divide(sr, nr.cast("double")).alias("customer_avg_order_value"),
        F.try_divide(sq, nq.cast("double")).alias("customer_avg_quantity"),
        sums["mq"].alias("customer_max_quantity"),
        _std(nr, F.when(nr > 0, sums["sr"]), F.when(nr > 0, sums["ssr"])).alias("customer_revenue_std"),
        sums["up"].cast("long").alias("customer_unique_products"),
        sums["uc"].cast("long").alias("customer_unique_categories"),
        F.try_divide(sp, np_.cast("double")).alias("customer_avg_price_purchased"),
        "first_order_date", "last_order_date",
        F.datediff(d_col, "first_order_date").alias("days_since_first_order"),
        F.datediff(F.lit(run_date).cast("date"), F.col("last_order_date")).alias("days_since_last_order"),
        *affinity_cols)
    return out.withColumn("order_frequency_days", ratio_or_zero(
        F.col("customer_total_orders") > 1, "days_since_first_order", "customer_total_orders"))


def split_customer_features(e: DataFrame, order_keys, run_date: str, affinity: bool = True,
                            order_bucket_bits: int = 20) -> DataFrame:
    """``customer_features`` for customers with too many rows for a task.

    The rows are hash-partitioned once on (customer, order date); every
    window below is partitioned by a superset of those keys, so none of them
    re-shuffles the rows. Everything that crosses days comes from small
    tables keyed by (customer, date) — built from map-side partial
    aggregates — and joins on exactly the rows' partitioning:

    * carry: per (customer, day) totals, prefix-summed over earlier days by a
      window over the customer's days (bounded by the calendar), plus the
      customer's first and last order date;
    * new products / categories: the values whose first day for the customer
      is that day (first-seen flags for the distinct counts, W6);
    * category carry: per (customer, category) rows on earlier days, packed
      as an array per (customer, day).
    A customer with a third of all rows is spread over its order dates, and a
    single (customer, day) over blocks of ``2**order_bucket_bits`` order ids:
    the bucket is (date, order_id >> bits), which keeps the total order
    (date first, then order id) and bounds every window task.
    """
    # the key as a struct is never NULL, so lines without a customer are a
    # customer's like any other, in every window and join below
    c = "_ck"
    e = e.withColumn(c, F.struct(F.col("customer_id").alias("v")))
    rest = list(order_keys[1:])
    e = e.withColumn("_ob", F.shiftright(F.col("order_id"), order_bucket_bits))
    d_col = order_keys[0]
    d = "_bk"
    e = e.withColumn(d, F.struct(F.col(d_col).alias("d"), F.col("_ob").alias("b")))
    keys = [c, d]
    rev, qty, price = F.col("revenue"), F.col("quantity"), F.col("product_price")
    rows = e.repartition(c, d)

    # -------- small tables keyed by (customer, day)
    hist = e.groupBy(*keys).agg(
        F.count("order_id").alias("h_n"), F.count(rev).alias("h_nr"), F.sum(dec(rev)).alias("h_sr"),
        F.sum(dec(rev) * dec(rev)).alias("h_ssr"), F.count(qty).alias("h_nq"), F.sum(dec(qty)).alias("h_sq"),
        F.max(qty).alias("h_mq"), F.count(price).alias("h_np"), F.sum(dec(price)).alias("h_sp"))
    new_p = (e.groupBy(c, "product_id").agg(F.min(d).alias(d))
             .groupBy(*keys).agg(F.collect_set("product_id").alias("new_products")))
    new_c = (e.where(F.col("product_category").isNotNull()).groupBy(c, "product_category").agg(F.min(d).alias(d))
             .groupBy(*keys).agg(F.collect_set("product_category").alias("new_categories")))
    hist = (hist.join(new_p, keys, "left").join(new_c, keys, "left")
            .withColumn("h_up", F.coalesce(F.size("new_products"), F.lit(0)))
            .withColumn("h_uc", F.coalesce(F.size("new_categories"), F.lit(0))))
    wp = Window.partitionBy(c).orderBy(F.asc_nulls_first(d)).rowsBetween(Window.unboundedPreceding, -1)
    wa = Window.partitionBy(c)
    carry = hist.select(
        *keys, "new_products", "new_categories",
        *[F.sum(x).over(wp).alias(f"c{x[1:]}") for x in
          ("h_n", "h_nr", "h_sr", "h_ssr", "h_nq", "h_sq", "h_np", "h_sp", "h_up", "h_uc")],
        F.max("h_mq").over(wp).alias("c_mq"),
        F.min(F.col(d)["d"]).over(wa).alias("first_order_date"),
        F.max(F.col(d)["d"]).over(wa).alias("last_order_date"))
    if affinity:
        cat_hist = e.groupBy(c, "product_category", d).agg(F.count("order_id").alias("_k"))
        wcat = Window.partitionBy(c, "product_category").orderBy(F.asc_nulls_first(d)).rowsBetween(
            Window.unboundedPreceding, -1)
        cat_carry = (cat_hist.select(c, "product_category", d,
                                     F.coalesce(F.sum("_k").over(wcat), F.lit(0)).alias("_cc"))
                     .groupBy(*keys).agg(F.collect_list(F.struct(F.col("product_category").alias("cat"),
                                                                 F.col("_cc").alias("n"))).alias("cat_carry")))

    # -------- row windows inside the (customer, day) partitions
    o = [F.col(x) for x in rest] or [F.col(d)]
    w = Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    w_p = Window.partitionBy(c, d, "product_id").orderBy(*o)
    w_c = Window.partitionBy(c, d, "product_category").orderBy(*o)
    w_cat = Window.partitionBy(c, d, "product_category").orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    r = rows.select("*",
                    (F.row_number().over(w_p) == 1).alias("_fp_day"),
                    (F.row_number().over(w_c) == 1).alias("_fc_day"),
                    *([F.count("order_id").over(w_cat).alias("_cat_local")] if affinity else []))
    r = r.join(carry, keys, "left")
    if affinity:
        r = r.join(cat_carry, keys, "left")
    # Evaluate every lookup into the joined per-day arrays right here and drop
    # the arrays, so no row carries them into the window sort below.
    lookups = [
        F.when(F.col("_fp_day") & F.array_contains(F.col("new_products"), F.col("product_id")), 1).alias("_new_p"),
        F.when(F.col("_fc_day") & F.col("product_category").isNotNull()
               & F.array_contains(F.col("new_categories"), F.col("product_category")), 1).alias("_new_c")]
    if affinity:
        lookups.append(F.coalesce(F.element_at(F.filter(
            "cat_carry", lambda x: x["cat"].eqNullSafe(F.col("product_category"))), 1)["n"], F.lit(0))
            .alias("_cat_prior"))
    arrays = {"new_products", "new_categories", "cat_carry"}
    r = r.select(*[x for x in r.columns if x not in arrays], *lookups)
    r = r.select("*",
                 F.count("order_id").over(w).alias("l_n"), F.count(rev).over(w).alias("l_nr"),
                 F.sum(dec(rev)).over(w).alias("l_sr"), F.sum(dec(rev) * dec(rev)).over(w).alias("l_ssr"),
                 F.count(qty).over(w).alias("l_nq"), F.sum(dec(qty)).over(w).alias("l_sq"),
                 F.max(qty).over(w).alias("l_mq"), F.count(price).over(w).alias("l_np"),
                 F.sum(dec(price)).over(w).alias("l_sp"),
                 F.count("_new_p").over(w).alias("l_up"), F.count("_new_c").over(w).alias("l_uc"))

    def tot(x, decimal=False):
        lc, cc = F.col(f"l_{x}"), F.col(f"c_{x}")
        if decimal:
            return F.coalesce(lc, F.lit(0)) + F.coalesce(cc, F.lit(0))
        return lc + F.coalesce(cc, F.lit(0))

    sums = {x: tot(x, x in ("sr", "ssr", "sq", "sp")) for x in ("n", "nr", "sr", "ssr", "nq", "sq", "np", "sp", "up", "uc")}
    sums["mq"] = F.greatest(F.col("l_mq"), F.col("c_mq"))
    cat_count = (F.col("_cat_local") + F.col("_cat_prior")).cast("long") if affinity else None
    return _customer_columns(r, [x for x in e.columns if x not in ("_ob", d, c)], d_col, run_date, sums, cat_count)
