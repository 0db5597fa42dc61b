"""Training-data operators and evaluation metrics (SURVEY X11, X12, A5–A8,
A16–A23, M7, M8).

Everything is a DataFrame aggregation; no label or prediction column is
collected to the driver. Rankings that the reference computes with a global
sort (AUC, split cut points) are computed on histograms whose size is
bounded by the calendar or by the number of distinct scores per class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.windows import prior_frame

METRIC_DIGITS = 6


def _one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Attach the values of a single-row aggregate to every row: the row is
    read once (a scalar result, like any global aggregate) and added as typed
    literals — no join at all."""
    row = right.first()
    cols = [F.lit(None if row is None else row[f.name]).cast(f.dataType).alias(f.name)
            for f in right.schema.fields]
    return left.select("*", *cols)


# ---------------------------------------------------------------- splits
def temporal_split(df: DataFrame, date_col: str, train_share: float = 0.8) -> DataFrame:
    """X11: the cut date is the first date at which the running share of
    rows reaches ``train_share``; rows up to it train, later rows test. The
    running share is a window over the date histogram (one row per date —
    bounded by the calendar), never a global row sort."""
    hist = df.groupBy(date_col).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, 0)
    hist = hist.select(date_col, F.sum("_n").over(w).alias("_cum"), F.sum("_n").over(Window.partitionBy()).alias("_tot"))
    # exact integer test of cum / tot >= share, share in thousandths
    cut = hist.where(F.col("_cum") * 1000 >= F.col("_tot") * int(round(train_share * 1000))) \
              .agg(F.min(date_col).alias("split_cut"))
    out = _one_row_join(df, cut)
    return out.withColumn("split", F.when(F.col(date_col) <= F.col("split_cut"), "train").otherwise("test"))


def stratified_split(df: DataFrame, label: str, key_cols: list[str], seed: int = 42,
                     train_tenths: int = 8) -> DataFrame:
    """Per class, rows ordered by a seeded SHA-256 of their key; the
    first round(0.8·n) are train. Exact per class (not in expectation), and
    the per-class ordering runs as the split running count: buckets of the
    hash are windowed separately, so a class with a third of the rows is not
    one task."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed)))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 15), 16, 10).cast("long")
    d = df.withColumn("_h", h).withColumn("_hb", F.shiftright("_h", 44))   # 65536 buckets per class
    d = prior_frame(d, [label], ["_hb", "_h"] + key_cols, {"_pos": ("count", "_h")},
                    skew_split=True, include_current=True)
    n = d.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, label, "left")
    n_train = F.floor((F.col("_n") * train_tenths + 5) / 10)
    return d.withColumn("split", F.when(F.col("_pos") <= n_train, "train").otherwise("test")) \
            .drop("_h", "_hb", "_pos", "_n")


# ---------------------------------------------------------------- classes
def class_frequency(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("class_count"))


def balanced_class_weights(df: DataFrame, label: str) -> DataFrame:
    """N / (k · n_c) per class (sklearn's 'balanced')."""
    freq = class_frequency(df, label)
    tot = freq.agg(F.sum("class_count").alias("_rows"), F.count(F.lit(1)).alias("_classes"))
    w = _one_row_join(freq, tot)
    return w.select(label, "class_count", (F.col("_rows").cast("double")
                                           / (F.col("_classes") * F.col("class_count")).cast("double")).alias("weight"))


def with_class_weights(df: DataFrame, label: str) -> DataFrame:
    """A17 joined back: a ``weight`` column per row (many-to-one join on
    the class; AQE broadcasts it when small and splits skewed classes)."""
    return df.join(balanced_class_weights(df, label).select(label, "weight"), label, "left")


def value_distribution(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k most frequent values (ties by value) — top-k is the feature."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")) \
             .orderBy(F.desc("count"), F.asc_nulls_last(col)).limit(k)


def numeric_summary(df: DataFrame, cols: list[str], quantiles: bool = False) -> DataFrame:
    """Count, mean, stddev, min, max per column as a long table (one
    aggregation pass). Mean and stddev are rounded to 6 decimals so the
    value does not depend on summation order. ``quantiles`` adds
    25/50/75 % from ``percentile_approx`` (bounded sketch memory)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.round(F.avg(x), METRIC_DIGITS).alias(f"m{i}"),
                 F.round(F.stddev_samp(x), METRIC_DIGITS).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if quantiles:
            aggs.append(F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(f"q{i}"))
    one = df.agg(*aggs)
    items = []
    for i, c in enumerate(cols):
        fields = [F.lit(c).alias("column_name"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                  F.col(f"s{i}").alias("stddev"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")]
        if quantiles:
            fields += [F.col(f"q{i}")[j].alias(n) for j, n in enumerate(("p25", "p50", "p75"))]
        items.append(F.struct(*fields))
    return one.select(F.inline(F.array(*items)))


# ---------------------------------------------------------------- metrics
def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """A19."""
    return pred.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"),
                    F.count(F.lit(1)).alias("rows"))


def top_k_accuracy(pred: DataFrame, ks=(5, 10), label: str = "label", proba: str = "probability") -> DataFrame:
    """Share of rows whose label is among the k most probable classes.
    ``proba``: array<double> (or an ML vector) indexed by class id."""
    p = F.col(proba)
    if dict(pred.dtypes)[proba] != "array<double>":
        from pyspark.ml.functions import vector_to_array
        p = vector_to_array(p)
    ranked = F.transform(F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("nv"), i.alias("i")))),
                         lambda s: s["i"])
    return pred.select(*[F.array_contains(F.slice(ranked, 1, k), F.col(label).cast("int")).cast("double")
                         .alias(f"top{k}") for k in ks]) \
               .agg(*[F.avg(f"top{k}").alias(f"top{k}_accuracy") for k in ks])


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (label, prediction)."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")) \
               .agg(F.count(F.lit(1)).alias("count"))


def class_report(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class support, predicted count, true positives, precision,
    recall and F1 — one aggregation over the confusion counts, each count
    viewed once as its true class and once as its predicted class (no
    joins)."""
    cm = confusion(pred, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(F.lit(0))
    roles = F.array(
        F.struct(F.col("label").alias("cls"), F.col("count").alias("s"), F.lit(0).cast("long").alias("p"),
                 hit.cast("long").alias("t")),
        F.struct(F.col("prediction").alias("cls"), F.lit(0).cast("long").alias("s"), F.col("count").alias("p"),
                 F.lit(0).cast("long").alias("t")))
    r = cm.select(F.inline(roles)).groupBy("cls").agg(
        F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("tp"))
    precision = F.when(F.col("predicted") > 0, F.col("tp").cast("double") / F.col("predicted").cast("double"))
    recall = F.when(F.col("support") > 0, F.col("tp").cast("double") / F.col("support").cast("double"))
    f1 = F.try_divide(F.lit(2.0) * precision * recall, precision + recall)
    return r.select("cls", "support", "predicted", "tp", precision.alias("precision"),
                    recall.alias("recall"), F.round(f1, METRIC_DIGITS).alias("f1"))


def binary_auc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Rank-sum (Mann–Whitney) AUC with ties counted half, from the
    (score -> positives, negatives) histogram: AUC = Σ_s pos_s·(neg below s
    + neg_s/2) / (P·N)."""
    hist = scored.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_p"),
                                     F.count_if(F.col(label) != 1).alias("_n"))
    # negatives below each score: a running sum over distinct scores, split
    # into score buckets so no single task holds every distinct score.
    hist = hist.withColumn("_all", F.lit(0)).withColumn("_b", F.floor(F.col(score) * 1024))
    hist = prior_frame(hist, ["_all"], ["_b", score], {"_nb0": ("sum", "_n", 0)}, skew_split=True)
    hist = hist.withColumn("_nb", F.coalesce(F.col("_nb0"), F.lit(0.0)).cast("long"))
    agg = hist.agg(F.sum(F.col("_p") * (F.col("_nb") * 2 + F.col("_n"))).alias("_u2"),
                   F.sum("_p").alias("P"), F.sum("_n").alias("N"))
    return agg.select(F.try_divide(F.col("_u2").cast("double"),
                                   (F.col("P") * F.col("N") * 2).cast("double")).alias("auc"), "P", "N")


def weighted_ovr_auc(pred: DataFrame, label: str = "label", proba: str = "probability") -> DataFrame:
    """One-vs-rest AUC per class from the class's probability, averaged
    with class support as weights (sklearn ``average='weighted'``). One pass:
    rows are exploded to (class, score, is_label), histogrammed per
    (class, score), and the rank sums run per class on bucketed scores."""
    p = F.col(proba)
    if dict(pred.dtypes)[proba] != "array<double>":
        from pyspark.ml.functions import vector_to_array
        p = vector_to_array(p)
    d = pred.select(F.col(label).cast("int").alias("_y"), F.posexplode(p).alias("cls", "_s"))
    hist = d.groupBy("cls", "_s").agg(F.count_if(F.col("_y") == F.col("cls")).alias("_p"),
                                      F.count_if(F.col("_y") != F.col("cls")).alias("_n"))
    hist = hist.withColumn("_b", F.floor(F.col("_s") * 1024))
    hist = prior_frame(hist, ["cls"], ["_b", "_s"], {"_nb0": ("sum", "_n", 0)}, skew_split=True)
    hist = hist.withColumn("_nb", F.coalesce(F.col("_nb0"), F.lit(0.0)).cast("long"))
    per = hist.groupBy("cls").agg(F.sum(F.col("_p") * (F.col("_nb") * 2 + F.col("_n"))).alias("_u2"),
                                  F.sum("_p").alias("P"), F.sum("_n").alias("N"))
    per = per.select("cls", F.try_divide(F.col("_u2").cast("double"),
                                         (F.col("P") * F.col("N") * 2).cast("double")).alias("auc"),
                     F.col("P").alias("support")).where(F.col("auc").isNotNull())
    return per.agg(F.round(F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support").cast("double")),
                           METRIC_DIGITS).alias("weighted_auc"))


def rmse(pred: DataFrame, label: str, prediction: str) -> DataFrame:
    """A22."""
    e = F.col(prediction).cast("double") - F.col(label).cast("double")
    return pred.agg(F.round(F.sqrt(F.avg(e * e)), METRIC_DIGITS).alias("rmse"), F.count(e).alias("rows"))


# ---------------------------------------------------------------- baselines / drift
def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """M8: predict the most frequent training class (ties: smallest value)."""
    top = class_frequency(train, label).orderBy(F.desc("class_count"), F.asc(label)).limit(1) \
        .select(F.col(label).alias("prediction"))
    return _one_row_join(test, top)


def psi(expected: DataFrame, actual: DataFrame, col: str, buckets: int = 10, eps: float = 1e-4) -> DataFrame:
    """M7: population stability index of ``col`` between a baseline and a
    new run. Equal-width buckets over the baseline's [min, max]; shares
    floored at ``eps``; PSI = Σ (a − e)·ln(a / e)."""
    rng = expected.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))

    def shares(df, side):
        d = _one_row_join(df.select(F.col(col).cast("double").alias("_v")), rng)
        width = (F.col("_hi") - F.col("_lo")) / buckets
        b = F.when(width <= 0, 0).otherwise(
            F.least(F.greatest(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(0)), F.lit(buckets - 1)))
        h = d.where(F.col("_v").isNotNull()).groupBy(b.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("_c"))
        tot = h.agg(F.sum("_c").alias("_t"))
        return _one_row_join(h, tot).select("bucket", (F.col("_c") / F.col("_t")).alias(side))

    all_b = expected.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    j = all_b.join(shares(expected, "e"), "bucket", "left").join(shares(actual, "a"), "bucket", "left")
    e = F.greatest(F.coalesce(F.col("e"), F.lit(0.0)), F.lit(eps))
    a = F.greatest(F.coalesce(F.col("a"), F.lit(0.0)), F.lit(eps))
    return j.agg(F.round(F.sum((a - e) * F.log(a / e)), METRIC_DIGITS).alias("psi"))
