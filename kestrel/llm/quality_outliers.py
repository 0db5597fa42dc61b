"""Quality rules by robust multivariate outliers.

Each document has a vector of transformed statistics. Per language and source
a minimum-covariance-determinant estimate is found by concentration steps:
from the medians and quartile ranges, the distances of all documents give the
half (``SUBSET``) that lies nearest, whose mean and covariance give the next
distances. A document far from its group's estimate (Mahalanobis distance over
the cut) is rejected, as is one that fails the base rules.

At scale: a step is one aggregation over the statistics table. The distances
are binned on a fixed logarithmic scale, so each group has at most ``BINS``
partial rows however many documents it holds; a hot group is summed where its
rows lie. The nearest part is taken in whole bins (at least ``SUBSET`` of the
group). Every group, of any size, has its own estimate, drawn toward that of
its language as if ``WEIGHT`` documents of the language's centre and spread
were among its nearest, and the language's toward that of all documents: a
large group hardly feels it, a group of a few documents has little to say
against it. Coordinates have a least scale (``FLOOR``), so groups made of
copies do not reject what differs slightly.

Null text: no words, fails the base rules. Null language or source: a group of
its own. Very long texts are read whole. Ties of distance fall into one bin and
are taken together. Repeated rows count as often as they come and get one row
each. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import chunks, cut_lineage, mix, raw, read, windows, words

FEATURES = ("word_length", "symbols", "capitals", "punctuation", "digits", "repeated_lines", "repeated_words")
FLOOR = (0.10, 0.04, 0.05, 0.05, 0.05, 0.08, 0.08)
SUBSET = 0.75
STEPS = 5
BINS = 4096
#: Documents that the estimate a group is drawn toward counts for.
WEIGHT = 200.0
#: Share of normal documents that lie within the cut.
COVERED = 1 - 1e-7

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_punct")


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a chunk."""
    data, at = raw(texts)
    w = words(texts)
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[at])
    space = np.zeros(len(data) + 1, np.int32)
    np.add.at(space, w.start, 1)
    np.add.at(space, w.end, -1)
    inside = np.cumsum(space[:-1]) > 0
    out = {
        "n_words": w.counts,
        "word_chars": total(inside & ((data & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[data]),
        "n_letters": total(_LETTER[data]),
        "n_upper": total(_UPPER[data]),
        "n_digits": total(_DIGIT[data]),
        "n_punct": total(_PUNCT[data]),
    }
    lines, repeated = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    whole = data.tobytes()
    for i in range(len(texts)):
        full = [x for x in whole[at[i] : at[i + 1]].split(b"\n") if x.strip()]
        lines[i], repeated[i] = len(full), len(full) - len(set(full))
    out |= {"n_lines": lines, "n_dup_lines": repeated}
    h, begin, first = windows(w.hashes(), w.first, 5)
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(first))
    key = mix(h ^ mix(doc))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.start) + 6, np.int32)
    cover[begin[twice]] += 1
    cover[begin[twice] + 5] -= 1
    covered = np.append(0, np.cumsum(np.cumsum(cover[: len(w.start)]) > 0))
    out["n_repeat_words"] = np.diff(covered[w.first])
    return out


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, and the vector ``x0..`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            c = text_counts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(c[k].astype(np.int64)) for k in COUNTS)], ["doc_id", "lang", "source", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    out = rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    vector = (
        F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_upper", "n_letters"),
        share("n_punct", "word_chars"), share("n_digits", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("*", failed.alias("base_failed"), *(x.alias(f"x{i}") for i, x in enumerate(vector)))


def scoped(stats: DataFrame) -> DataFrame:
    """With the columns ``scope0`` (all), ``scope1`` (the language) and ``scope2``
    (the language and source); null is a value."""
    return stats.withColumns({"scope0": F.lit("all"), "scope1": F.to_json(F.struct("lang")), "scope2": F.to_json(F.struct("lang", "source"))})


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(share: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(dims / 2, mid / 2) < share else (low, mid)
    return high


P = len(FEATURES)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
ESTIMATE = "scope string, " + ", ".join([*(f"m{i} double" for i in range(P)), *(f"w{i}_{j} double" for i, j in PAIRS)])


def _whitened(scope: str, mean: np.ndarray, cov: np.ndarray) -> dict:
    """The estimate as a mean and the inverse Cholesky factor: the distance is
    the length of the factor times the difference."""
    w = np.linalg.inv(np.linalg.cholesky(cov + np.diag(np.square(FLOOR))))
    return {"scope": scope} | {f"m{i}": mean[i] for i in range(P)} | {f"w{i}_{j}": w[i, j] for i, j in PAIRS}


def _moments(row) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the covariance (without ``FLOOR``) of an estimate."""
    w = np.zeros((P, P))
    for i, j in PAIRS:
        w[i, j] = row[f"w{i}_{j}"]
    factor = np.linalg.inv(w)
    return np.array([row[f"m{i}"] for i in range(P)]), factor @ factor.T - np.diag(np.square(FLOOR))


def start(stats: DataFrame) -> DataFrame:
    """Medians and quartile ranges of each group."""
    q = stats.groupBy("scope").agg(*(F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(P)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([_whitened(r.scope, np.array([r[f"q{i}"][1] for i in range(P)]), np.diag([((r[f"q{i}"][2] - r[f"q{i}"][0]) / 1.349) ** 2 for i in range(P)])) for _, r in f.iterrows()], columns=[x.split()[0] for x in ESTIMATE.split(", ")])

    return q.mapInPandas(run, ESTIMATE)


def distances(stats: DataFrame, estimate: DataFrame) -> DataFrame:
    """With the column ``d2``: squared distance from the group's estimate."""
    parts = [sum((F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    joined = stats.join(estimate, "scope")
    return joined.withColumn("d2", sum((p * p for p in parts), F.lit(0.0))).drop(*(x.split()[0] for x in ESTIMATE.split(", ")[1:]))


def binned(stats: DataFrame, estimate: DataFrame, sums: bool = True) -> DataFrame:
    """Counts (and sums and products) of each group's distance bins."""
    d = distances(stats, estimate).withColumn("bin", F.least(F.floor(F.log2(1 + F.col("d2")) * 128), F.lit(BINS - 1)).cast("int"))
    more = [*(F.sum(f"x{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in PAIRS)] if sums else []
    return d.groupBy("scope", "bin").agg(F.count("*").alias("n"), *more)


def step(stats: DataFrame, estimate: DataFrame, toward: DataFrame | None = None, weight: float = WEIGHT) -> DataFrame:
    """One concentration step: the estimate from each group's nearest part, drawn
    toward that of ``toward`` (scope and estimate), if given."""

    def run(f: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("bin")
        before = f["n"].cumsum() - f["n"]
        near = f[before < SUBSET * f["n"].sum()]
        n = near["n"].sum()
        mean = np.array([near[f"s{i}"].sum() / n for i in range(P)])
        cov = np.zeros((P, P))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = near[f"p{i}_{j}"].sum() / n - mean[i] * mean[j]
        if len(other) and weight:
            m, c = _moments(other.iloc[0])
            off = mean - m
            cov = (n * cov + weight * c + n * weight / (n + weight) * np.outer(off, off)) / (n + weight)
            mean = (n * mean + weight * m) / (n + weight)
        low, at = np.linalg.eigh(cov)
        return pd.DataFrame([_whitened(f["scope"].iloc[0], mean, (at * np.maximum(low, 0)) @ at.T)])

    bins = binned(stats, estimate)
    toward = stats.sparkSession.createDataFrame([], ESTIMATE) if toward is None else toward
    return bins.groupBy("scope").cogroup(toward.groupBy("scope")).applyInPandas(lambda f, o: run(f, o) if len(f) else f.reindex(columns=[x.split()[0] for x in ESTIMATE.split(", ")]), ESTIMATE)


def scale(stats: DataFrame, estimate: DataFrame, toward: DataFrame | None = None, weight: float = WEIGHT) -> DataFrame:
    """scope, factor: what makes the median distance that of normal data (never
    under 1), drawn toward that of ``toward`` (scope, factor), on a log scale."""
    normal = chi2_quantile(0.5, P)

    def run(f: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("bin")
        middle = f["bin"][f["n"].cumsum() >= 0.5 * f["n"].sum()].iloc[0]
        factor, n = max(1.0, (2 ** ((middle + 1) / 128) - 1) / normal), float(f["n"].sum())
        if len(other) and weight:
            factor = math.exp((n * math.log(factor) + weight * math.log(other["factor"].iloc[0])) / (n + weight))
        return pd.DataFrame({"scope": [f["scope"].iloc[0]], "factor": [factor]})

    bins = binned(stats, estimate, sums=False)
    toward = stats.sparkSession.createDataFrame([], "scope string, factor double") if toward is None else toward
    return bins.groupBy("scope").cogroup(toward.groupBy("scope")).applyInPandas(lambda f, o: run(f, o) if len(f) else pd.DataFrame({"scope": [], "factor": []}), "scope string, factor double")


def quality_outliers(docs: DataFrame) -> DataFrame:
    """Every document's counts, base verdict, distance and whether it is kept."""
    stats = cut_lineage(statistics(docs), "quality-statistics")
    stats = scoped(stats)
    estimate = factor = None
    for level in range(3):
        at = stats.withColumn("scope", F.col(f"scope{level}"))
        # each scope's wider one
        wider = None if level == 0 else cut_lineage(stats.groupBy(f"scope{level}").agg(F.min(f"scope{level - 1}").alias("wider")), "quality-scopes").withColumnRenamed(f"scope{level}", "of")
        rekeyed = lambda e: None if wider is None else e.join(wider, F.col("scope") == F.col("wider")).drop("scope", "wider").withColumnRenamed("of", "scope")  # noqa: E731, B023
        toward, toward_factor = rekeyed(estimate), rekeyed(factor)
        if wider is not None:
            toward, toward_factor = cut_lineage(toward, "quality-toward"), cut_lineage(toward_factor, "quality-toward")
        estimate = cut_lineage(start(at), "quality-estimate")
        for _ in range(STEPS):
            estimate = cut_lineage(step(at, estimate, toward), "quality-estimate")
        factor = cut_lineage(scale(at, estimate, toward_factor), "quality-scale")
    d = distances(at, estimate).join(factor, "scope").withColumn("d2", F.col("d2") / F.col("factor"))
    kept = ~F.col("base_failed") & (F.col("d2") <= chi2_quantile(COVERED, P))
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.sqrt("d2").alias("distance"), kept.alias("kept"))


def op2_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers(read(spark, sf_dir, "documents")).drop("lang", "source")
