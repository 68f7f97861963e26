"""Labelling samples, pseudo-labels and evaluation metrics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .calibration import QuantileCalibrator, not_above
from .curation import seeded
from .ranks import order_statistics, quantiles_of, ranked, value_counts

#: Most terms of the continued fraction of a p-value.
_TERMS = 10_000


def pseudo_labels(df: DataFrame, group: str, key: str, score: str, spread: str) -> DataFrame:
    """good from rank share 0.8, average from 0.4, else bad; uncertain where the methods disagree most (upper quarter).

    Ranks are by score, then key; a row without a score has no rank and is bad.
    """
    bound = order_statistics(df, [spread], [0.75]).select(F.col("q0").alias("_q75"))
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count(score).alias("_size"))
    r = ranked(df, [group], score, key, "_rank").join(sizes, F.col(group).eqNullSafe(F.col("_group"))).withColumn("rank_share", F.col("_rank") / F.col("_size"))
    r = r.drop("_rank", "_size", "_group").crossJoin(F.broadcast(bound))
    share = F.col("rank_share")
    label = F.when((share >= 0.3) & (share < 0.8) & (F.col(spread) >= F.col("_q75")), "uncertain").when(share >= 0.8, "good").when(share >= 0.4, "average").otherwise("bad")
    return r.withColumn("pseudo_label", label).drop("_q75")


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """(name, n, mean, std, min, p25, p50, p75, max): one row for each of these numeric columns; std is the sample's.

    ``df`` is computed once: all follows from its distinct values and how often they occur.
    """
    counts = value_counts(df, list(columns))
    means = counts.groupBy("name").agg(F.sum("c").alias("_n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    apart = F.col("v") - F.col("mean")
    moments = counts.join(F.broadcast(means), "name").groupBy("name", "mean", "_n").agg(F.sum(apart * apart * F.col("c")).alias("_s"))
    moments = moments.select("name", "mean", F.when(F.col("_n") > 1, F.sqrt(F.col("_s") / (F.col("_n") - 1))).alias("std"))
    at = quantiles_of(counts, list(columns), [0.25, 0.5, 0.75])
    return at.join(moments, "name", "left").select("name", "n", "mean", "std", F.col("low").alias("min"), F.col("q0").alias("p25"), F.col("q1").alias("p50"), F.col("q2").alias("p75"), F.col("high").alias("max"))


def stratified_sample(df: DataFrame, bucket: str, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows, an equal share of every bucket by seeded order, filled up from the rest."""
    buckets = df.agg(F.count_distinct(bucket).alias("_b"))
    rn = F.row_number().over(W.partitionBy(bucket).orderBy(seeded(seed, *keys), *keys))
    ranked = df.withColumn("_rn", rn).crossJoin(F.broadcast(buckets)).withColumn("_own", F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_b"))))
    return ranked.orderBy(F.desc("_own"), seeded(seed, *keys), *keys).limit(n).drop("_rn", "_b", "_own")


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy and macro precision, recall and F1 over the labels of either side; 0 where undefined."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    true = cells.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("actual"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    z = lambda c: F.coalesce(c, F.lit(0))
    per = true.join(said, "label", "full").select(z("hit").alias("hit"), z("actual").alias("actual"), z("said").alias("said"))
    per = per.withColumn("p", F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0)).withColumn("r", F.when(F.col("actual") > 0, F.col("hit") / F.col("actual")).otherwise(0.0))
    per = per.withColumn("f", F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0))
    return per.agg(F.round(F.sum("hit") / F.sum("actual"), 6).alias("accuracy"), F.round(F.avg("p"), 6).alias("macro_precision"), F.round(F.avg("r"), 6).alias("macro_recall"), F.round(F.avg("f"), 6).alias("macro_f1"))


def _log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive numbers, by Stirling's series from x + 8 on."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    shifted = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series
    return shifted - sum((F.ln(x + k) for k in range(1, 8)), F.ln(x))


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function for x below (a + 1) / (a + b + 2), by its continued fraction."""
    tiny = F.lit(1e-300)
    one = F.lit(1.0)
    some = lambda v: F.when(v == 0, tiny).otherwise(v)

    def step(s, i):
        m = F.floor(i / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        k = F.when(i == 0, one).when(i % 2 == 0, even).otherwise(odd)
        d = 1 / some(1 + k * s["d"])
        c = some(1 + k / s["c"])
        done = s["done"] | ((i > 0) & (F.abs(c * d - 1) < 1e-15))
        keep = lambda new, old: F.when(s["done"], s[old]).otherwise(new).alias(old)
        return F.struct(keep(c, "c"), keep(d, "d"), keep(s["t"] * c * d, "t"), done.alias("done"))

    start = F.struct(one.alias("c"), F.lit(0.0).alias("d"), one.alias("t"), F.lit(False).alias("done"))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(_TERMS)), start, step, lambda s: s["t"])
    front = F.exp(a * F.ln(x) + b * F.log1p(-x) + _log_gamma(a + b) - _log_gamma(a) - _log_gamma(b))
    return front * (total - 1) / a


def correlation_p_value(rho: Column, n: Column) -> Column:
    """Two-sided p-value of a rank correlation of ``n`` rows, by Student's t with n - 2 degrees; 1 where undefined.

    It is the incomplete beta function of 1 - rho squared with (n - 2) / 2 and 1 / 2.
    """
    x = F.greatest(F.lit(0.0), 1 - rho * rho)
    a, b = (n - 2) / 2.0, F.lit(0.5)
    inner = F.when(x >= (a + 1) / (a + b + 2), 1 - _beta_fraction(1 - x, b, a)).otherwise(_beta_fraction(x, a, b))
    return F.when((n < 3) | rho.isNull() | F.isnan(rho), 1.0).when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner)))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman, p_value): rank correlation with average ranks, from per-value counts; 0 and 1 where undefined.

    Rows without one of the two values do not count.
    """
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def ranks(c):
        counts = df.groupBy(c).agg(F.count("*").alias("n"))
        return not_above(counts, c).select(c, (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias(f"rank_{c}"))

    both = df.join(ranks(x), x).join(ranks(y), y)
    spread = F.stddev_pop(f"rank_{x}") * F.stddev_pop(f"rank_{y}")
    one = both.agg(F.covar_pop(f"rank_{x}", f"rank_{y}").alias("cov"), spread.alias("spread"), F.count("*").alias("n"))
    rho = F.when(F.col("spread") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide("cov", "spread"))))
    one = one.select(rho.alias("rho"), "n")
    return one.select(F.coalesce(F.round("rho", 6), F.lit(0.0)).alias("spearman"), correlation_p_value(F.col("rho"), F.col("n")).alias("p_value"))


def judged(predictions: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions with their labels, by key; ValueError if no row has one (one row is read to tell)."""
    both = predictions.join(labels, keys)
    if both.isEmpty():
        raise ValueError("no prediction has a label")
    return both


def largest_disagreements(df: DataFrame, score: str, keys: list[str], n: int = 25, human_score: str = "human_score", human_label: str = "human_label") -> DataFrame:
    """The n rows with the largest absolute_error of a score from the human score, or else from the label as a share of the highest one.

    Ties by key; rows without an error come last.
    """
    if human_score in df.columns:
        error = df.withColumn("absolute_error", F.abs(F.col(score) - F.col(human_score)))
    else:
        most = df.agg(F.greatest(F.lit(1), F.max(human_label)).alias("_most"))
        error = df.crossJoin(F.broadcast(most)).withColumn("absolute_error", F.abs(F.col(score) - F.col(human_label) / F.col("_most"))).drop("_most")
    return error.orderBy(F.col("absolute_error").desc_nulls_last(), *keys).limit(n)


def ranking(df: DataFrame, group: str, score: str, relevance: str, key: str, k: int) -> DataFrame:
    """Means over groups of precision, recall, nDCG (ideal of the retrieved k) and reciprocal rank at k; relevant from 1."""
    w = W.partitionBy(group)
    top = df.withColumn("_all", F.sum((F.col(relevance) > 0).cast("int")).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.desc(score), key))).filter(F.col("_rn") <= k)
    top = top.withColumn("_best", F.row_number().over(w.orderBy(F.desc(relevance), "_rn")))
    gain = F.pow(F.lit(2.0), F.col(relevance)) - 1
    per = top.groupBy(group).agg(
        (F.sum((F.col(relevance) > 0).cast("int")) / F.count("*")).alias("p"), (F.sum((F.col(relevance) > 0).cast("int")) / F.greatest(F.lit(1), F.max("_all"))).alias("r"),
        F.sum(gain / F.log2(F.col("_rn") + 1)).alias("dcg"), F.sum(gain / F.log2(F.col("_best") + 1)).alias("ideal"), F.coalesce(1 / F.min(F.when(F.col(relevance) > 0, F.col("_rn"))), F.lit(0.0)).alias("rr"),
    )
    return per.agg(F.round(F.avg("p"), 6).alias("precision_at_k"), F.round(F.avg("r"), 6).alias("recall_at_k"), F.round(F.avg(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0)), 6).alias("ndcg_at_k"), F.round(F.avg("rr"), 6).alias("mrr"))


def quantile_calibration(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the share of values not above each value."""
    return QuantileCalibrator().fit(df, column).predict(df, column)
