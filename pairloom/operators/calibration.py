"""Calibrators: scores to shares of 1."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores as S

#: Ranges that values are dealt out by, so that no task counts more than a range of them.
RANGES = 1024


def not_above(counts: DataFrame, value: str, n: str = "n") -> DataFrame:
    """(value, n, upto): running totals of ``n`` by value, within ranges first and over their few sums then."""
    ends = counts.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    share = (F.col(value) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0))
    dealt = counts.crossJoin(F.broadcast(ends)).withColumn("range", F.coalesce(F.least(F.lit(RANGES - 1), F.floor(share * RANGES)), F.lit(0)))
    sums = dealt.groupBy("range").agg(F.sum(n).alias("own"))
    sums = sums.select("range", (F.sum("own").over(W.orderBy("range")) - F.col("own")).alias("before"))
    within = F.sum(n).over(W.partitionBy("range").orderBy(value))
    return dealt.withColumn("within", within).join(F.broadcast(sums), "range").select(value, n, (F.col("before") + F.col("within")).alias("upto"))


class IdentityCalibrator:
    """Scores as they are, between 0 and 1."""

    def fit(self, df: DataFrame, column: str) -> IdentityCalibrator:
        return self

    def predict(self, df: DataFrame, column: str, out: str = "calibrated") -> DataFrame:
        return df.withColumn(out, S.clip(F.col(column).cast("double")))


class QuantileCalibrator:
    """The share of the fitted scores that are not above a score; null for a null score."""

    def __init__(self) -> None:
        self._fitted: DataFrame | None = None

    def fit(self, df: DataFrame, column: str) -> QuantileCalibrator:
        counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("n"))
        if counts.isEmpty():
            raise ValueError("no scores to fit")
        self._fitted = counts
        return self

    def predict(self, df: DataFrame, column: str, out: str = "calibrated") -> DataFrame:
        if self._fitted is None:
            raise ValueError("fit the calibrator first")
        asked = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("value")).distinct()
        both = self._fitted.unionByName(asked.withColumn("n", F.lit(0).cast("long"))).groupBy("value").agg(F.sum("n").alias("n"))
        total = self._fitted.agg(F.sum("n").alias("total"))
        shares = not_above(both, "value").crossJoin(F.broadcast(total)).select(F.col("value").alias("_value"), (F.col("upto") / F.col("total")).alias(out))
        return df.join(shares, F.col(column).cast("double") == F.col("_value"), "left").drop("_value")
