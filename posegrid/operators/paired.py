"""Paired tests, per key: sums by Spark, tail probabilities by a small helper over one row per key."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import avg_rank

#: Up to this many pairs without ties the distribution of the rank sum is counted out.
EXACT_PAIRS = 50


def _rank_sum_tail(w: int, n: int) -> float:
    """P(W >= w) for the sum of positive ranks of n signs."""
    counts = [1] + [0] * (n * (n + 1) // 2)
    for r in range(1, n + 1):
        for s in range(len(counts) - 1, r - 1, -1):
            counts[s] += counts[s - r]
    return sum(counts[w:]) / 2**n


def wilcoxon(df: DataFrame, before: str, after: str, keys: list[str]) -> DataFrame:
    """Signed-rank test that ``after`` is greater: (keys, n, w, p). Zero differences are dropped; ties share ranks."""
    moved = df.withColumn("_d", F.col(after) - F.col(before)).filter("_d <> 0").withColumn("_a", F.abs("_d"))
    ranked = avg_rank(moved, "_a", tuple(keys))
    ties = ranked.groupBy(*keys, "_a").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum(F.expr("t * t * t - t")).alias("ties"))
    sums = ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("rank")).otherwise(0.0)).alias("w"))

    @F.pandas_udf("double")
    def tail(n: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for k, s, t in zip(n, w, ties):
            if t == 0 and k <= EXACT_PAIRS:
                out.append(_rank_sum_tail(round(s), int(k)))
            else:
                var = k * (k + 1) * (2 * k + 1) / 24 - t / 48
                out.append(math.erfc((s - k * (k + 1) / 4) / math.sqrt(2 * var)) / 2)
        return pd.Series(out)

    return sums.join(ties, keys).select(*keys, "n", "w", tail("n", "w", "ties").alias("p"))


def _t_tail(t: float, df: float) -> float:
    """P(T > t) by Simpson's rule on the angle of the density."""
    if df <= 0 or math.isnan(t):
        return math.nan
    top, steps = math.pi / 2, 2000
    low = math.atan(t / math.sqrt(df))
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(math.pi)
    h = (top - low) / steps
    area = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * math.cos(low + i * h) ** (df - 1) for i in range(steps + 1))
    return scale * area * h / 3


def cv_ttest(df: DataFrame, difference: str, keys: list[str], test_share: float) -> DataFrame:
    """Corrected t-test over repeated cross-validation runs: variance grows by n_test / n_train; one-sided."""
    stats = df.groupBy(*keys).agg(F.count(difference).alias("runs"), F.avg(difference).alias("mean"), F.var_samp(difference).alias("var"))
    t = F.try_divide(F.col("mean"), F.sqrt(F.col("var") * (1 / F.col("runs") + test_share)))

    @F.pandas_udf("double")
    def tail(t: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([_t_tail(a, n - 1) for a, n in zip(t, runs)])

    return stats.withColumn("t", t).withColumn("p", tail("t", "runs"))
