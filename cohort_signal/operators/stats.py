"""Hypothesis tests and intervals.

Every test is an aggregate over an unpivoted (feature, value, ...) table
grouped by feature, followed by column arithmetic; tails come from
``functions.tails``, so the p-values are computed on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import effect_direction, significance_stars
from ..functions.tails import normal_two_sided_p, t_two_sided_p
from .profile import corr_with_target, unpivot

Z95 = 1.96


def r_to_t(r: Column, n: Column) -> Column:
    """t statistic of a Pearson r with n pairs (df = n - 2)."""
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), F.lit(1.0) - r * r))


def pearson_tests(df: DataFrame, cols: Sequence[str], target: str, min_pairs: int = 0,
                  not_significant: str = "ns") -> DataFrame:
    """Per feature r, n, t, p (two-sided), stars; features with
    ``n <= min_pairs`` are skipped."""
    c = corr_with_target(df, cols, target).filter(F.col("n") > min_pairs)
    t = r_to_t(F.col("r"), F.col("n"))
    out = c.withColumn("t", t).withColumn("p", t_two_sided_p(F.col("t"), F.col("n") - 2))
    return out.withColumn("stars", significance_stars("p", not_significant))


def fisher_ci(r: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """95 % interval of r via Fisher z, se = 1/sqrt(n - 3)."""
    zr = F.atanh(r)
    se = F.lit(1.0) / F.sqrt((n - 3).cast("double"))
    return F.tanh(zr - F.lit(z) * se), F.tanh(zr + F.lit(z) * se)


def with_fisher_ci(tests: DataFrame) -> DataFrame:
    lo, hi = fisher_ci(F.col("r"), F.col("n"))
    return tests.withColumns({"z": F.atanh("r"), "ci_low": lo, "ci_high": hi})


def fisher_compare(tests: DataFrame) -> DataFrame:
    """Is the strongest |r| different from the second strongest
    (treated as independent, n of the strongest)?  Works on the tiny
    per-feature result: rank by |r| with a window over those rows only."""
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(1)).orderBy(F.abs(F.col("r")).desc(), F.col("feature"))
    top = tests.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= 2)
    pair = top.agg(
        F.max(F.when(F.col("_rk") == 1, F.col("feature"))).alias("top1"),
        F.max(F.when(F.col("_rk") == 2, F.col("feature"))).alias("top2"),
        F.max(F.when(F.col("_rk") == 1, F.col("r"))).alias("r1"),
        F.max(F.when(F.col("_rk") == 2, F.col("r"))).alias("r2"),
        F.max(F.when(F.col("_rk") == 1, F.col("n"))).alias("n1"))
    zd = (F.atanh("r1") - F.atanh("r2")) / F.sqrt(F.lit(2.0) / (F.col("n1") - 3).cast("double"))
    return pair.withColumn("z_diff", zd).withColumn("p_diff", normal_two_sided_p(F.col("z_diff")))


def two_sample_t(df: DataFrame, cols: Sequence[str], flag: str, min_group: int = 5,
                 not_significant: str = "ns") -> DataFrame:
    """T4: pooled-variance two-sample t-test of group 0 vs group 1 per
    feature (both groups larger than ``min_group``)."""
    long = unpivot(df, [flag], cols).filter(F.col("value").isNotNull() & F.col(flag).isNotNull())
    g0, g1 = F.col(flag) == 0, F.col(flag) == 1
    s = long.groupBy("feature").agg(
        F.count_if(g0).alias("n0"), F.count_if(g1).alias("n1"),
        F.avg(F.when(g0, F.col("value"))).alias("mean_0"), F.avg(F.when(g1, F.col("value"))).alias("mean_1"),
        F.var_samp(F.when(g0, F.col("value"))).alias("v0"), F.var_samp(F.when(g1, F.col("value"))).alias("v1"))
    s = s.filter((F.col("n0") > min_group) & (F.col("n1") > min_group))
    dof = F.col("n0") + F.col("n1") - 2
    sp2 = ((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1")) / dof
    t = F.try_divide(F.col("mean_0") - F.col("mean_1"),
                     F.sqrt(sp2 * (F.lit(1.0) / F.col("n0") + F.lit(1.0) / F.col("n1"))))
    return (s.withColumn("diff", F.col("mean_0") - F.col("mean_1")).withColumn("t", t)
            .withColumn("p", t_two_sided_p(F.col("t"), dof))
            .withColumn("stars", significance_stars("p", not_significant))
            .drop("v0", "v1"))


def one_sample_t(df: DataFrame, col: str, mu: float = 0.0) -> DataFrame:
    """T5: one-sample t-test of mean(col) against ``mu``, with the share of
    positive and non-positive values."""
    x = F.col(col)
    s = df.filter(x.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"),
        F.stddev_samp(x).alias("sd"), F.count_if(x > 0).alias("n_improved"),
        F.count_if(x <= 0).alias("n_not_improved"))
    t = F.try_divide(F.col("mean") - F.lit(mu), F.col("sd") / F.sqrt(F.col("n").cast("double")))
    return s.withColumn("t", t).withColumn("p", t_two_sided_p(F.col("t"), F.col("n") - 1))


def mean_ci(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean +- 1.96 * std(ddof 0) / sqrt(k) over k scores."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    s = g.agg(F.count(col).alias("k"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))
    half = F.lit(Z95) * F.col("std") / F.sqrt(F.col("k").cast("double"))
    return s.withColumns({"ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half})


def count_significant(tests: DataFrame, alpha: float = 0.001) -> DataFrame:
    """Number of features with p below ``alpha`` and mean |r|."""
    return tests.agg(F.count(F.lit(1)).alias("n_features"),
                     F.count_if(F.col("p") < alpha).alias("n_significant"),
                     F.avg(F.abs("r")).alias("mean_abs_r"))


def worst_case(mae_mean: Column, mae_std: Column) -> Column:
    """Mean MAE + 2 std."""
    return mae_mean + F.lit(2.0) * mae_std


def direction_table(tests: DataFrame) -> DataFrame:
    """F14 on a test table."""
    return tests.withColumn("direction", effect_direction("r"))
