"""Exploratory profiles.

Per-column statistics are computed as one wide aggregate (one job, one
partial-aggregation pass) and reshaped to long rows afterwards, or on an
unpivoted (feature, value) table grouped by feature, which spreads the work
over executors by feature and keeps everything JVM-side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import correlation_strength
from ..functions.rowwise import round_half_even, without_nan
from .ranking import exact_quantiles


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
            name: str = "feature", value: str = "value") -> DataFrame:
    return without_nan(df, cols).select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), name, value)


def describe(df: DataFrame, cols: Sequence[str], decimals: int = 1) -> DataFrame:
    """A2: count, mean, std (n-1), min, 25/50/75 % (exact, linear
    interpolation), max per column, rounded like the reference (1 dp)."""
    cols = list(cols)
    df = without_nan(df, cols)
    spark: SparkSession = df.sparkSession
    row = df.agg(*[e for i, c in enumerate(cols) for e in (
        F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
        F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = []
    for i, c in enumerate(cols):
        rows.append((c, float(row[f"n{i}"]), row[f"m{i}"], row[f"s{i}"],
                     None if row[f"lo{i}"] is None else float(row[f"lo{i}"]), *q[c],
                     None if row[f"hi{i}"] is None else float(row[f"hi{i}"])))
    out = spark.createDataFrame(rows, "feature string, count double, mean double, std double, min double, "
                                      "p25 double, p50 double, p75 double, max double")
    return out.select("feature", *[round_half_even(F.col(c), decimals).alias(c) for c in out.columns[1:]])


def mean_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A3: mean and exact median per column."""
    cols = list(cols)
    df = without_nan(df, cols)
    spark = df.sparkSession
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    q = exact_quantiles(df, cols, [0.5])
    return spark.createDataFrame([(c, row[f"m{i}"], q[c][0]) for i, c in enumerate(cols)],
                                 "feature string, mean double, median double")


def group_means(df: DataFrame, cols: Sequence[str], flag: str) -> DataFrame:
    """Per feature, mean for flag = 0 and flag = 1 and their difference."""
    long = unpivot(df, [flag], cols)
    return (long.groupBy("feature").agg(
        F.avg(F.when(F.col(flag) == 0, F.col("value"))).alias("mean_0"),
        F.avg(F.when(F.col(flag) == 1, F.col("value"))).alias("mean_1"))
        .withColumn("diff", F.col("mean_0") - F.col("mean_1")))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: pairwise-complete Pearson matrix as long rows (a, b, r).

    Each row emits one record per column pair where both values are present
    (a generator inside the codegen'd stage); one ``groupBy(a, b)`` with
    three aggregates, partially aggregated before the shuffle, then mirrors
    the upper triangle.  Zero variance gives null, not an error.
    """
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    x = [F.col(c).cast("double") for c in cols]
    recs = df.select(F.explode(F.array(*[
        F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), x[i].alias("x"), x[j].alias("y"))
        for i, j in pairs])).alias("p")).select("p.*").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    upper = recs.groupBy("a", "b").agg(
        F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))
    same = F.struct("a", "b", "r")
    mirrored = F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "r")
    both = F.when(F.col("a") == F.col("b"), F.array(same)).otherwise(F.array(same, mirrored))
    return upper.select(F.explode(both).alias("m")).select("m.*")


def corr_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """A11 / T1 base: per feature r and n with the target (pairwise complete)."""
    long = unpivot(df, [target], cols).filter(F.col("value").isNotNull() & F.col(target).isNotNull())
    y = F.col(target).cast("double")
    return long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.covar_pop("value", y), F.stddev_pop("value") * F.stddev_pop(y)).alias("r"))


def ranked_correlations(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """R with the target, strength class, rank by r descending."""
    c = corr_with_target(df, cols, target)
    return c.select("feature", "n", "r", correlation_strength("r").alias("strength"))


def residual_stats(df: DataFrame, residual: str = "residual") -> DataFrame:
    """Mean and population std of residuals."""
    return df.agg(F.avg(residual).alias("mean_residual"), F.stddev_pop(residual).alias("std_residual"),
                   F.count(residual).alias("n"))


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins between min and max (last bin right-closed),
    optionally per class; bins without rows have n = 0."""
    df = without_nan(df, [col])
    spark = df.sparkSession
    x = F.col(col).cast("double")
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = rng["lo"], rng["hi"]
    if lo is None:
        return spark.createDataFrame([], "bin int, bin_lo double, bin_hi double, n long")
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    keys = [by] if by else []
    counted = df.filter(x.isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # one row of zeros per class and bin, summed with the counts: no join
    every = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    zero = (counted.select(*keys).distinct() if by else spark.range(1)).select(*keys, every, F.lit(0).cast("long").alias("n"))
    g = counted.select(*keys, "bin", "n").union(zero).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    return g.select(*keys, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")

def trend_line(df: DataFrame, x: str, y: str, points: int = 100) -> DataFrame:
    """Least-squares line y = a + b x and its values on an evenly
    spaced grid of ``points`` x values from min(x) to max(x)."""
    fit = df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                 F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                 F.min(F.when(F.col(y).isNotNull(), F.col(x))).alias("lo"),
                 F.max(F.when(F.col(y).isNotNull(), F.col(x))).alias("hi"))
    grid = fit.select("slope", "intercept", "lo", "hi",
                      F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    gx = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    return grid.select("k", "slope", "intercept", gx.alias("x"),
                       (F.col("intercept") + F.col("slope") * gx).alias("y_hat"))


#: Bins of the density's linear binning.
KDE_BINS = 1 << 16


def kde_grid(df: DataFrame, col: str, gridsize: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE on an evenly spaced grid (Scott bandwidth
    n^(-1/5) * sample std; grid from min - cut*bw to max + cut*bw).

    Values are binned linearly on KDE_BINS + 1 points: each adds to the points
    on either side in proportion to its nearness, summed inside the tasks, so
    at most that many rows leave a task whatever the data; the kernel is then
    evaluated between the points.  A bin of width w changes the density by at
    most (w / bw)^2 / 8 of a kernel's peak, 1 / (bw sqrt(2 pi)).
    """
    x = F.col(col).cast("double")
    st = df.agg(F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("lo"),
                F.max(x).alias("hi")).first()
    n, sd = st["n"], st["sd"]
    if not n or not sd:
        return df.sparkSession.createDataFrame([], "k int, x double, density double")
    bw = sd * n ** (-0.2)
    g0, g1 = st["lo"] - cut * bw, st["hi"] + cut * bw
    step = (g1 - g0) / (gridsize - 1)
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    width = (st["hi"] - st["lo"]) / KDE_BINS
    place = (x - F.lit(st["lo"])) / F.lit(width)
    left = F.least(F.lit(KDE_BINS - 1), F.floor(place)).cast("int")
    near = df.filter(x.isNotNull()).select(left.alias("_i"), (place - left).alias("_s"))
    halves = F.array(F.struct(F.col("_i").alias("i"), (1 - F.col("_s")).alias("c")), F.struct((F.col("_i") + 1).alias("i"), F.col("_s").alias("c")))
    bins = near.select(F.explode(halves).alias("h")).groupBy("h.i").agg(F.sum("h.c").alias("_c"))
    vals = bins.select((F.lit(st["lo"]) + F.col("i") * F.lit(width)).alias("_v"), "_c")
    contrib = vals.select(F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(gridsize - 1)),
        lambda k: F.col("_c") * F.exp(-F.pow((F.lit(g0) + k * F.lit(step) - F.col("_v")) / F.lit(bw), 2) / 2))).alias("k", "w"))
    return contrib.groupBy("k").agg(F.sum("w").alias("s")).select(
        F.col("k").cast("int").alias("k"), (F.lit(g0) + F.col("k") * F.lit(step)).alias("x"),
        (F.col("s") * F.lit(norm)).alias("density"))
