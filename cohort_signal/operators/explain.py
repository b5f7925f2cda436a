"""Model explanation.

For a linear model everything is closed-form over one aggregate:
coefficients (E1), the expected R^2 drop under a random permutation of one
feature (E2), and additive attributions coef * (x - background mean) (E3).
A sampled permutation variant pairs numbered rows by a keyed permutation of
their numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import coefficient_sign
from ..session import cut_lineage
from .linear import LinearFit

#: Rounds of the permutation's network, and how often it may be stepped again.
FEISTEL_ROUNDS = 6
FEISTEL_STEPS = 64


def coefficients(spark: SparkSession, fit: LinearFit) -> DataFrame:
    """E1 + F20 + W4: standardised coefficient, |coef|, sign, rank."""
    df = spark.createDataFrame(fit.coefficient_rows(), "feature string, coef double")
    return ranked(df.select("feature", "coef", F.abs("coef").alias("abs_coef"), coefficient_sign("coef").alias("sign")), "abs_coef")


def ranked(df: DataFrame, by: str) -> DataFrame:
    """A table of one row per feature with its rank by a column, largest first."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.col(by).desc(), "feature")
    return df.withColumn("rank", F.row_number().over(w))


def permutation_importance(df: DataFrame, fit: LinearFit, target: str) -> DataFrame:
    """E2 (closed form): expected R^2 drop when feature j is randomly permuted
    = (2 b_j n cov_pop(e, x_j) + 2 b_j^2 n var_pop(x_j)) / SST, with raw-scale
    coefficient b_j and residual e of ``fit`` on ``df``.  One aggregate."""
    e = F.col(target) - fit.predict()
    feats = fit.features
    aggs = [F.count(F.lit(1)).alias("n"), F.var_pop(target).alias("vy")]
    for i, c in enumerate(feats):
        aggs += [F.covar_pop(e, F.col(c)).alias(f"ce{i}"), F.var_pop(F.col(c)).alias(f"vx{i}")]
    row = df.agg(*aggs)
    items = []
    for i, (c, b) in enumerate(zip(feats, fit.raw_coef)):
        bj = F.lit(float(b))
        drop = F.try_divide(F.lit(2.0) * bj * F.col(f"ce{i}") + F.lit(2.0) * bj * bj * F.col(f"vx{i}"), F.col("vy"))
        items.append(F.struct(F.lit(c).alias("feature"), drop.alias("importance")))
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def positions(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` with ``_pos``, a number from 0 to n - 1 for each row, and n.  The
    rows are written once, then numbered within their partition behind the
    rows of the partitions before, whose sizes are a table of one row each."""
    rows = cut_lineage(df).withColumn("_at", F.monotonically_increasing_id())
    sizes = [(r["p"], r["n"]) for r in rows.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()]
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    side = df.sparkSession.createDataFrame(starts, "_p long, _start long")
    numbered = rows.withColumn("_p", F.shiftright("_at", 33)).join(F.broadcast(side), "_p")
    return numbered.withColumn("_pos", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_start"), total


def permuted(pos: Column, repeat: Column, n: int, seed: int) -> Column:
    """The place of ``pos`` in a keyed permutation of 0 to n - 1: a Feistel
    network on quotient and remainder by the root of n, stepped again while
    the result lies beyond n (the surplus of the square is below the root of n,
    so this ends after a step or two; FEISTEL_STEPS is never the end but for
    a chance of n^(-FEISTEL_STEPS / 2))."""
    b = max(1, math.isqrt(max(n - 1, 0)) + 1)
    a = max(1, -(-n // b))

    def network(v: Column) -> Column:
        left, right = F.floor(v / b).cast("long"), F.pmod(v, F.lit(b))
        for r in range(FEISTEL_ROUNDS):
            if r % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), repeat, F.lit(r), right), F.lit(a)), F.lit(a))
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), repeat, F.lit(r), left), F.lit(b)), F.lit(b))
        return left * b + right

    steps = F.sequence(F.lit(1), F.lit(min(FEISTEL_STEPS, a * b - n + 1)))
    return F.aggregate(steps, F.lit(-1).cast("long"), lambda v, i: F.when((v >= 0) & (v < n), v).otherwise(network(F.when(i == 1, pos).otherwise(v))))


def permutation_importance_sampled(df: DataFrame, fit: LinearFit, target: str, key: str,
                                   repeats: int = 30, seed: int = 42) -> DataFrame:
    """E2 (sampled): mean R^2 drop over ``repeats`` random permutations per
    feature.  Rows are numbered once; a repeat pairs row i with the row at the
    permuted number, computed on the spot, so the one exchange of the repeats
    is the join with the partners' features.  For a linear model, swapping
    feature c changes the prediction by b_c * (donor_c - x_c), so every
    (feature, repeat) SSE comes out of one aggregate."""
    feats = fit.features
    base, n = positions(df.select((F.col(target) - fit.predict()).alias("_e"), F.col(target).alias("_y"), *feats))
    if not n:
        return df.sparkSession.createDataFrame([], "feature string, importance double")
    own = base.select("_pos", "_e", *feats, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    own = own.withColumn("_src", permuted(F.col("_pos"), F.col("rep"), n, seed))
    donor = base.select(F.col("_pos").alias("_src"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(feats)])
    errors = [F.col("_e") - F.lit(float(b)) * (F.col(f"_d{i}") - F.col(c)) for i, (c, b) in enumerate(zip(feats, fit.raw_coef))]
    sse = own.join(donor, "_src").agg(*[F.sum(e * e).alias(f"s{i}") for i, e in enumerate(errors)])
    total = base.agg((F.var_pop("_y") * F.count(F.lit(1))).alias("sst"), F.sum(F.col("_e") * F.col("_e")).alias("sse0"))
    drop = [F.struct(F.lit(c).alias("feature"), F.try_divide(F.col(f"s{i}") / repeats - F.col("sse0"), F.col("sst")).alias("importance")) for i, c in enumerate(feats)]
    return sse.crossJoin(F.broadcast(total)).select(F.explode(F.array(*drop)).alias("x")).select("x.*")


def attributions(df: DataFrame, fit: LinearFit, key: str) -> DataFrame:
    """Per entity and feature coef_raw * (x - mean over ``df``) (the
    background is the scored rows themselves); their sum equals
    prediction - mean prediction."""
    feats = fit.features
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(feats)]).first()
    items = [F.struct(F.lit(c).alias("feature"),
                      (F.lit(float(b)) * (F.col(c) - F.lit(float(means[f"m{i}"])))).alias("attribution"))
             for i, (c, b) in enumerate(zip(feats, fit.raw_coef))]
    return df.select(key, F.explode(F.array(*items)).alias("x")).select(key, "x.*")


def combined_importance(coefs: DataFrame, perm: DataFrame) -> DataFrame:
    """E5: coefficient and permutation importance side by side."""
    return coefs.select("feature", "coef", "abs_coef").join(perm, "feature", "full")


def top_features(coefs: DataFrame, n: int, by: str = "abs_coef") -> DataFrame:
    """Top n features by |coef| (or any importance column)."""
    return coefs.orderBy(F.col(by).desc(), "feature").limit(n)
