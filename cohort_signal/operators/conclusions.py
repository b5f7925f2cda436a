"""Evidence and conclusions of a cohort analysis.

The evidence table holds every statistic a conclusion rests on, one row each,
with its interval, p-value and count; the conclusions table grades seven claims
by fixed rules over that table.  Both are built from result tables of a few
rows; nothing is stated that was not computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import Z95, count_significant, fisher_ci, fisher_compare, worst_case

COLUMNS = "statistic string, subject string, value double, ci_low double, ci_high double, p double, n long"


def _row(df: DataFrame, statistic: str, subject: Column, value: Column | None = None, low: Column | None = None,
         high: Column | None = None, p: Column | None = None, n: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(F.lit(statistic).alias("statistic"), subject.alias("subject"),
                     *[(none if c is None else c.cast("double")).alias(a) for a, c in (("value", value), ("ci_low", low), ("ci_high", high), ("p", p))],
                     (F.lit(None) if n is None else n).cast("long").alias("n"))


def evidence(tests: DataFrame, model: DataFrame, early: DataFrame, model_name: str, early_name: str) -> DataFrame:
    """Statistic rows from the correlation tests of the features (T1), the
    cross-validation summary of the model and that of the early model (T6):
    counts and mean |r| (T9), strongest and weakest r with intervals (T2), the
    test of the strongest against the second (T3), R^2 of both models, mean
    and worst-case error (T10)."""
    by_size = Window.partitionBy(F.lit(1))  # one row per feature
    ranked = tests.withColumns({"_top": F.row_number().over(by_size.orderBy(F.abs("r").desc(), "feature")),
                                "_low": F.row_number().over(by_size.orderBy(F.abs("r").asc(), F.col("feature").desc()))})
    low, high = fisher_ci(F.col("r"), F.col("n"))
    counts = count_significant(tests)
    half = F.lit(Z95) * F.col("mae_std") / F.sqrt(F.col("n_folds").cast("double"))
    rows = [
        _row(counts, "tested_correlations", F.lit("features"), n=F.col("n_features")),
        _row(counts, "significant_correlations", F.lit("features"), F.col("mean_abs_r"), n=F.col("n_significant")),
        _row(ranked.filter("_top = 1"), "strongest_r", F.col("feature"), F.col("r"), low, high, F.col("p"), F.col("n")),
        _row(fisher_compare(tests), "strongest_vs_second", F.col("top2"), F.col("z_diff"), p=F.col("p_diff"), n=F.col("n1")),
        _row(ranked.filter("_low = 1"), "weakest_r", F.col("feature"), F.col("r"), low, high, F.col("p"), F.col("n")),
        _row(model, "model_r2", F.lit(model_name), F.col("r2_mean"), F.col("r2_ci_low"), F.col("r2_ci_high"), n=F.col("n_folds")),
        _row(early, "early_r2", F.lit(early_name), F.col("r2_mean"), F.col("r2_ci_low"), F.col("r2_ci_high"), n=F.col("n_folds")),
        _row(model, "model_mae", F.lit(model_name), F.col("mae_mean"), F.col("mae_mean") - half, F.col("mae_mean") + half, n=F.col("n_folds")),
        _row(model, "worst_case_error", F.lit(model_name), worst_case(F.col("mae_mean"), F.col("mae_std")), n=F.col("n_folds")),
    ]
    return reduce(DataFrame.unionByName, rows)


def conclusions(table: DataFrame) -> DataFrame:
    """Seven graded claims: claim_no, claim, subject, confidence, value,
    ci_low, ci_high, p.  A claim whose statistic is missing is left out, one
    that cannot be graded has no confidence."""
    def of(statistic: str, column: str) -> Column:
        return F.max(F.when(F.col("statistic") == statistic, F.col(column)))

    wide = table.agg(of("tested_correlations", "n").alias("tested"), of("significant_correlations", "n").alias("significant"),
                     of("strongest_r", "ci_low").alias("top_low"), of("strongest_r", "ci_high").alias("top_high"))
    low, high, n = F.col("ci_low"), F.col("ci_high"), F.col("significant")
    top_least = F.least(F.abs("top_low"), F.abs("top_high"))
    grades = {
        "significant_correlations": (1, "features_relate_to_outcome", F.when((n == F.col("tested")) & (n > 0), "VERY HIGH").when(n > 0, "MODERATE").when(n.isNotNull(), "LOW")),
        "strongest_r": (2, "among_the_strongest", F.when(low * high > 0, "HIGH").when(low.isNotNull(), "LOW")),
        "strongest_vs_second": (3, "strongest_of_all", F.when(F.col("p") < 0.05, "HIGH").when(F.col("p").isNotNull(), "MODERATE")),
        "weakest_r": (4, "weakest_of_all", F.when((F.col("top_low") * F.col("top_high") > 0) & (F.greatest(F.abs(low), F.abs(high)) < top_least), "HIGH")
                      .when(low.isNotNull(), "MODERATE")),
        "model_r2": (5, "model_explains_outcome", F.when(low > 0, "HIGH").when(low.isNotNull(), "LOW")),
        "early_r2": (6, "early_warning_works", F.when(low > 0.15, "HIGH").when(low.isNotNull(), "MODERATE")),
        "model_mae": (7, "error_is_known", F.when(high - low < F.lit(0.2) * F.col("value"), "HIGH").when(low.isNotNull(), "MODERATE")),
    }

    def pick(i: int) -> Column:
        out = F.lit(None)
        for statistic, g in grades.items():
            out = F.when(F.col("statistic") == statistic, F.lit(g[i]) if i < 2 else g[i]).otherwise(out)
        return out

    return (table.filter(F.col("statistic").isin(list(grades))).crossJoin(F.broadcast(wide))
            .select(pick(0).cast("int").alias("claim_no"), pick(1).alias("claim"), "subject", pick(2).alias("confidence"), "value", "ci_low", "ci_high", "p")
            .orderBy("claim_no"))
