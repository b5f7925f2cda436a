"""Model evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import overfit_flag


def regression_metrics(pred: DataFrame, label: str, prediction: str,
                       keys: Sequence[str] = ()) -> DataFrame:
    """M7: MAE, RMSE and R^2 per key group (e.g. model x split), one job."""
    e = F.col(label).cast("double") - F.col(prediction).cast("double")
    g = pred.groupBy(*keys) if keys else pred.groupBy()
    return g.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(F.col(label).cast("double")) * F.count(F.lit(1))))
        .alias("r2"))


def metrics_wide(long: DataFrame, model_col: str = "model", split_col: str = "split") -> DataFrame:
    """M7 layout: one row per model with train_/test_ metrics, the R^2 gap
    and the overfit flag (F17)."""
    aggs = []
    for split in ("train", "test"):
        for m in ("mae", "rmse", "r2"):
            aggs.append(F.max(F.when(F.col(split_col) == split, F.col(m))).alias(f"{split}_{m}"))
    w = long.groupBy(model_col).agg(*aggs)
    return w.withColumns({"r2_gap": F.col("train_r2") - F.col("test_r2"),
                          "overfit": overfit_flag("train_r2", "test_r2")})


def best_model(metrics: DataFrame, metric: str = "test_r2", model_col: str = "model") -> DataFrame:
    """The model with the highest metric (ties: first name)."""
    return metrics.agg(F.min_by(F.col(model_col), F.struct(-F.col(metric), F.col(model_col))).alias("best_model"),
                       F.max(metric).alias(f"best_{metric}"))


def confusion(pred: DataFrame, actual: str, predicted: str, threshold: float) -> DataFrame:
    """pass/fail confusion cells with accuracy, the failure catch rate
    tn/(tn+fp) and the pass recall tp/(tp+fn) (null when undefined)."""
    pp = F.col(predicted) >= threshold
    ap = F.col(actual) >= threshold
    s = pred.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(
        F.count_if(pp & ap).alias("tp"), F.count_if(~pp & ~ap).alias("tn"),
        F.count_if(pp & ~ap).alias("fp"), F.count_if(~pp & ap).alias("fn"))
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return s.withColumns({
        "accuracy": F.try_divide((F.col("tp") + F.col("tn")).cast("double"), total.cast("double")),
        "fail_catch_rate": F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp")).cast("double")),
        "pass_recall": F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")),
    })


def accuracy(pred: DataFrame, label: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows with predicted == label."""
    g = pred.groupBy(*keys) if keys else pred.groupBy()
    return g.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def first_checkpoint(results: DataFrame, level: float, r2_col: str = "r2_mean") -> DataFrame:
    """First checkpoint (by order) whose R^2 exceeds ``level``."""
    return results.filter(F.col(r2_col) > level).agg(
        F.min_by("checkpoint", "course_num").alias("checkpoint"), F.min("course_num").alias("course_num"))


def residuals(pred: DataFrame, label: str, prediction: str) -> Column:
    """E6."""
    return (F.col(label) - F.col(prediction)).alias("residual")
