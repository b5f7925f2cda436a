"""Risk flagging, tiers and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.labels import RISK_TIERS, risk_tier
from ..functions.rowwise import round_half_even

KEY = "entity_id"


def rounded_prediction(pred: Column) -> Column:
    """half-to-even rounding to an integer."""
    return F.rint(pred).cast("int")


def flag_at_risk(pred_df: DataFrame, threshold: float, pred_col: str = "predicted") -> DataFrame:
    """threshold, risk_score = round((T - pred) / T, 3), at_risk = pred < T."""
    p = F.col(pred_col)
    t = F.lit(float(threshold))
    return pred_df.withColumns({
        "threshold": t,
        "risk_score": round_half_even((t - p) / t, 3),
        "at_risk": p < t,
    })


def sort_by_risk(df: DataFrame, key: str = KEY) -> DataFrame:
    """O1: highest risk first; the key breaks ties so the order is total."""
    return df.orderBy(F.col("risk_score").desc(), F.col(key).asc())


def top_at_risk(df: DataFrame, n: int = 10, key: str = KEY) -> DataFrame:
    """O2: top n flagged entities (a take-ordered, no full sort)."""
    return df.filter(F.col("at_risk")).orderBy(F.col("risk_score").desc(), F.col(key).asc()).limit(n)


def tiered(pred_df: DataFrame, threshold: float, pred_col: str = "predicted") -> DataFrame:
    """F9 on a prediction column."""
    return pred_df.withColumn("risk_level", risk_tier(pred_col, threshold))


def tier_counts(tiered_df: DataFrame, levels: Sequence[str] = RISK_TIERS,
                level_col: str = "risk_level") -> DataFrame:
    """A5: count and percent per level in fixed order; absent level -> 0.
    The level list is a fixed 4-row table, so joining it is bounded."""
    spark: SparkSession = tiered_df.sparkSession
    order = spark.createDataFrame([(lv, i) for i, lv in enumerate(levels)], f"{level_col} string, level_order int")
    counts = tiered_df.groupBy(level_col).agg(F.count(F.lit(1)).alias("n"))
    # window over the <= len(levels) result rows only
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return (F.broadcast(order).join(counts, level_col, "left")
            .select(level_col, "level_order", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
            .withColumn("pct", F.round(F.try_divide(F.col("n") * 100.0, total.cast("double")), 6)))


def prediction_summary(pred_df: DataFrame, pred_col: str = "predicted") -> DataFrame:
    """Min / max / mean of predictions."""
    return pred_df.agg(F.min(pred_col).alias("pred_min"), F.max(pred_col).alias("pred_max"),
                       F.avg(pred_col).alias("pred_mean"), F.count(F.lit(1)).alias("n"))
