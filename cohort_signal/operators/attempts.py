"""Multi-attempt outcome records (A8, A9, W1, W2, T5 input, O7).

Attempts arrive long: (entity_id, attempt_no, attempt_date, score).  All
windows are partitioned by entity, so they parallelise over entities; the
summary is one grouped aggregate with conditional pivots (one shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "entity_id"
# Attempts with date and score columns of their own in the summary; its
# count, best, latest and change use every attempt.
ATTEMPT_COLUMNS = 3


def sequence_attempts(raw: DataFrame, order_cols=("attempt_date",), tiebreak: str = "attempt_id") -> DataFrame:
    """Number each entity's sittings in date order (a tiebreak column
    makes the order total)."""
    w = Window.partitionBy(KEY).orderBy(*order_cols, tiebreak)
    return raw.withColumn("attempt_no", F.row_number().over(w).cast("int"))


def attempt_changes(att: DataFrame) -> DataFrame:
    """Score change versus the previous attempt (null on the first)."""
    w = Window.partitionBy(KEY).orderBy("attempt_no")
    return att.select(KEY, "attempt_no", "score",
                      (F.col("score") - F.lag("score").over(w)).alias("change"))


def attempt_summary(att: DataFrame, attempt_columns: int = ATTEMPT_COLUMNS) -> DataFrame:
    """Per entity: count, best, first, latest, latest - first (null below
    two attempts), and date/score columns of the first attempts."""
    aggs = [
        F.count(F.lit(1)).cast("int").alias("total_attempts"),
        F.max("score").alias("best_score"),
        F.min_by("score", "attempt_no").alias("first_score"),
        F.max_by("score", "attempt_no").alias("latest_score"),
    ]
    for i in range(1, attempt_columns + 1):
        aggs.append(F.max(F.when(F.col("attempt_no") == i, F.col("attempt_date"))).alias(f"attempt{i}_date"))
        aggs.append(F.max(F.when(F.col("attempt_no") == i, F.col("score"))).alias(f"attempt{i}_score"))
    s = att.groupBy(KEY).agg(*aggs)
    return s.withColumn("score_change", F.when(F.col("total_attempts") >= 2,
                                               F.col("latest_score") - F.col("first_score")))


def attempt_distribution(summary: DataFrame) -> DataFrame:
    """Number of entities per attempt count."""
    return summary.groupBy("total_attempts").agg(F.count(F.lit(1)).alias("n_entities"))


def paired_change(summary: DataFrame, a: int, b: int) -> DataFrame:
    """W2 (pivoted form): change from attempt a to attempt b where both exist."""
    sa, sb = f"attempt{a}_score", f"attempt{b}_score"
    return (summary.filter(F.col(sa).isNotNull() & F.col(sb).isNotNull())
            .select(KEY, (F.col(sb) - F.col(sa)).alias("change")))
