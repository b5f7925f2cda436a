"""Feature preparation: missing policy, clipping, engineered row features,
population standardisation (F1-F8, A15, A16).

``fit_*`` functions run one aggregate and return a small driver-side object
(per-column constants); ``apply_*`` functions turn it into column
expressions, so applying a fit to new data (the current cohort) is a narrow
projection with the constants inlined, never a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rowwise
from .ranking import exact_quantiles

# Missing-share above which a column is dropped, clip range,
# names of the engineered features.
DROP_MISSING_ABOVE = 0.5
CLIP_RANGE = (0.0, 100.0)
ENGINEERED = ("block_average", "block_variance", "lowest_block")


@dataclass
class MissingPlan:
    """F7 decision per column: drop (> 50 % missing) or impute the median."""
    rates: dict[str, float]
    dropped: list[str]
    medians: dict[str, float]
    kept: list[str] = field(default_factory=list)

    @property
    def indicators(self) -> list[str]:
        return [f"{c}_missing" for c in self.medians]


def missing_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: missing_count, missing_pct (2 dp), n."""
    df = rowwise.without_nan(df, cols)
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.unpivot("_n", list(cols), "feature", "missing_count")
    return long.select(
        "feature",
        F.col("missing_count").cast("long").alias("missing_count"),
        rowwise.round_half_even(F.try_divide(F.col("missing_count") * 100.0, F.col("_n").cast("double")), 2)
        .alias("missing_pct"))


def fit_missing(df: DataFrame, cols: Sequence[str], drop_above: float = DROP_MISSING_ABOVE) -> MissingPlan:
    """F7 fit: one aggregate for the missing shares, then exact medians of
    the columns that will be imputed."""
    cols = list(cols)
    df = rowwise.without_nan(df, cols)
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    n = row["_n"] or 0
    rates = {c: (row[c] / n if n else 0.0) for c in cols}
    dropped = [c for c in cols if rates[c] > drop_above]
    to_impute = [c for c in cols if 0 < rates[c] <= drop_above]
    medians = {}
    if to_impute:
        q = exact_quantiles(df, to_impute, [0.5])
        medians = {c: q[c][0] for c in to_impute}
    return MissingPlan(rates, dropped, medians, [c for c in cols if c not in dropped])


def apply_missing(df: DataFrame, plan: MissingPlan, add_indicators: bool = True) -> DataFrame:
    """F7 apply: drop, add ``<col>_missing`` 0/1, fill with the fitted median."""
    out = df.drop(*plan.dropped)
    extra = []
    for c, med in plan.medians.items():
        if c not in out.columns:
            continue
        if add_indicators:
            extra.append((f"{c}_missing", F.col(c).isNull().cast("int")))
        extra.append((c, F.coalesce(F.col(c), F.lit(med))))
    return out.withColumns(dict(extra)) if extra else out


def clip_counts(df: DataFrame, cols: Sequence[str], lo: float = CLIP_RANGE[0],
                hi: float = CLIP_RANGE[1]) -> DataFrame:
    """F6 report: values below ``lo`` and above ``hi`` per column."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c) < lo).alias(f"{c}__low"), F.count_if(F.col(c) > hi).alias(f"{c}__high")]
    row = df.agg(*aggs)
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__low").cast("long").alias("n_low"),
                 F.col(f"{c}__high").cast("long").alias("n_high")) for c in cols])).alias("r")).select("r.*")


def apply_clip(df: DataFrame, cols: Sequence[str], lo: float = CLIP_RANGE[0],
               hi: float = CLIP_RANGE[1]) -> DataFrame:
    """clip each column into [lo, hi], nulls untouched."""
    return df.withColumns({c: rowwise.clip(c, lo, hi) for c in cols})


def engineered_columns(cols: Sequence[str]) -> dict[str, Column]:
    """F1-F3 as the reference names them: rounded row mean and variance, row minimum."""
    return {
        ENGINEERED[0]: rowwise.row_mean(cols, 2),
        ENGINEERED[1]: rowwise.row_variance(cols, 2),
        ENGINEERED[2]: rowwise.row_min(cols),
    }


def add_engineered(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    new = engineered_columns(cols)
    return df.withColumns(new), list(cols) + list(new)


@dataclass
class Scaler:
    """F8: population mean/std per column; zero std scales by 1.  ``extra``
    holds means of other columns computed in the same pass (e.g. the target,
    used as a numerical shift by the moment fits)."""
    cols: list[str]
    mean: dict[str, float]
    std: dict[str, float]
    extra: dict[str, float] = field(default_factory=dict)

    def scale(self, c: str) -> float:
        s = self.std.get(c) or 0.0
        return s if s > 0 else 1.0

    def column(self, c: str, source: Column | None = None) -> Column:
        src = F.col(c) if source is None else source
        return (src - F.lit(self.mean[c])) / F.lit(self.scale(c))


def fit_scaler(df: DataFrame, cols: Sequence[str], extra_means: Sequence[str] = ()) -> Scaler:
    cols = list(cols)
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)],
                 *[F.avg(c).alias(f"x_{i}") for i, c in enumerate(extra_means)]).first()
    return Scaler(cols, {c: row[f"m_{i}"] for i, c in enumerate(cols)},
                  {c: row[f"s_{i}"] for i, c in enumerate(cols)},
                  {c: row[f"x_{i}"] for i, c in enumerate(extra_means)})


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: scaler.column(c) for c in scaler.cols if c in df.columns})


def scaler_frame(spark, scaler: Scaler) -> DataFrame:
    """The fitted constants as a small result table (feature, mean, std, scale)."""
    rows = [(c, float(scaler.mean[c]) if scaler.mean[c] is not None else None,
             float(scaler.std[c]) if scaler.std[c] is not None else None, float(scaler.scale(c)))
            for c in scaler.cols]
    return spark.createDataFrame(rows, "feature string, mean double, std double, scale double")


def total_flags(cols: Sequence[str]) -> Column:
    """Row sum of 0/1 flags, null flags counted as 0."""
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in cols), F.lit(0)).cast("int")


def availability(df: DataFrame, score_cols: Sequence[str], flag_cols: Sequence[str]) -> DataFrame:
    """Entities with a value per score column and remediated entities
    per flag column, as (feature, kind, n)."""
    aggs = [F.count(F.col(c)).alias(c) for c in score_cols] + \
           [F.sum(F.col(c)).cast("long").alias(c) for c in flag_cols]
    wide = df.agg(*aggs)
    items = [F.struct(F.lit(c).alias("feature"), F.lit("with_value").alias("kind"),
                      F.col(c).cast("long").alias("n")) for c in score_cols] + \
            [F.struct(F.lit(c).alias("feature"), F.lit("remediated").alias("kind"),
                      F.col(c).cast("long").alias("n")) for c in flag_cols]
    return wide.select(F.explode(F.array(*items)).alias("r")).select("r.*")
