"""End-to-end pipelines (Q1-Q15) composed from the operators.

Each pipeline is a lazy plan plus a handful of small driver-side fits
(medians, scaler constants, moment matrices); the big data only ever moves
through Spark joins, aggregates and projections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, features, linear, risk, splits
from ..session import cut_lineage
from ..sources import fixtures

KEY = "entity_id"
OUTCOME = "outcome"


@dataclass
class Prepared:
    """Q2 output: the cleaned training table and everything fitted on it."""
    table: DataFrame
    raw_features: list[str]
    features: list[str]
    plan: features.MissingPlan
    scaler: features.Scaler


def preprocess(df: DataFrame, raw_features: list[str], add_indicators: bool = True) -> Prepared:
    """Q2: missing policy (F7) -> clip (F6) -> engineered features
    -> population scaler (F8, fitted on all rows: the reference's scope)."""
    plan = features.fit_missing(df, raw_features)
    t = features.apply_missing(df, plan, add_indicators)
    t = features.apply_clip(t, plan.kept)
    t, all_feats = features.add_engineered(t, plan.kept)
    scaler = features.fit_scaler(t, all_feats, extra_means=[OUTCOME] if OUTCOME in t.columns else [])
    return Prepared(t, plan.kept, all_feats, plan, scaler)


def apply_preprocess(df: DataFrame, prep: Prepared) -> DataFrame:
    """The training-time cleaning applied to new rows: training medians,
    same clip, same engineered features (no refit)."""
    t = features.apply_missing(df, prep.plan, add_indicators=False)
    t = features.apply_clip(t, prep.raw_features)
    t, _ = features.add_engineered(t, prep.raw_features)
    return t


def load_and_merge(spark: SparkSession, sf_dir: str,
                   materialize: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Q1 (without the sink): wide scores, outcomes, their inner join.

    The wide table (one row per entity, aggregated from every order) feeds
    half a dozen small fit jobs and the scoring pass; with ``materialize``
    it and the merge are checkpointed once to the shared checkpoint folder, so
    the order table is aggregated and joined a single time."""
    wide = fixtures.wide_scores(spark, sf_dir)
    if materialize:
        wide = cut_lineage(wide)
    out = fixtures.outcomes(spark, sf_dir)
    merged = cohort.merge(wide, out)
    return wide, out, cut_lineage(merged) if materialize else merged


def train_linear(prep: Prepared, test_percent: int = 20) -> linear.LinearFit:
    """OLS on the training rows, standardised with the scaler fitted on all
    rows (M1 + M2); orthogonal factors, since the rounded row mean nearly
    depends on the scores."""
    train = prep.table.filter(splits.split_column(prep.table, KEY, test_percent) == "train")
    sc = prep.scaler
    return linear.fit_least_squares(train, prep.features, OUTCOME, [sc.mean[c] for c in prep.features],
                                    [sc.scale(c) for c in prep.features], sc.extra.get(OUTCOME) or 0.0)


def early_warning(spark: SparkSession, sf_dir: str,
                  threshold: float = fixtures.OUTCOME_THRESHOLD) -> DataFrame:
    """Q5: train on entities with an outcome, predict the current cohort
    (anti-join), round, score and flag risk, attach raw scores, sort.

    The raw scores ride along the scoring projection under private names,
    which gives the J6 report (raw scores next to the prediction) without
    re-joining the cohort to itself - the orders aggregation runs once.
    """
    wide, out, merged = load_and_merge(spark, sf_dir)
    prep = preprocess(merged, list(fixtures.SCORE_COLUMNS))
    fit = train_linear(prep)
    current = cohort.current_cohort(wide, out)
    raw = {f"_raw_{c}": F.col(c) for c in fixtures.SCORE_COLUMNS}
    scored = apply_preprocess(current.withColumns(raw), prep).select(
        KEY, "name", risk.rounded_prediction(fit.predict()).alias("predicted"),
        *[F.col(k).alias(k[len("_raw_"):]) for k in raw])
    return risk.sort_by_risk(risk.flag_at_risk(scored, threshold))
