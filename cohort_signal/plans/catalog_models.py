"""Catalogue: preprocessing, linear models, CV, explanation, risk (F7, F8,
M*, E*, Q2-Q5, Q8, Q9 ...)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures as fx
from . import pipelines as pl
from .catalog import p6, query, significant
from .oracle import (CUR, MERGED, NAMED, OUTC, WIDE, centred_sql, clip_sql, in_test, ols_ctes, predict_sql,
                     refined_ctes, rev, row_mean_sql, row_var_sql, with_)

SC = list(fx.SCORE_COLUMNS)
ENG = ["block_average", "block_variance", "lowest_block"]
FEATS = SC + ENG
TH = float(fx.OUTCOME_THRESHOLD)
THS = f"{TH}::DOUBLE"

MED = "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in SC) + " FROM merged)"


def _imputed(name: str, src: str, keep: str) -> str:
    cols = ", ".join(f"{clip_sql(f'coalesce(s.{c}, med.med_{c})')} AS {c}" for c in SC)
    return f"{name}0 AS (SELECT {keep}, {cols} FROM {src} s CROSS JOIN med)"


def _engineered(name: str) -> str:
    return (f"{name} AS (SELECT *, {rev(row_mean_sql(SC), 2)} AS block_average, "
            f"{rev(row_var_sql(SC), 2)} AS block_variance, least({', '.join(SC)}) AS lowest_block FROM {name}0)")


PREP_CTES = [WIDE, NAMED, OUTC, MERGED, CUR, MED,
             _imputed("prep", "merged", "s.entity_id, s.outcome"), _engineered("prep")]


TRAIN = f"train AS (SELECT * FROM prep QUALIFY NOT {in_test()})"

# ---------------------------------------------------------------------------
# Q5 / flagship: early warning report
# ---------------------------------------------------------------------------

Q5_SQL = with_(
    *PREP_CTES,
    TRAIN,
    *ols_ctes("fit", "train", FEATS, "outcome"),
    _imputed("curp", "cur", "s.entity_id, s.name"), _engineered("curp"),
    f"pred AS (SELECT entity_id, name, round_even({predict_sql('fit_coef', FEATS)}, 0)::INTEGER AS predicted "
    f"FROM curp CROSS JOIN fit_coef)",
) + (f"SELECT p.entity_id, p.name, p.predicted, {THS} AS threshold, "
     f"{p6(rev(f'({THS} - p.predicted) / {THS}', 3))} AS risk_score, p.predicted < {THS} AS at_risk, "
     + ", ".join(f"{p6('c.' + c)} AS {c}" for c in SC)
     + " FROM pred p LEFT JOIN cur c USING (entity_id)")


@query("q5_early_warning", Q5_SQL)
def q5_early_warning(spark: SparkSession, sf_dir: str):
    """Q5: predict the current cohort, flag and rank risk, attach scores."""
    return pl.early_warning(spark, sf_dir)


@query("m14_predict_current_cohort", with_(
    *PREP_CTES,
    TRAIN,
    *ols_ctes("fit", "train", FEATS, "outcome"),
    _imputed("curp", "cur", "s.entity_id, s.name"), _engineered("curp"),
) + f"SELECT entity_id, name, round_even({predict_sql('fit_coef', FEATS)}, 0)::INTEGER AS predicted "
    f"FROM curp CROSS JOIN fit_coef")
def m14_predict_current_cohort(spark: SparkSession, sf_dir: str):
    """Training medians + training fit applied to the current cohort."""
    wide, out, merged = pl.load_and_merge(spark, sf_dir)
    prep = pl.preprocess(merged, SC)
    fit = pl.train_linear(prep)
    cur = pl.apply_preprocess(pl.cohort.current_cohort(wide, out), prep)
    return cur.select("entity_id", "name", F.rint(fit.predict()).cast("int").alias("predicted"))


# ---------------------------------------------------------------------------
# shared Spark-side state for the linear world (R1 scores -> outcome)
# ---------------------------------------------------------------------------

from ..functions.labels import (auc_class, confidence_above, confidence_positive,  # noqa: E402
                                confidence_useful, fixed_tier, usefulness, usefulness_band)
from ..operators import classify, evaluate, explain, linear, splits, stats, trees  # noqa: E402
from ..session import cut_lineage  # noqa: E402
from ..operators import cohort, risk  # noqa: E402
from ..operators.checkpoints import checkpoint_features, complete_depth  # noqa: E402
from .oracle import EXAMS  # noqa: E402


def _linear_world(spark: SparkSession, sf_dir: str):
    wide, out, merged = pl.load_and_merge(spark, sf_dir)
    prep = pl.preprocess(merged, SC)
    fit = pl.train_linear(prep)
    split = splits.split_column(prep.table, "entity_id")
    scored = prep.table.select("entity_id", "outcome", *prep.features, split.alias("split"),
                               fit.predict().alias("pred"))
    return wide, out, prep, fit, scored


PST = "pst AS (SELECT " + ", ".join(
    f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd{i}" for i, c in enumerate(FEATS)) + " FROM prep)"
SPLIT = f"CASE WHEN {in_test()} THEN 'test' ELSE 'train' END"
LIN = [*PREP_CTES, PST, TRAIN,
       *refined_ctes("fit", "train", FEATS, "outcome", "pst"),
       f"pr AS (SELECT p.*, {SPLIT} AS split, {centred_sql('fit_coef', FEATS)} AS pred FROM prep p CROSS JOIN fit_coef)"]
#: Significant digits of what is proportional to a coefficient of the nearly
#: dependent design, decimals of its predictions.
DIGITS, DECIMALS = 7, 4
FEAT_LIST = "[" + ", ".join(f"'{c}'" for c in FEATS) + "]"
E1 = (f"e1 AS (SELECT {FEAT_LIST}[i] AS feature, s.coef_std[i] AS coef FROM fit_sol s CROSS JOIN range(1, {len(FEATS) + 1}) t(i))")


@query("m1_split", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, {SPLIT} AS split FROM merged")
def m1_split(spark: SparkSession, sf_dir: str):
    """M1: 80/20 split in digest order of the key; the test set has ceil(0.2 n) rows."""
    merged = pl.load_and_merge(spark, sf_dir)[2]
    return merged.select("entity_id", splits.split_column(merged, "entity_id").alias("split"))


@query("m2_ols_coefficients", with_(*LIN, E1) + (
    f"SELECT feature, {significant('coef', DIGITS)} AS coef, {significant('abs(coef)', DIGITS)} AS abs_coef, CASE WHEN coef > 0 THEN '+' ELSE '-' END AS sign, "
    "row_number() OVER (ORDER BY abs(coef) DESC, feature)::INTEGER AS rank FROM e1"), digits=DIGITS)
def m2_ols_coefficients(spark: SparkSession, sf_dir: str):
    """M2 + E1 + F20 + W4: OLS on standardised features, ranked by |coef|."""
    _, _, prep, fit, _ = _linear_world(spark, sf_dir)
    return explain.coefficients(spark, fit)


M7_SQL = with_(*LIN) + (
    f"SELECT 'linear' AS model, split, count(*) AS n, {p6('avg(abs(outcome - pred))')} AS mae, "
    f"{p6('sqrt(avg((outcome - pred) * (outcome - pred)))')} AS rmse, "
    f"{p6('1.0 - sum((outcome - pred) * (outcome - pred)) / (var_pop(outcome) * count(*))')} AS r2 FROM pr GROUP BY split")


@query("m7_linear_metrics", M7_SQL)
def m7_linear_metrics(spark: SparkSession, sf_dir: str):
    """M7: MAE / RMSE / R^2 of the linear model on train and test."""
    _, _, _, _, scored = _linear_world(spark, sf_dir)
    return evaluate.regression_metrics(scored.withColumn("model", F.lit("linear")), "outcome", "pred", ["model", "split"])


@query("f17_overfit_flag", with_(*LIN, "mm AS (SELECT split, 1.0 - sum((outcome - pred) * (outcome - pred)) / (var_pop(outcome) * count(*)) AS r2 FROM pr GROUP BY split)") + (
    f"SELECT 'linear' AS model, {p6('max(r2) FILTER (WHERE split = ' + chr(39) + 'train' + chr(39) + ') - max(r2) FILTER (WHERE split = ' + chr(39) + 'test' + chr(39) + ')')} AS r2_gap, "
    "(max(r2) FILTER (WHERE split = 'train') - max(r2) FILTER (WHERE split = 'test')) > 0.15 AS overfit FROM mm"))
def f17_overfit_flag(spark: SparkSession, sf_dir: str):
    """train R^2 - test R^2 gap and the 0.15 overfit flag."""
    _, _, _, _, scored = _linear_world(spark, sf_dir)
    m = evaluate.regression_metrics(scored.withColumn("model", F.lit("linear")), "outcome", "pred", ["model", "split"])
    return evaluate.metrics_wide(m).select("model", "r2_gap", "overfit")


@query("e6_residuals", with_(*LIN) + f"SELECT entity_id, split, {p6('outcome - pred', DECIMALS)} AS residual FROM pr", decimals=DECIMALS)
def e6_residuals(spark: SparkSession, sf_dir: str):
    """Residual table (actual - predicted)."""
    _, _, _, _, scored = _linear_world(spark, sf_dir)
    return scored.select("entity_id", "split", (F.col("outcome") - F.col("pred")).alias("residual"))


@query("a12_residual_stats", with_(*LIN) + f"SELECT {p6('avg(outcome - pred)', DECIMALS)} AS mean_residual, {p6('stddev_pop(outcome - pred)', DECIMALS)} AS std_residual, count(*) AS n FROM pr WHERE split = 'test'", decimals=DECIMALS)
def a12_residual_stats(spark: SparkSession, sf_dir: str):
    """Mean and population std of test residuals."""
    _, _, _, _, scored = _linear_world(spark, sf_dir)
    from ..operators.profile import residual_stats
    return residual_stats(scored.filter(F.col("split") == "test").withColumn("residual", F.col("outcome") - F.col("pred")))


def _perm_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (2.0 * coef[{i + 1}] * covar_pop(outcome - pred, {c}) + 2.0 * coef[{i + 1}] * coef[{i + 1}] * var_pop({c})) / var_pop(outcome) AS importance "
        f"FROM pr CROSS JOIN fit_coef WHERE split = 'test' GROUP BY coef" for i, c in enumerate(FEATS))
    return f"perm AS ({parts})"


@query("e2_permutation_closed_form", with_(*LIN, _perm_sql()) + f"SELECT feature, {significant('importance', DIGITS)} AS importance FROM perm", digits=DIGITS)
def e2_permutation_closed_form(spark: SparkSession, sf_dir: str):
    """Expected R^2 drop under a random permutation of each feature
    (closed form for a linear model), on the test rows."""
    _, _, prep, fit, scored = _linear_world(spark, sf_dir)
    return explain.permutation_importance(scored.filter(F.col("split") == "test"), fit, "outcome")


@query("e2_permutation_sampled")
def e2_permutation_sampled(spark: SparkSession, sf_dir: str):
    """E2 (sampled): mean R^2 drop over 30 random permutations per feature."""
    _, _, prep, fit, scored = _linear_world(spark, sf_dir)
    return explain.permutation_importance_sampled(scored.filter(F.col("split") == "test"), fit, "outcome",
                                                  "entity_id", repeats=30)


@query("e3_attributions", with_(*LIN, "bg AS (SELECT " + ", ".join(f"avg({c}) AS bm{i}" for i, c in enumerate(FEATS)) + " FROM pr WHERE split = 'test')")
       + " UNION ALL ".join(f"SELECT entity_id, '{c}' AS feature, {significant(f'(coef[{i + 1}] * ({c} - bm{i}))', DIGITS)} AS attribution FROM pr CROSS JOIN fit_coef CROSS JOIN bg WHERE split = 'test'" for i, c in enumerate(FEATS)), digits=DIGITS)
def e3_attributions(spark: SparkSession, sf_dir: str):
    """Additive attributions coef * (x - background mean), test rows."""
    _, _, prep, fit, scored = _linear_world(spark, sf_dir)
    return explain.attributions(scored.filter(F.col("split") == "test"), fit, "entity_id")


COMBINED_SQL = with_(*LIN, E1, _perm_sql()) + f"SELECT feature, {significant('coef', DIGITS)} AS coef, {significant('abs(coef)', DIGITS)} AS abs_coef, {significant('importance', DIGITS)} AS importance FROM e1 FULL OUTER JOIN perm USING (feature)"


@query("e5_combined_importance", COMBINED_SQL, digits=DIGITS)
def e5_combined_importance(spark: SparkSession, sf_dir: str):
    """E5: coefficients and permutation importance side by side."""
    _, _, prep, fit, scored = _linear_world(spark, sf_dir)
    return explain.combined_importance(explain.coefficients(spark, fit),
                                       explain.permutation_importance(scored.filter(F.col("split") == "test"), fit, "outcome"))


@query("o4_top_features", with_(*LIN, E1) + f"SELECT feature, {significant('coef', DIGITS)} AS coef, {significant('abs(coef)', DIGITS)} AS abs_coef FROM e1 ORDER BY abs(coef) DESC, feature LIMIT 5", digits=DIGITS)
def o4_top_features(spark: SparkSession, sf_dir: str):
    """Top features by |coef|."""
    _, _, prep, fit, _ = _linear_world(spark, sf_dir)
    return explain.top_features(explain.coefficients(spark, fit), 5).select("feature", "coef", "abs_coef")


@query("m12_confusion", with_(*LIN) + (
    f"SELECT count(*) FILTER (WHERE pred >= {THS} AND outcome >= {THS}) AS tp, count(*) FILTER (WHERE pred < {THS} AND outcome < {THS}) AS tn, "
    f"count(*) FILTER (WHERE pred >= {THS} AND outcome < {THS}) AS fp, count(*) FILTER (WHERE pred < {THS} AND outcome >= {THS}) AS fn, "
    f"{p6('(count(*) FILTER (WHERE pred >= ' + THS + ' AND outcome >= ' + THS + ') + count(*) FILTER (WHERE pred < ' + THS + ' AND outcome < ' + THS + '))::DOUBLE / count(*)')} AS accuracy, "
    f"{p6('count(*) FILTER (WHERE pred < ' + THS + ' AND outcome < ' + THS + ')::DOUBLE / nullif(count(*) FILTER (WHERE outcome < ' + THS + '), 0)')} AS fail_catch_rate, "
    f"{p6('count(*) FILTER (WHERE pred >= ' + THS + ' AND outcome >= ' + THS + ')::DOUBLE / nullif(count(*) FILTER (WHERE outcome >= ' + THS + '), 0)')} AS pass_recall FROM pr"))
def m12_confusion(spark: SparkSession, sf_dir: str):
    """pass/fail confusion of the linear model over all scored rows
    (in-sample for the training rows, as in the reference)."""
    _, _, _, _, scored = _linear_world(spark, sf_dir)
    return evaluate.confusion(scored, "outcome", "pred", TH)


CURPRED = [*PREP_CTES, TRAIN,
           *ols_ctes("fit", "train", FEATS, "outcome"),
           _imputed("curp", "cur", "s.entity_id, s.name"), _engineered("curp"),
           f"cp AS (SELECT entity_id, round_even({predict_sql('fit_coef', FEATS)}, 0)::INTEGER AS predicted FROM curp CROSS JOIN fit_coef)",
           f"tiers AS (SELECT *, CASE WHEN predicted < {TH - 8} THEN 'HIGH RISK' WHEN predicted < {TH - 3} THEN 'AT RISK' WHEN predicted < {TH + 3} THEN 'BORDERLINE' ELSE 'LIKELY PASS' END AS risk_level FROM cp)"]


def _current_predictions(spark, sf_dir):
    return m14_predict_current_cohort(spark, sf_dir).select("entity_id", "predicted")


@query("a5_tier_counts", with_(*CURPRED, "lv AS (SELECT * FROM (VALUES ('HIGH RISK', 0), ('AT RISK', 1), ('BORDERLINE', 2), ('LIKELY PASS', 3)) v(risk_level, level_order))") + (
    "SELECT lv.risk_level, lv.level_order, coalesce(c.n, 0)::BIGINT AS n, "
    + p6("coalesce(c.n, 0) * 100.0 / sum(coalesce(c.n, 0)) OVER ()") + " AS pct FROM lv LEFT JOIN (SELECT risk_level, count(*) AS n FROM tiers GROUP BY risk_level) c USING (risk_level)"))
def a5_tier_counts(spark: SparkSession, sf_dir: str):
    """A5: tier counts in fixed order (absent tier = 0) with percent."""
    return risk.tier_counts(risk.tiered(_current_predictions(spark, sf_dir), TH)).withColumn("level_order", F.col("level_order").cast("int"))


@query("a7_prediction_summary", with_(*CURPRED) + f"SELECT min(predicted) AS pred_min, max(predicted) AS pred_max, {p6('avg(predicted)')} AS pred_mean, count(*) AS n FROM cp")
def a7_prediction_summary(spark: SparkSession, sf_dir: str):
    """Min / max / mean of current-cohort predictions."""
    return risk.prediction_summary(_current_predictions(spark, sf_dir))


@query("o3_sort_by_predicted", with_(*CURPRED) + "SELECT entity_id, predicted, risk_level FROM tiers ORDER BY predicted, entity_id")
def o3_sort_by_predicted(spark: SparkSession, sf_dir: str):
    """O3 + F9: tiered predictions sorted ascending."""
    return risk.tiered(_current_predictions(spark, sf_dir), TH).orderBy("predicted", "entity_id")


@query("o1_sort_by_risk", Q5_SQL)
def o1_sort_by_risk(spark: SparkSession, sf_dir: str):
    """O1: the report sorted by risk (key tiebreak)."""
    return pl.early_warning(spark, sf_dir)


# ---------------------------------------------------------------------------
# exam world (R2 exams -> outcome): ridge, CV, checkpoints
# ---------------------------------------------------------------------------

from ..functions import clean  # noqa: E402
from .oracle import OUTC as _OUTC, cv_sql  # noqa: E402

EX = list(fx.EXAM_COLUMNS)
COURSES = list(fx.COURSES)
EXO_K = "exk AS (SELECT * FROM exams JOIN outc USING (entity_id))"
CC = "cc AS (SELECT * FROM exk WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in EX) + ")"
EXAM_BASE = [EXAMS, _OUTC, EXO_K, CC]
ALPHA = 1.0


def _exam_world(spark: SparkSession, sf_dir: str):
    """Exam table with known outcome (P13) and its complete cases.
    The entity-level table is checkpointed once: the CV jobs (shift,
    moments, MAE) then never re-aggregate the event table."""
    ex = cut_lineage(fx.exam_scores(spark, sf_dir, with_name=False).join(fx.outcomes(spark, sf_dir), "entity_id"))
    return ex, clean.drop_null(ex, EX)


def _ridge_scored(spark, sf_dir):
    _, cc = _exam_world(spark, sf_dir)
    sc = pl.features.fit_scaler(cc, EX)
    split = splits.split_column(cc, "entity_id")
    fit = linear.fit_linear(cc.filter(split == "train"), EX, "outcome", ALPHA,
                            [sc.mean[c] for c in EX], [sc.scale(c) for c in EX])
    scored = cc.select("entity_id", "outcome", *EX, split.alias("split"), fit.predict().alias("pred"))
    return fit, scored


CST = "cst AS (SELECT " + ", ".join(f"CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd{i}" for i, c in enumerate(EX)) + " FROM cc)"
RIDGE = [*EXAM_BASE, CST, f"rtrain AS (SELECT * FROM cc QUALIFY NOT {in_test()})",
         *ols_ctes("rg", "rtrain", EX, "outcome", alpha=ALPHA, scale_src="cst"),
         f"rp AS (SELECT c.*, {SPLIT} AS split, {predict_sql('rg_coef', EX)} AS pred FROM cc c CROSS JOIN rg_coef)"]
EX_LIST = "[" + ", ".join(f"'{c}'" for c in EX) + "]"
RE1 = f"re1 AS (SELECT {EX_LIST}[i] AS feature, s.coef_std[i] AS coef FROM rg_sol s CROSS JOIN range(1, {len(EX) + 1}) t(i))"


@query("m3_ridge_coefficients", with_(*EXAM_BASE, CST, *ols_ctes("rall", "cc", EX, "outcome", alpha=ALPHA, scale_src="cst"),
                                      f"ra AS (SELECT {EX_LIST}[i] AS feature, s.coef_std[i] AS coef FROM rall_sol s CROSS JOIN range(1, {len(EX) + 1}) t(i))")
       + f"SELECT feature, {p6('coef')} AS coef FROM ra")
def m3_ridge_coefficients(spark: SparkSession, sf_dir: str):
    """M3: ridge (alpha = 1, intercept unpenalised) on standardised exams."""
    _, cc = _exam_world(spark, sf_dir)
    fit = linear.fit_linear(cc, EX, "outcome", ALPHA)
    return spark.createDataFrame(fit.coefficient_rows(), "feature string, coef double")


@query("e1_ridge_coefficients", with_(*RIDGE, RE1) + (
    f"SELECT feature, {p6('coef')} AS coef, {p6('abs(coef)')} AS abs_coef, CASE WHEN coef > 0 THEN '+' ELSE '-' END AS sign, "
    "row_number() OVER (ORDER BY abs(coef) DESC, feature)::INTEGER AS rank FROM re1"))
def e1_ridge_coefficients(spark: SparkSession, sf_dir: str):
    """E1 + F20 + W4 on the (well-conditioned) exam ridge model."""
    fit, _ = _ridge_scored(spark, sf_dir)
    return explain.coefficients(spark, fit)


def _rperm_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, (2.0 * coef[{i + 1}] * covar_pop(outcome - pred, {c}) + 2.0 * coef[{i + 1}] * coef[{i + 1}] * var_pop({c})) / var_pop(outcome) AS importance "
        f"FROM rp CROSS JOIN rg_coef WHERE split = 'test' GROUP BY coef" for i, c in enumerate(EX))
    return f"rperm AS ({parts})"


@query("e2_ridge_permutation", with_(*RIDGE, _rperm_sql()) + f"SELECT feature, {p6('importance')} AS importance FROM rperm")
def e2_ridge_permutation(spark: SparkSession, sf_dir: str):
    """E2 (closed form) on the exam ridge model, test rows."""
    fit, scored = _ridge_scored(spark, sf_dir)
    return explain.permutation_importance(scored.filter(F.col("split") == "test"), fit, "outcome")


@query("e3_ridge_attributions", with_(*RIDGE, "rbg AS (SELECT " + ", ".join(f"avg({c}) AS bm{i}" for i, c in enumerate(EX)) + " FROM rp WHERE split = 'test')")
       + " UNION ALL ".join(f"SELECT entity_id, '{c}' AS feature, {p6(f'coef[{i + 1}] * ({c} - bm{i})')} AS attribution FROM rp CROSS JOIN rg_coef CROSS JOIN rbg WHERE split = 'test'" for i, c in enumerate(EX)))
def e3_ridge_attributions(spark: SparkSession, sf_dir: str):
    """E3 on the exam ridge model, test rows as background."""
    fit, scored = _ridge_scored(spark, sf_dir)
    return explain.attributions(scored.filter(F.col("split") == "test"), fit, "entity_id")


@query("e5_ridge_combined", with_(*RIDGE, RE1, _rperm_sql()) + f"SELECT feature, {p6('coef')} AS coef, {p6('abs(coef)')} AS abs_coef, {p6('importance')} AS importance FROM re1 FULL OUTER JOIN rperm USING (feature)")
def e5_ridge_combined(spark: SparkSession, sf_dir: str):
    """E5 on the exam ridge model."""
    fit, scored = _ridge_scored(spark, sf_dir)
    return explain.combined_importance(explain.coefficients(spark, fit),
                                       explain.permutation_importance(scored.filter(F.col("split") == "test"), fit, "outcome"))


@query("e6_ridge_residuals", with_(*RIDGE) + f"SELECT entity_id, split, {p6('outcome - pred')} AS residual FROM rp")
def e6_ridge_residuals(spark: SparkSession, sf_dir: str):
    """E6 on the exam ridge model."""
    _, scored = _ridge_scored(spark, sf_dir)
    return scored.select("entity_id", "split", (F.col("outcome") - F.col("pred")).alias("residual"))


@query("o4_ridge_top_features", with_(*RIDGE, RE1) + f"SELECT feature, {p6('coef')} AS coef, {p6('abs(coef)')} AS abs_coef FROM re1 ORDER BY abs(coef) DESC, feature LIMIT 5")
def o4_ridge_top_features(spark: SparkSession, sf_dir: str):
    """O4 on the exam ridge model."""
    fit, _ = _ridge_scored(spark, sf_dir)
    return explain.top_features(explain.coefficients(spark, fit), 5).select("feature", "coef", "abs_coef")


def _cv_folds(spark, sf_dir, reps: int | None = None, feats=None, data=None):
    feats = feats or EX
    if data is None:
        data = _exam_world(spark, sf_dir)[1]
    folds = splits.fold_columns(data, "entity_id", 5, 42, reps)
    if reps is None:
        return linear.cv_linear(data.withColumn("fold", folds[0]), feats, "outcome", "fold", alpha=ALPHA)
    names = [f"_fold{r}" for r in range(reps)]
    return linear.repeated_cv(data.withColumns(dict(zip(names, folds))), feats, "outcome", names, alpha=ALPHA)


@query("m5_cv_folds", with_(*EXAM_BASE, *cv_sql("k5", "cc", EX, "outcome", ALPHA))
       + f"SELECT fold, n_train, n_test, {p6('r2')} AS r2, {p6('mae')} AS mae FROM k5_ev")
def m5_cv_folds(spark: SparkSession, sf_dir: str):
    """M5: 5-fold CV (digest order) of the exam ridge: per-fold R^2 and MAE from
    fold moments (train = total - fold), MAE in one extra pass."""
    return _cv_folds(spark, sf_dir)


CV_SUMMARY = (f"SELECT count(*) AS n_folds, {p6('avg(r2)')} AS r2_mean, {p6('stddev_pop(r2)')} AS r2_std, "
              f"{p6('avg(mae)')} AS mae_mean, {p6('stddev_pop(mae)')} AS mae_std, "
              f"{p6('avg(r2) - 1.96 * stddev_pop(r2) / sqrt(count(*))')} AS r2_ci_low, "
              f"{p6('avg(r2) + 1.96 * stddev_pop(r2) / sqrt(count(*))')} AS r2_ci_high")


@query("m5_cv_summary", with_(*EXAM_BASE, *cv_sql("k5", "cc", EX, "outcome", ALPHA)) + CV_SUMMARY + " FROM k5_ev")
def m5_cv_summary(spark: SparkSession, sf_dir: str):
    """M5 + T6: mean and population std of fold scores with the 95 % CI."""
    return linear.cv_summary(_cv_folds(spark, sf_dir))


@query("m6_repeated_cv", with_(*EXAM_BASE, *cv_sql("k50", "cc", EX, "outcome", ALPHA, reps=10))
       + f"SELECT rep::INTEGER AS rep, fold, n_train, n_test, {p6('r2')} AS r2, {p6('mae')} AS mae FROM k50_ev")
def m6_repeated_cv(spark: SparkSession, sf_dir: str):
    """M6: 10 x 5 repeated K-fold (digest order per repeat), one moment pass
    for all 50 fits."""
    return _cv_folds(spark, sf_dir, reps=10)


@query("t6_cv_ci", with_(*EXAM_BASE, *cv_sql("k50", "cc", EX, "outcome", ALPHA, reps=10)) + CV_SUMMARY + " FROM k50_ev")
def t6_cv_ci(spark: SparkSession, sf_dir: str):
    """Mean +- 1.96 std / sqrt(k) over the 50 repeated-CV scores."""
    return linear.cv_summary(_cv_folds(spark, sf_dir, reps=10))


@query("f18_confidence_wording", with_(*EXAM_BASE, *cv_sql("k50", "cc", EX, "outcome", ALPHA, reps=10),
                                       "sm AS (SELECT avg(r2) AS m, avg(r2) - 1.96 * stddev_pop(r2) / sqrt(count(*)) AS lo, avg(mae) AS mm, stddev_pop(mae) AS ms FROM k50_ev)")
       + ("SELECT CASE WHEN lo > 0 THEN 'HIGH' WHEN lo IS NOT NULL THEN 'LOW' END AS r2_above_0, "
          "CASE WHEN lo > 0.3 THEN 'HIGH' WHEN m > 0.3 THEN 'MODERATE' WHEN m IS NOT NULL THEN 'LOW' END AS r2_above_030, "
          f"{p6('mm + 2.0 * ms')} AS worst_case_mae FROM sm"))
def f18_confidence_wording(spark: SparkSession, sf_dir: str):
    """F18 + T10: confidence wording from the R^2 interval; worst-case MAE."""
    s = linear.cv_summary(_cv_folds(spark, sf_dir, reps=10))
    return s.select(confidence_positive("r2_ci_low").alias("r2_above_0"),
                    confidence_above("r2_ci_low", "r2_mean", 0.3).alias("r2_above_030"),
                    stats.worst_case(F.col("mae_mean"), F.col("mae_std")).alias("worst_case_mae"))


def _checkpoint_rows(spark, sf_dir, parts):
    ex, _ = _exam_world(spark, sf_dir)
    depth = complete_depth(COURSES, parts)
    rows = ex.withColumn("_depth", depth).filter(F.col("_depth") >= 1)
    return rows.select(F.explode(F.sequence(F.lit(1), F.col("_depth"))).alias("checkpoint"), *ex.columns)


def _contiguous_folds(rows, k: int = 5):
    """Unshuffled K-fold in key order within each checkpoint, from
    distributed ranks (no global window); per-checkpoint counts are a
    5-row table."""
    from ..operators.ranking import row_rank
    base = rows
    ranked = row_rank(base.select("checkpoint", "entity_id"), "entity_id", keys=["checkpoint"])
    n = base.groupBy("checkpoint").agg(F.count(F.lit(1)).alias("_n"))
    folds = ranked.join(F.broadcast(n), "checkpoint").select(
        "checkpoint", "entity_id", linear.contiguous_fold(F.col("_rank"), F.col("_n"), k).alias("fold"))
    return base.join(folds, ["checkpoint", "entity_id"])


def _checkpoint_cv(spark, sf_dir, parts, contiguous: bool = False):
    rows = _checkpoint_rows(spark, sf_dir, parts)
    rows = _contiguous_folds(rows) if contiguous else rows.withColumn("fold", splits.grouped_folds(rows, "checkpoint", "entity_id", 5, 42))
    feats_for = {k: checkpoint_features(COURSES, k, parts) for k in range(1, len(COURSES) + 1)}
    folds = linear.grouped_cv(rows, EX, "outcome", "fold", "checkpoint", feats_for, alpha=ALPHA, min_rows=20)
    names = spark.createDataFrame([(k, COURSES[k - 1], len(feats_for[k])) for k in feats_for],
                                  "checkpoint int, course string, n_features int")
    s = folds.groupBy("checkpoint").agg(
        F.max("n_rows").alias("n_rows"), F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"))
    return (s.join(F.broadcast(names), "checkpoint")
            .select(F.col("course").alias("checkpoint"), F.col("checkpoint").alias("course_num"), "n_features",
                    "n_rows", "r2_mean", "r2_std", "mae_mean", "mae_std",
                    usefulness("r2_mean").alias("usefulness"), usefulness_band("r2_mean").alias("band")))


def _checkpoint_sql(parts: tuple[str, ...], name: str, contiguous: bool = False) -> list[str]:
    ctes, selects = [], []
    for k in range(1, len(COURSES) + 1):
        feats = checkpoint_features(COURSES, k, parts)
        cond = " AND ".join(f"{c} IS NOT NULL" for c in feats)
        ctes.append(f"{name}d{k} AS (SELECT * FROM exk WHERE {cond})")
        fold = "(ntile(5) OVER (ORDER BY entity_id) - 1)::INTEGER" if contiguous else None
        ctes += cv_sql(f"{name}{k}", f"{name}d{k}", feats, "outcome", ALPHA, fold_sql=fold)
        selects.append(
            f"SELECT '{COURSES[k - 1]}' AS checkpoint, {k} AS course_num, {len(feats)} AS n_features, "
            f"(SELECT count(*) FROM {name}d{k}) AS n_rows, avg(r2) AS r2_mean, stddev_pop(r2) AS r2_std, "
            f"avg(mae) AS mae_mean, stddev_pop(mae) AS mae_std FROM {name}{k}_ev")
    ctes.append(f"{name}res AS ({' UNION ALL '.join(selects)})")
    return ctes


def _checkpoint_final(name: str) -> str:
    return (f"SELECT checkpoint, course_num::INTEGER AS course_num, n_features::INTEGER AS n_features, n_rows, {p6('r2_mean')} AS r2_mean, "
            f"{p6('r2_std')} AS r2_std, {p6('mae_mean')} AS mae_mean, {p6('mae_std')} AS mae_std, "
            "CASE WHEN r2_mean > 0.4 THEN 'USEFUL' WHEN r2_mean > 0.25 THEN 'MODERATE' WHEN r2_mean > 0.1 THEN 'EMERGING' WHEN r2_mean IS NOT NULL THEN '' END AS usefulness, "
            "CASE WHEN r2_mean < 0.15 THEN 'LOW' WHEN r2_mean < 0.3 THEN 'MEDIUM' WHEN r2_mean IS NOT NULL THEN 'HIGH' END AS band "
            f"FROM {name}res WHERE n_rows >= 20")


ORACLE_M17 = with_(EXAMS, _OUTC, EXO_K, *_checkpoint_sql(("midterm", "final"), "ck")) + _checkpoint_final("ck")


@query("m17_checkpoints", ORACLE_M17)
def m17_checkpoints(spark: SparkSession, sf_dir: str):
    """M17 + F15: cumulative-course checkpoints, ridge 5-fold CV each; one
    moment pass for every checkpoint x fold."""
    return _checkpoint_cv(spark, sf_dir, ("midterm", "final"))


@query("m18_midterm_checkpoints", with_(EXAMS, _OUTC, EXO_K, *_checkpoint_sql(("midterm",), "mk")) + _checkpoint_final("mk"))
def m18_midterm_checkpoints(spark: SparkSession, sf_dir: str):
    """Midterm-only cumulative checkpoints."""
    return _checkpoint_cv(spark, sf_dir, ("midterm",))


@query("w6_first_useful_checkpoint", with_(EXAMS, _OUTC, EXO_K, *_checkpoint_sql(("midterm", "final"), "ck"))
       + " UNION ALL ".join(f"SELECT {lv}::DOUBLE AS level, arg_min(checkpoint, course_num) AS checkpoint, min(course_num)::INTEGER AS course_num FROM ckres WHERE n_rows >= 20 AND r2_mean > {lv}" for lv in (0.25, 0.4)))
def w6_first_useful_checkpoint(spark: SparkSession, sf_dir: str):
    """First checkpoint whose CV R^2 exceeds 0.25 and 0.4."""
    res = _checkpoint_cv(spark, sf_dir, ("midterm", "final"))
    out = None
    for lv in (0.25, 0.4):
        r = evaluate.first_checkpoint(res, lv).select(F.lit(lv).alias("level"), "checkpoint", "course_num")
        out = r if out is None else out.unionByName(r)
    return out


EARLY = checkpoint_features(COURSES, 2)


@query("m19_early_model", with_(*EXAM_BASE, "early AS (SELECT * FROM exk WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in EARLY) + ")",
                                *cv_sql("e50", "early", EARLY, "outcome", ALPHA, reps=10),
                                "es AS (SELECT count(*) AS n_folds, avg(r2) AS m, stddev_pop(r2) AS s, avg(mae) AS mm FROM e50_ev)")
       + (f"SELECT n_folds, {p6('m')} AS r2_mean, {p6('m - 1.96 * s / sqrt(n_folds)')} AS r2_ci_low, {p6('m + 1.96 * s / sqrt(n_folds)')} AS r2_ci_high, "
          f"{p6('mm')} AS mae_mean, CASE WHEN m - 1.96 * s / sqrt(n_folds) > 0.15 THEN 'HIGH' ELSE 'MODERATE' END AS useful_for_warning FROM es"))
def m19_early_model(spark: SparkSession, sf_dir: str):
    """Model on the first two courses only, repeated CV with CI."""
    ex, _ = _exam_world(spark, sf_dir)
    s = linear.cv_summary(_cv_folds(spark, sf_dir, reps=10, feats=EARLY, data=clean.drop_null(ex, EARLY)))
    return s.select("n_folds", "r2_mean", "r2_ci_low", "r2_ci_high", "mae_mean",
                    confidence_useful("r2_ci_low").alias("useful_for_warning"))


# ---------------------------------------------------------------------------
# two-class models (R6 labelled documents, R8 retake)
# ---------------------------------------------------------------------------

from .oracle import DOCFEATS, auc_summary_sql, logistic_ctes, logistic_cv_ctes  # noqa: E402

DOC_FEATS = ["n_chars", "n_words", "n_lines", "digit_share"]


def _docs_std(spark, sf_dir):
    d = clean.drop_null(fx.document_features(spark, sf_dir), DOC_FEATS)
    sc = pl.features.fit_scaler(d, DOC_FEATS)
    return pl.features.apply_scaler(d, sc)


DOC_COMPLETE = "dcc AS (SELECT * FROM docfeats WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in DOC_FEATS) + ")"
DOC_ALL = "dall AS (SELECT 0 AS rep, 0 AS hold, label, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE stddev_pop({c}) OVER () END AS {c}" for c in DOC_FEATS) + " FROM dcc)"


@query("m9_logistic", with_(DOCFEATS, DOC_COMPLETE, DOC_ALL, *logistic_ctes("lg", "dall", DOC_FEATS, "label")) + " UNION ALL ".join(
    f"SELECT '{term}' AS term, {p6(f'b[{i + 1}]', 4)} AS coef_mllib, {p6(f'b[{i + 1}]', 4)} AS coef_newton FROM lg_beta" for i, term in enumerate(["intercept", *DOC_FEATS])), decimals=4)
def m9_logistic(spark: SparkSession, sf_dir: str):
    """M9: L2 logistic regression (C = 1) on standardised document features
    with Spark ML, next to the grouped-Newton fit of the same objective."""
    d = _docs_std(spark, sf_dir)
    model = classify.mllib_logistic(d, DOC_FEATS, "label")
    beta = classify.logistic_newton(d, DOC_FEATS, "label")[()]
    rows = [("intercept", float(model.intercept), float(beta[0]))] + [
        (f, float(w), float(b)) for f, w, b in zip(DOC_FEATS, model.coefficients.toArray(), beta[1:])]
    return spark.createDataFrame(rows, "term string, coef_mllib double, coef_newton double")


def _logistic_cv(d, feats, label, reps=10, k=5):
    """Repeated CV of the logistic model: AUC and accuracy per (rep, fold)."""
    names = [f"_fold{r}" for r in range(reps)]
    folds = splits.fold_columns(d, "entity_id", k, 42, reps)
    return classify.logistic_cv(d.withColumns(dict(zip(names, folds))), feats, label, names, k)


def auc_summary(folds):
    """Mean AUC with its 95 % interval and class, mean accuracy, over folds."""
    s = folds.agg(F.count(F.lit(1)).alias("n_folds"), F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
                  F.avg("accuracy").alias("accuracy_mean"))
    half = F.lit(1.96) * F.col("auc_std") / F.sqrt(F.col("n_folds").cast("double"))
    return s.withColumns({"auc_ci_low": F.col("auc_mean") - half, "auc_ci_high": F.col("auc_mean") + half,
                          "auc_class": auc_class("auc_mean")})


@query("m10_auc_cv", with_(DOCFEATS, DOC_COMPLETE, *logistic_cv_ctes("lc", "dcc", DOC_FEATS, "label")) + auc_summary_sql(p6, "lc_ev"))
def m10_auc_cv(spark: SparkSession, sf_dir: str):
    """M10 + M11 + F16: repeated 5 x 10 CV of the logistic model (50 fits in
    one blocked Newton loop), exact AUC and accuracy per fold, summary."""
    return auc_summary(_logistic_cv(cut_lineage(_docs_std(spark, sf_dir)), DOC_FEATS, "label"))


AUC_SQL = with_(DOCFEATS, "rk AS (SELECT label, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rnk FROM docfeats)",
                "u AS (SELECT sum(rnk) FILTER (WHERE label = 1) AS rs, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM rk)")


@query("m10_auc_feature", AUC_SQL + f"SELECT {p6('(rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg)')} AS auc, n_pos, n_neg FROM u")
def m10_auc_feature(spark: SparkSession, sf_dir: str):
    """Exact ROC AUC of one score (document length for quality), ties
    counted one half, via distributed prefix sums."""
    return classify.exact_auc(fx.document_features(spark, sf_dir), "label", "n_chars")


@query("f16_auc_class", AUC_SQL + "SELECT CASE WHEN a > 0.8 THEN 'GOOD' WHEN a > 0.7 THEN 'MODERATE' WHEN a IS NOT NULL THEN 'WEAK' END AS auc_class FROM (SELECT (rs - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS a FROM u)")
def f16_auc_class(spark: SparkSession, sf_dir: str):
    """F16: AUC class (0.8 / 0.7)."""
    return classify.exact_auc(fx.document_features(spark, sf_dir), "label", "n_chars").select(auc_class("auc").alias("auc_class"))


@query("m11_rule_accuracy", with_(DOCFEATS) + f"SELECT {p6('avg(((n_words >= 100)::INTEGER = label)::INTEGER)')} AS accuracy FROM docfeats")
def m11_rule_accuracy(spark: SparkSession, sf_dir: str):
    """Accuracy of a thresholded score against the label."""
    d = fx.document_features(spark, sf_dir).withColumn("pred", (F.col("n_words") >= 100).cast("int"))
    return evaluate.accuracy(d, "label", "pred")


def _retake_t_sql() -> str:
    from .catalog_relational import RETAKE
    from .oracle import ATTEMPTS, WIDE
    parts = []
    for c in SC:
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) FILTER (WHERE needed_retake = 0) AS n0, count({c}) FILTER (WHERE needed_retake = 1) AS n1, "
            f"avg({c}) FILTER (WHERE needed_retake = 0) AS mean_0, avg({c}) FILTER (WHERE needed_retake = 1) AS mean_1, "
            f"var_samp({c}) FILTER (WHERE needed_retake = 0) AS v0, var_samp({c}) FILTER (WHERE needed_retake = 1) AS v1 FROM rl")
    from .oracle import stars_sql, t_p_sql
    return with_(WIDE, ATTEMPTS, RETAKE, f"s AS ({' UNION ALL '.join(parts)})",
                 "tt AS (SELECT *, mean_0 - mean_1 AS diff, CASE WHEN sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) = 0 THEN NULL ELSE "
                 "(mean_0 - mean_1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) END AS t, n0 + n1 - 2 AS dof FROM s WHERE n0 > 5 AND n1 > 5)",
                 f"tp AS (SELECT *, {t_p_sql('t', 'dof')} AS p FROM tt)") + (
        f"SELECT feature, n0, n1, {p6('mean_0')} AS mean_0, {p6('mean_1')} AS mean_1, {p6('diff')} AS diff, {p6('t')} AS t, {p6('p')} AS p, {stars_sql('p', '')} AS stars FROM tp")


@query("q11_retake_analysis", _retake_t_sql())
def q11_retake_analysis(spark: SparkSession, sf_dir: str):
    """Q11: score differences between entities that needed a retake and
    those that did not (pooled t-test per score, blank for ns)."""
    return stats.two_sample_t(fx.retake_labels(spark, sf_dir), SC, "needed_retake", not_significant="")


def _retake_std(spark, sf_dir):
    """Complete retake rows with standardised scores, aggregated once."""
    r = cut_lineage(clean.drop_null(fx.retake_labels(spark, sf_dir), SC))
    return pl.features.apply_scaler(r, pl.features.fit_scaler(r, SC))


def retake_ctes() -> list[str]:
    """CTE ``rcc``: complete retake rows; ``rt_ev``: their model's folds."""
    from .catalog_relational import RETAKE
    from .oracle import ATTEMPTS
    return [WIDE, ATTEMPTS, RETAKE, "rcc AS (SELECT * FROM rl WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in SC) + ")",
            *logistic_cv_ctes("rt", "rcc", SC, "needed_retake")]


@query("q11_retake_logistic", with_(*retake_ctes()) + f"SELECT rep, fold, {p6('auc')} AS auc, n_pos, n_neg, {p6('accuracy')} AS accuracy FROM rt_ev")
def q11_retake_logistic(spark: SparkSession, sf_dir: str):
    """Q11: can scores predict a retake?  Logistic 10 x 5 CV on complete
    rows, exact AUC and accuracy per fold (blocked Newton fits)."""
    return _logistic_cv(_retake_std(spark, sf_dir), SC, "needed_retake").select("rep", "fold", "auc", "n_pos", "n_neg", "accuracy")


# ---------------------------------------------------------------------------
# trees (rows-only: Spark ML forests are not reproducible in SQL)
# ---------------------------------------------------------------------------

def _tree_world(spark, sf_dir):
    wide, out, prep, fit, scored = _linear_world(spark, sf_dir)
    t = cut_lineage(prep.table.withColumn("split", splits.split_column(prep.table, "entity_id")))
    return wide, out, prep, fit, scored, t


@query("m4_random_forest")
def m4_random_forest(spark: SparkSession, sf_dir: str):
    """M4: random forest (100 trees, depth 10, all features per split),
    train/test metrics."""
    _, _, prep, _, _, t = _tree_world(spark, sf_dir)
    model = trees.random_forest(t.filter(F.col("split") == "train"), prep.features, "outcome")
    p = trees.predict(model, t, prep.features, "pred").withColumn("model", F.lit("random_forest"))
    return evaluate.regression_metrics(p, "outcome", "pred", ["model", "split"])


@query("m4b_boosted_trees")
def m4b_boosted_trees(spark: SparkSession, sf_dir: str):
    """Gradient-boosted trees (100 rounds, depth 5, rate 0.1)."""
    _, _, prep, _, _, t = _tree_world(spark, sf_dir)
    model = trees.boosted_trees(t.filter(F.col("split") == "train"), prep.features, "outcome")
    p = trees.predict(model, t, prep.features, "pred").withColumn("model", F.lit("boosted_trees"))
    return evaluate.regression_metrics(p, "outcome", "pred", ["model", "split"])


def _compare(spark, sf_dir):
    _, _, prep, fit, scored, t = _tree_world(spark, sf_dir)
    parts = [scored.withColumn("model", F.lit("linear"))]
    sc = prep.scaler
    ridge = linear.fit_linear(t.filter(F.col("split") == "train"), prep.features, "outcome", ALPHA,
                              [sc.mean[c] for c in prep.features], [sc.scale(c) for c in prep.features])
    parts.append(t.select("entity_id", "outcome", "split", ridge.predict().alias("pred")).withColumn("model", F.lit("ridge")))
    train = t.filter(F.col("split") == "train")
    rf, gb = trees.side_by_side(spark, [lambda: trees.random_forest(train, prep.features, "outcome"),
                                        lambda: trees.boosted_trees(train, prep.features, "outcome")])
    parts.append(trees.predict(rf, t, prep.features, "pred").withColumn("model", F.lit("random_forest")))
    parts.append(trees.predict(gb, t, prep.features, "pred").withColumn("model", F.lit("boosted_trees")))
    long = None
    for p in parts:
        m = evaluate.regression_metrics(p.select("model", "split", "outcome", "pred"), "outcome", "pred", ["model", "split"])
        long = m if long is None else long.unionByName(m)
    return evaluate.metrics_wide(long)


@query("m8_compare_models")
def m8_compare_models(spark: SparkSession, sf_dir: str):
    """M8 + M7 + F17: linear, ridge, forest and boosting side by side."""
    return _compare(spark, sf_dir)


@query("o5_best_model")
def o5_best_model(spark: SparkSession, sf_dir: str):
    """The model with the highest test R^2."""
    return evaluate.best_model(_compare(spark, sf_dir))


@query("e4_tree_importances")
def e4_tree_importances(spark: SparkSession, sf_dir: str):
    """Normalised forest importances, engineered features marked new."""
    _, _, prep, _, _, t = _tree_world(spark, sf_dir)
    model = trees.random_forest(t, prep.features, "outcome", max_depth=5)
    return trees.importances(spark, model, prep.features, new_features=ENG)


@query("m16_tree_spread")
def m16_tree_spread(spark: SparkSession, sf_dir: str):
    """M16 + F9: forest prediction with per-tree std and a +-1.96 std band
    for the current cohort, tiered."""
    wide, out, prep, _, _, t = _tree_world(spark, sf_dir)
    model = trees.random_forest(t, prep.features, "outcome", max_depth=5)
    cur = pl.apply_preprocess(cohort.current_cohort(wide, out), prep)
    sp = trees.tree_spread(model, cur.select("entity_id", *prep.features), prep.features)
    return risk.tiered(sp.select("entity_id", "predicted", "pred_std", "pred_low", "pred_high"), TH)


@query("m15_predict_no_outcome")
def m15_predict_no_outcome(spark: SparkSession, sf_dir: str):
    """M15 + F10: forest trained on entities with an outcome predicts the
    complete-exam entities without one; fixed-cut tiers."""
    ex = fx.exam_scores(spark, sf_dir, with_name=False).join(fx.outcomes(spark, sf_dir), "entity_id", "left")
    cc = clean.drop_null(ex, EX)
    model = trees.random_forest(cc.filter(F.col("outcome").isNotNull()), EX, "outcome", max_depth=5)
    p = trees.predict(model, cc.filter(F.col("outcome").isNull()), EX, "predicted")
    return p.select("entity_id", "predicted", fixed_tier("predicted").alias("tier"))


@query("m7_ridge_metrics", with_(*RIDGE) + (
    f"SELECT 'ridge' AS model, split, count(*) AS n, {p6('avg(abs(outcome - pred))')} AS mae, "
    f"{p6('sqrt(avg((outcome - pred) * (outcome - pred)))')} AS rmse, "
    f"{p6('1.0 - sum((outcome - pred) * (outcome - pred)) / (var_pop(outcome) * count(*))')} AS r2 FROM rp GROUP BY split"))
def m7_ridge_metrics(spark: SparkSession, sf_dir: str):
    """M7: MAE / RMSE / R^2 on train and test of the exam ridge model."""
    _, scored = _ridge_scored(spark, sf_dir)
    return evaluate.regression_metrics(scored.withColumn("model", F.lit("ridge")), "outcome", "pred", ["model", "split"])


@query("a12_ridge_residual_stats", with_(*RIDGE) + f"SELECT {p6('avg(outcome - pred)')} AS mean_residual, {p6('stddev_pop(outcome - pred)')} AS std_residual, count(*) AS n FROM rp WHERE split = 'test'")
def a12_ridge_residual_stats(spark: SparkSession, sf_dir: str):
    """Mean and population std of the exam ridge model's test residuals."""
    from ..operators.profile import residual_stats
    _, scored = _ridge_scored(spark, sf_dir)
    return residual_stats(scored.filter(F.col("split") == "test").withColumn("residual", F.col("outcome") - F.col("pred")))


@query("m17_checkpoints_contiguous", with_(EXAMS, _OUTC, EXO_K, *_checkpoint_sql(("midterm", "final"), "cc5", contiguous=True)) + _checkpoint_final("cc5"))
def m17_checkpoints_contiguous(spark: SparkSession, sf_dir: str):
    """M17 with the reference's unshuffled contiguous 5-fold split (W3) per
    checkpoint, computed from distributed ranks."""
    return _checkpoint_cv(spark, sf_dir, ("midterm", "final"), contiguous=True)


@query("f17_overfit_flag_ge", with_(*RIDGE, "mm AS (SELECT split, 1.0 - sum((outcome - pred) * (outcome - pred)) / (var_pop(outcome) * count(*)) AS r2 FROM rp GROUP BY split)") + (
    f"SELECT 'ridge' AS model, {p6('max(r2) FILTER (WHERE split = ' + chr(39) + 'train' + chr(39) + ') - max(r2) FILTER (WHERE split = ' + chr(39) + 'test' + chr(39) + ')')} AS r2_gap, "
    "(max(r2) FILTER (WHERE split = 'train') - max(r2) FILTER (WHERE split = 'test')) >= 0.2 AS overfit FROM mm"))
def f17_overfit_flag_ge(spark: SparkSession, sf_dir: str):
    """F17 (second rule): gap of at least 0.2 counts as overfitting."""
    from ..functions.labels import overfit_flag_ge
    _, scored = _ridge_scored(spark, sf_dir)
    m = evaluate.regression_metrics(scored.withColumn("model", F.lit("ridge")), "outcome", "pred", ["model", "split"])
    w = evaluate.metrics_wide(m)
    return w.select("model", "r2_gap", overfit_flag_ge("train_r2", "test_r2").alias("overfit"))


@query("q3_linear_cv", with_(*PREP_CTES, *cv_sql("f5", "prep", FEATS, "outcome", 0.0))
       + f"SELECT fold, n_train, n_test, {p6('r2')} AS r2 FROM f5_ev")
def q3_linear_cv(spark: SparkSession, sf_dir: str):
    """Q3 / M5: 5-fold CV (digest order) of the main OLS model from fold moments;
    fold R^2 (MAE of this near-collinear design is engine-sensitive in the
    7th digit and is reported by ``m7_linear_metrics``)."""
    _, _, merged = pl.load_and_merge(spark, sf_dir)
    prep = pl.preprocess(merged, SC)
    d = prep.table.withColumn("fold", splits.fold_columns(prep.table, "entity_id", 5, 42)[0])
    return linear.cv_linear(d, prep.features, "outcome", "fold", alpha=0.0, with_mae=False)
