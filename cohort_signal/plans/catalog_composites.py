"""Catalogue: composites over several models or cohorts (Q3 cross-validation,
Q4, Q11 model, Q12, Q13, T11, M13 with forests)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import conclusions, evaluate, explain, features, linear, profile, risk, splits, stats, trees
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as fx
from ..sources import gradebooks, io
from . import catalog_models as cm
from . import catalog_pipelines as cp
from . import catalog_relational as cr
from . import catalog_stats as cs
from . import pipelines as pl
from .catalog import p6, query, significant
from .oracle import (EXAMS, OUTC, auc_summary_sql, centred_sql, cv_sql, in_test, normal_p_sql, refined_ctes, row_mean_sql,
                     row_var_sql, stars_sql, t_p_sql, with_)

EX, SC, TH = cm.EX, cm.SC, cm.TH
#: Repeats of the cross-validations, as the reference runs them.
REPEATS, FOLDS = 10, 5


# ---------------------------------------------------------------------------
# Evidence and conclusions
# ---------------------------------------------------------------------------

EARLY_NAME = fx.COURSES[1]


def _evidence_ctes() -> list[str]:
    ci = "tanh(atanh(r) {} 1.96 * (1.0 / sqrt((n - 3)::DOUBLE)))"
    nul = "NULL::DOUBLE"
    return [
        *cs.PEARSON, cm.EXO_K, cm.CC, *cv_sql("k50", "cc", EX, "outcome", cm.ALPHA, reps=10),
        "early AS (SELECT * FROM exk WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cm.EARLY) + ")",
        *cv_sql("e50", "early", cm.EARLY, "outcome", cm.ALPHA, reps=10),
        "rk AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, feature) AS top, row_number() OVER (ORDER BY abs(r), feature DESC) AS low FROM pp)",
        "two AS (SELECT max(feature) FILTER (WHERE top = 2) AS top2, max(n) FILTER (WHERE top = 1) AS n1, (atanh(max(r) FILTER (WHERE top = 1)) - atanh(max(r) FILTER (WHERE top = 2))) "
        "/ sqrt(2.0 / (max(n) FILTER (WHERE top = 1) - 3)::DOUBLE) AS z FROM rk)",
        "mk AS (SELECT count(*) AS k, avg(r2) AS m, stddev_pop(r2) AS s, avg(mae) AS a, stddev_pop(mae) AS b FROM k50_ev)",
        "ek AS (SELECT count(*) AS k, avg(r2) AS m, stddev_pop(r2) AS s FROM e50_ev)",
        "ev AS (" + " UNION ALL ".join([
            f"SELECT 'tested_correlations' AS statistic, 'features' AS subject, {nul} AS value, {nul} AS ci_low, {nul} AS ci_high, {nul} AS p, count(*) AS n FROM pp",
            f"SELECT 'significant_correlations', 'features', avg(abs(r)), {nul}, {nul}, {nul}, count(*) FILTER (WHERE p < 0.001) FROM pp",
            f"SELECT 'strongest_r', feature, r, {ci.format('-')}, {ci.format('+')}, p, n FROM rk WHERE top = 1",
            f"SELECT 'strongest_vs_second', top2, z, {nul}, {nul}, {normal_p_sql('z')}, n1 FROM two",
            f"SELECT 'weakest_r', feature, r, {ci.format('-')}, {ci.format('+')}, p, n FROM rk WHERE low = 1",
            f"SELECT 'model_r2', 'ridge', m, m - 1.96 * s / sqrt(k), m + 1.96 * s / sqrt(k), {nul}, k FROM mk",
            f"SELECT 'early_r2', '{EARLY_NAME}', m, m - 1.96 * s / sqrt(k), m + 1.96 * s / sqrt(k), {nul}, k FROM ek",
            f"SELECT 'model_mae', 'ridge', a, a - 1.96 * b / sqrt(k), a + 1.96 * b / sqrt(k), {nul}, k FROM mk",
            f"SELECT 'worst_case_error', 'ridge', a + 2.0 * b, {nul}, {nul}, {nul}, k FROM mk"]) + ")"]


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ex, cc = cm._exam_world(spark, sf_dir)
    tests = cut_lineage(stats.pearson_tests(cs._exo(spark, sf_dir), EX, "outcome", min_pairs=10))
    model = linear.cv_summary(cm._cv_folds(spark, sf_dir, reps=10, data=cc))
    early = linear.cv_summary(cm._cv_folds(spark, sf_dir, reps=10, feats=cm.EARLY, data=clean.drop_null(ex, cm.EARLY)))
    return conclusions.evidence(tests, model, early, "ridge", EARLY_NAME)


@query("q12_confidence_report", with_(*_evidence_ctes())
       + f"SELECT statistic, subject, {p6('value')} AS value, {p6('ci_low')} AS ci_low, {p6('ci_high')} AS ci_high, {p6('p')} AS p, n FROM ev")
def q12_confidence_report(spark: SparkSession, sf_dir: str):
    """Q12: the statistics behind the conclusions."""
    return _evidence(spark, sf_dir)


_GRADE = ("CASE statistic WHEN 'significant_correlations' THEN CASE WHEN n = tested AND n > 0 THEN 'VERY HIGH' WHEN n > 0 THEN 'MODERATE' WHEN n IS NOT NULL THEN 'LOW' END "
          "WHEN 'strongest_r' THEN CASE WHEN ci_low * ci_high > 0 THEN 'HIGH' WHEN ci_low IS NOT NULL THEN 'LOW' END "
          "WHEN 'strongest_vs_second' THEN CASE WHEN p < 0.05 THEN 'HIGH' WHEN p IS NOT NULL THEN 'MODERATE' END "
          "WHEN 'weakest_r' THEN CASE WHEN top_low * top_high > 0 AND greatest(abs(ci_low), abs(ci_high)) < least(abs(top_low), abs(top_high)) THEN 'HIGH' WHEN ci_low IS NOT NULL THEN 'MODERATE' END "
          "WHEN 'model_r2' THEN CASE WHEN ci_low > 0 THEN 'HIGH' WHEN ci_low IS NOT NULL THEN 'LOW' END "
          "WHEN 'early_r2' THEN CASE WHEN ci_low > 0.15 THEN 'HIGH' WHEN ci_low IS NOT NULL THEN 'MODERATE' END "
          "WHEN 'model_mae' THEN CASE WHEN ci_high - ci_low < 0.2 * value THEN 'HIGH' WHEN ci_low IS NOT NULL THEN 'MODERATE' END END")


@query("t11_conclusions", with_(
    *_evidence_ctes(),
    "claims AS (SELECT * FROM (VALUES ('significant_correlations', 1, 'features_relate_to_outcome'), ('strongest_r', 2, 'among_the_strongest'), ('strongest_vs_second', 3, 'strongest_of_all'), "
    "('weakest_r', 4, 'weakest_of_all'), ('model_r2', 5, 'model_explains_outcome'), ('early_r2', 6, 'early_warning_works'), ('model_mae', 7, 'error_is_known')) v(statistic, claim_no, claim))",
    "w AS (SELECT max(n) FILTER (WHERE statistic = 'tested_correlations') AS tested, max(ci_low) FILTER (WHERE statistic = 'strongest_r') AS top_low, max(ci_high) FILTER (WHERE statistic = 'strongest_r') AS top_high FROM ev)")
    + f"SELECT claim_no::INTEGER AS claim_no, claim, subject, {_GRADE} AS confidence, {p6('value')} AS value, {p6('ci_low')} AS ci_low, {p6('ci_high')} AS ci_high, {p6('p')} AS p FROM ev JOIN claims USING (statistic) CROSS JOIN w")
def t11_conclusions(spark: SparkSession, sf_dir: str):
    """Seven claims with their confidence, graded from the evidence."""
    return conclusions.conclusions(_evidence(spark, sf_dir))


# ---------------------------------------------------------------------------
# Q4: importance with attributions
# ---------------------------------------------------------------------------

@query("q4_importance", with_(*cm.LIN, cm.E1, cm._perm_sql(), "bg AS (SELECT " + ", ".join(f"avg({c}) AS bm{i}" for i, c in enumerate(cm.FEATS)) + " FROM pr WHERE split = 'test')",
                              "attr AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(abs(coef[{i + 1}] * ({c} - bm{i}))) AS mean_abs_attribution, max(abs(coef[{i + 1}] * ({c} - bm{i}))) AS max_abs_attribution "
                                                             f"FROM pr CROSS JOIN fit_coef CROSS JOIN bg WHERE split = 'test'" for i, c in enumerate(cm.FEATS)) + ")")
       + "SELECT feature, " + ", ".join(f"{significant(c, cm.DIGITS)} AS {c}" for c in ("coef", "importance", "mean_abs_attribution", "max_abs_attribution"))
       + ", row_number() OVER (ORDER BY mean_abs_attribution DESC, feature)::INTEGER AS rank FROM e1 JOIN perm USING (feature) JOIN attr USING (feature)", digits=cm.DIGITS)
def q4_importance(spark: SparkSession, sf_dir: str):
    """Q4: the three explanations of the main linear model side by side:
    coefficient (E1), permutation importance (E2) and the size of the
    attributions (E3) on the test rows, ranked by the last."""
    _, _, _, fit, scored = cm._linear_world(spark, sf_dir)
    test = scored.filter(F.col("split") == "test")
    attributed = explain.attributions(test, fit, "entity_id").groupBy("feature").agg(
        F.avg(F.abs("attribution")).alias("mean_abs_attribution"), F.max(F.abs("attribution")).alias("max_abs_attribution"))
    both = explain.combined_importance(explain.coefficients(spark, fit), explain.permutation_importance(test, fit, "outcome"))
    return explain.ranked(both.join(attributed, "feature").select("feature", "coef", "importance", "mean_abs_attribution", "max_abs_attribution"),
                          "mean_abs_attribution")


# ---------------------------------------------------------------------------
# Cross-validated model and feature-set comparison
# ---------------------------------------------------------------------------

def _forest(feats, depth):
    return lambda d: trees.random_forest(d, feats, "outcome", max_depth=depth)


def _fold_names(df: DataFrame, repeats: int) -> tuple[DataFrame, list[str]]:
    names = [f"_fold{r}" for r in range(repeats)]
    return df.withColumns(dict(zip(names, splits.fold_columns(df, "entity_id", FOLDS, 42, repeats)))), names


@query("q3_model_cv")
def q3_model_cv(spark: SparkSession, sf_dir: str):
    """Q3 / M5: 5-fold CV of the linear model, the forest (100 trees, depth
    10) and boosting (100 rounds) on the same folds: one row per model and
    fold."""
    _, _, merged = pl.load_and_merge(spark, sf_dir)
    prep = pl.preprocess(merged, SC)
    table = cut_lineage(prep.table.select("entity_id", *prep.features, F.col("outcome").cast("double").alias("outcome")))
    data, names = _fold_names(table, 1)
    feats = prep.features
    lin = linear.repeated_cv(data, feats, "outcome", names).select("rep", "fold", "n_test", "r2", "mae")
    parts = {"linear": lin, "random_forest": trees.cv_trees(data, feats, "outcome", names, FOLDS, _forest(feats, 10)),
             "boosted_trees": trees.cv_trees(data, feats, "outcome", names, FOLDS, lambda d: trees.boosted_trees(d, feats, "outcome"))}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("model"), "fold", "n_test", "r2", "mae")
        out = part if out is None else out.unionByName(part)
    return out


def _feature_sets(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, list[str]]]:
    """(name, complete rows with outcome, features): exams alone, and with the
    remediation flags and their total."""
    _, cc = cm._exam_world(spark, sf_dir)
    enhanced = cc.join(fx.remediation_flags(spark, sf_dir), "entity_id")
    enhanced = clean.drop_null(enhanced, cr.FLAG_COLS).withColumn("total_remediations", features.total_flags(cr.FLAG_COLS))
    return [("original", cc, EX), ("enhanced", cut_lineage(enhanced), EX + cp.FLAGS_T)]


@query("m13_feature_sets_forest")
def m13_feature_sets_forest(spark: SparkSession, sf_dir: str):
    """M13 with the reference's model: original and enhanced features, each by
    10 x 5 repeated CV of a depth-5 forest: R^2 with interval and MAE."""
    out = None
    for name, data, feats in _feature_sets(spark, sf_dir):
        rows = data.count()
        folded, names = _fold_names(data.select("entity_id", *feats, F.col("outcome").cast("double").alias("outcome")), REPEATS)
        s = linear.cv_summary(trees.cv_trees(folded, feats, "outcome", names, FOLDS, _forest(feats, 5)))
        r = s.select(F.lit(name).alias("feature_set"), F.lit(len(feats)).alias("n_features"), F.lit(rows).cast("long").alias("n_rows"), "n_folds",
                     "r2_mean", "r2_ci_low", "r2_ci_high", "mae_mean")
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------------------
# Q13: enhanced risk list
# ---------------------------------------------------------------------------

def _enhanced_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity with all exams and flags, its name, its outcome where
    known and its number of attempts."""
    ex = fx.exam_scores(spark, sf_dir)
    t = ex.join(fx.remediation_flags(spark, sf_dir), "entity_id")
    t = clean.drop_null(t, EX + cr.FLAG_COLS).withColumn("total_remediations", features.total_flags(cr.FLAG_COLS))
    n = fx.attempts(spark, sf_dir).groupBy("entity_id").agg(F.count(F.lit(1)).alias("total_attempts"))
    out = fx.outcomes(spark, sf_dir).select("entity_id", F.col("outcome").cast("double").alias("outcome"))
    return cut_lineage(t.join(out, "entity_id", "left").join(n, "entity_id", "left"))


def _risk_list(spark: SparkSession, sf_dir: str) -> tuple[object, DataFrame]:
    """The final forest (depth 5, all rows with an outcome) and a row per
    complete entity: prediction, band of the trees, tier."""
    cohort = _enhanced_cohort(spark, sf_dir)
    feats = EX + cp.FLAGS_T
    model = trees.random_forest(cohort.filter("outcome is not null"), feats, "outcome", max_depth=5)
    spread = trees.tree_spread(model, cohort, feats)
    return model, risk.tiered(spread, TH).select("entity_id", "name", "predicted", "pred_std", "pred_low", "pred_high", "risk_level", "outcome", "total_attempts")


@query("q13_enhanced_risk_list")
def q13_enhanced_risk_list(spark: SparkSession, sf_dir: str):
    """Q13: one row per complete entity, with or without an outcome: the final
    forest's prediction on the enhanced features, the +-1.96 std band over its
    trees (M16), tier (F9), actual outcome and attempts, riskiest first."""
    return _risk_list(spark, sf_dir)[1].orderBy("predicted", "entity_id")


@query("q13_tier_counts")
def q13_tier_counts(spark: SparkSession, sf_dir: str):
    """Q13 / A5: tier counts of the enhanced risk list."""
    return risk.tier_counts(_risk_list(spark, sf_dir)[1])


@query("q13_accuracy")
def q13_accuracy(spark: SparkSession, sf_dir: str):
    """pass/fail confusion of the risk list over entities whose
    outcome is known (in-sample, as in the reference)."""
    return evaluate.confusion(_risk_list(spark, sf_dir)[1], "outcome", "predicted", TH)


@query("q13_importances")
def q13_importances(spark: SparkSession, sf_dir: str):
    """The 15 most important features of the final forest, the
    enhancement features marked."""
    model, _ = _risk_list(spark, sf_dir)
    return trees.importances(spark, model, EX + cp.FLAGS_T, new_features=cp.FLAGS_T).limit(15)


# ---------------------------------------------------------------------------
# Q11: the retake model as reported
# ---------------------------------------------------------------------------

@query("q11_retake_model", with_(*cm.retake_ctes()) + auc_summary_sql(p6, "rt_ev", ", (SELECT count(*) FROM rcc) AS n_rows, " + p6("(SELECT avg(needed_retake) FROM rcc)") + " AS retake_share"))
def q11_retake_model(spark: SparkSession, sf_dir: str):
    """10 x 5 CV of the retake model: mean AUC with its 95 %
    interval and class, mean accuracy, rows and share that needed a retake."""
    data = cm._retake_std(spark, sf_dir)
    share = data.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("needed_retake").alias("retake_share"))
    return cm.auc_summary(cm._logistic_cv(data, SC, "needed_retake")).crossJoin(F.broadcast(share))


@query("q11_no_outcome_tiers")
def q11_no_outcome_tiers(spark: SparkSession, sf_dir: str):
    """Entities without an outcome, their predicted outcome by the
    depth-5 forest of the others and the number in each fixed tier (F10)."""
    return cm.m15_predict_no_outcome(spark, sf_dir).groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.avg("predicted").alias("mean_predicted"),
                                                                       F.min("predicted").alias("min_predicted"))


# ---------------------------------------------------------------------------
# Q6: extraction from several gradebooks
# ---------------------------------------------------------------------------

BOOKS = [gradebooks.Course("a", "course_a", {"a_final": fx.GRADEBOOK_EXAM_COLUMN, "a_midterm": "Midterm"}),
         gradebooks.Course("b", "course_b", {"b_midterm": "Midterm, part 1 (201)", "b_final": "Final (202)"}),
         gradebooks.Course("c", "course_c", {"c_quiz": "Quiz"}),
         gradebooks.Course("d", "course_d", {"d_final": "Final"})]


@query("q6_several_gradebooks", "SELECT c_custkey AS entity_id, c_name AS name, "
       + f"CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 THEN {p6('c_acctbal')} END AS a_final, NULL::DOUBLE AS a_midterm, "
       "CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey * 3.0::DOUBLE END AS b_midterm, CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 THEN c_custkey % 100 + 0.5::DOUBLE END AS b_final, "
       "CASE WHEN c_custkey % 4 = 0 THEN o.n::DOUBLE END AS c_quiz, NULL::DOUBLE AS d_final "
       "FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey "
       f"WHERE c_custkey BETWEEN {fx.GRADEBOOK_ID_RANGE[0]} AND {fx.GRADEBOOK_ID_RANGE[1]}")
def q6_several_gradebooks(spark: SparkSession, sf_dir: str):
    """The gradebook of each course found by name
    among several, read under its own header, cleaned and merged over all
    courses; a course without a gradebook and a missing exam give nulls."""
    return gradebooks.extract_courses(spark, cr._gradebook_files(spark, sf_dir), BOOKS, fx.GRADEBOOK_ID_RANGE)


@query("s8_write_report", cm.Q5_SQL)
def s8_write_report(spark: SparkSession, sf_dir: str):
    """Write the at-risk report as CSV, riskiest first, read its text back
    and give it the types that were written."""
    report = pl.early_warning(spark, sf_dir)
    path = io.write_table(report, scratch_path(spark, "at_risk"), fmt="csv")
    return io.with_types(io.read_assessments(spark, path, fmt="csv", key="entity_id"), report.schema)


# ---------------------------------------------------------------------------
# Q7: the enhanced table
# ---------------------------------------------------------------------------

FORMATIVE = [c.replace("s_", "") + "_formative" for c in SC]


def _enhanced_sql() -> str:
    cols = []
    for (prio, c), f, flag in zip(fx.PRIORITY_COLUMNS.items(), FORMATIVE, cr.FLAG_COLS):
        of = f"o_orderpriority = '{prio}'"
        score = "o_totalprice / 5000.0"
        cols += [f"coalesce(avg(CASE WHEN {of} AND o_orderstatus = 'F' THEN {score} END), avg(CASE WHEN {of} THEN {score} END)) AS {c}",
                 f"avg(CASE WHEN {of} AND o_orderstatus = 'O' THEN {score} END) AS {f}",
                 f"max(CASE WHEN {of} THEN (o_orderstatus = 'F')::INTEGER END) AS {flag}"]
    inner = f"SELECT o_custkey AS entity_id, {', '.join(cols)} FROM orders GROUP BY o_custkey"
    return ("SELECT entity_id, " + ", ".join(f"{p6(c)} AS {c}" for c in SC + FORMATIVE) + ", " + ", ".join(cr.FLAG_COLS)
            + ", (" + " + ".join(f"coalesce({c}, 0)" for c in cr.FLAG_COLS) + f")::INTEGER AS total_remediations FROM ({inner})")


@query("q7_enhanced_table", _enhanced_sql())
def q7_enhanced_table(spark: SparkSession, sf_dir: str):
    """The scores with a re-run's values over the old
    ones where it has any, the numeric add-on scores, the remediation flags and
    their total: one row per entity from one scan.  The re-run's values are
    those of finished orders, the add-on scores those of open ones."""
    orders = fx.table(spark, sf_dir, "orders")
    prio, status, value = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice") / F.lit(fx.SCORE_DIVISOR)
    finished = (status == "F").cast("int")
    aggs = []
    for (p, c), f, flag in zip(fx.PRIORITY_COLUMNS.items(), FORMATIVE, cr.FLAG_COLS):
        old, new = F.avg(F.when(prio == p, value)), F.avg(F.when((prio == p) & (status == "F"), value))
        aggs += [F.coalesce(new, old).alias(c), F.avg(F.when((prio == p) & (status == "O"), value)).alias(f), F.max(F.when(prio == p, finished)).alias(flag)]
    table = orders.groupBy(F.col("o_custkey").alias("entity_id")).agg(*aggs)
    return table.select("entity_id", *SC, *FORMATIVE, *cr.FLAG_COLS, features.total_flags(cr.FLAG_COLS).alias("total_remediations"))


@query("q7_formative_tests", with_("en AS (" + _enhanced_sql() + ")", OUTC, "exo AS (SELECT en.*, outcome FROM en JOIN outc USING (entity_id))",
                                   cs._corr_cte(FORMATIVE), f"pt AS (SELECT feature, n, r, {cs.T_OF_R} AS t FROM ct WHERE n > 10)", f"pp AS (SELECT *, {t_p_sql('t', '(n - 2)')} AS p FROM pt)")
       + f"SELECT feature, n, {p6('r')} AS r, {p6('t')} AS t, {p6('p')} AS p, {stars_sql('p')} AS stars FROM pp")
def q7_formative_tests(spark: SparkSession, sf_dir: str):
    """Pearson test of each numeric add-on score against the outcome
    (more than 10 pairs)."""
    rows = q7_enhanced_table(spark, sf_dir).join(fx.outcomes(spark, sf_dir), "entity_id")
    return stats.pearson_tests(rows, FORMATIVE, "outcome", min_pairs=10)


# ---------------------------------------------------------------------------
# Q8: coefficients and residuals of the gradebook-world model
# ---------------------------------------------------------------------------

def _gradebook_fit(spark: SparkSession, sf_dir: str) -> tuple[linear.LinearFit, DataFrame]:
    """Least squares on the training rows, scaled with the training rows'
    constants, and all rows with split and prediction."""
    table, feats = cp._q8_table(spark, sf_dir)
    table = cut_lineage(table.withColumn("split", splits.split_column(table, "entity_id")))
    train = table.filter(F.col("split") == "train")
    sc = features.fit_scaler(train, feats, extra_means=["outcome"])
    fit = linear.fit_least_squares(train, feats, "outcome", [sc.mean[c] for c in feats], [sc.scale(c) for c in feats], sc.extra["outcome"])
    return fit, table.select("entity_id", "split", "outcome", fit.predict().alias("pred"))


@query("q8_coefficients", digits=5)
def q8_coefficients(spark: SparkSession, sf_dir: str):
    """The 15 largest coefficients of the gradebook-world
    model (least norm, its features depend on each other exactly)."""
    fit, _ = _gradebook_fit(spark, sf_dir)
    return explain.coefficients(spark, fit).filter("rank <= 15")


# The exam mean and the improvements are sums of the exams, so the fitted
# values are those of the model without them.
FREE = EX + ["exam_var", "exam_min", "exam_max"]
GB_CTES = [*cm.EXAM_BASE, f"gb AS (SELECT *, {row_var_sql(EX)} AS exam_var, least({', '.join(EX)}) AS exam_min, greatest({', '.join(EX)}) AS exam_max FROM cc)",
           f"gtrain AS (SELECT * FROM gb QUALIFY NOT {in_test()})", "gst AS (SELECT " + ", ".join(f"stddev_pop({c}) AS sd{i}" for i, c in enumerate(FREE)) + " FROM gtrain)",
           *refined_ctes("gf", "gtrain", FREE, "outcome", "gst"), f"gp AS (SELECT g.entity_id, {cm.SPLIT} AS split, outcome, {centred_sql('gf_coef', FREE)} AS pred FROM gb g CROSS JOIN gf_coef)"]


@query("q8_residuals", with_(*GB_CTES) + f"SELECT entity_id, split, {p6('outcome', 4)} AS outcome, {p6('pred', 4)} AS pred, {p6('outcome - pred', 4)} AS residual FROM gp", decimals=4)
def q8_residuals(spark: SparkSession, sf_dir: str):
    """Actual, predicted and residual of each complete entity."""
    _, scored = _gradebook_fit(spark, sf_dir)
    return scored.withColumn("residual", F.col("outcome") - F.col("pred"))


# ---------------------------------------------------------------------------
# Q10: histogram and trend of the improvement
# ---------------------------------------------------------------------------

IMPROVED = [EXAMS, OUTC, "io0 AS (SELECT entity_id, " + ", ".join(f"{c}_final - {c}_midterm AS {c}_improvement" for c in fx.COURSES) + ", outcome FROM exams JOIN outc USING (entity_id))",
            f"io AS (SELECT *, outcome >= {cm.THS} AS passed, {row_mean_sql(cp.IMP)} AS avg_improvement FROM io0)"]


@query("q10_improvement_histogram", with_(*IMPROVED) + cr._hist_sql("avg_improvement", "io", 15, "passed"))
def q10_improvement_histogram(spark: SparkSession, sf_dir: str):
    """Average improvement in 15 bins, passers and failers apart on
    the same edges."""
    rows = cp._improvements(spark, sf_dir).withColumn("passed", F.col("outcome") >= TH)
    return profile.histogram(rows, "avg_improvement", 15, by="passed")


@query("q10_improvement_line", with_(*IMPROVED) + (
    "SELECT k::INTEGER AS k, " + p6("slope") + " AS slope, " + p6("intercept") + " AS intercept, " + p6("lo + k * (hi - lo) / 99.0") + " AS x, "
    + p6("intercept + slope * (lo + k * (hi - lo) / 99.0)") + " AS y_hat FROM (SELECT regr_slope(outcome, avg_improvement) AS slope, regr_intercept(outcome, avg_improvement) AS intercept, "
    "min(avg_improvement) FILTER (WHERE outcome IS NOT NULL) AS lo, max(avg_improvement) FILTER (WHERE outcome IS NOT NULL) AS hi FROM io) CROSS JOIN range(0, 100) t(k)"))
def q10_improvement_line(spark: SparkSession, sf_dir: str):
    """The outcome's trend over the average improvement."""
    return profile.trend_line(cp._improvements(spark, sf_dir), "avg_improvement", "outcome")
