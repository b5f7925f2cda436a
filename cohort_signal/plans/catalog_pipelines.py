"""Catalogue: end-to-end pipelines (Q1-Q15) and the remaining composites
(M13, S9, T11).  Each registered pipeline returns its headline table."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import attempts as att
from ..operators import cohort, evaluate, features, linear, profile, risk, splits, stats, trees
from ..session import cut_lineage, scratch_path
from ..sources import fixtures as fx
from ..sources import io
from . import catalog_models as cm
from . import catalog_relational as cr
from . import catalog_stats as cs
from . import pipelines as pl
from .catalog import p6, query
from .oracle import (ATTEMPTS, EXAMS, EXAMS_NAMED, GRADEBOOK, MERGED, NAMED, OUTC, WIDE, cv_sql,
                     row_mean_sql, stars_sql, t_p_sql, with_)

SC = cm.SC
EX = cm.EX
FEATS = cm.FEATS
TH = cm.TH


@query("q1_load_and_merge", with_(WIDE, NAMED, OUTC, MERGED) + f"SELECT entity_id, name, {cr._scores()}, {p6('outcome')} AS outcome FROM merged")
def q1_load_and_merge(spark: SparkSession, sf_dir: str):
    """Q1: read, validate, inner-merge, write the merged table, re-read."""
    _, _, merged = pl.load_and_merge(spark, sf_dir)
    path = io.write_table(merged, scratch_path(spark, "merged"))
    return io.read_assessments(spark, path)


@query("q2_preprocess", with_(*cm.PREP_CTES, "st AS (SELECT " + ", ".join(
    f"avg({c}) AS m{i}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s{i}" for i, c in enumerate(FEATS)) + " FROM prep)")
       + "SELECT entity_id, " + p6("outcome") + " AS outcome, " + ", ".join(f"{p6(f'({c} - m{i}) / s{i}')} AS {c}" for i, c in enumerate(FEATS)) + " FROM prep CROSS JOIN st")
def q2_preprocess(spark: SparkSession, sf_dir: str):
    """Q2: missing policy -> clip -> engineered features -> population
    standardisation; the model-ready table."""
    _, _, merged = pl.load_and_merge(spark, sf_dir)
    prep = pl.preprocess(merged, SC)
    return features.apply_scaler(prep.table, prep.scaler).select("entity_id", "outcome", *prep.features)


@query("q3_train_and_compare")
def q3_train_and_compare(spark: SparkSession, sf_dir: str):
    """Q3: split, linear / ridge / forest / boosting fits, train-test
    metrics, overfit flags."""
    return cm._compare(spark, sf_dir)


@query("q5_flagged_top10", with_(*cm.PREP_CTES, cm.TRAIN,
                                 *cm.ols_ctes("fit", "train", FEATS, "outcome"),
                                 cm._imputed("curp", "cur", "s.entity_id, s.name"), cm._engineered("curp"),
                                 f"pred AS (SELECT entity_id, name, round_even({cm.predict_sql('fit_coef', FEATS)}, 0)::INTEGER AS predicted FROM curp CROSS JOIN fit_coef)")
       + f"SELECT entity_id, predicted, {p6(cm.rev(f'({cm.THS} - predicted) / {cm.THS}', 3))} AS risk_score FROM pred WHERE predicted < {cm.THS} ORDER BY risk_score DESC, entity_id LIMIT 10")
def q5_flagged_top10(spark: SparkSession, sf_dir: str):
    """Q5 / O2: the ten highest-risk flagged entities of the report."""
    return risk.top_at_risk(pl.early_warning(spark, sf_dir), 10).select("entity_id", "predicted", "risk_score")


Q6_SQL = with_(GRADEBOOK, cr.P1, cr.P3, cr.P5, cr.P7, cr.P10, EXAMS, EXAMS_NAMED, ATTEMPTS, cr.A8,
               "nw AS (SELECT coalesce(a.entity_id, e.entity_id) AS entity_id, coalesce(a.name, e.name) AS name, a.final_exam, "
               + ", ".join(f"e.{c}" for c in EX) + " FROM (SELECT entity_id, name, final_exam FROM p10) a FULL OUTER JOIN exams_named e ON a.entity_id = e.entity_id)",
               "j AS (SELECT nw.*, nw.entity_id AS assessed, s.* EXCLUDE (entity_id), coalesce(nw.entity_id, s.entity_id) AS eid FROM nw FULL OUTER JOIN a8s s ON nw.entity_id = s.entity_id)") + (
    f"SELECT eid AS entity_id, name, {p6('final_exam')} AS final_exam, {cr._exams()}, total_attempts, {p6('first_score')} AS first_score, "
    "CASE WHEN assessed IS NOT NULL AND total_attempts IS NOT NULL THEN 'both' WHEN assessed IS NOT NULL THEN 'assessments_only' ELSE 'outcome_only' END AS cohort FROM j")


@query("q6_gradebook_extraction", Q6_SQL)
def q6_gradebook_extraction(spark: SparkSession, sf_dir: str):
    """Q6: clean a raw gradebook (P1-P10), outer-merge it with the other
    courses (J3), attach the attempt summary (A8, J4), label the cohort
    partition (P16)."""
    a = cr._extracted(spark, sf_dir).select("entity_id", "name", "final_exam")
    ex = fx.exam_scores(spark, sf_dir)
    wide = cohort.nway_outer({"gradebook": a, "exams": ex}).withColumn("_assessed", F.lit(True))
    s = att.attempt_summary(fx.attempts(spark, sf_dir))
    j = cohort.outer_merge(wide, s)
    return j.select("entity_id", "name", "final_exam", *EX, "total_attempts", "first_score",
                    cohort.cohort_partition(F.col("_assessed").isNotNull(), F.col("total_attempts").isNotNull()).alias("cohort"))


FLAGS_T = cr.FLAG_COLS + ["total_remediations"]


def _flag_pearson_sql() -> str:
    parts = []
    for c in FLAGS_T:
        both = f"{c} IS NOT NULL AND outcome IS NOT NULL"
        parts.append(
            f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {both}) AS n, "
            f"CASE WHEN stddev_pop({c}) FILTER (WHERE {both}) * stddev_pop(outcome) FILTER (WHERE {both}) = 0 THEN NULL "
            f"ELSE covar_pop({c}, outcome) FILTER (WHERE {both}) / (stddev_pop({c}) FILTER (WHERE {both}) * stddev_pop(outcome) FILTER (WHERE {both})) END AS r FROM fo")
    return with_(cr.FLAGS, OUTC, "fo AS (SELECT f.*, (" + " + ".join(f"coalesce({c}, 0)" for c in cr.FLAG_COLS) + ")::INTEGER AS total_remediations, o.outcome FROM flags f JOIN outc o USING (entity_id))",
                 f"ct AS ({' UNION ALL '.join(parts)})", f"pt AS (SELECT feature, n, r, {cs.T_OF_R} AS t FROM ct WHERE n > 10)",
                 f"pp AS (SELECT *, {t_p_sql('t', '(n - 2)')} AS p FROM pt)") + (
        f"SELECT feature, n, {p6('r')} AS r, {p6('t')} AS t, {p6('p')} AS p, {stars_sql('p')} AS stars FROM pp")


@query("q7_enhancement_features", _flag_pearson_sql())
def q7_enhancement_features(spark: SparkSession, sf_dir: str):
    """Q7: remediation flags (P17/R7) and their total (A15) joined to the
    outcome; Pearson test of each new feature (T1, > 10 pairs)."""
    f = fx.remediation_flags(spark, sf_dir)
    f = f.withColumn("total_remediations", features.total_flags(cr.FLAG_COLS))
    fo = f.join(fx.outcomes(spark, sf_dir), "entity_id")
    return stats.pearson_tests(fo, FLAGS_T, "outcome", min_pairs=10)


def _q8_table(spark, sf_dir):
    """Exam features plus row statistics and per-course improvements on
    complete cases (the gradebook-world feature set)."""
    from ..functions import rowwise
    _, cc = cm._exam_world(spark, sf_dir)
    eng = {"exam_mean": rowwise.row_mean(EX), "exam_var": rowwise.row_variance(EX),
           "exam_min": rowwise.row_min(EX), "exam_max": rowwise.row_max(EX)}
    eng.update({f"{c}_improvement": rowwise.improvement(f"{c}_final", f"{c}_midterm") for c in fx.COURSES})
    return cc.withColumns(eng), EX + list(eng)


@query("q8_gradebook_model")
def q8_gradebook_model(spark: SparkSession, sf_dir: str):
    """Q8: exam features plus row statistics (mean, variance, min, max) and
    per-course improvements; OLS (least-squares, min-norm on the exactly
    collinear set) and a depth-5 forest, train/test metrics."""
    t, feats = _q8_table(spark, sf_dir)
    t = t.withColumn("split", splits.split_column(t, "entity_id"))
    sc = features.fit_scaler(t, feats, extra_means=["outcome"])
    fit = linear.fit_least_squares(t.filter(F.col("split") == "train"), feats, "outcome", [sc.mean[c] for c in feats],
                                   [sc.scale(c) for c in feats], sc.extra["outcome"])
    lin = t.select("split", "outcome", fit.predict().alias("pred")).withColumn("model", F.lit("linear"))
    rf = trees.random_forest(t.filter(F.col("split") == "train"), feats, "outcome", max_depth=5)
    rfp = trees.predict(rf, t, feats, "pred").select("split", "outcome", "pred").withColumn("model", F.lit("random_forest"))
    long = evaluate.regression_metrics(lin.unionByName(rfp), "outcome", "pred", ["model", "split"])
    return evaluate.metrics_wide(long)


@query("q8_gradebook_cv")
def q8_gradebook_cv(spark: SparkSession, sf_dir: str):
    """Q8 / M5: unshuffled 5-fold CV (contiguous in key order, from
    distributed ranks) of OLS (fold moments) and of a depth-5 forest (one
    Spark ML fit per fold, side by side); mean and std of fold R^2 and MAE per model."""
    from ..operators.ranking import row_rank
    t, feats = _q8_table(spark, sf_dir)
    n = t.count()
    ranked = row_rank(t.select("entity_id"), "entity_id")
    t = trees.for_fits(t.join(ranked.select("entity_id", linear.contiguous_fold(F.col("_rank"), F.lit(n), 5).alias("fold")), "entity_id"))
    ols = linear.cv_linear(t, feats, "outcome", "fold").select("fold", "r2", "mae").withColumn("model", F.lit("linear"))
    models = trees.fold_models(t, ["fold"], 5, lambda d: trees.random_forest(d, feats, "outcome", max_depth=5))
    rf_pred = trees.held_out(t, feats, "outcome", ["fold"], models)
    rf = evaluate.regression_metrics(rf_pred, "outcome", "pred", ["fold"]).select("fold", "r2", "mae") \
        .withColumn("model", F.lit("random_forest"))
    return linear.cv_summary(ols.unionByName(rf), ["model"]).drop("r2_ci_low", "r2_ci_high")


def _q9_sql() -> str:
    from .oracle import EXAMS as _E
    ctes = [_E, OUTC, cm.EXO_K, *cm._checkpoint_sql(("midterm", "final"), "ck"), *cm._checkpoint_sql(("midterm",), "mk")]
    a = cm._checkpoint_final("ck").replace(" FROM ckres", ", 'cumulative' AS kind FROM ckres")
    b = cm._checkpoint_final("mk").replace(" FROM mkres", ", 'midterm_only' AS kind FROM mkres")
    return with_(*ctes) + a + " UNION ALL " + b


@query("q9_how_early", _q9_sql())
def q9_how_early(spark: SparkSession, sf_dir: str):
    """Q9: cumulative and midterm-only checkpoints side by side."""
    a = cm._checkpoint_cv(spark, sf_dir, ("midterm", "final")).withColumn("kind", F.lit("cumulative"))
    b = cm._checkpoint_cv(spark, sf_dir, ("midterm",)).withColumn("kind", F.lit("midterm_only"))
    return a.unionByName(b)


IMP = [f"{c}_improvement" for c in fx.COURSES]
IMP_ALL = IMP + ["avg_improvement"]


def _q10_sql() -> str:
    parts = []
    for c in IMP_ALL:
        both = f"{c} IS NOT NULL AND outcome IS NOT NULL"
        parts.append(
            f"SELECT '{c}' AS feature, avg({c}) AS avg_improvement, count(*) FILTER (WHERE {both}) AS n, "
            f"CASE WHEN stddev_pop({c}) FILTER (WHERE {both}) * stddev_pop(outcome) FILTER (WHERE {both}) = 0 THEN NULL "
            f"ELSE covar_pop({c}, outcome) FILTER (WHERE {both}) / (stddev_pop({c}) FILTER (WHERE {both}) * stddev_pop(outcome) FILTER (WHERE {both})) END AS r FROM io")
    imp = ", ".join(f"{c}_final - {c}_midterm AS {c}_improvement" for c in fx.COURSES)
    return with_(EXAMS, OUTC, f"io0 AS (SELECT entity_id, {imp}, outcome FROM exams JOIN outc USING (entity_id))",
                 f"io AS (SELECT *, {row_mean_sql(IMP)} AS avg_improvement FROM io0)",
                 f"ct AS ({' UNION ALL '.join(parts)})", f"pt AS (SELECT *, {cs.T_OF_R} AS t FROM ct)",
                 f"pp AS (SELECT *, {t_p_sql('t', '(n - 2)')} AS p FROM pt)") + (
        f"SELECT feature, {p6('avg_improvement')} AS avg_improvement, n, {p6('r')} AS r, {p6('p')} AS p, {stars_sql('p')} AS stars, "
        "CASE WHEN r > 0.1 THEN 'higher' WHEN r < -0.1 THEN 'lower' WHEN r IS NOT NULL THEN 'none' END AS direction FROM pp")


def _improvements(spark, sf_dir):
    """F4 per course and F5 (their mean) with the outcome."""
    from ..functions import rowwise
    ex = fx.exam_scores(spark, sf_dir, with_name=False).join(fx.outcomes(spark, sf_dir), "entity_id")
    imp = ex.select("entity_id", "outcome", *[rowwise.improvement(f"{c}_final", f"{c}_midterm").alias(f"{c}_improvement")
                                              for c in fx.COURSES])
    return cut_lineage(imp.withColumn("avg_improvement", rowwise.row_mean(IMP)))


@query("q10_improvement_trend", _q10_sql())
def q10_improvement_trend(spark: SparkSession, sf_dir: str):
    """Q10: per-course improvement (final - midterm), its mean, correlation
    with the outcome, p-value, stars and direction text."""
    imp = _improvements(spark, sf_dir)
    means = imp.agg(*[F.avg(c).alias(c) for c in IMP_ALL]).unpivot([], IMP_ALL, "feature", "avg_improvement")
    t = stats.direction_table(stats.pearson_tests(imp, IMP_ALL, "outcome"))
    return t.join(means, "feature").select("feature", "avg_improvement", "n", "r", "p", "stars", "direction")


@query("m13_feature_sets", with_(*cm.EXAM_BASE, cr.FLAGS,
                                 "enh AS (SELECT c.*, " + ", ".join(cr.FLAG_COLS) + ", (" + " + ".join(f"coalesce({c}, 0)" for c in cr.FLAG_COLS) + ")::INTEGER AS total_remediations FROM cc c JOIN flags f USING (entity_id) WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in cr.FLAG_COLS) + ")",
                                 *cv_sql("o50", "cc", EX, "outcome", cm.ALPHA, reps=10),
                                 *cv_sql("n50", "enh", EX + FLAGS_T, "outcome", cm.ALPHA, reps=10))
       + " UNION ALL ".join(
           f"SELECT '{nm}' AS feature_set, {nf} AS n_features, (SELECT count(*) FROM {src}) AS n_rows, {p6('avg(r2)')} AS r2_mean, "
           f"{p6('avg(r2) - 1.96 * stddev_pop(r2) / sqrt(count(*))')} AS r2_ci_low, {p6('avg(r2) + 1.96 * stddev_pop(r2) / sqrt(count(*))')} AS r2_ci_high, "
           f"{p6('avg(mae)')} AS mae_mean FROM {cte}_ev"
           for nm, nf, src, cte in (("original", len(EX), "cc", "o50"), ("enhanced", len(EX) + len(FLAGS_T), "enh", "n50"))))
def m13_feature_sets(spark: SparkSession, sf_dir: str):
    """Original vs enhanced feature set (exams + remediation flags +
    total), each by 10 x 5 repeated CV of the ridge model."""
    _, cc = cm._exam_world(spark, sf_dir)
    fl = fx.remediation_flags(spark, sf_dir)
    enh = clean.drop_null(cc.join(fl, "entity_id"), cr.FLAG_COLS).withColumn("total_remediations", features.total_flags(cr.FLAG_COLS))
    out = None
    for name, data, feats in (("original", cc, EX), ("enhanced", enh, EX + FLAGS_T)):
        s = linear.cv_summary(cm._cv_folds(spark, sf_dir, reps=10, feats=feats, data=data))
        n = data.count()
        r = s.select(F.lit(name).alias("feature_set"), F.lit(len(feats)).alias("n_features"), F.lit(n).cast("long").alias("n_rows"),
                     "r2_mean", "r2_ci_low", "r2_ci_high", "mae_mean")
        out = r if out is None else out.unionByName(r)
    return out


@query("s9_write_metrics")
def s9_write_metrics(spark: SparkSession, sf_dir: str):
    """Write the model-comparison metrics as CSV; read back."""
    m = cm._compare(spark, sf_dir)
    path = io.write_table(m, scratch_path(spark, "model_metrics"), fmt="csv", order_by=[F.col("test_r2").desc()])
    return io.read_assessments(spark, path, fmt="csv", key="model")


@query("q14_eda", cr._describe_sql(EX, [EXAMS], "exams"))
def q14_eda(spark: SparkSession, sf_dir: str):
    """Q14: describe() of every exam (the EDA summary table)."""
    return profile.describe(fx.exam_scores(spark, sf_dir, with_name=False), EX)


FINALS = [f"{c}_final" for c in fx.COURSES]


@query("q15_presentation_correlations", with_(EXAMS, OUTC, cs.EXO, cs._corr_cte(FINALS))
       + f"SELECT feature, n, {p6('r')} AS r, CASE WHEN r > 0.6 THEN 'very strong' WHEN r > 0.4 THEN 'strong' WHEN r > 0.2 THEN 'moderate' WHEN r IS NOT NULL THEN 'weak' END AS band FROM ct")
def q15_presentation_correlations(spark: SparkSession, sf_dir: str):
    """Q15: final-exam correlations with the outcome and their colour bands."""
    from ..functions.labels import correlation_band
    c = profile.corr_with_target(cs._exo(spark, sf_dir), FINALS, "outcome")
    return c.select("feature", "n", "r", correlation_band("r").alias("band"))


# ---------------------------------------------------------------------------
# IDs whose logic lives inside larger tables above, registered on their own
# ---------------------------------------------------------------------------

@query("o6_top_group_diffs", with_(*cs._t4_ctes()) + f"SELECT feature, {p6('diff')} AS diff, {p6('p')} AS p FROM tp ORDER BY abs(diff) DESC, feature LIMIT 12")
def o6_top_group_diffs(spark: SparkSession, sf_dir: str):
    """The 12 exams with the largest |mean difference| between groups."""
    t = cs.t4_two_sample_t(spark, sf_dir)
    return t.orderBy(F.abs("diff").desc(), "feature").limit(12).select("feature", "diff", "p")


@query("w4_rank_features", with_(*cm.RIDGE, cm.RE1) + "SELECT feature, row_number() OVER (ORDER BY abs(coef) DESC, feature)::INTEGER AS rank FROM re1")
def w4_rank_features(spark: SparkSession, sf_dir: str):
    """Features ranked by |coefficient| (row_number over the p-row result)."""
    return cm.e1_ridge_coefficients(spark, sf_dir).select("feature", "rank")


@query("f15_usefulness", cm.ORACLE_M17.rsplit("SELECT checkpoint, course_num", 1)[0]
       + "SELECT checkpoint, CASE WHEN r2_mean > 0.4 THEN 'USEFUL' WHEN r2_mean > 0.25 THEN 'MODERATE' WHEN r2_mean > 0.1 THEN 'EMERGING' WHEN r2_mean IS NOT NULL THEN '' END AS usefulness, "
       "CASE WHEN r2_mean < 0.15 THEN 'LOW' WHEN r2_mean < 0.3 THEN 'MEDIUM' WHEN r2_mean IS NOT NULL THEN 'HIGH' END AS band FROM ckres WHERE n_rows >= 20")
def f15_usefulness(spark: SparkSession, sf_dir: str):
    """usefulness classes of each checkpoint's CV R^2 (both rules)."""
    return cm.m17_checkpoints(spark, sf_dir).select("checkpoint", "usefulness", "band")


@query("f19_fisher_z", with_(*cs.PEARSON) + f"SELECT feature, {p6('atanh(r)')} AS z, {p6('tanh(atanh(r))')} AS r_back FROM pp")
def f19_fisher_z(spark: SparkSession, sf_dir: str):
    """arctanh of each r and its tanh round trip."""
    t = stats.pearson_tests(cs._exo(spark, sf_dir), EX, "outcome", min_pairs=10)
    return t.select("feature", F.atanh("r").alias("z"), F.tanh(F.atanh("r")).alias("r_back"))


@query("f20_coef_sign", with_(*cm.RIDGE, cm.RE1) + f"SELECT feature, CASE WHEN coef > 0 THEN '+' ELSE '-' END AS sign, {p6('abs(coef)')} AS abs_coef FROM re1")
def f20_coef_sign(spark: SparkSession, sf_dir: str):
    """sign label and absolute value of each coefficient."""
    return cm.e1_ridge_coefficients(spark, sf_dir).select("feature", "sign", "abs_coef")


@query("t10_worst_case", with_(*cm.EXAM_BASE, *cv_sql("k50", "cc", EX, "outcome", cm.ALPHA, reps=10))
       + f"SELECT {p6('avg(mae)')} AS mae_mean, {p6('stddev_pop(mae)')} AS mae_std, {p6('avg(mae) + 2.0 * stddev_pop(mae)')} AS worst_case FROM k50_ev")
def t10_worst_case(spark: SparkSession, sf_dir: str):
    """Worst case per entity = mean CV MAE + 2 std."""
    s = linear.cv_summary(cm._cv_folds(spark, sf_dir, reps=10))
    return s.select("mae_mean", "mae_std", stats.worst_case(F.col("mae_mean"), F.col("mae_std")).alias("worst_case"))


@query("q10_pass_fail_improvement", with_(EXAMS, OUTC, "io0 AS (SELECT entity_id, " + ", ".join(f"{c}_final - {c}_midterm AS {c}_improvement" for c in fx.COURSES) + " , outcome FROM exams JOIN outc USING (entity_id))",
                                          f"io AS (SELECT *, (outcome < {cm.THS})::INTEGER AS failed, " + row_mean_sql(IMP) + " AS avg_improvement FROM io0)",
                                          "s AS (SELECT count(avg_improvement) FILTER (WHERE failed = 0) AS n0, count(avg_improvement) FILTER (WHERE failed = 1) AS n1, "
                                          "avg(avg_improvement) FILTER (WHERE failed = 0) AS mean_0, avg(avg_improvement) FILTER (WHERE failed = 1) AS mean_1, "
                                          "var_samp(avg_improvement) FILTER (WHERE failed = 0) AS v0, var_samp(avg_improvement) FILTER (WHERE failed = 1) AS v1 FROM io)",
                                          "tt AS (SELECT *, (mean_0 - mean_1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) AS t, n0 + n1 - 2 AS dof FROM s)")
       + f"SELECT n0 AS n_passed, n1 AS n_failed, {p6('mean_0')} AS mean_passed, {p6('mean_1')} AS mean_failed, {p6('mean_0 - mean_1')} AS diff, {p6('t')} AS t, {p6(t_p_sql('t', 'dof'))} AS p FROM tt")
def q10_pass_fail_improvement(spark: SparkSession, sf_dir: str):
    """Q10 / T4: average improvement of passers vs failers, pooled t-test."""
    imp = _improvements(spark, sf_dir).withColumn("failed", (F.col("outcome") < TH).cast("int"))
    t = stats.two_sample_t(imp, ["avg_improvement"], "failed", min_group=0)
    return t.select(F.col("n0").alias("n_passed"), F.col("n1").alias("n_failed"), F.col("mean_0").alias("mean_passed"),
                    F.col("mean_1").alias("mean_failed"), "diff", "t", "p")


@query("w2_change_2to3", with_(ATTEMPTS, cr.A8, "ch AS (SELECT attempt3_score - attempt2_score AS change FROM a8s WHERE attempt2_score IS NOT NULL AND attempt3_score IS NOT NULL)")
       + f"SELECT count(*) AS n, {p6('avg(change)')} AS mean_change, count(*) FILTER (WHERE change > 0) AS n_improved, count(*) FILTER (WHERE change <= 0) AS n_not_improved, {p6('avg((change > 0)::INTEGER)')} AS share_improved FROM ch")
def w2_change_2to3(spark: SparkSession, sf_dir: str):
    """Attempt 2 -> 3 change: count, mean, improved / not."""
    ch = att.paired_change(att.attempt_summary(fx.attempts(spark, sf_dir)), 2, 3)
    c = F.col("change")
    return ch.agg(F.count(F.lit(1)).alias("n"), F.avg(c).alias("mean_change"), F.count_if(c > 0).alias("n_improved"),
                  F.count_if(c <= 0).alias("n_not_improved"), F.avg((c > 0).cast("int")).alias("share_improved"))


@query("q11_retake_group_profiles", with_(WIDE, ATTEMPTS, cr.RETAKE, cr.A8,
                                          "rg AS (SELECT rl.needed_retake, " + row_mean_sql(SC) + " AS block_avg, a8s.attempt1_score FROM rl JOIN a8s USING (entity_id) WHERE " + " AND ".join(f"rl.{c} IS NOT NULL" for c in SC) + ")")
       + f"SELECT needed_retake, count(*) AS n, {p6('avg(block_avg)')} AS mean_block_avg, {p6('avg(attempt1_score)')} AS mean_first_score FROM rg GROUP BY needed_retake")
def q11_retake_group_profiles(spark: SparkSession, sf_dir: str):
    """Q11: complete-score entities by retake group: row mean of scores (F1)
    and first-attempt score (A8), per group."""
    from ..functions import rowwise
    r = clean.drop_null(fx.retake_labels(spark, sf_dir), SC)
    s = att.attempt_summary(fx.attempts(spark, sf_dir)).select("entity_id", "attempt1_score")
    g = r.join(s, "entity_id").withColumn("block_avg", rowwise.row_mean(SC))
    return g.groupBy("needed_retake").agg(F.count(F.lit(1)).alias("n"), F.avg("block_avg").alias("mean_block_avg"),
                                          F.avg("attempt1_score").alias("mean_first_score"))


@query("m14_streaming_scores", with_(*cm.PREP_CTES, cm.TRAIN,
                                     *cm.ols_ctes("fit", "train", FEATS, "outcome"),
                                     cm._imputed("curp", "cur", "s.entity_id, s.name"), cm._engineered("curp"),
                                     f"pred AS (SELECT entity_id, name, round_even({cm.predict_sql('fit_coef', FEATS)}, 0)::INTEGER AS predicted FROM curp CROSS JOIN fit_coef)")
       + f"SELECT entity_id, name, predicted, {cm.THS} AS threshold, {p6(cm.rev(f'({cm.THS} - predicted) / {cm.THS}', 3))} AS risk_score, predicted < {cm.THS} AS at_risk FROM pred")
def m14_streaming_scores(spark: SparkSession, sf_dir: str):
    """M14 + F11 on a stream: current-cohort rows land as parquet files in
    the shared scratch folder, a Structured Streaming query scores them with
    the frozen training fit (available-now trigger, checkpointed), and the
    sink is read back."""
    from ..streaming.scoring import fit_scorer, start_scoring
    scorer = fit_scorer(spark, sf_dir)
    current = cohort.current_cohort(fx.wide_scores(spark, sf_dir), fx.outcomes(spark, sf_dir))
    src = scratch_path(spark, "arrivals")
    current.write.parquet(src)
    q, sink = start_scoring(spark, scorer, src, current.schema)
    if not q.awaitTermination(900):
        q.stop()
        raise TimeoutError("streaming scorer did not drain its input")
    return spark.read.parquet(sink).select("entity_id", "name", "predicted", "threshold", "risk_score", "at_risk")
