"""Catalogue: hypothesis tests and intervals."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.tails import normal_cdf, t_two_sided_p
from ..operators import attempts as att
from ..operators import stats
from ..operators.profile import corr_with_target
from ..sources import fixtures as fx
from .catalog import p6, query
from .oracle import (ATTEMPTS, EXAMS, OUTC, normal_p_sql, stars_sql, t_p_sql, with_)

EX = list(fx.EXAM_COLUMNS)
TH = float(fx.OUTCOME_THRESHOLD)
THS = f"{TH}::DOUBLE"
EXO = "exo AS (SELECT * FROM exams LEFT JOIN outc USING (entity_id))"


def _exo(spark, sf_dir):
    return fx.exam_scores(spark, sf_dir, with_name=False).join(fx.outcomes(spark, sf_dir), "entity_id", "left")


def _corr_cte(cols: list[str], name: str = "ct") -> str:
    parts = []
    for c in cols:
        both = f"{c} IS NOT NULL AND outcome IS NOT NULL"
        parts.append(
            f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {both}) AS n, "
            f"CASE WHEN stddev_pop({c}) FILTER (WHERE {both}) * stddev_pop(outcome) FILTER (WHERE {both}) = 0 THEN NULL "
            f"ELSE covar_pop({c}, outcome) FILTER (WHERE {both}) / (stddev_pop({c}) FILTER (WHERE {both}) * stddev_pop(outcome) FILTER (WHERE {both})) END AS r FROM exo")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


T_OF_R = "r * sqrt(CASE WHEN 1.0 - r * r = 0 THEN NULL ELSE (n - 2)::DOUBLE / (1.0 - r * r) END)"
PEARSON = [EXAMS, OUTC, EXO, _corr_cte(EX),
           f"pt AS (SELECT feature, n, r, {T_OF_R} AS t FROM ct WHERE n > 10)",
           f"pp AS (SELECT *, {t_p_sql('t', '(n - 2)')} AS p FROM pt)"]


@query("t1_pearson_tests", with_(*PEARSON) + f"SELECT feature, n, {p6('r')} AS r, {p6('t')} AS t, {p6('p')} AS p, {stars_sql('p')} AS stars FROM pp")
def t1_pearson_tests(spark: SparkSession, sf_dir: str):
    """T1 + T7 + F13: Pearson r with two-sided p per exam (> 10 pairs)."""
    return stats.pearson_tests(_exo(spark, sf_dir), EX, "outcome", min_pairs=10)


@query("t2_fisher_ci", with_(*PEARSON) + (
    f"SELECT feature, {p6('atanh(r)')} AS z, {p6('tanh(atanh(r) - 1.96 * (1.0 / sqrt((n - 3)::DOUBLE)))')} AS ci_low, "
    f"{p6('tanh(atanh(r) + 1.96 * (1.0 / sqrt((n - 3)::DOUBLE)))')} AS ci_high FROM pp"))
def t2_fisher_ci(spark: SparkSession, sf_dir: str):
    """T2 + F19: 95 % Fisher-z interval of each r."""
    t = stats.with_fisher_ci(stats.pearson_tests(_exo(spark, sf_dir), EX, "outcome", min_pairs=10))
    return t.select("feature", "z", "ci_low", "ci_high")


@query("t3_fisher_compare", with_(*PEARSON, "rk AS (SELECT *, row_number() OVER (ORDER BY abs(r) DESC, feature) AS rk FROM pp)",
                                  "pr AS (SELECT max(feature) FILTER (WHERE rk = 1) AS top1, max(feature) FILTER (WHERE rk = 2) AS top2, max(r) FILTER (WHERE rk = 1) AS r1, max(r) FILTER (WHERE rk = 2) AS r2, max(n) FILTER (WHERE rk = 1) AS n1 FROM rk)",
                                  "zd AS (SELECT *, (atanh(r1) - atanh(r2)) / sqrt(2.0 / (n1 - 3)::DOUBLE) AS z_diff FROM pr)")
       + f"SELECT top1, top2, {p6('r1')} AS r1, {p6('r2')} AS r2, n1, {p6('z_diff')} AS z_diff, {p6(normal_p_sql('z_diff'))} AS p_diff FROM zd")
def t3_fisher_compare(spark: SparkSession, sf_dir: str):
    """T3 + T8: strongest vs second-strongest correlation, Fisher z test."""
    return stats.fisher_compare(stats.pearson_tests(_exo(spark, sf_dir), EX, "outcome", min_pairs=10))


def _t4_ctes() -> list[str]:
    parts = []
    for c in EX:
        parts.append(
            f"SELECT '{c}' AS feature, count({c}) FILTER (WHERE passed = 0) AS n0, count({c}) FILTER (WHERE passed = 1) AS n1, "
            f"avg({c}) FILTER (WHERE passed = 0) AS mean_0, avg({c}) FILTER (WHERE passed = 1) AS mean_1, "
            f"var_samp({c}) FILTER (WHERE passed = 0) AS v0, var_samp({c}) FILTER (WHERE passed = 1) AS v1 FROM g")
    return [EXAMS, OUTC, f"g AS (SELECT e.*, (o.outcome >= {THS})::INTEGER AS passed FROM exams e JOIN outc o USING (entity_id))",
            f"s AS ({' UNION ALL '.join(parts)})",
            "tt AS (SELECT *, mean_0 - mean_1 AS diff, CASE WHEN sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) = 0 THEN NULL ELSE "
            "(mean_0 - mean_1) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) END AS t, n0 + n1 - 2 AS dof FROM s WHERE n0 > 5 AND n1 > 5)",
            f"tp AS (SELECT *, {t_p_sql('t', 'dof')} AS p FROM tt)"]


def _t4_sql() -> str:
    return with_(*_t4_ctes()) + (
        f"SELECT feature, n0, n1, {p6('mean_0')} AS mean_0, {p6('mean_1')} AS mean_1, {p6('diff')} AS diff, {p6('t')} AS t, {p6('p')} AS p, {stars_sql('p')} AS stars FROM tp")


@query("t4_two_sample_t", _t4_sql())
def t4_two_sample_t(spark: SparkSession, sf_dir: str):
    """T4: pooled two-sample t-test of each exam between fail and pass."""
    ex = fx.exam_scores(spark, sf_dir, with_name=False).join(fx.outcomes(spark, sf_dir), "entity_id")
    g = ex.withColumn("passed", (F.col("outcome") >= TH).cast("int"))
    return stats.two_sample_t(g, EX, "passed")


A8CH = ("ch AS (SELECT entity_id, arg_max(score, attempt_no) FILTER (WHERE attempt_no = 2) - arg_max(score, attempt_no) FILTER (WHERE attempt_no = 1) AS change "
        "FROM attempts GROUP BY entity_id HAVING count(*) FILTER (WHERE attempt_no = 1) > 0 AND count(*) FILTER (WHERE attempt_no = 2) > 0)")


@query("t5_one_sample_t", with_(ATTEMPTS, A8CH,
                                "s AS (SELECT count(*) AS n, avg(change) AS mean, median(change) AS median, stddev_samp(change) AS sd, count(*) FILTER (WHERE change > 0) AS n_improved, count(*) FILTER (WHERE change <= 0) AS n_not_improved FROM ch)",
                                "st AS (SELECT *, CASE WHEN sd / sqrt(n::DOUBLE) = 0 THEN NULL ELSE (mean - 0.0) / (sd / sqrt(n::DOUBLE)) END AS t FROM s)")
       + f"SELECT n, {p6('mean')} AS mean, {p6('median')} AS median, {p6('sd')} AS sd, n_improved, n_not_improved, {p6('t')} AS t, {p6(t_p_sql('t', '(n - 1)'))} AS p FROM st")
def t5_one_sample_t(spark: SparkSession, sf_dir: str):
    """T5: one-sample t-test of the attempt 1 -> 2 change against 0."""
    ch = att.paired_change(att.attempt_summary(fx.attempts(spark, sf_dir)), 1, 2)
    return stats.one_sample_t(ch, "change")


@query("t7_t_tail", with_(EXAMS, OUTC, EXO, _corr_cte(EX), f"pt AS (SELECT feature, n, {T_OF_R} AS t FROM ct)")
       + f"SELECT feature, {p6('t')} AS t, n - 2 AS dof, {p6(t_p_sql('t', '(n - 2)'))} AS p FROM pt")
def t7_t_tail(spark: SparkSession, sf_dir: str):
    """Student-t two-sided tail of each exam's correlation t statistic."""
    c = corr_with_target(_exo(spark, sf_dir), EX, "outcome")
    t = stats.r_to_t(F.col("r"), F.col("n"))
    return c.select("feature", t.alias("t"), (F.col("n") - 2).alias("dof")).withColumn(
        "p", t_two_sided_p(F.col("t"), F.col("dof")))


@query("t8_normal_cdf", with_(*PEARSON) + (
    f"SELECT feature, {p6('atanh(r) * sqrt((n - 3)::DOUBLE)')} AS z, "
    f"{p6('CASE WHEN atanh(r) * sqrt((n - 3)::DOUBLE) >= 0 THEN 1.0 - ' + normal_p_sql('atanh(r) * sqrt((n - 3)::DOUBLE)') + ' / 2.0 ELSE ' + normal_p_sql('atanh(r) * sqrt((n - 3)::DOUBLE)') + ' / 2.0 END')} AS phi FROM pp"))
def t8_normal_cdf(spark: SparkSession, sf_dir: str):
    """Standard normal CDF of each correlation's Fisher z score."""
    t = stats.pearson_tests(_exo(spark, sf_dir), EX, "outcome", min_pairs=10)
    z = F.atanh("r") * F.sqrt((F.col("n") - 3).cast("double"))
    return t.select("feature", z.alias("z"), normal_cdf(z).alias("phi"))


@query("t9_count_significant", with_(*PEARSON) + f"SELECT count(*) AS n_features, count(*) FILTER (WHERE p < 0.001) AS n_significant, {p6('avg(abs(r))')} AS mean_abs_r FROM pp")
def t9_count_significant(spark: SparkSession, sf_dir: str):
    """Features significant at 0.001 and mean |r|."""
    return stats.count_significant(stats.pearson_tests(_exo(spark, sf_dir), EX, "outcome", min_pairs=10))


IMP = ", ".join(f"{c}_final - {c}_midterm AS {c}_improvement" for c in fx.COURSES)
IMPS = [f"{c}_improvement" for c in fx.COURSES]


@query("f14_direction", with_(EXAMS, OUTC, f"exo AS (SELECT entity_id, {IMP}, outcome FROM exams LEFT JOIN outc USING (entity_id))", _corr_cte(IMPS))
       + f"SELECT feature, {p6('r')} AS r, CASE WHEN r > 0.1 THEN 'higher' WHEN r < -0.1 THEN 'lower' WHEN r IS NOT NULL THEN 'none' END AS direction FROM ct")
def f14_direction(spark: SparkSession, sf_dir: str):
    """direction-of-effect text for the improvement correlations."""
    ex = _exo(spark, sf_dir)
    imp = ex.select("entity_id", "outcome", *[(F.col(f"{c}_final") - F.col(f"{c}_midterm")).alias(f"{c}_improvement") for c in fx.COURSES])
    return stats.direction_table(corr_with_target(imp, IMPS, "outcome")).select("feature", "r", "direction")


@query("f13_stars_blank", with_(*PEARSON) + f"SELECT feature, {stars_sql('p', '')} AS stars FROM pp")
def f13_stars_blank(spark: SparkSession, sf_dir: str):
    """F13 variant: blank instead of 'ns'."""
    return stats.pearson_tests(_exo(spark, sf_dir), EX, "outcome", min_pairs=10, not_significant="").select("feature", "stars")
