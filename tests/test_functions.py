"""Column builders on tiny hand-built frames (edge cases from the survey)."""

import math

import pytest
from pyspark.sql import functions as F

from cohort_signal.functions import clean, labels, rowwise, tails


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_clip_keeps_null_and_clips(spark):
    got = one(spark, rowwise.clip("x"), [(-5.0,), (50.0,), (150.0,), (None,)], "x double")
    assert got == [0.0, 50.0, 100.0, None]


def test_row_mean_variance_min_skip_nulls(spark):
    df = spark.createDataFrame([(1.0, None, 3.0), (None, None, None), (4.0, None, None)], "a double, b double, c double")
    r = df.select(rowwise.row_mean(["a", "b", "c"]).alias("m"), rowwise.row_variance(["a", "b", "c"]).alias("v"),
                  rowwise.row_min(["a", "b", "c"]).alias("lo")).collect()
    assert r[0]["m"] == 2.0 and r[0]["v"] == 2.0 and r[0]["lo"] == 1.0
    assert r[1]["m"] is None and r[1]["v"] is None and r[1]["lo"] is None
    assert r[2]["m"] == 4.0 and r[2]["v"] is None  # one value: sample variance undefined


def test_round_half_even_matches_numpy(spark):
    import numpy as np
    vals = [2.675, 0.125, 0.135, 1.005, -2.5, 3.5]
    got = one(spark, rowwise.round_half_even(F.col("x"), 2), [(v,) for v in vals], "x double")
    assert got == [float(np.round(v, 2)) for v in vals]


def test_points_possible_and_test_accounts(spark):
    df = spark.createDataFrame([("\t  Points Possible",), ("Jane Test",), ("Ann",), (None,)], "Student string")
    kept = [r[0] for r in clean.drop_points_possible(df).collect()]
    assert kept == ["Jane Test", "Ann", None]
    flags = [r[0] for r in df.select(clean.is_test_account("Student")).collect()]
    assert flags == [False, True, False, False]


def test_id_extraction_and_number_parsing(spark):
    got = one(spark, clean.first_digit_run("s"), [("12345 - LOA",), ("abc",), (None,)], "s string")
    assert got == ["12345", None, None]
    nums = one(spark, clean.to_number("s"), [(" 12.5 ",), ("N/A",), ("",), ("7",)], "s string")
    assert nums == [12.5, None, None, 7.0]


def test_clean_name(spark):
    got = one(spark, clean.clean_name("s"), [('  "Doe, Jane"  ',)], "s string")
    assert got == ["Doe, Jane"]


def test_remediation_flag_cases(spark):
    cells = ["N/A", "", "0", "0.0", "77", None, " 0 ", "nan"]
    got = one(spark, clean.remediation_flag("s"), [(c,) for c in cells], "s string")
    assert got == [0, 0, 0, 0, 1, 0, 0, 0]


def test_risk_tier_edges(spark):
    t = 194.0
    preds = [t - 8.01, t - 8, t - 3.01, t - 3, t + 2.99, t + 3]
    got = one(spark, labels.risk_tier("p", t), [(p,) for p in preds], "p double")
    assert got == ["HIGH RISK", "AT RISK", "AT RISK", "BORDERLINE", "BORDERLINE", "LIKELY PASS"]


def test_risk_score_golden(spark):
    from cohort_signal.operators.risk import flag_at_risk
    df = spark.createDataFrame([(160,), (191,), (194,), (229,)], "predicted int")
    r = flag_at_risk(df, 194).collect()
    assert [x["risk_score"] for x in r] == [0.175, 0.015, 0.0, -0.18]
    assert [x["at_risk"] for x in r] == [True, True, False, False]


# goldens: regularized incomplete beta I_{nu/(nu+t^2)}(nu/2, 1/2), computed
# independently (continued fraction), not with the code under test
@pytest.mark.parametrize("t,nu,p", [(4.3957, 38, 8.585871592870888e-05), (3.2825, 38, 0.0022123246432480368),
                                    (1.5, 60000, 0.13361966418108684)])
def test_t_tail(spark, t, nu, p):
    got = one(spark, tails.t_two_sided_p(F.col("t"), F.col("nu")), [(t, nu)], "t double, nu int")[0]
    assert math.isclose(got, p, rel_tol=1e-7)


def test_t_tail_huge_dof_is_normal(spark):
    got = one(spark, tails.t_two_sided_p(F.col("t"), F.col("nu")), [(1.96, 10**9)], "t double, nu long")[0]
    assert math.isclose(got, 0.04999579, rel_tol=1e-5)


def test_normal_tail(spark):
    got = one(spark, tails.normal_two_sided_p(F.col("z")), [(1.96,), (0.0,)], "z double")
    assert math.isclose(got[0], 0.04999579, rel_tol=1e-6)
    assert math.isclose(got[1], 1.0, rel_tol=1e-9)
