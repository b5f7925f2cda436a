"""Invariants from the survey's test plan on small hand-built frames."""

import numpy as np
from pyspark.sql import functions as F

from cohort_signal.operators import classify, cohort, evaluate, linear, profile, risk


def test_tier_counts_fixed_order_and_absent_tier(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 188.5), (3, 300.0), (4, 301.0)], "entity_id long, predicted double")
    out = risk.tier_counts(risk.tiered(df, 194.0)).orderBy("level_order").collect()
    assert [(r["risk_level"], r["n"]) for r in out] == [("HIGH RISK", 1), ("AT RISK", 1), ("BORDERLINE", 0), ("LIKELY PASS", 2)]
    assert sum(r["n"] for r in out) == 4 and abs(sum(r["pct"] for r in out) - 100.0) < 1e-9


def test_confusion_cells_sum_and_undefined_rates(spark):
    df = spark.createDataFrame([(200.0, 210.0), (199.0, 250.0), (198.0, 180.0)], "actual double, pred double")
    r = evaluate.confusion(df, "actual", "pred", 194.0).first()
    assert r["tp"] + r["tn"] + r["fp"] + r["fn"] == 3
    assert r["fail_catch_rate"] is None and r["pass_recall"] == 2 / 3  # no actual failures


def test_nway_outer_equals_chained_full_joins(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "entity_id long, name string, a double")
    b = spark.createDataFrame([(2, "y", 20.0), (3, "z", 30.0)], "entity_id long, name string, b double")
    c = spark.createDataFrame([(3, "z", 300.0)], "entity_id long, name string, c double")
    got = sorted(tuple(r) for r in cohort.nway_outer({"a": a, "b": b, "c": c}).select("entity_id", "name", "a", "b", "c").collect())
    assert got == [(1, "x", 1.0, None, None), (2, "y", 2.0, 20.0, None), (3, "z", None, 30.0, 300.0)]


def test_coalesce_update_keeps_old_values(spark):
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "entity_id long, v double")
    upd = spark.createDataFrame([(1, None), (2, 5.0)], "entity_id long, v double")
    got = sorted(tuple(r) for r in cohort.coalesce_update(base, upd, ["v"]).collect())
    assert got == [(1, 1.0), (2, 5.0)]


def test_kde_mass_and_trend_line(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(10, 2, 500)
    y = 3 * x + rng.normal(0, 1, 500) + 4
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    kde = sorted((r["x"], r["density"]) for r in profile.kde_grid(df, "x").collect())
    xs, ds = np.array([k[0] for k in kde]), np.array([k[1] for k in kde])
    assert len(kde) == 200 and abs(np.trapezoid(ds, xs) - 1.0) < 0.01
    t = profile.trend_line(df, "x", "y").first()
    slope, intercept = np.polyfit(x, y, 1)
    assert np.isclose(t["slope"], slope, rtol=1e-9) and np.isclose(t["intercept"], intercept, rtol=1e-9)


def test_grouped_cv_single_group_equals_cv_linear(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 3))
    y = x @ [1.0, 2.0, -1.0] + rng.normal(size=120)
    rows = [(i, 1) + tuple(map(float, r)) + (float(t),) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "entity_id long, g int, a double, b double, c double, y double")
    df = df.withColumn("fold", linear.hash_fold(F.col("entity_id"), 5, 42))
    one = {r["fold"]: (r["r2"], r["mae"]) for r in linear.cv_linear(df, ["a", "b"], "y", "fold", alpha=1.0).collect()}
    grp = {r["fold"]: (r["r2"], r["mae"]) for r in
           linear.grouped_cv(df, ["a", "b", "c"], "y", "fold", "g", {1: ["a", "b"]}, alpha=1.0).collect()}
    for k in one:
        assert np.allclose(one[k], grp[k], rtol=1e-9)


def test_grouped_logistic_equals_separate_fits(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 2))
    g = rng.integers(0, 2, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -1.0] + g)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), float(c), int(d)) for a, (b, c), d in zip(g, x, y)],
                               "g int, a double, b double, y int")
    both = classify.logistic_newton(df, ["a", "b"], "y", ["g"])
    for k in (0, 1):
        single = classify.logistic_newton(df.filter(F.col("g") == k), ["a", "b"], "y")[()]
        assert np.allclose(both[(k,)], single, atol=1e-8)
