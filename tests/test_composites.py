"""Conclusions, fold CV of tree models, permutations, binned densities."""

import math

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from cohort_signal.operators import conclusions, evaluate, explain, linear, profile, trees
from cohort_signal.plans import catalog_composites as cc


def _tests(spark, rows):
    return spark.createDataFrame(rows, "feature string, n long, r double, t double, p double")


def _cv(spark, r2, low, high, mae, std):
    return spark.createDataFrame([(50, r2, 0.1, mae, std, low, high)],
                                 "n_folds long, r2_mean double, r2_std double, mae_mean double, mae_std double, r2_ci_low double, r2_ci_high double")


def test_claims_follow_their_evidence(spark):
    strong = _tests(spark, [("a", 500, 0.8, 1.0, 1e-9), ("b", 500, 0.5, 1.0, 1e-9), ("c", 500, -0.2, 1.0, 1e-5)])
    table = conclusions.evidence(strong, _cv(spark, 0.4, 0.35, 0.45, 6.0, 0.5), _cv(spark, 0.2, 0.1, 0.3, 7.0, 0.5), "m", "early").cache()
    ev = {r.statistic: r for r in table.collect()}
    assert len(ev) == 9
    assert (ev["tested_correlations"].n, ev["significant_correlations"].n) == (3, 3)
    assert ev["strongest_r"].subject == "a" and ev["weakest_r"].subject == "c" and ev["strongest_vs_second"].subject == "b"
    half = 1.96 / math.sqrt(497)
    assert math.isclose(ev["weakest_r"].ci_low, math.tanh(math.atanh(-0.2) - half), rel_tol=1e-12)
    assert math.isclose(ev["worst_case_error"].value, 7.0) and math.isclose(ev["model_mae"].ci_high, 6 + 1.96 * 0.5 / math.sqrt(50))
    got = [(r.claim_no, r.claim, r.subject, r.confidence) for r in conclusions.conclusions(table).collect()]
    assert got == [(1, "features_relate_to_outcome", "features", "VERY HIGH"), (2, "among_the_strongest", "a", "HIGH"), (3, "strongest_of_all", "b", "HIGH"),
                   (4, "weakest_of_all", "c", "HIGH"), (5, "model_explains_outcome", "m", "HIGH"), (6, "early_warning_works", "early", "MODERATE"),
                   (7, "error_is_known", "m", "HIGH")]
    weak = _tests(spark, [("a", 30, 0.05, 1.0, 0.8), ("b", 30, 0.04, 1.0, 0.9)])
    table = conclusions.evidence(weak, _cv(spark, -0.1, -0.2, 0.0, 6.0, 9.0), _cv(spark, 0.3, 0.2, 0.4, 6.0, 0.5), "m", "early")
    assert [r.confidence for r in conclusions.conclusions(table).collect()] == ["LOW", "LOW", "MODERATE", "MODERATE", "LOW", "HIGH", "MODERATE"]


def test_conclusions_without_tests(spark):
    table = conclusions.evidence(_tests(spark, []), _cv(spark, 0.4, 0.3, 0.5, 6.0, 0.5), _cv(spark, 0.2, 0.1, 0.3, 6.0, 0.5), "m", "e")
    got = {r.claim: r.confidence for r in conclusions.conclusions(table).collect()}
    assert got == {"features_relate_to_outcome": "LOW", "strongest_of_all": None, "model_explains_outcome": "HIGH", "early_warning_works": "MODERATE", "error_is_known": "HIGH"}


def test_cv_of_trees_equals_a_fit_per_fold(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=120)
    df = spark.createDataFrame([(float(a), float(b), float(t), i % 3, (i // 3) % 3) for i, ((a, b), t) in enumerate(zip(x, y))],
                               "a double, b double, y double, f0 int, f1 int").coalesce(1).cache()

    def fit(d):
        return trees.random_forest(d, ["a", "b"], "y", n_trees=5, max_depth=3)

    got = {(r.rep, r.fold): r for r in trees.cv_trees(df, ["a", "b"], "y", ["f0", "f1"], 3, fit).collect()}
    assert sorted(got) == [(r, k) for r in range(2) for k in range(3)] and sum(r.n_test for r in got.values()) == 240
    model = fit(df.filter("f1 <> 2").select("a", "b", "y", "f0", "f1"))
    want = evaluate.regression_metrics(trees.predict(model, df.filter("f1 = 2"), ["a", "b"], "pred"), "y", "pred").first()
    assert math.isclose(got[1, 2].r2, want.r2, rel_tol=1e-9) and math.isclose(got[1, 2].mae, want.mae, rel_tol=1e-9)


def test_permutations_are_bijections(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        df = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(0), F.lit(1))).alias("rep"))
        got = df.select("i", "rep", explain.permuted(F.col("i"), F.col("rep"), n, 42).alias("p")).collect()
        for rep in (0, 1):
            assert sorted(r.p for r in got if r.rep == rep) == list(range(n))
    numbered, n = explain.positions(spark.range(57).repartition(5))
    assert n == 57 and sorted(r["_pos"] for r in numbered.collect()) == list(range(57))


def test_sampled_permutation_agrees_with_its_expectation(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = x @ [3.0, 1.0, 0.0] + rng.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "entity_id long, a double, b double, c double, y double").repartition(4)
    fit = linear.fit_linear(df, ["a", "b", "c"], "y")
    exact = {r.feature: r.importance for r in explain.permutation_importance(df, fit, "y").collect()}
    out = explain.permutation_importance_sampled(df, fit, "y", "entity_id", repeats=40)
    sampled = {r.feature: r.importance for r in out.collect()}
    assert all(abs(sampled[f] - exact[f]) < 0.03 for f in exact)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") <= 3
    assert explain.permutation_importance_sampled(df.limit(0), fit, "y", "entity_id").count() == 0


def test_binned_density_within_its_bound(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1, 500), rng.normal(8, 0.2, 100)])
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double")
    bw = v.std(ddof=1) * len(v) ** -0.2
    for bins in (64, 1 << 16):
        monkeypatch.setattr(profile, "KDE_BINS", bins)
        rows = profile.kde_grid(df, "x").collect()
        assert len(rows) == 200
        g = np.array([r.x for r in rows])
        want = np.exp(-((g[:, None] - v[None, :]) / bw) ** 2 / 2).sum(1) / (len(v) * bw * math.sqrt(2 * math.pi))
        bound = ((v.max() - v.min()) / bins / bw) ** 2 / 8 / (bw * math.sqrt(2 * math.pi))
        assert np.max(np.abs(np.array([r.density for r in rows]) - want)) <= bound + 1e-14


def test_risk_list_has_every_complete_entity(spark):
    cohort = cc._enhanced_cohort(spark, SF001)
    got = cc.q13_enhanced_risk_list(spark, SF001).collect()
    assert len(got) == cohort.count() == len({r.entity_id for r in got})
    assert [r.predicted for r in got] == sorted(r.predicted for r in got)
    assert all(r.pred_low <= r.predicted <= r.pred_high for r in got)
    known = cohort.filter("outcome is not null").count()
    cells = cc.q13_accuracy(spark, SF001).first()
    assert cells.tp + cells.tn + cells.fp + cells.fn == known
