"""Operators against brute force / numpy on small frames, and invariants."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_signal.operators import (attempts, classify, cohort, explain, features, linear,
                                     profile, ranking)


@pytest.mark.parametrize("rows_per_block,coarse", [(50_000, 64), (7, 64), (3, 2)])
def test_prefix_sums_match_brute_force(spark, monkeypatch, rows_per_block, coarse):
    # small targets force many blocks, and (coarse=2) the refined sketch
    monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", rows_per_block)
    monkeypatch.setattr(ranking, "COARSE_BLOCKS", coarse)
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 40, 300)
    keys = rng.integers(0, 3, 300)
    pdf = {}
    for k, v in zip(keys, vals):
        pdf[(int(k), int(v))] = pdf.get((int(k), int(v)), 0) + 1
    df = spark.createDataFrame([(k, v, c) for (k, v), c in pdf.items()], "k int, v int, w long")
    got = {(r["k"], r["v"]): r["w_below"] for r in ranking.prefix_sums(df, ["k"], "v", ["w"], n_blocks=16).collect()}
    for (k, v) in pdf:
        assert got[(k, v)] == sum(c for (k2, v2), c in pdf.items() if k2 == k and v2 < v)


@pytest.mark.parametrize("refined", [False, True])
def test_exact_quantiles_match_numpy(spark, monkeypatch, refined):
    if refined:  # several counting passes, down to single values
        monkeypatch.setattr(ranking, "BUCKETS", 3)
        monkeypatch.setattr(ranking, "FETCH", 1)
    rng = np.random.default_rng(2)
    a = np.round(rng.normal(50, 10, 257), 1)
    rows = [(float(x), float(x) if i % 3 else None) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double")
    q = ranking.exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75])
    b = np.array([r[1] for r in rows if r[1] is not None])
    assert np.allclose(q["a"], np.percentile(a, [25, 50, 75]), rtol=0, atol=1e-12)
    assert np.allclose(q["b"], np.percentile(b, [25, 50, 75]), rtol=0, atol=1e-12)


def test_contiguous_folds_sizes(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", 2)
    df = spark.range(7).withColumnRenamed("id", "entity_id")
    r = ranking.row_rank(df, "entity_id")
    folds = r.select(linear.contiguous_fold(F.col("_rank"), F.lit(7), 5).alias("f")).groupBy("f").count()
    assert sorted((x["f"], x["count"]) for x in folds.collect()) == [(0, 2), (1, 2), (2, 1), (3, 1), (4, 1)]


def test_missing_policy_thresholds(spark):
    rows = [(1.0, None, None, 1.0), (2.0, None, None, None), (3.0, 5.0, None, None), (4.0, 7.0, None, 2.0)]
    df = spark.createDataFrame(rows, "a double, half double, allnull double, most double")
    df = df.withColumn("most", F.when(F.col("a") > 3, F.col("most")))  # 3 of 4 missing
    plan = features.fit_missing(df, ["a", "half", "allnull", "most"])
    assert plan.dropped == ["allnull", "most"]           # > 50 % missing
    assert plan.medians == {"half": 6.0}                 # exactly 50 %: kept, imputed
    out = features.apply_missing(df, plan).orderBy("a").collect()
    assert [r["half"] for r in out] == [6.0, 6.0, 5.0, 7.0]
    assert [r["half_missing"] for r in out] == [1, 1, 0, 0]


def _xy(n=200, p=4, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) * [1, 5, 10, 0.5][:p] + [3, -2, 40, 1][:p]
    y = x @ np.array([1.5, -0.3, 0.2, 4.0][:p]) + rng.normal(size=n) * 2 + 7
    return x, y


def test_ols_and_ridge_match_numpy(spark):
    x, y = _xy()
    cols = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in cols) + ", y double")
    ols = linear.fit_linear(df, cols, "y")
    X1 = np.column_stack([np.ones(len(y)), x])
    ref = np.linalg.lstsq(X1, y, rcond=None)[0]
    assert np.allclose(ols.raw_coef, ref[1:], rtol=1e-9)
    assert np.isclose(ols.raw_intercept, ref[0], rtol=1e-9)
    # ridge on standardised features, intercept unpenalised
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    zc, yc = z - z.mean(0), y - y.mean()
    b = np.linalg.solve(zc.T @ zc + np.eye(len(cols)), zc.T @ yc)
    ridge = linear.fit_linear(df, cols, "y", alpha=1.0)
    assert np.allclose(ridge.coef, b, rtol=1e-9)


def test_cv_fold_r2_matches_direct_fit(spark):
    x, y = _xy(n=103)
    cols = [f"x{i}" for i in range(x.shape[1])]
    rows = [(i,) + tuple(map(float, r)) + (float(t),) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "entity_id long, " + ", ".join(f"{c} double" for c in cols) + ", y double")
    df = df.withColumn("fold", linear.hash_fold(F.col("entity_id"), 5, 42))
    res = {r["fold"]: r for r in linear.cv_linear(df, cols, "y", "fold", alpha=1.0).collect()}
    folds = {r["entity_id"]: r["fold"] for r in df.select("entity_id", "fold").collect()}
    f = np.array([folds[i] for i in range(len(y))])
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    assert sum(r["n_test"] for r in res.values()) == len(y)
    for k, r in res.items():
        tr, te = f != k, f == k
        zc = z[tr] - z[tr].mean(0)
        b = np.linalg.solve(zc.T @ zc + np.eye(len(cols)), zc.T @ (y[tr] - y[tr].mean()))
        pred = y[tr].mean() + (z[te] - z[tr].mean(0)) @ b
        r2 = 1 - np.sum((y[te] - pred) ** 2) / np.sum((y[te] - y[te].mean()) ** 2)
        assert np.isclose(r["r2"], r2, rtol=1e-8)
        assert np.isclose(r["mae"], np.mean(np.abs(y[te] - pred)), rtol=1e-8)


def test_exact_auc_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", 2)
    rng = np.random.default_rng(4)
    s = rng.integers(0, 10, 400).astype(float)
    lab = (rng.random(400) < 0.3 + s / 30).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, lab)], "score double, label int")
    got = classify.exact_auc(df, "label", "score").first()["auc"]
    pos, neg = s[lab == 1], s[lab == 0]
    brute = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert np.isclose(got, brute, rtol=1e-12)


def test_newton_logistic_matches_mllib(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.5] + 0.3)))).astype(int)
    df = spark.createDataFrame([tuple(map(float, r)) + (int(t),) for r, t in zip(x, y)], "a double, b double, c double, y int")
    beta = classify.logistic_newton(df, ["a", "b", "c"], "y")[()]
    m = classify.mllib_logistic(df, ["a", "b", "c"], "y")
    assert np.allclose(beta[1:], m.coefficients.toArray(), atol=1e-5)
    assert np.isclose(beta[0], m.intercept, atol=1e-5)


def test_permutation_closed_form_and_attributions(spark):
    x, y = _xy(n=400, p=3)
    cols = ["x0", "x1", "x2"]
    rows = [(i,) + tuple(map(float, r)) + (float(t),) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "entity_id long, x0 double, x1 double, x2 double, y double")
    fit = linear.fit_linear(df, cols, "y")
    closed = {r["feature"]: r["importance"] for r in explain.permutation_importance(df, fit, "y").collect()}
    sampled = {r["feature"]: r["importance"] for r in
               explain.permutation_importance_sampled(df, fit, "y", "entity_id", repeats=30).collect()}
    for c in cols:
        assert abs(closed[c] - sampled[c]) < 0.1 * max(closed[c], 0.05)
    att = explain.attributions(df, fit, "entity_id").groupBy("entity_id").agg(F.sum("attribution").alias("s"))
    pred = df.select("entity_id", fit.predict().alias("p"))
    mean_p = pred.agg(F.avg("p")).first()[0]
    chk = att.join(pred, "entity_id").select(F.max(F.abs(F.col("s") - (F.col("p") - F.lit(mean_p))))).first()[0]
    assert chk < 1e-8


def test_attempt_summary_gaps(spark):
    import datetime as dt
    rows = [(1, 1, dt.date(2024, 1, 1), 50.0), (1, 3, dt.date(2024, 6, 1), 70.0), (2, 1, dt.date(2024, 1, 1), 60.0)]
    df = spark.createDataFrame(rows, "entity_id long, attempt_no int, attempt_date date, score double")
    s = {r["entity_id"]: r for r in attempts.attempt_summary(df).collect()}
    assert s[1]["total_attempts"] == 2 and s[1]["first_score"] == 50.0 and s[1]["latest_score"] == 70.0
    assert s[1]["score_change"] == 20.0 and s[1]["attempt2_score"] is None
    assert s[2]["score_change"] is None


def test_histogram_counts_sum_to_n(spark):
    df = spark.createDataFrame([(float(i % 17),) for i in range(500)], "x double")
    h = profile.histogram(df, "x", 25)
    assert h.agg(F.sum("n")).first()[0] == 500
    assert h.agg(F.max("bin")).first()[0] == 24  # the maximum lands in the last (closed) bin


def test_anti_join_and_partitions(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "entity_id long")
    o = spark.createDataFrame([(2,), (4,)], "entity_id long")
    assert [r[0] for r in cohort.current_cohort(a, o).orderBy("entity_id").collect()] == [1, 3]
    assert [r[0] for r in cohort.key_difference(a, o).orderBy("entity_id").collect()] == [1, 3]


def test_moments_of_blocks_equal_numpy(spark):
    """One form at every width: 3 and 30 columns, by key, and over repeats."""
    from pyspark.sql.types import IntegerType, StructField

    rng = np.random.default_rng(12)
    for d in (3, 30):
        x = rng.normal(50, 5, (400, d))
        g, h = rng.integers(0, 3, 400), rng.integers(0, 4, 400)
        cols = [f"x{i}" for i in range(d)]
        df = spark.createDataFrame([(int(a), int(b), *map(float, r)) for a, b, r in zip(g, h, x)],
                                   "g int, h int, " + ", ".join(f"{c} double" for c in cols)).repartition(5)
        shift = [49.0] * d
        got = linear.moments_by(df, cols, ["g"], shift)
        assert sorted(got) == [(0,), (1,), (2,)]
        for (k,), m in got.items():
            z = x[g == k] - 49.0
            assert m.n == len(z) and np.allclose(m.s, z.sum(0), rtol=1e-10) and np.allclose(m.m, z.T @ z, rtol=1e-10)
        views = [((0,), ["g"]), ((1,), ["h"])]
        both = linear.moments_by(df, cols, shift=shift, key_fields=[StructField("rep", IntegerType()), StructField("fold", IntegerType())], views=views)
        assert sorted(both) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (1, 3)]
        assert all(both[1, k].n == int((h == k).sum()) for k in range(4))
    assert linear.moments_by(df.limit(0), cols, ["g"]) == {}
    assert linear.moments_by(df.limit(0), cols)[()].n == 0


def test_least_squares_by_triangular_factors(spark):
    """Nearly dependent features: a rounded mean beside its parts."""
    rng = np.random.default_rng(7)
    x = rng.uniform(20, 60, (300, 5))
    x = np.column_stack([x, np.round(x.mean(1), 2)])
    y = x @ [1.0, -2, 3, 0.5, 0, 4] + rng.normal(0, 3, 300) + 200
    cols = [f"x{i}" for i in range(6)]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in cols) + ", y double").repartition(7)
    mean, scale = x.mean(0), x.std(0)
    fit = linear.fit_least_squares(df, cols, "y", mean, scale, 200.0)
    want = np.linalg.lstsq(np.column_stack([np.ones(300), (x - mean) / scale]), y, rcond=None)[0]
    assert np.allclose(fit.coef, want[1:], rtol=1e-10) and np.isclose(fit.intercept, want[0], rtol=1e-12)
    normal = linear.fit_linear(df, cols, "y", 0.0, mean, scale, list(mean) + [200.0])
    assert np.max(np.abs(fit.coef / want[1:] - 1)) < np.max(np.abs(normal.coef / want[1:] - 1))
    same = df.withColumn("x5", F.col("x0"))
    x[:, 5] = x[:, 0]
    mean, scale = x.mean(0), x.std(0)
    least = np.linalg.lstsq(np.column_stack([np.ones(300), (x - mean) / scale]), y, rcond=None)[0]
    assert np.allclose(linear.fit_least_squares(same, cols, "y", mean, scale).coef, least[1:], rtol=1e-8)
    with pytest.raises(ValueError):
        linear.fit_least_squares(df.limit(0), cols, "y", mean, scale)
    few = linear.fit_least_squares(df.limit(3), cols, "y", mean, scale)
    assert np.isfinite(few.coef).all()


def test_repeated_cv_equals_cv_of_each_repeat(spark):
    x, y = _xy(n=160)
    cols = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "entity_id long, " + ", ".join(f"{c} double" for c in cols) + ", y double")
    df = df.withColumns({f"f{r}": linear.hash_fold(F.col("entity_id"), 4, 42, repeat=r) for r in range(3)})
    got = {(r.rep, r.fold): r for r in linear.repeated_cv(df, cols, "y", ["f0", "f1", "f2"], alpha=1.0).collect()}
    assert len(got) == 12
    for rep in range(3):
        for r in linear.cv_linear(df, cols, "y", f"f{rep}", alpha=1.0).collect():
            one = got[rep, r[f"f{rep}"]]
            assert (one.n_train, one.n_test) == (r.n_train, r.n_test) and np.allclose([one.r2, one.mae], [r.r2, r.mae], rtol=1e-10)


def test_moment_fits_match_mllib_linear_regression(spark):
    """SURVEY test plan (5): moment OLS / ridge agree with Spark ML."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    x, y = _xy(n=250)
    cols = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)],
                               ", ".join(f"{c} double" for c in cols) + ", y double")
    ols = linear.fit_linear(df, cols, "y")
    va = VectorAssembler(inputCols=cols, outputCol="f").transform(df)
    m = LinearRegression(featuresCol="f", labelCol="y", regParam=0.0, solver="normal").fit(va)
    assert np.allclose(ols.raw_coef, m.coefficients.toArray(), rtol=1e-8)
    assert np.isclose(ols.raw_intercept, m.intercept, rtol=1e-8)
    # ridge (alpha = 1 on population-standardised features): Spark ML's
    # objective scales the penalty by n and sigma_y (population)
    sc = features.fit_scaler(df, cols)
    z = features.apply_scaler(df, sc)
    ridge = linear.fit_linear(df, cols, "y", alpha=1.0)
    n, sy = len(y), float(np.std(y))
    vz = VectorAssembler(inputCols=cols, outputCol="f").transform(z)
    mr = LinearRegression(featuresCol="f", labelCol="y", regParam=1.0 * sy / n, elasticNetParam=0.0,
                          standardization=False, solver="normal").fit(vz)
    assert np.allclose(ridge.coef, mr.coefficients.toArray(), rtol=1e-8)


def test_fits_have_no_more_tasks_than_cores(spark):
    from cohort_signal.operators import trees
    # a task sends the statistics of all nodes, however few rows it has
    assert trees.fit_tasks(0, 12) == trees.fit_tasks(30_000, 12) == 1
    assert trees.fit_tasks(450_000, 12) == 9
    assert trees.fit_tasks(5_000_000, 12) == 12
    assert trees.fit_tasks(50_000_000, 12) == 50
    rows = spark.range(0, 4000, 1, 40)
    few = trees.for_fits(rows)
    assert few.rdd.getNumPartitions() == 1 and few.count() == 4000
    few.unpersist()


def test_compared_trees_are_fitted_side_by_side(spark, monkeypatch):
    """Each fit waits until the other has begun."""
    from cohort_signal.operators import trees
    from cohort_signal.plans import catalog_models
    both, forest, boosted = threading.Barrier(2, timeout=60), trees.random_forest, trees.boosted_trees
    monkeypatch.setattr(trees, "random_forest", lambda *a: (both.wait(), forest(*a, n_trees=2, max_depth=2))[1])
    monkeypatch.setattr(trees, "boosted_trees", lambda *a: (both.wait(), boosted(*a, rounds=1, max_depth=2))[1])
    got = {r.model for r in catalog_models._compare(spark, "/root/testdata/sf0.001").collect()}
    assert got == {"linear", "ridge", "random_forest", "boosted_trees"}

    def fails():
        raise ValueError("no rows")

    assert trees.side_by_side(spark, [lambda: 1, lambda: spark.range(3).count()]) == [1, 3]
    with pytest.raises(ValueError, match="no rows"):
        trees.side_by_side(spark, [lambda: 1, fails])
