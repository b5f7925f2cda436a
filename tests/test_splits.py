"""Exact split sizes by selection on digests."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_signal.operators import classify, splits


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_split_has_the_first_keys_in_digest_order(spark):
    for n in (1, 4, 5, 6, 37, 3000):
        df = spark.range(n).withColumnRenamed("id", "k").repartition(3)
        got = {r.k for r in df.withColumn("s", splits.split_column(df, "k")).filter("s = 'test'").collect()}
        order = sorted(range(n), key=lambda i: md5(str(i)))
        assert got == set(order[:-(-n // 5)])
    empty = spark.range(0).withColumnRenamed("id", "k")
    assert empty.withColumn("s", splits.split_column(empty, "k")).count() == 0


def test_folds_of_all_repeats(spark):
    n = 1003
    df = spark.createDataFrame([(f"key {i}",) for i in range(n)], "k string").repartition(4)
    cols = splits.fold_columns(df, "k", 5, 42, 3)
    rows = df.select("k", *[c.alias(f"f{r}") for r, c in enumerate(cols)]).collect()
    for rep in range(3):
        order = sorted((r.k for r in rows), key=lambda k: md5(f"42-{rep}-{k}"))
        want = {k: int(fold) for fold, part in enumerate(np.array_split(order, 5)) for k in part}
        assert {r.k: r[f"f{rep}"] for r in rows} == want


def test_folds_within_groups_and_deep_cuts(spark, monkeypatch):
    monkeypatch.setattr(splits, "DIGITS", 1)  # many passes
    df = spark.createDataFrame([(i % 3, i) for i in range(400)] + [(7, 1), (7, 2)], "g int, k long")
    got = df.withColumn("f", splits.grouped_folds(df, "g", "k", 5, 1)).collect()
    for g in (0, 1, 2, 7):
        order = sorted((r.k for r in got if r.g == g), key=lambda k: md5(f"1-{k}"))
        want = {k: fold for fold, part in enumerate(np.array_split(order, 5)) for k in part}
        assert {r.k: r.f for r in got if r.g == g} == want
    assert splits.fold_starts(7, 5) == [2, 4, 5, 6]


def test_repeated_keys_at_a_cut_raise(spark):
    df = spark.createDataFrame([(1,)] * 10, "k long")
    with pytest.raises(ValueError):
        splits.split_column(df, "k")


def test_logistic_cv_equals_separate_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    y = (rng.random(240) < 1 / (1 + np.exp(-(x @ [1.0, -2.0])))).astype(int)
    df = spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))], "entity_id long, a double, b double, y int")
    names = ["_fold0", "_fold1"]
    df = df.withColumns(dict(zip(names, splits.fold_columns(df, "entity_id", 3, 42, 2)))).cache()
    got = {(r.rep, r.fold): r for r in classify.logistic_cv(df, ["a", "b"], "y", names, 3).collect()}
    assert len(got) == 6
    for rep in range(2):
        for fold in range(3):
            beta = classify.logistic_newton(df.filter(F.col(names[rep]) != fold), ["a", "b"], "y")[()]
            held = df.filter(F.col(names[rep]) == fold).withColumn("score", classify.score_column(beta, ["a", "b"]))
            want = classify.exact_auc(held, "y", "score").first()
            assert np.isclose(got[rep, fold].auc, want.auc, atol=1e-12)
            assert np.isclose(got[rep, fold].accuracy, held.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("y")).cast("double"))).first()[0])
    df.unpersist()
