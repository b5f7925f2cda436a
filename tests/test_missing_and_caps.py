"""NaN is missing, numbers are parsed strictly, nothing is capped."""

import math

import pytest
from pyspark.sql import functions as F

from cohort_signal.functions import clean, rowwise
from cohort_signal.operators import attempts, classify, cohort, evaluate, features, profile, ranking
from cohort_signal.sources import io

NAN = float("nan")


def test_every_attempt_counts(spark):
    raw = spark.createDataFrame([(1, i, float(10 + i)) for i in range(1, 6)], "entity_id long, attempt_no int, score double")
    r = attempts.attempt_summary(raw.withColumn("attempt_date", F.lit("2024-01-01"))).first()
    assert (r.total_attempts, r.best_score, r.latest_score, r.score_change, r.attempt3_score) == (5, 15.0, 15.0, 4.0, 13.0)


@pytest.mark.parametrize("text,value", [("5d", None), ("7f", None), ("NaN", None), ("inf", None), (" 3.5 ", 3.5), ("-.5e1", -5.0), ("", None), ("4.", 4.0)])
def test_strict_numbers(spark, text, value):
    assert spark.range(1).select(clean.to_number(F.lit(text)).alias("x")).first().x == value


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, 50.0), (2, NAN), (3, None), (4, 130.0)], "entity_id long, x double")
    assert [r.c for r in df.orderBy("entity_id").select(rowwise.clip("x").alias("c")).collect()] == [50.0, None, None, 100.0]
    m = features.missing_rates(df, ["x"]).first()
    assert (m.missing_count, m.missing_pct) == (2, 50.0)
    d = profile.describe(df, ["x"]).first()
    assert d["count"] == 2 and d["max"] == 130.0 and not math.isnan(d["mean"])
    assert profile.mean_median(df, ["x"]).first()["median"] == 90.0


def test_name_of_first_course_wins(spark):
    a = spark.createDataFrame([(1, "Zoe Q", 1.0), (2, None, 2.0)], "entity_id long, name string, a double")
    b = spark.createDataFrame([(1, "Abe Q", 1.0), (2, "Bo", 2.0)], "entity_id long, name string, b double")
    assert {r.entity_id: r.name for r in cohort.nway_outer({"a": a, "b": b}).collect()} == {1: "Zoe Q", 2: "Bo"}


def test_empty_bins_are_rows(spark):
    df = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    assert [(r.bin, r.n) for r in profile.histogram(df, "x", 5).orderBy("bin").collect()] == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 1)]


def test_best_model_tie_goes_to_first_name(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", 0.1)], "model string, test_r2 double")
    assert evaluate.best_model(df).first().best_model == "a"


@pytest.mark.parametrize("n_blocks", [None, 5])
def test_ranks_of_text_keys(spark, monkeypatch, n_blocks):
    monkeypatch.setattr(ranking, "ROWS_PER_BLOCK", 40)
    names = [f"customer-{i * 7919 % 1000:04d}" for i in range(1000)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(names)], "k int, name string")
    alone = {r.name: r._rank for r in ranking.row_rank(df.select("name"), "name", n_blocks=n_blocks).select("name", "_rank").collect()}
    assert alone == {v: i for i, v in enumerate(sorted(names))}
    keyed = ranking.row_rank(df, "name", ["k"], n_blocks=n_blocks).collect()
    assert len(keyed) == 1000
    for k in range(3):
        own = sorted(v for i, v in enumerate(names) if i % 3 == k)
        assert [r["name"] for r in sorted((r for r in keyed if r.k == k), key=lambda r: r._rank)] == own
    assert ranking.row_rank(df.limit(0), "name").count() == 0
    assert ranking.row_rank(df.limit(0), "name", ["k"]).count() == 0


def test_unconverged_fit_raises(spark):
    df = spark.createDataFrame([(float(i % 5), float(i % 5 > 1 + i % 3)) for i in range(40)], "x double, y double")
    with pytest.raises(RuntimeError):
        classify.logistic_newton(df, ["x"], "y", max_iter=1)
    assert classify.logistic_newton(df.limit(0).withColumn("g", F.lit(1)), ["x"], "y", ["g"]) == {}


def test_chosen_file_keeps_its_own_header(spark, tmp_path):
    (tmp_path / "b gradebook.csv").write_text("id,extra,score\n1,x,N/A\n")
    (tmp_path / "a gradebook.csv").write_text("id,score\n7,N/A\n8,5\n")
    (tmp_path / "other.csv").write_text("id\n9\n")
    got = io.read_matching_file(spark, str(tmp_path), "gradebook")
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("7", None, "a gradebook.csv"), ("8", "5", "a gradebook.csv")]
    assert io.read_matching_file(spark, str(tmp_path), "gradebook", keep_na_text=True).filter("score = 'N/A'").count() == 1
    with pytest.raises(ValueError):
        io.read_matching_file(spark, str(tmp_path), "nothing")
