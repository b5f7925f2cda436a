"""Invariants for outputs that have no SQL twin (forests, sinks)."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from cohort_signal.operators import trees


def _data(spark, n=300):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, 3))
    y = x @ [2.0, -1.0, 0.5] + rng.normal(size=n)
    return spark.createDataFrame([(i,) + tuple(map(float, r)) + (float(t),) for i, (r, t) in enumerate(zip(x, y))],
                                 "entity_id long, a double, b double, c double, y double")


def test_tree_spread_mean_is_forest_prediction(spark):
    df = _data(spark)
    feats = ["a", "b", "c"]
    model = trees.random_forest(df, feats, "y", n_trees=20, max_depth=4)
    sp = trees.tree_spread(model, df, feats).select("entity_id", "predicted", "pred_std", "pred_low", "pred_high")
    fp = trees.predict(model, df, feats, "forest").select("entity_id", "forest")
    j = sp.join(fp, "entity_id")
    worst = j.agg(F.max(F.abs(F.col("predicted") - F.col("forest")))).first()[0]
    assert worst < 1e-9
    assert j.filter((F.col("pred_std") < 0) | (F.col("pred_low") > F.col("predicted")) |
                    (F.col("predicted") > F.col("pred_high"))).count() == 0


def test_importances_normalised_and_sorted(spark):
    df = _data(spark)
    model = trees.random_forest(df, ["a", "b", "c"], "y", n_trees=20, max_depth=4)
    imp = trees.importances(spark, model, ["a", "b", "c"], new_features=["c"]).collect()
    assert abs(sum(r["importance"] for r in imp) - 1.0) < 1e-9
    assert [r["importance"] for r in imp] == sorted((r["importance"] for r in imp), reverse=True)
    assert {r["feature"]: r["is_new"] for r in imp}["c"] is True
    assert imp[0]["feature"] == "a"  # the strongest planted effect


def test_csv_sink_round_trip_keeps_values(spark):
    import __spark_entry__ as e
    back = e.queries()["s7_write_csv"](spark, SF001)
    orig = e.queries()["j1_merge"](spark, SF001)
    got = {r["entity_id"]: float(r["outcome"]) for r in back.select(F.col("entity_id").cast("long"), "outcome").collect()}
    want = {r["entity_id"]: r["outcome"] for r in orig.select("entity_id", "outcome").collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6
