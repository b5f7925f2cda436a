"""Tree ensembles with Spark ML.

Settings that matter for parity with the reference toolkit: every feature
is a split candidate (``featureSubsetStrategy='all'``), bootstrap on, and
more bins than the default 32 so continuous scores keep their resolution.
Per-tree predictions (M16) come from the forest's own tree models applied
in one projection (JVM-side), then a population std across the array.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .evaluate import regression_metrics

FEATURES_COL = "_features"
MAX_BINS = 128
#: Rows a task of a fit takes at least, where the table has them, and at most.
ROWS_PER_TASK, MOST_ROWS_PER_TASK = 50_000, 1_000_000


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES_COL).transform(df)


def fit_tasks(rows: int, cores: int) -> int:
    """Tasks of a fit on ``rows`` rows.  Every task sends the statistics of all
    nodes, whatever rows it has (features x bins x nodes of all trees: hundreds
    of MB for a forest), so there are no more tasks than cores, unless they
    would get too large."""
    return max(1, math.ceil(rows / MOST_ROWS_PER_TASK), min(math.ceil(rows / ROWS_PER_TASK), cores))


def for_fits(df: DataFrame) -> DataFrame:
    """``df`` in ``fit_tasks`` tasks, persisted."""
    return df.coalesce(fit_tasks(df.count(), df.sparkSession.sparkContext.defaultParallelism)).persist()


def random_forest(df: DataFrame, features: Sequence[str], label: str, n_trees: int = 100,
                  max_depth: int = 10, seed: int = 42):
    """M4: random forest regressor."""
    from pyspark.ml.regression import RandomForestRegressor
    rf = RandomForestRegressor(featuresCol=FEATURES_COL, labelCol=label, numTrees=n_trees, maxDepth=max_depth,
                               featureSubsetStrategy="all", maxBins=MAX_BINS, seed=seed, bootstrap=True)
    return rf.fit(_assemble(df.withColumn(label, F.col(label).cast("double")), features))


def boosted_trees(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100,
                  max_depth: int = 5, rate: float = 0.1, seed: int = 42):
    """Gradient-boosted trees (squared loss)."""
    from pyspark.ml.regression import GBTRegressor
    gbt = GBTRegressor(featuresCol=FEATURES_COL, labelCol=label, maxIter=rounds, maxDepth=max_depth,
                       stepSize=rate, maxBins=MAX_BINS, seed=seed)
    return gbt.fit(_assemble(df.withColumn(label, F.col(label).cast("double")), features))


def predict(model, df: DataFrame, features: Sequence[str], out: str = "prediction") -> DataFrame:
    return model.setPredictionCol(out).transform(_assemble(df, features)).drop(FEATURES_COL)


def tree_spread(model, df: DataFrame, features: Sequence[str], z: float = 1.96) -> DataFrame:
    """Forest prediction, std over trees (ddof 0) and pred +- z * std."""
    d = _assemble(df, features)
    names = []
    for i, t in enumerate(model.trees):
        name = f"_t{i}"
        d = t.copy().setPredictionCol(name).transform(d)
        names.append(name)
    arr = F.array(*[F.col(n) for n in names])
    k = float(len(names))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.lit(k)
    var = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.lit(k)
    out = d.withColumn("_mean", mean).withColumn("pred_std", F.sqrt(var))
    out = out.withColumn("predicted", F.col("_mean"))
    return out.withColumns({"pred_low": F.col("predicted") - F.lit(z) * F.col("pred_std"),
                            "pred_high": F.col("predicted") + F.lit(z) * F.col("pred_std")}) \
        .drop(FEATURES_COL, "_mean", *names)


def side_by_side(spark: SparkSession, fits: Sequence[Callable[[], object]]) -> list:
    """Results of independent fits, run from driver threads, each in a
    scheduler pool of its own: another takes the cores that one leaves idle."""
    def one(at: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{at}")
        try:
            return fits[at]()
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=len(fits)) as pool:
        return list(pool.map(inheritable_thread_target(spark)(one), range(len(fits))))


def fold_models(df: DataFrame, fold_cols: Sequence[str], k: int, fit: Callable[[DataFrame], object], threads: int = 8) -> dict[tuple[int, int], object]:
    """(repeat, fold) -> the model fitted on the other folds.  ``df`` is read
    by every fit, so persist it; the fits are independent Spark jobs and run
    side by side from driver threads, each in a scheduler pool of its own, so
    that one fit's small last stages do not leave the executors idle."""
    spark = df.sparkSession
    cells = [(r, h) for r in range(len(fold_cols)) for h in range(k)]

    def one(cell: tuple[int, int]):
        r, h = cell
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fold-{r}-{h}")
        try:
            return cell, fit(df.filter(F.col(fold_cols[r]) != h))
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=min(threads, len(cells))) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(one), cells))


def held_out(df: DataFrame, features: Sequence[str], label: str, fold_cols: Sequence[str], models: dict[tuple[int, int], object]) -> DataFrame:
    """(rep, fold, label, pred): every row scored once a repeat by the model
    that has not seen it; one plan, so one pass over the persisted table."""
    parts = [predict(model, df.filter(F.col(fold_cols[r]) == h), features, "pred")
             .select(F.lit(r).alias("rep"), F.lit(h).alias("fold"), F.col(label).cast("double").alias(label), "pred") for (r, h), model in models.items()]
    return reduce(DataFrame.unionByName, parts)


def cv_trees(df: DataFrame, features: Sequence[str], label: str, fold_cols: Sequence[str], k: int, fit: Callable[[DataFrame], object]) -> DataFrame:
    """M5 / M6 of a tree ensemble: (rep, fold, n_test, r2, mae), as
    ``linear.repeated_cv`` gives for a linear model.  ``fit`` takes a training
    table and returns a model on ``features``."""
    data = for_fits(df.select(*features, label, *fold_cols))
    try:
        models = fold_models(data, fold_cols, k, fit)
        scored = held_out(data, features, label, fold_cols, models)
        return cut_lineage(regression_metrics(scored, label, "pred", ["rep", "fold"]).select("rep", "fold", F.col("n").alias("n_test"), "r2", "mae"))
    finally:
        data.unpersist()


def importances(spark: SparkSession, model, features: Sequence[str], new_features: Sequence[str] = ()) -> DataFrame:
    """Normalised importances, sorted, with a marker for new features."""
    imp = model.featureImportances.toArray()
    total = float(imp.sum()) or 1.0
    rows = [(f, float(v) / total, f in set(new_features)) for f, v in zip(features, imp)]
    return spark.createDataFrame(rows, "feature string, importance double, is_new boolean") \
        .orderBy(F.col("importance").desc(), "feature")
