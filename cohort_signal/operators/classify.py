"""Two-class models and their scores.

``newton_fits`` fits many L2-penalised logistic regressions at once (e.g.
every (repeat, fold) training set of a repeated K-fold): a Newton step is one
pass in which each block of rows gives the gradients and Hessians of all fits
by matrix products, so 50 CV fits cost about 8 passes over unexpanded rows.  The
objective is C * sum(logloss) + ||w||^2 / 2 with an unpenalised intercept,
the reference toolkit's default (C = 1).

``exact_auc`` is the Mann-Whitney form with average ranks for ties,
computed by distributed prefix sums (no global window, no binning).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocked import logistic_sums
from .ranking import prefix_sums

NEWTON_MAX_ITER = 25
MAX_FITS = 10_000
MLLIB_MAX_ITER = 200
NEWTON_TOL = 1e-10


def newton_fits(data: DataFrame, features: Sequence[str], label: str, members: Sequence[str], fits: Sequence[tuple[int, object, bool]],
                c: float = 1.0, max_iter: int = NEWTON_MAX_ITER) -> np.ndarray:
    """(fits, p) coefficients [intercept, w_1..w_p] of several fits over one
    table, which is read once a step (persist it).  ``fits`` says which rows a
    fit takes (``blocked.logistic_sums``).  Raises when ``max_iter`` steps do
    not bring the last change, by the largest coefficient, under NEWTON_TOL."""
    p = len(features) + 1
    beta = np.zeros((len(fits), p))
    pen = np.eye(p)
    pen[0, 0] = 0.0
    moved = math.inf if fits else 0.0
    for _ in range(max_iter if fits else 0):
        sums = logistic_sums(data, features, label, members, fits, beta)
        if sums is None:
            raise ValueError("no rows to fit")
        moved = 0.0
        for f, s in enumerate(sums):
            step = np.linalg.solve(s[:, 1:] * c + pen, s[:, 0] * c - pen @ beta[f])
            beta[f] += step
            moved = float(np.maximum(moved, np.max(np.abs(step)) / np.maximum(1.0, np.max(np.abs(beta[f])))))  # NaN stays
        if moved < NEWTON_TOL:
            break
    if not moved < NEWTON_TOL:
        raise RuntimeError(f"logistic fit not converged after {max_iter} steps: last change {moved:.3g}")
    return beta


def logistic_newton(df: DataFrame, features: Sequence[str], label: str, group_cols: Sequence[str] = (),
                    c: float = 1.0, max_iter: int = NEWTON_MAX_ITER) -> dict[tuple, np.ndarray]:
    """Per group (at most MAX_FITS): coefficients [intercept, w_1..w_p];
    without rows there is no group and no fit."""
    keys = list(group_cols)
    data = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label)).persist()
    try:
        if not keys:
            return {(): newton_fits(data, features, label, [], [(-1, None, True)], c, max_iter)[0]}
        groups = [tuple(r) for r in data.select(*keys).distinct().limit(MAX_FITS + 1).collect()]
        if len(groups) > MAX_FITS:
            raise ValueError(f"more than {MAX_FITS} groups")
        numbered = df.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], data.select(*keys).schema.add("_fit", "integer"))
        beta = newton_fits(data.join(F.broadcast(numbered), keys), features, label, ["_fit"], [(0, i, True) for i in range(len(groups))], c, max_iter)
        return dict(zip(groups, beta))
    finally:
        data.unpersist()


def logistic_cv(df: DataFrame, features: Sequence[str], label: str, fold_cols: Sequence[str], k: int) -> DataFrame:
    """Repeated k-fold CV of a logistic model, one repeat per fold
    column: (rep, fold, auc, n_pos, n_neg, accuracy).  The table is passed once
    a Newton step for all repeats and folds; a held-out row is scored once a
    repeat with the coefficients of its own fold."""
    data = df.select(*features, label, *fold_cols).persist()
    try:
        cells = [(r, h) for r in range(len(fold_cols)) for h in range(k)]
        beta = newton_fits(data, features, label, list(fold_cols), [(r, h, False) for r, h in cells])
        spark = df.sparkSession
        coef = spark.createDataFrame([(r, h, [float(v) for v in b]) for (r, h), b in zip(cells, beta)], "rep int, fold int, _b array<double>")
        held = F.explode(F.array(*[F.struct(F.lit(r).alias("rep"), F.col(c).cast("int").alias("fold")) for r, c in enumerate(fold_cols)]))
        x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
        z = F.aggregate(F.zip_with("_x", "_b", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        scored = (data.select(x.alias("_x"), label, held.alias("_h")).select("_x", label, "_h.*")
                  .join(F.broadcast(coef), ["rep", "fold"]).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))
        auc = exact_auc(scored, label, "score", ["rep", "fold"])
        acc = scored.groupBy("rep", "fold").agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"))
        return cut_lineage(auc.join(acc, ["rep", "fold"]))
    finally:
        data.unpersist()


def score_column(beta: Sequence[float], features: Sequence[str]) -> Column:
    """Probability of class 1 as one inlined expression."""
    z = F.lit(float(beta[0]))
    for f, w in zip(features, beta[1:]):
        z = z + F.lit(float(w)) * F.col(f)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def exact_auc(scored: DataFrame, label: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """ROC AUC per key group, ties counted one half."""
    keys = list(keys)
    counts = scored.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    ranked = prefix_sums(counts, keys, score, ["neg"])
    g = ranked.groupBy(*keys) if keys else ranked.groupBy()
    s = g.agg(F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5)).alias("u"),
              F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return s.select(*keys, F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auc"),
                    "n_pos", "n_neg")


def mllib_logistic(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0):
    """M9 with Spark ML: regParam = 1 / (C n) reproduces the C-weighted
    objective (features must already be standardised).  Raises when
    MLLIB_MAX_ITER steps do not converge."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    n = df.count()
    va = VectorAssembler(inputCols=list(features), outputCol="_features")
    lr = LogisticRegression(featuresCol="_features", labelCol=label, regParam=1.0 / (c * n),
                            elasticNetParam=0.0, standardization=False, maxIter=MLLIB_MAX_ITER, tol=1e-12)
    model = lr.fit(va.transform(df.withColumn(label, F.col(label).cast("double"))))
    if model.summary.totalIterations >= MLLIB_MAX_ITER:
        raise RuntimeError(f"logistic fit not converged after {MLLIB_MAX_ITER} steps")
    return model
