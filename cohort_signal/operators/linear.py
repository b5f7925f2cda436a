"""Linear models from additive moments.

For z = (x_1..x_p, y) the sums n, sum z, sum z z^T are additive, so one pass
of block Gram matrices (``blocked``) gives the moments of every (checkpoint,
repeat, fold) cell, train moments of a fold are ``total - fold``, and a
population standardisation is an affine map of the moments.  The solve is a
(p x p) system on the driver (p <= ~50); only moments and coefficients ever
leave the executors.  R^2 of a held-out fold is a quadratic form in the test
fold's moments; MAE needs one more pass with the coefficients.

Values are shifted by a per-column constant (a global mean) before the sums
are formed, which keeps the centred cross-products accurate at any n.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from .blocked import View, block_states, gram_by, triangular


@dataclass
class Moments:
    n: float
    s: np.ndarray       # sum of z
    m: np.ndarray       # sum of z z^T
    shift: np.ndarray   # z = value - shift

    def __add__(self, o: "Moments") -> "Moments":
        return Moments(self.n + o.n, self.s + o.s, self.m + o.m, self.shift)

    def __sub__(self, o: "Moments") -> "Moments":
        return Moments(self.n - o.n, self.s - o.s, self.m - o.m, self.shift)

    def mean(self) -> np.ndarray:
        return self.s / self.n + self.shift

    def cov_pop(self) -> np.ndarray:
        zbar = self.s / self.n
        return self.m / self.n - np.outer(zbar, zbar)


def moments_by(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), shift: Sequence[float] | None = None,
               key_fields: Sequence[StructField] | None = None, views: Sequence[View] | None = None) -> dict[tuple, Moments]:
    """One pass: moments of ``cols`` per key tuple, from the Gram matrices of
    row blocks.  Rows must be complete on the columns that are used (a null
    counts as zero).  ``key_fields`` with ``views`` take keys of another form
    than plain columns (``blocked.block_states``)."""
    cols = list(cols)
    offset = np.zeros(len(cols)) if shift is None else np.asarray(shift, dtype=float)
    fields = [df.schema[k] for k in keys] if key_fields is None else list(key_fields)
    grams = gram_by(df, cols, offset, fields, views)
    if not fields and not grams:
        grams = {(): np.zeros((len(cols) + 1, len(cols) + 1))}
    return {k: Moments(float(g[0, 0]), g[0, 1:], g[1:, 1:], offset) for k, g in grams.items()}


def column_means(df: DataFrame, cols: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    return [float(row[f"a{i}"] or 0.0) for i in range(len(cols))]


@dataclass
class LinearFit:
    """Coefficients on standardised features plus the scaler constants."""
    features: list[str]
    coef: np.ndarray
    intercept: float
    mean: np.ndarray
    scale: np.ndarray
    n: float = 0.0

    @property
    def raw_coef(self) -> np.ndarray:
        return self.coef / self.scale

    @property
    def raw_intercept(self) -> float:
        return float(self.intercept - np.sum(self.coef * self.mean / self.scale))

    def predict(self) -> Column:
        """Prediction as one inlined linear expression over raw columns, in
        the centred form (which cancels less when features nearly depend)."""
        expr = F.lit(0.0)
        for c, w, m in zip(self.features, self.raw_coef, self.mean):
            expr = expr + F.lit(float(w)) * (F.col(c) - F.lit(float(m)))
        return F.lit(float(self.intercept)) + expr

    def coefficient_rows(self) -> list[tuple[str, float]]:
        return [(f, float(b)) for f, b in zip(self.features, self.coef)]


def scaler_from_moments(mom: Moments, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Population mean/std of the first p columns; std 0 -> scale 1."""
    mean = mom.mean()[:p]
    std = np.sqrt(np.maximum(np.diag(mom.cov_pop())[:p], 0.0))
    return mean, np.where(std > 0, std, 1.0)


def fit_from_moments(mom: Moments, features: Sequence[str], alpha: float = 0.0,
                     mean: np.ndarray | None = None, scale: np.ndarray | None = None) -> LinearFit:
    """OLS (alpha=0, least-squares/min-norm) or ridge with an unpenalised
    intercept on standardised features.  ``mean``/``scale`` are the scaler
    constants (fit elsewhere, e.g. on all rows); default: these rows."""
    p = len(features)
    if mean is None or scale is None:
        mean, scale = scaler_from_moments(mom, p)
    cov = mom.cov_pop() * mom.n
    d = 1.0 / scale
    a = cov[:p, :p] * np.outer(d, d)
    b = cov[:p, p] * d
    if alpha > 0:
        coef = np.linalg.solve(a + alpha * np.eye(p), b)
    else:
        coef = np.linalg.lstsq(a, b, rcond=None)[0]
    means = mom.mean()
    intercept = float(means[p] - np.sum(coef * (means[:p] - mean) / scale))
    return LinearFit(list(features), coef, intercept, np.asarray(mean), np.asarray(scale), mom.n)


def sse_from_moments(mom: Moments, fit: LinearFit) -> tuple[float, float]:
    """(SSE, SST) of ``fit`` on the rows summarised by ``mom``."""
    p = len(fit.features)
    w = fit.raw_coef
    a_shift = fit.raw_intercept + float(np.dot(w, mom.shift[:p])) - mom.shift[p]
    v = np.concatenate([-w, [1.0]])
    sse = float(v @ mom.m @ v - 2 * a_shift * (v @ mom.s) + mom.n * a_shift ** 2)
    sst = float(mom.m[p, p] - mom.s[p] ** 2 / mom.n)
    return max(sse, 0.0), sst


def r2_from_moments(mom: Moments, fit: LinearFit) -> float | None:
    sse, sst = sse_from_moments(mom, fit)
    return None if sst <= 0 else 1.0 - sse / sst


# --------------------------------------------------------------------------
# fold assignment
# --------------------------------------------------------------------------

def hash_bucket(key: Column, modulus: int, salt: str | Column | None = None) -> Column:
    """Deterministic bucket from md5 of the key text: the first 32 bits of the
    digest as an unsigned integer, mod ``modulus``."""
    text = key.cast("string") if salt is None else F.concat_ws("-", F.lit(salt) if isinstance(salt, str) else salt,
                                                                 key.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(modulus)).cast("int")


def split_flag(key: Column, test_percent: int = 20) -> Column:
    """M1: 'test' for ~test_percent % of keys by hash, else 'train'."""
    return F.when(hash_bucket(key, 100) < test_percent, F.lit("test")).otherwise(F.lit("train"))


def hash_fold(key: Column, k: int = 5, seed: int = 42, repeat: Column | int | None = None) -> Column:
    """M5/M6 fold id; with ``repeat`` each repetition reshuffles."""
    if repeat is None:
        return hash_bucket(key, k, str(seed))
    rep = repeat if isinstance(repeat, Column) else F.lit(repeat)
    return hash_bucket(key, k, F.concat_ws("-", F.lit(str(seed)), rep.cast("string")))


def contiguous_fold(rank: Column, n: Column, k: int = 5) -> Column:
    """Unshuffled K-fold over 0-based rank: the first n mod k folds get
    one extra row."""
    q = F.floor(n / k)
    r = n % k
    big = (q + 1) * r
    return F.when(rank < big, F.floor(rank / (q + 1))).otherwise(
        r + F.floor((rank - big) / F.greatest(q, F.lit(1)))).cast("int")


# --------------------------------------------------------------------------
# cross-validation from fold moments
# --------------------------------------------------------------------------

def _fold_fits(folds: dict, features: Sequence[str], alpha: float, scale_scope: str = "all") -> dict:
    """fold -> (n_train, n_test, r2, fit) of one group, from its fold moments."""
    total = None
    for mom in folds.values():
        total = mom if total is None else total + mom
    out = {}
    for fold, test in folds.items():
        train = total - test
        mean, scale = scaler_from_moments(total if scale_scope == "all" else train, len(features))
        fit = fit_from_moments(train, features, alpha, mean, scale)
        out[fold] = (int(train.n), int(test.n), r2_from_moments(test, fit), fit)
    return out


def _mean_errors(df: DataFrame, cols: Sequence[str], fields: Sequence[StructField], views: Sequence[View],
                 fits: dict[tuple, tuple[float, np.ndarray]]) -> dict[tuple, float]:
    """Mean absolute error per key of a linear prediction (intercept, raw
    coefficients of all but the last column); keys without a fit are left out."""

    def make(z: np.ndarray, key: tuple) -> np.ndarray:
        if key not in fits:
            return np.zeros(2)
        b0, b = fits[key]
        return np.array([len(z), np.abs(z[:, -1] - b0 - np.nan_to_num(z[:, :-1]) @ b).sum()])

    sums = block_states(df, cols, (2,), make, np.add, fields, views)
    return {k: float(s[1] / s[0]) for k, s in sums.items() if s[0]}


def _cv_views(df: DataFrame, features: Sequence[str], target: str, fields: list[StructField], views: list[View], alpha: float,
              scale_scope: str, with_mae: bool, shift: Sequence[float] | None) -> DataFrame:
    cols = [*features, target]
    if shift is None:
        shift = column_means(df, cols)
    by_group: dict[tuple, dict] = {}
    for key, mom in moments_by(df, cols, shift=shift, key_fields=fields, views=views).items():
        by_group.setdefault(key[:-1], {})[key[-1]] = mom
    found = {(*g, fold): cell for g, folds in by_group.items() for fold, cell in _fold_fits(folds, features, alpha, scale_scope).items()}
    out = [*fields, StructField("n_train", LongType()), StructField("n_test", LongType()), StructField("r2", DoubleType())]
    rows = [(*k, n_train, n_test, r2) for k, (n_train, n_test, r2, _) in found.items()]
    if with_mae:
        mae = _mean_errors(df, cols, fields, views, {k: (fit.raw_intercept, fit.raw_coef) for k, (_, _, _, fit) in found.items()})
        out.append(StructField("mae", DoubleType()))
        rows = [(*r, mae.get(k)) for r, k in zip(rows, found)]
    return df.sparkSession.createDataFrame(rows, StructType(out))


def cv_linear(df: DataFrame, features: Sequence[str], target: str, fold_col: str,
              group_cols: Sequence[str] = (), alpha: float = 0.0, scale_scope: str = "all",
              with_mae: bool = True, shift: Sequence[float] | None = None) -> DataFrame:
    """Per (group, fold): n_train, n_test, test R^2 and MAE of a linear model
    fit on the other folds.  ``scale_scope='all'`` standardises with all
    rows of the group (the reference's order), ``'train'`` with the fold's
    training rows.  Two passes in total, however many groups and folds."""
    keys = [*group_cols, fold_col]
    return _cv_views(df, list(features), target, [df.schema[k] for k in keys], [((), keys)], alpha, scale_scope, with_mae, shift)


def repeated_cv(df: DataFrame, features: Sequence[str], target: str, fold_cols: Sequence[str], alpha: float = 0.0,
                scale_scope: str = "all", with_mae: bool = True) -> DataFrame:
    """``cv_linear`` for several repeats, one per fold column: (rep, fold, ...).
    Rows are read once a pass, not once a repeat."""
    fields = [StructField("rep", IntegerType()), StructField("fold", IntegerType())]
    return _cv_views(df, list(features), target, fields, [((r,), [c]) for r, c in enumerate(fold_cols)], alpha, scale_scope, with_mae, None)


def cv_summary(folds: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """Mean and population std (ddof 0) of fold R^2 and MAE, with the
    normal 95 % interval mean +- 1.96 std / sqrt(k)."""
    g = folds.groupBy(*group_cols) if group_cols else folds.groupBy()
    k = F.count(F.lit(1))
    return g.agg(
        k.alias("n_folds"),
        F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
        F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"),
    ).withColumns({
        "r2_ci_low": F.col("r2_mean") - 1.96 * F.col("r2_std") / F.sqrt(F.col("n_folds")),
        "r2_ci_high": F.col("r2_mean") + 1.96 * F.col("r2_std") / F.sqrt(F.col("n_folds")),
    })


def fit_linear(df: DataFrame, features: Sequence[str], target: str, alpha: float = 0.0,
               scaler_mean: Sequence[float] | None = None,
               scaler_scale: Sequence[float] | None = None,
               shift: Sequence[float] | None = None) -> LinearFit:
    """M2/M3 on complete rows of ``df``: one pass for the moments (plus one
    for the shift when no approximate column means are supplied)."""
    cols = list(features) + [target]
    if shift is None:
        shift = column_means(df, cols)
    mom = moments_by(df, cols, (), shift)[()]
    mean = None if scaler_mean is None else np.asarray(scaler_mean, dtype=float)
    scale = None if scaler_scale is None else np.asarray(scaler_scale, dtype=float)
    return fit_from_moments(mom, features, alpha, mean, scale)


def fit_least_squares(df: DataFrame, features: Sequence[str], target: str, scaler_mean: Sequence[float],
                      scaler_scale: Sequence[float], target_mean: float = 0.0) -> LinearFit:
    """M2 by orthogonal factors instead of normal equations: the triangular
    factors of row blocks of [1, standardised features, target] are merged into
    one, whose leading part is solved for the last column.  The error grows
    with the condition of the features, not with its square.  Exactly
    dependent features get the solution of least norm.  Rows must be complete;
    no rows raise."""
    mean, scale = np.asarray(scaler_mean, dtype=float), np.asarray(scaler_scale, dtype=float)
    p = len(features)
    r = triangular(df, [*features, target], [*mean, target_mean], [*scale, 1.0])
    if r is None:
        raise ValueError("no rows to fit")
    solution = np.linalg.lstsq(r[:p + 1, :p + 1], r[:p + 1, p + 1], rcond=None)[0]
    return LinearFit(list(features), solution[1:], float(solution[0]) + target_mean, mean, scale)


def coefficient_frame(spark: SparkSession, fit: LinearFit) -> DataFrame:
    """(feature, coef, abs_coef, rank) on the standardised scale."""
    rows = sorted(fit.coefficient_rows(), key=lambda r: -abs(r[1]))
    return spark.createDataFrame(
        [(f, c, abs(c), i + 1) for i, (f, c) in enumerate(rows)],
        "feature string, coef double, abs_coef double, rank int")


def grouped_cv(df: DataFrame, all_features: Sequence[str], target: str, fold_col: str,
               group_col: str, features_for: dict, alpha: float = 0.0, min_rows: int = 0,
               extra_keys: Sequence[str] = ()) -> DataFrame:
    """Cross-validation for several feature sets in one pass.

    ``df`` holds one row per (group, entity) - e.g. a row exploded to every
    checkpoint it is complete for - with all features; ``features_for[g]``
    names the features of group g.  Moments of all features are summed per
    (group, extra keys, fold) once; each group's fits use its sub-block.
    Scaling uses all rows of the (group, extra keys) cell (scope 'all').
    Groups with fewer than ``min_rows`` rows are skipped.
    """
    spark = df.sparkSession
    allf = list(all_features)
    cols = allf + [target]
    keys = [group_col, *extra_keys, fold_col]
    fields = [df.schema[k] for k in keys]
    by: dict[tuple, dict] = {}
    for key, mom in moments_by(df, cols, keys, column_means(df, cols)).items():
        by.setdefault(key[:-1], {})[key[-1]] = mom
    rows, fits = [], {}
    for gk, folds in by.items():
        feats = list(features_for[gk[0]])
        idx = [allf.index(f) for f in feats] + [len(allf)]
        n = sum(mom.n for mom in folds.values())
        if n < min_rows:
            continue
        part = {fold: Moments(m.n, m.s[idx], m.m[np.ix_(idx, idx)], m.shift[idx]) for fold, m in folds.items()}
        for fold, (n_train, n_test, r2, fit) in _fold_fits(part, feats, alpha).items():
            full = np.zeros(len(allf))
            full[idx[:-1]] = fit.raw_coef
            fits[(*gk, fold)] = (fit.raw_intercept, full)
            rows.append((*gk, fold, int(n), n_train, n_test, r2))
    mae = _mean_errors(df, cols, fields, [((), keys)], fits)
    schema = StructType([*fields, *[StructField(c, LongType()) for c in ("n_rows", "n_train", "n_test")],
                         StructField("r2", DoubleType()), StructField("mae", DoubleType())])
    return spark.createDataFrame([(*r, mae.get(r[:len(keys)])) for r in rows], schema)
