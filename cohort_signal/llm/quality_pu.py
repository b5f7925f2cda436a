"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents marked good in the training part; all other
text is unlabelled, marks of bad documents are never used.  A small network
g(x) on text statistics minimises the non-negative unbiased risk

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]),  l = logistic,

by Adam steps on batches of both samples, as the estimator's authors do.  The
class prior is estimated first from a positive-against-unlabelled
fit: the least ratio, over score thresholds, of the unlabelled to the positive
share above the threshold (with a Dvoretzky-Kiefer-Wolfowitz allowance).
score = sigmoid(g).

Bounded sample: the fit uses at most about MAX_POSITIVE positives and
MAX_UNLABELLED other texts, drawn by a hash of the id; their statistics
(N_FEATURES numbers a text) are all that reaches the driver.  Every whole text
is scored in one pass without a shuffle.

Edge cases: null and empty texts are scored like a text of no words; rows with
a null id are left out; repeated rows are each scored; without positives or
without unlabelled text every score is 0.5; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, only, ship, slices, texts_of

MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
THRESHOLD = 0.3
FOLDS = 5
HIDDEN = 24
STEPS = 600
#: Rows of each sample that one step of the fit sees.
BATCH = 3_000
RATE = 0.02
SEED = 11

_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_UPPER = slice(65, 91)
_DIGIT = slice(48, 58)
_SPACE = [9, 10, 11, 12, 13, 32]
_SENTENCE = [ord(c) for c in ".,;:?!'\"-()"]
N_FEATURES = 22


def statistics(text: bytes | None) -> np.ndarray:
    """N_FEATURES numbers of one whole text."""
    text = text or b""
    words = text.split()
    n, size = len(words), len(text)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if size else np.zeros(256, np.int64)
    solid = max(1, size - int(byte[_SPACE].sum()))
    share = byte / max(1, size)
    letters = int(byte[_LETTER].sum())
    symbols = solid - letters - int(byte[_DIGIT].sum())
    counts = Counter(words)
    top = [c for _, c in counts.most_common(10)]
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    odd = symbols - int(byte[_SENTENCE].sum())
    ends = sum(not _LETTER[w[-1]] for w in words)
    nz = share[share > 0]
    return np.array([
        math.log1p(n), math.log1p(size), len(counts) / max(1, n), math.log1p(len(counts)) / max(1.0, math.log1p(n)),
        (top[0] if top else 0) / max(1, n), sum(top) / max(1, n),
        sum(map(eq, words, words[1:])) / max(1, n - 1),
        symbols / solid, odd / solid, int(byte[_DIGIT].sum()) / solid, int(byte[_UPPER].sum()) / max(1, letters),
        int(byte[ord("!")]) / solid, int(byte[ord("|")]) / solid,
        float(lengths.mean()), float(lengths.std()), math.log1p(int(lengths.max())),
        ends / max(1, n), len(line_counts) / max(1, len(lines)),
        sum(len(x) * (c - 1) for x, c in line_counts.items()) / max(1, size),
        math.log1p(size / max(1, len(lines))), float(-(nz * np.log(nz)).sum()),
        sum(1 for c in counts.values() if c == 1) / max(1, n),
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _descend(positive: np.ndarray, unlabelled: np.ndarray, gradients, steps: int) -> tuple:
    """Adam on a one-hidden-layer network; ``gradients`` maps the margins of
    a batch of each sample to the derivatives of the risk by each margin.  The
    rate falls to nearly nothing, so the last batches hardly move the result."""
    rng = np.random.default_rng(SEED)
    d = positive.shape[1]
    params = [rng.normal(0, 1 / math.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m = [np.zeros_like(p) for p in params]
    v = [np.zeros_like(p) for p in params]
    k, ku = min(BATCH, len(positive)), min(BATCH, len(unlabelled))
    for t in range(1, steps + 1):
        w1, b1, w2, b2 = params
        both = np.concatenate([positive[rng.integers(0, len(positive), k)], unlabelled[rng.integers(0, len(unlabelled), ku)]])
        rate = RATE * (0.01 + 0.99 * (1 + math.cos(math.pi * t / steps)) / 2)
        hidden = np.tanh(both @ w1 + b1)
        g = hidden @ w2 + b2[0]
        dg = np.concatenate(gradients(g[:k], g[k:]))
        back = np.outer(dg, w2) * (1 - hidden ** 2)
        grads = [both.T @ back + 1e-4 * w1, back.sum(0), hidden.T @ dg + 1e-4 * w2, np.array([dg.sum()])]
        for i, gr in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * gr
            v[i] = 0.999 * v[i] + 0.001 * gr ** 2
            params[i] = params[i] - rate * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(params)


def estimate_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled: the least ratio of the shares
    above a threshold, each widened by its uniform deviation bound."""
    cuts = np.quantile(positive_scores, np.linspace(0.02, 0.98, 97))
    p = 1 - np.searchsorted(np.sort(positive_scores), cuts, side="left") / len(positive_scores)
    u = 1 - np.searchsorted(np.sort(unlabelled_scores), cuts, side="left") / len(unlabelled_scores)
    room = math.sqrt(math.log(4 / delta) / 2) * (1 / math.sqrt(len(positive_scores)) + 1 / math.sqrt(len(unlabelled_scores)))
    best = int(np.argmin((u + room) / np.maximum(p, 1e-9)))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Fit prior and network to the statistics of the two samples."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))

    # half of each sample fits the positive-against-unlabelled network, the other half gives the prior
    w1, b1, w2, b2 = _descend(p[::2], u[::2], lambda gp, gu: (-_sigmoid(-gp) / len(gp), _sigmoid(gu) / len(gu)), STEPS // 2)
    def margin(z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ w1 + b1) @ w2 + b2[0]
    prior = estimate_prior(margin(p[1::2]) if len(p) > 1 else margin(p), margin(u[1::2]) if len(u) > 1 else margin(u))

    def risk(gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        as_positive = -prior * _sigmoid(-gp) / len(gp)
        if negative < 0:  # the estimated negative risk may not fall below zero: climb back
            return prior * _sigmoid(gp) / len(gp), -_sigmoid(gu) / len(gu)
        return as_positive - prior * _sigmoid(gp) / len(gp), _sigmoid(gu) / len(gu)

    w1, b1, w2, b2 = _descend(p, u, risk, STEPS)
    return Model(mean, scale, w1, b1, w2, float(b2[0]), prior)


def is_held_out(doc_id: Column) -> Column:
    return (F.crc32(doc_id.cast("string")) % FOLDS) == 0


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("quality")
    for batch in slices(batches):
        yield pa.record_batch({"doc_id": batch.column("doc_id"), "x": pa.array([statistics(t) for t in texts_of(batch)], pa.list_(pa.float64()))})


def _sample(df: DataFrame, most: int, part: int) -> DataFrame:
    """About ``most`` rows by a hash of the id (all, if fewer)."""
    total = df.count()
    if total <= most:
        return df
    cut = int(most / total * (1 << 30))
    return df.filter(F.pmod(F.xxhash64("doc_id", F.lit(SEED + part)), F.lit(1 << 30)) < cut)


def _matrix(texts: DataFrame, most: int) -> np.ndarray:
    """Statistics of at most ``most`` texts in the order of their ids; no text
    leaves the task that reads it."""
    rows = texts.select("doc_id", "text").mapInArrow(_featurise, "doc_id long, x array<double>").limit(most).toArrow()
    col = rows.sort_by("doc_id").column("x").combine_chunks()
    return np.asarray(col.flatten()).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from the training part of ``docs`` (doc_id, text) and the
    positives of ``labels`` (doc_id, quality); None without either sample."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter((F.col("quality") == 1) & F.col("doc_id").isNotNull())
    good = _sample(good.filter(~is_held_out(F.col("doc_id"))).select("doc_id"), MAX_POSITIVE, 1).limit(2 * MAX_POSITIVE)
    # at most 2 * MAX_POSITIVE ids
    positive = _matrix(src.join(F.broadcast(good.distinct()), "doc_id", "left_semi"), 2 * MAX_POSITIVE)
    unlabelled = _matrix(_sample(src, MAX_UNLABELLED, 2), 2 * MAX_UNLABELLED)
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled)


def _scores(model: Model | None, texts: list[bytes | None]) -> pa.Array:
    x = np.array([statistics(t) for t in texts]).reshape(-1, N_FEATURES)
    return pa.array(model.score(x) if model is not None else np.full(len(x), 0.5), pa.float64())


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    ship(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": _scores(model, texts_of(batch))})

    scored = src.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept.
    Only texts go to Python and only scores come back; nothing is shuffled."""
    ship(docs.sparkSession)
    model = train(docs, labels)

    @F.arrow_udf("double")
    def score_of(text: pa.Array) -> pa.Array:
        only("quality")
        return pa.concat_arrays([pa.array([], pa.float64()), *(_scores(model, text.slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist())
                                                               for at in range(0, len(text), SLICE_ROWS))])

    return docs.filter(score_of(F.col("text").cast("string")) >= THRESHOLD)
