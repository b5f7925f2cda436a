"""Matrix statistics of row blocks, merged in a tree.

Linear and logistic fits need sums over rows of small matrices: Gram matrices,
triangular factors, gradients with Hessians.  Each Arrow batch is one matrix
whose statistic is a matrix product; a task keeps one state per key and
returns it once, so what leaves a task does not depend on its rows, and no row
is copied per fold, repeat or matrix cell.  States of the tasks are merged in
two grouped steps (at most FAN states a key after the first), so no merging
task sees more than a bounded share of them and the driver gets one per key.

A key comes from *views*: a view is a tuple of constants followed by columns
whose values complete the key, so a table with ten fold columns gives the
states of ten repeats in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..session import ship

#: States a key has after the first merging step.
FAN = 64
#: Keys a task holds before it passes their states on.
HELD_KEYS = 4096
#: Keys whose states may be collected; more raise.
MAX_KEYS = 100_000

View = tuple[tuple, list[str]]
Make = Callable[[np.ndarray, tuple], np.ndarray]
Merge = Callable[[np.ndarray, np.ndarray], np.ndarray]


def matrix(batch: pa.RecordBatch, cols: Sequence[str]) -> np.ndarray:
    """Columns of doubles as a matrix; nulls are NaN."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols]) if cols else np.zeros((batch.num_rows, 0))


def _groups(batch: pa.RecordBatch, view: View) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, rows) of one view."""
    constants, names = view
    code = np.zeros(batch.num_rows, dtype=np.int64)
    values = []
    for name in names:
        coded = batch.column(name).dictionary_encode(null_encoding="encode")
        values.append(coded.dictionary.to_pylist())
        code = code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    found, first = np.unique(code[order], return_index=True)
    for c, rows in zip(found.tolist(), np.split(order, first[1:])):
        key = []
        for v in reversed(values):
            key.append(v[c % len(v)])
            c //= len(v)
        yield (*constants, *reversed(key)), rows


def _states(cols: list[str], views: list[View], key_names: list[str], make: Make, merge: Merge, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(len(key_names))]
            return pa.record_batch([*columns, pa.array([s.ravel() for s in held.values()], pa.list_(pa.float64()))], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            z = matrix(batch, cols)
            for view in views:
                for key, rows in _groups(batch, view):
                    state = make(z[rows], key)
                    held[key] = merge(held[key], state) if key in held else state
            if len(held) > HELD_KEYS:
                yield out()
                held.clear()
        if held:
            yield out()

    return run


def _merged(key_names: list[str], shape: tuple[int, ...], merge: Merge) -> Callable[[pa.Table], pa.Table]:
    def run(t: pa.Table) -> pa.Table:
        states = t.column("state").combine_chunks().flatten().to_numpy().reshape(-1, *shape)
        total = states[0]
        for state in states[1:]:
            total = merge(total, state)
        return pa.table({**{n: t.column(n).slice(0, 1) for n in key_names}, "state": pa.array([total.ravel()], pa.list_(pa.float64()))})

    return run


def block_states(df: DataFrame, cols: Sequence[str], shape: tuple[int, ...], make: Make, merge: Merge,
                 keys: Sequence[StructField] = (), views: Sequence[View] | None = None) -> dict[tuple, np.ndarray]:
    """State of each key: ``make`` turns the rows of a block (a matrix of
    ``cols``, and their key) into a state of ``shape``, ``merge`` joins two.  ``keys`` are the
    key's fields; ``views`` say where their values come from (default: the
    columns of the same names).  No rows give no states."""
    from pyspark.sql.pandas.types import to_arrow_schema
    ship(df.sparkSession)
    names = [k.name for k in keys]
    views = list(views) if views is not None else [((), names)]
    schema = StructType([*keys, StructField("state", ArrayType(DoubleType()))])
    wanted = dict.fromkeys(c for _, cs in views for c in cs)
    src = df.select(*[F.col(c).cast("double").alias(f"_z{i}") for i, c in enumerate(cols)], *wanted)
    run = _states([f"_z{i}" for i in range(len(cols))], views, names, make, merge, to_arrow_schema(schema))
    states = src.mapInArrow(run, schema).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    join = _merged(names, shape, merge)
    some = states.groupBy(*names, "_part").applyInArrow(join, schema)
    rows = some.withColumn("_part", F.lit(0)).groupBy(*names, "_part").applyInArrow(join, schema).limit(MAX_KEYS + 1).collect()
    if len(rows) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} keys")
    return {tuple(r[n] for n in names): np.array(r["state"]).reshape(shape) for r in rows}


def gram_by(df: DataFrame, cols: Sequence[str], shift: Sequence[float], keys: Sequence[StructField] = (),
            views: Sequence[View] | None = None) -> dict[tuple, np.ndarray]:
    """Gram matrix of [1, cols - shift] per key; a null counts as zero."""
    d = len(cols) + 1
    offset = np.asarray(shift, dtype=np.float64)

    def make(z: np.ndarray, key: tuple) -> np.ndarray:
        one = np.column_stack([np.ones(len(z)), np.nan_to_num(z - offset, nan=0.0)])
        return one.T @ one

    return block_states(df, cols, (d, d), make, np.add, keys, views)


def triangular(df: DataFrame, cols: Sequence[str], mean: Sequence[float], scale: Sequence[float]) -> np.ndarray | None:
    """R of the QR factorisation of [1, (cols - mean) / scale] over all rows,
    from the factors of the blocks; None without rows."""
    d = len(cols) + 1
    m, s = np.asarray(mean, dtype=np.float64), np.asarray(scale, dtype=np.float64)

    def factor(a: np.ndarray) -> np.ndarray:
        if len(a) < d:
            a = np.vstack([a, np.zeros((d - len(a), d))])
        return np.linalg.qr(a, mode="r")

    def make(z: np.ndarray, key: tuple) -> np.ndarray:
        return factor(np.column_stack([np.ones(len(z)), (z - m) / s]))

    return block_states(df, cols, (d, d), make, lambda a, b: factor(np.vstack([a, b]))).get(())


def logistic_sums(df: DataFrame, features: Sequence[str], label: str, members: Sequence[str], fits: Sequence[tuple[int, object, bool]],
                  beta: np.ndarray) -> np.ndarray | None:
    """Gradient and Hessian sums of the log-likelihood of several logistic
    fits, (fits, p, 1 + p), p = features + 1.  Fit f takes the rows where
    column ``members[i]`` equals (or, if False, differs from) its value:
    ``fits[f] = (i, value, equal)``; i = -1 takes all rows."""
    p = len(features) + 1
    cols = [*features, label, *members]
    at = {i: len(features) + 1 + i for i in range(len(members))}

    def make(z: np.ndarray, key: tuple) -> np.ndarray:
        x = np.column_stack([np.ones(len(z)), z[:, :len(features)]])
        y = z[:, len(features)]
        mu = 1.0 / (1.0 + np.exp(-(x @ beta.T)))
        out = np.empty((len(fits), p, 1 + p))
        for f, (i, value, equal) in enumerate(fits):
            taken = np.ones(len(z), dtype=bool) if i < 0 else (z[:, at[i]] == value) == equal
            xf, m = x[taken], mu[taken, f]
            out[f, :, 0] = xf.T @ (y[taken] - m)
            out[f, :, 1:] = xf.T @ (xf * (m * (1.0 - m))[:, None])
        return out

    return block_states(df, cols, (len(fits), p, 1 + p), make, np.add).get(())
