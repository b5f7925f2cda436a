"""Helpers shared by the training-data operators.

Word rule used by the shingle operators: A-Z lower-cased, words are maximal
runs of bytes other than 0x20 and 0x09-0x0D (``bytes.split`` splits on exactly
these), so a text never needs a regular expression.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

import cohort_signal
from cohort_signal.session import scratch_path

#: Entries a worker's word cache may hold before it is emptied (about 60 MB).
WORD_CACHE_LIMIT = 400_000
#: Rows of one Arrow batch that are handled at a time.
SLICE_ROWS = 512
#: Bytes of an Arrow batch where rows are wide.
BATCH_BYTES = 4 << 20

_SHINGLE_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
     0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], dtype=np.uint64)


def ship(spark: SparkSession) -> None:
    """Let Python workers started by this session import the package from
    where the driver found it (on a cluster the package is installed or sent
    with --py-files and this changes nothing)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(cohort_signal.__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and
    read it back: later jobs start from the files, whichever executors have
    been lost meanwhile, and nothing upstream is computed twice."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs started inside send rows to Python in batches of at most about
    ``size`` bytes (a longer row is a batch of its own): a batch is held by the
    JVM, on the way and in Python, by every running task at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: What this worker remembers from task to task: owner -> how to forget it.
_REMEMBERED: dict[str, Callable[[], None]] = {}


def only(owner: str, forget: Callable[[], None] = lambda: None) -> None:
    """Called where ``owner``'s tasks begin: a worker serves the tasks of many
    stages in turn, and what those of others remember is dropped here, so that
    it holds one such table at a time."""
    others = [o for o in _REMEMBERED if o != owner]
    for other in others:
        _REMEMBERED.pop(other)()
    if others:
        pa.default_memory_pool().release_unused()
    _REMEMBERED[owner] = forget


class WordHashes(dict):
    """word -> 64-bit hash, remembered per worker up to WORD_CACHE_LIMIT."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()


def only_words() -> None:
    """``only`` for tasks that hash words."""
    only("words", _WORDS.clear)


def ascii_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers with good avalanche."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingle_set(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``size``-word shingles; with
    fewer words the whole sequence is the one shingle; without words empty."""
    h = hash_words(ascii_words(text))
    n = len(h)
    if n == 0:
        return h
    width = min(size, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        out += h[i:n - width + 1 + i] * _SHINGLE_MULTIPLIERS[i]
    return np.unique(mix64(out + np.uint64(width)))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()
