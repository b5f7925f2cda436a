"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Unit vectors whose cosine is at least the threshold lie within a distance
``reach`` of each other, so on a random direction their projections differ by
a normal variable of at most that deviation.  Vectors are sorted by their
projection on each of PROJECTIONS directions; a pair collides on a direction
when one lies in the window of WIDTH * reach around the other.  The number of
collisions of a pair at the threshold is binomial, which gives the count that
such a pair reaches with a chance of 1 - MISS; pairs that reach it are verified
by their exact cosine in doubles.

Counting all pairs this way takes work with the square of the table, so the
vectors are first dealt into slabs: each of a few random rotations splits the
space in two halves with directions in each, a slab is a pair of directions,
one of each half, and a vector joins the PROBES slabs of each rotation on
which its summed projection is largest.  Two vectors are counted in the first
slab they share.  The number of directions grows with the root of the number
of vectors, which keeps the mean slab at SLAB vectors, and the number of
rotations is set by a simulation of pairs at the threshold, such that all
rotations together miss a pair with a chance of MISS.  A slab of more than
BLOCK vectors is dealt out as pairs of blocks, so a task holds two blocks
whatever the slab; every block pair is counted, none is cut off.

Equal vectors are one vector with a weight from the start.  A task returns a
row per vector with its links' weights and the least vector it reaches inside
the task, never the pairs.  Vectors of different lengths are never linked.

Scale: work and shuffle grow with vectors * rotations * PROBES.  A group of g
different vectors that are all near each other has g * g / 2 links; counting
them takes that work, in tasks of bounded size that return links' sums only.

Edge cases: null, empty and zero vectors and those with null or non-finite
components are returned with no link; rows with a null id are left out; an id
that repeats is one vector, the least of its linkable ones; an empty table gives no
rows; other columns are ignored; components may be of any size, vectors are
scaled before they are squared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship
from .components import connected_components

THRESHOLD = 0.95
PROJECTIONS = 96
#: Half a window, as a multiple of the distance at the threshold.
WIDTH = 0.5
#: Chance that a pair at the threshold stays below the count, and that it shares no slab.
MISS = 1e-5
#: Mean number of vectors of a slab, slabs a vector joins in each rotation.
SLAB = 256
PROBES = 4
#: Vectors of a block; a task compares two.
BLOCK = 1024
#: Simulated pairs that the number of rotations is set by.
TRIALS = 4096
#: Verified together.
PAIRS = 1 << 16
SEED = 42

_SLABS = "node long, dim int, slabs array<long>"
_LINKS = "node long, links long, root long"


def reach(threshold: float) -> float:
    """Distance of unit vectors at the threshold."""
    return math.sqrt(2 - 2 * threshold)


def least_count(threshold: float, projections: int = PROJECTIONS, miss: float = MISS) -> int:
    """The collisions that a pair at the threshold has with a chance of 1 - miss."""
    p = math.erf(WIDTH / math.sqrt(2))
    below, k = 0.0, 0
    while True:
        below += math.comb(projections, k) * p ** k * (1 - p) ** (projections - k)
        if below > miss:
            return k
        k += 1


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in doubles."""
    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


class Slabs:
    """The slabs of one rotation of ``dim`` dimensions."""

    def __init__(self, dim: int, n: int, number: int):
        rng = np.random.default_rng([SEED, dim, number])
        self.number = number
        self.side = max(PROBES, math.ceil(math.sqrt(PROBES * n / SLAB)))
        self.turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        halves = [rng.standard_normal((self.side, dim // 2)), rng.standard_normal((self.side, dim - dim // 2))]
        self.directions = [h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-300) for h in halves]

    def of(self, x: np.ndarray) -> np.ndarray:
        """(len(x), PROBES) of slab numbers: the largest sums are made of the
        largest projections of either half."""
        turned = x @ self.turn
        half = x.shape[1] // 2
        picks, values = [], []
        for part, directions in ((turned[:, :half], self.directions[0]), (turned[:, half:], self.directions[1])):
            p = part @ directions.T
            best = np.argsort(-p, axis=1, kind="stable")[:, :PROBES]
            picks.append(best)
            values.append(np.take_along_axis(p, best, axis=1))
        sums = (values[0][:, :, None] + values[1][:, None, :]).reshape(len(x), -1)
        cells = (picks[0][:, :, None] * self.side + picks[1][:, None, :]).reshape(len(x), -1)
        top = np.argsort(-sums, axis=1, kind="stable")[:, :PROBES]
        return self.number * self.side ** 2 + np.take_along_axis(cells, top, axis=1)


def pairs_at(threshold: float, dim: int, trials: int = TRIALS) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors whose cosine is the threshold."""
    rng = np.random.default_rng([SEED, dim, 1 << 20])
    x = units(rng.standard_normal((trials, dim)))
    if dim == 1:
        return x, x
    y = rng.standard_normal((trials, dim))
    y = units(y - np.einsum("ij,ij->i", x, y)[:, None] * x)
    return x, threshold * x + math.sqrt(1 - threshold * threshold) * y


def calibrated(dim: int, n: int, threshold: float, miss: float = MISS) -> list[Slabs]:
    """As many rotations as make the chance to share no slab at most ``miss``,
    by the share of simulated pairs that the first four of them miss."""
    x, y = pairs_at(threshold, dim)
    first = [Slabs(dim, n, i) for i in range(4)]
    missed = [float(np.mean(~(s.of(x)[:, :, None] == s.of(y)[:, None, :]).any(axis=(1, 2)))) for s in first]
    rate = max(sum(missed) / len(missed), 1 / len(x))
    if rate >= 1:
        raise ValueError(f"pairs at a cosine of {threshold} in {dim} dimensions share no slab")
    count = max(1, math.ceil(math.log(miss) / math.log(rate)))
    return [first[i] if i < 4 else Slabs(dim, n, i) for i in range(count)]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    """Equally long lists as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if rows is not None:
        column = column.take(pa.array(rows))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _deal(rotations: dict[int, list[Slabs]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = np.nonzero(dims == dim)[0]
                x = units(_matrix(batch.column("v"), rows))
                slabs = np.concatenate([s.of(x) for s in rotations[int(dim)]], axis=1)
                yield pa.record_batch({"node": batch.column("node").take(pa.array(rows)), "dim": pa.array(np.full(len(rows), dim, dtype=np.int32)),
                                       "slabs": pa.array(list(slabs), pa.list_(pa.int64()))})

    return run


def shared_before(left: np.ndarray, right: np.ndarray, slab: int) -> np.ndarray:
    """(len(left), len(right)): whether two rows share a slab with a lower number."""
    both = np.concatenate([left, right])
    rows = np.repeat(np.arange(len(both)), both.shape[1])
    known, number, count = np.unique(both.ravel(), return_inverse=True, return_counts=True)
    use = (known < slab) & (count > 1)
    if not use.any():
        return np.zeros((len(left), len(right)), dtype=bool)
    place = np.cumsum(use) - 1
    inside = use[number]
    joined = np.zeros((len(both), int(use.sum())), dtype=np.float32)
    joined[rows[inside], place[number[inside]]] = 1
    return joined[:len(left)] @ joined[len(left):].T > 0


def collisions(left: np.ndarray, right: np.ndarray, window: float) -> np.ndarray:
    """(len(left), len(right)): on how many projections (columns) a row of
    ``right`` lies in the window around a row of ``left``."""
    counts = np.zeros(len(left) * len(right), dtype=np.int16)
    for k in range(left.shape[1]):
        order = np.argsort(right[:, k])
        line = right[order, k]
        lo = np.searchsorted(line, left[:, k] - window, side="left")
        size = np.searchsorted(line, left[:, k] + window, side="right") - lo
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) - np.repeat(ends - size - lo, size)
        counts[np.repeat(np.arange(len(left)) * len(right), size) + order[at]] += 1
    return counts.reshape(len(left), len(right))


def _least_reached(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least label each of ``n`` rows reaches over the links a - b."""
    least = label.copy()
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        if np.array_equal(now, least):
            return least
        least = now


def _count(directions: dict[int, np.ndarray], threshold: float, need: int) -> Callable[[pa.Table], pa.Table]:
    """One pair of blocks of one slab -> its vectors' links."""
    window = WIDTH * reach(threshold)

    def run(t: pa.Table) -> pa.Table:
        node = t.column("node").to_numpy()
        block = t.column("block").to_numpy()
        slab, lo, hi = (t.column(c)[0].as_py() for c in ("slab", "lo", "hi"))
        left = np.nonzero(block == lo)[0]
        right = np.nonzero(block == hi)[0]
        slabs = _matrix(t.column("slabs"))
        open_pairs = ~shared_before(slabs[left], slabs[right], slab)
        if lo == hi:
            open_pairs &= np.triu(np.ones_like(open_pairs), 1)
        empty = pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not open_pairs.any():
            return empty
        x = units(_matrix(t.column("v")))
        line = x @ directions[x.shape[1]]
        passed = open_pairs & (collisions(line[left], line[right], window) >= need)
        i, j = (side[k] for side, k in zip((left, right), np.nonzero(passed)))
        good = np.concatenate([np.einsum("ij,ij->i", x[i[s:s + PAIRS]], x[j[s:s + PAIRS]]) >= threshold for s in range(0, len(i), PAIRS)] or [np.zeros(0, dtype=bool)])
        i, j = i[good], j[good]
        if not len(i):
            return empty
        copies = t.column("copies").to_numpy()
        links = np.zeros(len(node), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        linked = np.unique(np.concatenate([i, j]))
        root = _least_reached(len(node), i, j, node)
        return pa.table({"node": node[linked], "links": links[linked], "root": root[linked]})

    return run


def near_duplicates(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per id: ``id_col``, n_links (other ids linked directly),
    component_id (the least id reachable) and kept."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    spark = table.sparkSession
    ship(spark)
    v = F.col(vector_col)
    usable = F.exists(v, lambda c: c != 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.when(usable, v).alias("v")).filter("id is not null")
    one = materialise(rows.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    nodes = materialise(one.filter("v is not null").groupBy("v").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
                        .withColumn("dim", F.size("v")), "distinct")
    sizes = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")).collect()}
    rotations = {d: calibrated(d, n, threshold) for d, n in sizes.items()}
    directions = {d: np.random.default_rng([SEED, d, 1 << 21]).standard_normal((d, PROJECTIONS)) for d in sizes}

    dealt = materialise(nodes.select("node", "dim", "v").mapInArrow(_deal(rotations), _SLABS), "slabs")
    members = dealt.select("node", "dim", F.explode("slabs").alias("slab"))
    filled = members.groupBy("dim", "slab").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK)
    tasks = (members.join(filled, ["dim", "slab"])
             .withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("node", "slab", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")))
    payload = nodes.join(dealt.drop("dim"), "node")
    found = (tasks.join(payload, "node").select("dim", "slab", "lo", "hi", "block", "node", "copies", "slabs", "v")
             .groupBy("dim", "slab", "lo", "hi").applyInArrow(_count(directions, threshold, least_count(threshold)), _LINKS))
    links = materialise(found, "links")
    roots = connected_components(links.select("node", "root"), "node", "root")
    per_node = (nodes.join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(roots, "node", "left")
                .select(F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                        F.coalesce("root", "node").alias("component_id")))
    return (one.join(per_node, F.col("v") == F.col("w"), "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col) == F.col("component_id")))
