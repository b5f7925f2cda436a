"""MinHash near-duplicate groups by circulant MinHash (C-MinHash).

One permutation ``sigma`` shuffles the shingles, a second one ``pi`` is
applied after shifting by 1, 2, ... K positions of its ring: coordinate k of a
document is the least ``pi(sigma(x) + k)`` over its shingles x.  Two
permutations of the 32-bit ring thus give all K coordinates.

Steps, all joins and groupings on Spark:
1. one pass over the texts gives set size, set digest and band keys;
2. documents with equal sets collapse into one representative;
3. each band bucket proposes (least member, member) pairs, which are
   confirmed on the full shingle sets; components of the links;
4. buckets that still hold more than one component are completed: every pair
   of different components that shares a band and whose signatures do not
   rule out the threshold is confirmed on the full sets, inside tasks of two
   blocks of at most about BLOCK members, so a bucket of any size becomes
   bounded tasks that return links only; members of a larger bucket's largest
   component meet its other members only, so a group of copies gives rows by
   its size times the blocks of what is near but not linked to it;
5. components of all links.

Chance to miss a pair at the threshold: below MISS for the banding, whose rows
and bands follow from the threshold (0.85: 32 bands of 6, (1 - 0.85^6)^32;
0.8: 38 bands of 5), and about 4e-6 for the signature filter of step 4.

Edge cases: a null or wordless text has no shingles and is linked with
nothing; fewer words than a shingle form one shingle; rows with a null id are
left out; rows that repeat an id are one document; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, only_words, shingle_set, ship, slices, texts_of
from .components import connected_components

SHINGLE = 5
THRESHOLD_PCT = 85
COORDINATES = 192
#: Chance that a pair at the threshold shares no band.
MISS = 3e-7
#: Shingles hashed together; keeps the work arrays inside the CPU cache.
CHUNK = 1 << 16
#: Members of a block; a completion task compares two blocks.
BLOCK = 256
#: Standard deviations below the threshold at which a signature rules a pair out.
SLACK = 4.5

_SIG_SCHEMA = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"


def _pi(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A bijection of the 32-bit ring."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(a)
    x ^= x >> np.uint32(15)
    x = x * np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), COORDINATES) of uint32; rows of empty sets are zero."""
    out = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
    filled = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(filled):
        rows, total = [], 0
        while at < len(filled) and (not rows or total + len(sets[filled[at]]) <= CHUNK):
            rows.append(filled[at])
            total += len(sets[filled[at]])
            at += 1
        x = np.concatenate([sets[i] for i in rows])
        x = _pi((x ^ (x >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
        starts = np.cumsum([0] + [len(sets[i]) for i in rows[:-1]])
        for k in range(COORDINATES):
            out[rows, k] = np.minimum.reduceat(_pi(x + np.uint32(k + 1), 0x21F0AAAD, 0xD35A2D97), starts)
    return out


def banding(threshold_pct: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which a pair at the threshold is
    missed with a chance below MISS."""
    for rows in range(COORDINATES, 0, -1):
        bands = COORDINATES // rows
        if (1 - (threshold_pct / 100) ** rows) ** bands < MISS:
            return bands, rows
    raise ValueError(f"a threshold of {threshold_pct} % needs more than {COORDINATES} coordinates")


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) of int64: one key per band; the band's number is part of it."""
    keys = np.zeros((len(sig), bands), dtype=np.uint64)
    for b in range(bands):
        acc = np.full(len(sig), b + 1, dtype=np.uint64)
        for r in range(rows):
            acc = mix64(acc ^ sig[:, b * rows + r].astype(np.uint64))
        keys[:, b] = acc
    return keys.view(np.int64)


def _sign(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_words()
        for batch in slices(batches):
            sets = [shingle_set(t, SHINGLE) for t in texts_of(batch)]
            sig = signatures(sets)
            full = np.array([len(s) > 0 for s in sets])
            keys = band_keys(sig, bands, rows)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "set_key": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                "bands": pa.array([k if f else None for k, f in zip(keys, full)], pa.list_(pa.int64())),
                "sig": pa.array([s.astype(np.uint8).tobytes() if f else None for s, f in zip(sig, full)], pa.binary()),
            })

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only_words()
    for batch in slices(batches):
        yield pa.record_batch({
            "node": batch.column("doc_id"),
            "shingles": pa.array([shingle_set(t, SHINGLE).tobytes() for t in texts_of(batch)], pa.binary()),
        })


def _near(x: np.ndarray, y: np.ndarray, threshold_pct: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if 100 * len(small) < threshold_pct * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= threshold_pct * (len(x) + len(y) - both)


def _confirm(threshold_pct: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs with both full sets -> those at or above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_words()
        for batch in slices(batches):
            keep = [_near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), threshold_pct)
                    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            keep = np.nonzero(keep)[0]
            yield pa.record_batch({"a": batch.column("a").take(pa.array(keep)), "b": batch.column("b").take(pa.array(keep))})

    return run


def _least_agreeing(threshold_pct: int) -> int:
    """Coordinates that a pair at the threshold agrees on, less SLACK deviations."""
    t = threshold_pct / 100
    return math.floor(COORDINATES * t - SLACK * math.sqrt(COORDINATES * t * (1 - t)))


def _open_pairs(t: pa.Table, threshold_pct: int) -> tuple[list[int], list[int]]:
    """Pairs of rows of one task (two blocks of one bucket) still to be
    confirmed: of different components, in the first band they share, with
    signatures and sizes that allow the threshold; each across the two blocks
    or inside the one block.  Both lists are row numbers."""
    comp = t.column("comp").to_numpy()
    block = t.column("block").to_numpy()
    n = t.column("n").to_numpy()
    m = len(comp)
    bands = np.asarray(t.column("bands").combine_chunks().flatten()).reshape(m, -1)
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(m, COORDINATES)
    key, lo, hi = t.column("bkey")[0].as_py(), t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    left = np.nonzero(block == lo)[0]
    right = np.nonzero(block == hi)[0]
    here = int(np.argmax(bands[0] == key))
    need = _least_agreeing(threshold_pct)
    out_i: list[int] = []
    out_j: list[int] = []
    for i in left:
        j = right[right > i] if lo == hi else right
        j = j[comp[j] != comp[i]]
        j = j[100 * np.minimum(n[j], n[i]) >= threshold_pct * np.maximum(n[j], n[i])]
        if not len(j):
            continue
        j = j[np.argmax(bands[j] == bands[i], axis=1) == here]
        j = j[np.count_nonzero(sig[j] == sig[i], axis=1) >= need]
        out_i += [int(i)] * len(j)
        out_j += j.tolist()
    return out_i, out_j


def _needed(threshold_pct: int) -> Callable[[pa.Table], pa.Table]:
    """Members of one task that have a pair to confirm."""

    def run(t: pa.Table) -> pa.Table:
        i, j = _open_pairs(t, threshold_pct)
        rows = pa.array(sorted(set(i) | set(j)), pa.int64())
        return t.take(rows)

    return run


def _complete(threshold_pct: int) -> Callable[[pa.Table], pa.Table]:
    """Links of one task, skipping pairs that earlier links have joined."""

    def run(t: pa.Table) -> pa.Table:
        i, j = _open_pairs(t, threshold_pct)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        comp = t.column("comp").to_pylist()
        node = t.column("node").to_pylist()
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        a, b = [], []
        for x, y in zip(i, j):
            cx, cy = find(comp[x]), find(comp[y])
            if cx != cy and _near(sets[x], sets[y], threshold_pct):
                root[max(cx, cy)] = min(cx, cy)
                a.append(node[x])
                b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def mixed_buckets(placed: DataFrame) -> DataFrame:
    """``placed``: (bkey, node, comp).  (bkey, main, n_main, n_rest) of the buckets with
    more than one component: the largest one, its members and the others'."""
    sizes = placed.groupBy("bkey", "comp").agg(F.count(F.lit(1)).alias("size"))
    return (sizes.groupBy("bkey").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("size", "comp")).alias("m"), F.sum("size").alias("size"))
            .filter("comps > 1").select("bkey", F.col("m.comp").alias("main"), F.col("m.size").alias("n_main"), (F.col("size") - F.col("m.size")).alias("n_rest")))


def task_members(members: DataFrame) -> DataFrame:
    """``members`` with the columns of ``mixed_buckets``: a row for each task
    (bkey, lo, hi) that a member takes part in, with its own ``block``.  A
    bucket of at most BLOCK is one block; else its largest component and the
    rest are dealt into blocks, and two blocks of the former never meet."""
    whole = F.col("n_main") + F.col("n_rest") <= BLOCK
    mains = F.when(whole, 0).otherwise(F.ceil(F.col("n_main") / BLOCK)).cast("long")
    rests = F.when(whole, 1).otherwise(F.ceil(F.col("n_rest") / BLOCK)).cast("long")
    in_main = (F.col("comp") == F.col("main")) & ~whole
    drawn = F.xxhash64("node")
    return (members.withColumns({"mains": mains, "rests": rests})
            .withColumn("block", F.when(in_main, F.pmod(drawn, F.greatest("mains", F.lit(1).cast("long")))).otherwise(F.col("mains") + F.pmod(drawn, F.col("rests"))))
            .withColumn("other", F.explode(F.sequence(F.when(in_main, F.col("mains")).otherwise(F.lit(0).cast("long")), F.col("mains") + F.col("rests") - 1)))
            .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("mains", "rests", "other"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold_pct: int = THRESHOLD_PCT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.  Documents
    are linked from a similarity of ``threshold_pct`` per cent on."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id is not null")
    signed = materialise(src.mapInArrow(_sign(*banding(threshold_pct)), _SIG_SCHEMA), "minhash")
    reps = materialise(signed.filter("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "reps")

    # 3. least member of each bucket against the others
    members = reps.select("node", F.explode("bands").alias("bkey"))
    buckets = members.groupBy("bkey").agg(F.min("node").alias("pivot"), F.max("node").alias("last"))
    shared = materialise(members.join(buckets.filter("pivot <> last"), "bkey").select("bkey", "node", "pivot"), "buckets")
    pairs = shared.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    sets = materialise(src.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "node long, shingles binary"), "sets")
    first = materialise(
        pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
        .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .select("a", "b", "x", "y").mapInArrow(_confirm(threshold_pct), "a long, b long"), "links")
    comps = connected_components(first)

    # 4. buckets that hold more than one component
    placed = shared.join(comps, "node", "left").select("bkey", "node", F.coalesce("root", "node").alias("comp"))
    units = task_members(placed.join(mixed_buckets(placed), "bkey").join(reps.select("node", "n", "bands", "sig"), "node"))
    cols = ["bkey", "node", "comp", "block", "lo", "hi", "n", "bands", "sig"]
    schema = "bkey long, node long, comp long, block long, lo long, hi long, n long, bands array<long>, sig binary"
    need = units.select(*cols).groupBy("bkey", "lo", "hi").applyInArrow(_needed(threshold_pct), schema)
    more = need.join(sets, "node").groupBy("bkey", "lo", "hi").applyInArrow(_complete(threshold_pct), "a long, b long")
    roots = connected_components(first.union(more))

    by_set = reps.select("set_key", "node").join(roots, "node", "left").select("set_key", F.coalesce("root", "node").alias("component_id"))
    return (signed.select("doc_id", "n_shingles", "set_key").join(by_set, "set_key", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id") == F.col("component_id")))
