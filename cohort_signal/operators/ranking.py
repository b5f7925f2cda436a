"""Exact ranks, prefix sums and quantiles without a single-partition window.

A global ``Window.orderBy`` moves every row into one task.  Instead:

1. collapse equal values first (``groupBy(keys, value)`` with map-side
   combine), so a hot value is one row however many times it occurs;
2. cut each key's value range into blocks of about ROWS_PER_BLOCK values, at
   approximate quantiles of the *distinct* values (a mergeable sketch for
   numbers, a hash sample of the values for text, dates and other types);
   a row finds its block by binary search over the split points;
3. prefix-sum the per-block totals (groups x blocks rows: tiny);
4. prefix-sum inside each block with a window partitioned by (keys, block).

Every step is exact; the approximate splits only decide how work is spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import cut_lineage

COARSE_BLOCKS = 64              # first sketch; refined only for large groups
ROWS_PER_BLOCK = 50_000         # target distinct values per block
SKETCH_ACCURACY = 10000         # at least; four times the blocks beyond that
SAMPLES_PER_BLOCK = 20          # sampled values per split, for types without a sketch
# Parts a stretch of values is counted in, values of one that are fetched.
BUCKETS = 1024
FETCH = 4096
# Bounded side of a join that may be broadcast (rows).
BROADCAST_ROW_LIMIT = 200_000
# The same in numbers, where a row carries an array of split points (40 MB).
BROADCAST_NUMBERS = 5_000_000


def _count_below(splits: Column, v: Column, n_splits: int) -> Column:
    """Number of sorted ``splits`` strictly below ``v``: a lower-bound binary
    search unrolled as a fixed-length ``aggregate`` (O(log B) per row)."""
    steps = max(1, math.ceil(math.log2(n_splits + 1)) + 1)
    init = F.struct(F.lit(0).alias("lo"), F.size(splits).alias("hi"))

    def step(acc, _):
        lo, hi = acc["lo"], acc["hi"]
        mid = F.floor((lo + hi) / 2).cast("int")
        below = F.element_at(splits, mid + 1) < v
        return F.when(lo >= hi, acc).when(below, F.struct((mid + 1).alias("lo"), hi.alias("hi"))) \
            .otherwise(F.struct(lo.alias("lo"), mid.alias("hi")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def _splits(df: DataFrame, keys: list[str], value: str, n_blocks: int | None) -> tuple[DataFrame, int, int]:
    """Per key group: its count and sorted split points (``_cnt``, ``_all``);
    also the number of blocks and of groups.  ``n_blocks`` None: as many blocks
    as the largest group needs."""
    grouped = df.groupBy(*keys)
    numeric = isinstance(df.schema[value].dataType, NumericType)

    def sketch(blocks: int) -> DataFrame:
        probs = [i / blocks for i in range(1, blocks)]
        return cut_lineage(grouped.agg(F.percentile_approx(value, probs, max(SKETCH_ACCURACY, 4 * blocks)).alias("_all"),
                                       F.count(value).alias("_cnt")))

    # numbers, one pass: a coarse sketch and the group sizes; a finer sketch
    # only when some group needs more than COARSE_BLOCKS blocks
    blocks = n_blocks or COARSE_BLOCKS
    stats = sketch(blocks) if numeric else cut_lineage(grouped.agg(F.count(value).alias("_cnt")))
    size = stats.agg(F.max("_cnt").alias("m"), F.count(F.lit(1)).alias("g")).first()
    n_groups, biggest = size["g"] or 0, size["m"] or 0
    needed = math.ceil(biggest / ROWS_PER_BLOCK)
    if n_blocks is None and needed > blocks:
        blocks = needed
        if numeric:
            stats = sketch(blocks)
    if not numeric:
        # about SAMPLES_PER_BLOCK hash-chosen values a block; every so many-th is a split
        if keys:
            rows = df.select(*keys, value).join(F.broadcast(stats) if n_groups <= BROADCAST_ROW_LIMIT else stats, keys)
        else:
            rows = df.select(value, F.lit(biggest).alias("_cnt"))
        each = F.greatest(F.lit(1), F.floor(F.col("_cnt") / (blocks * SAMPLES_PER_BLOCK)))
        sample = (rows.filter(F.pmod(F.xxhash64(value), each) == 0).groupBy(*keys)
                  .agg(F.sort_array(F.collect_list(value)).alias("_s"), F.max("_cnt").alias("_cnt")))
        every = F.greatest(F.lit(1), F.ceil(F.size("_s") / blocks)).cast("int")
        sample = sample.select(*keys, F.filter("_s", lambda x, i: (i + 1) % every == 0).alias("_all"), "_cnt")
        if keys:  # a group of which no value was chosen has no split
            sample = stats.select(*keys).join(sample, keys, "left").withColumns(
                {"_all": F.coalesce("_all", F.array().cast(sample.schema["_all"].dataType)), "_cnt": F.coalesce("_cnt", F.lit(1))})
        stats = cut_lineage(sample)
    return stats, blocks, n_groups


def prefix_sums(df: DataFrame, keys: Sequence[str], value: str,
                weights: Sequence[str], n_blocks: int | None = None) -> DataFrame:
    """For rows unique on (keys, value): add ``<w>_below`` = sum of ``w`` over
    rows with the same keys and a strictly smaller value, for each weight.
    ``value`` is of any orderable type; ``n_blocks`` fixes the number of blocks,
    else it follows from the largest group."""
    keys = list(keys)
    stats, blocks, n_groups = _splits(df, keys, value, n_blocks)
    # keep every k-th split so a block holds ~ROWS_PER_BLOCK values
    step = F.least(F.lit(float(blocks)), F.greatest(
        F.lit(1.0), F.ceil(F.lit(float(blocks)) * F.lit(float(ROWS_PER_BLOCK)) / F.greatest(F.lit(1), F.col("_cnt"))))).cast("int")
    splits = stats.select(*keys, F.filter("_all", lambda x, i: (i + 1) % step == 0).alias("_splits"))
    if not keys:
        row = splits.first()
        arr = row["_splits"] if row else None
        if not arr:
            # fewer than ~ROWS_PER_BLOCK distinct values in total: one window
            # over them is bounded by construction
            w1 = Window.partitionBy(F.lit(0)).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
            return df.withColumns({f"{w}_below": F.coalesce(F.sum(w).over(w1), F.lit(0)) for w in weights})
        with_splits = df.withColumn("_splits", F.array(*[F.lit(x) for x in arr]).cast(splits.schema["_splits"].dataType))
    else:
        side = F.broadcast(splits) if n_groups * blocks <= BROADCAST_NUMBERS else splits
        with_splits = df.join(side, keys)
    blocked = with_splits.withColumn("_block", _count_below(F.col("_splits"), F.col(value), blocks)).drop("_splits")

    # block totals: at most groups x blocks rows, so the prefix over blocks
    # and the broadcast back are bounded without counting them
    totals = blocked.groupBy(*keys, "_block").agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    wb = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("_block") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", *[
        F.coalesce(F.sum(f"_t_{w}").over(wb), F.lit(0)).alias(f"_o_{w}") for w in weights])
    bound = max(n_groups, 1) * blocks
    side = F.broadcast(offsets) if bound <= BROADCAST_ROW_LIMIT else offsets

    inner = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = blocked.join(side, [*keys, "_block"])
    for w in weights:
        out = out.withColumn(f"{w}_below", F.col(f"_o_{w}") + F.coalesce(F.sum(w).over(inner), F.lit(0)))
    return out.drop("_block", *[f"_o_{w}" for w in weights])


def row_rank(df: DataFrame, order_col: str, keys: Sequence[str] = (),
             n_blocks: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_col`` order within ``keys``
    (``order_col`` unique within keys, e.g. an entity id)."""
    ranked = prefix_sums(df.withColumn("_one", F.lit(1)), keys, order_col, ["_one"], n_blocks)
    return ranked.withColumn("_rank", F.col("_one_below").cast("long")).drop("_one", "_one_below")


@dataclass
class _Stretch:
    """Values of one column from ``lo`` to ``hi``: ``count`` of them, with the
    positions that are looked for, relative to the stretch and in the column."""
    feature: str
    lo: float
    hi: float
    count: int
    wanted: list[tuple[int, int]]


def _counted(long: DataFrame, stretches: list[_Stretch]) -> list[_Stretch]:
    """The parts of the stretches that hold their wanted positions: one pass
    that counts each stretch in BUCKETS equal parts."""
    spark = long.sparkSession
    side = spark.createDataFrame([(s.feature, i, s.lo, s.hi) for i, s in enumerate(stretches)], "feature string, id int, lo double, hi double")
    lo, hi, v = F.col("lo"), F.col("hi"), F.col("v")
    share = (v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5)  # halves, so that no difference overflows
    part = F.least(F.lit(BUCKETS - 1), F.floor(share * F.lit(float(BUCKETS)))).cast("int")
    inside = long.join(F.broadcast(side), "feature").filter((v >= lo) & (v <= hi))
    rows = inside.groupBy("id", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["part"])):
        by.setdefault(r["id"], []).append(r)
    out = []
    for i, s in enumerate(stretches):
        below = 0
        for r in by[i]:
            here = [(at - below, pos) for at, pos in s.wanted if below <= at < below + r["c"]]
            if here:
                out.append(_Stretch(s.feature, r["lo"], r["hi"], r["c"], here))
            below += r["c"]
    return out


def _order_statistics(long: DataFrame, stretches: list[_Stretch]) -> dict[tuple[str, int], float]:
    """(column, position) -> value.  A stretch of equal values is settled; one
    of at most FETCH values is fetched; the others are counted in parts."""
    found: dict[tuple[str, int], float] = {}
    fetch: list[_Stretch] = []
    while stretches:
        wide = []
        for s in stretches:
            if s.lo == s.hi:
                found.update({(s.feature, pos): s.lo for _, pos in s.wanted})
            elif s.count <= FETCH:
                fetch.append(s)
            else:
                wide.append(s)
        stretches = _counted(long, wide) if wide else []
    if fetch:
        side = long.sparkSession.createDataFrame([(s.feature, i, s.lo, s.hi) for i, s in enumerate(fetch)], "feature string, id int, lo double, hi double")
        rows = long.join(F.broadcast(side), "feature").filter((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi"))).select("id", "v").collect()
        values: dict[int, list[float]] = {}
        for r in rows:
            values.setdefault(r["id"], []).append(r["v"])
        for i, s in enumerate(fetch):
            ordered = sorted(values[i])
            found.update({(s.feature, pos): ordered[at] for at, pos in s.wanted})
    return found


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between order statistics
    (the default of pandas/numpy), nulls and NaN skipped: {col: [q(prob) for
    prob in probs]}, None for a column without values.

    The order statistics of all columns are found together by counting: a
    pass counts each open stretch of values in BUCKETS parts, the parts that
    hold a wanted position are the next stretches, until at most FETCH values
    are left of each.  No row is moved and no map of values is built; a pass
    returns at most BUCKETS counts a wanted position."""
    cols = list(cols)
    held = df.select(*cols).persist()  # passed a few times
    try:
        return _quantiles(held, cols, probs)
    finally:
        held.unpersist()


def _quantiles(df: DataFrame, cols: list[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    long = (df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("_kv"))
            .select("_kv.feature", "_kv.v").filter(F.col("v").isNotNull() & ~F.isnan("v")))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    finite = (F.col("v") > low) & (F.col("v") < high)
    stats = {r["feature"]: r for r in long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") == low).alias("below"), F.count_if(finite).alias("inner"),
        F.min(F.when(finite, F.col("v"))).alias("lo"), F.max(F.when(finite, F.col("v"))).alias("hi")).collect()}
    found: dict[tuple[str, int], float] = {}
    stretches, places = [], {}
    for c, r in stats.items():
        places[c] = [((r["n"] - 1) * p) for p in probs]
        positions = sorted({q for h in places[c] for q in (int(h), min(int(h) + 1, r["n"] - 1))})
        found.update({(c, q): float("-inf") for q in positions if q < r["below"]})
        found.update({(c, q): float("inf") for q in positions if q >= r["below"] + r["inner"]})
        inside = [(q - r["below"], q) for q in positions if (c, q) not in found]
        if inside:
            stretches.append(_Stretch(c, r["lo"], r["hi"], r["inner"], inside))
    found |= _order_statistics(long, stretches)
    out: dict[str, list[float | None]] = {}
    for c in cols:
        if c not in stats:
            out[c] = [None] * len(probs)
            continue
        last = stats[c]["n"] - 1
        out[c] = []
        for h in places[c]:
            a, b = found[c, int(h)], found[c, min(int(h) + 1, last)]
            out[c].append(a if a == b or h == int(h) else a + (h - int(h)) * (b - a))
    return out
