"""Exact random splits and folds (M1, M5, M6) by selection on key digests.

Rows are put in the order of a digest of seed and key, a fixed shuffle, and cut
at given positions: 20 % of n rounded up for a test set, folds that differ by
at most one row.  The digest at a position is found by counting, not sorting:
a pass counts rows by the leading DIGITS hex digits, the digits that hold the
position are known then, and the next pass counts only rows that begin with
them.  A cut is settled as soon as it falls between two counted stretches, so
n rows take about log(n) / log(16^DIGITS) passes that return at most 16^DIGITS
counts a cut; no row is moved.  Membership is then an expression over the row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 3
DIGEST = 32


def digest(key: Column, seed: int | str | None = None, repeat: int | None = None) -> Column:
    """Hex digest that orders the rows: of the key's text behind seed and repeat."""
    parts = [F.lit(str(p)) for p in (seed, repeat) if p is not None]
    return F.md5(F.concat_ws("-", *parts, key.cast("string")).cast("binary"))


def fold_starts(n: int, k: int) -> list[int]:
    """Positions at which the second and later of k folds begin; the first
    n mod k folds have one row more."""
    q, rest = divmod(n, k)
    return [j * q + min(j, rest) for j in range(1, k)]


def test_size(n: int, percent: int) -> int:
    """``percent`` of n rows, rounded up."""
    return -(-n * percent // 100)


def cuts(rows: DataFrame, places: Callable[[int], list[int]], group: str = "g", digest_col: str = "d") -> dict:
    """Per group the digests that cut it at the positions ``places(n)``: rows
    with a lesser digest lie before.  The number of groups must be small, the
    digests of a group distinct (equal ones at a cut raise)."""
    counts: dict = {}
    for r in rows.groupBy(group, F.substring(digest_col, 1, DIGITS).alias("p")).count().collect():
        counts.setdefault(r[group], {})[r["p"]] = r["count"]
    found: dict = {}
    waiting = []
    for g, buckets in counts.items():
        wanted = places(sum(buckets.values()))
        found[g] = [None] * len(wanted)
        waiting += [(g, i, "", at, buckets) for i, at in enumerate(wanted)]
    while True:
        deeper = []
        for g, i, _, at, buckets in waiting:
            prefix = None
            for p in sorted(buckets):
                if at < buckets[p]:
                    prefix = p
                    break
                at -= buckets[p]
            if prefix is None or at == 0:
                found[g][i] = prefix if prefix is not None else "g"  # behind every digest
            elif len(prefix) >= DIGEST:
                raise ValueError("keys repeat: rows of one digest lie on both sides of a cut")
            else:
                deeper.append((g, i, prefix, at))
        if not deeper:
            return found
        width = len(deeper[0][2])
        active = rows.sparkSession.createDataFrame(sorted({(g, prefix) for g, _, prefix, _ in deeper}, key=str),
                                                   rows.select(group).schema.add("p0", "string"))
        inside = rows.join(F.broadcast(active), (rows[group].eqNullSafe(active[group])) & (F.substring(digest_col, 1, width) == F.col("p0"))).select(rows[group], "p0", digest_col)
        counts = {}
        for r in inside.groupBy(group, "p0", F.substring(digest_col, 1, width + DIGITS).alias("p")).count().collect():
            counts.setdefault((r[group], r["p0"]), {})[r["p"]] = r["count"]
        waiting = [(g, i, prefix, at, counts[g, prefix]) for g, i, prefix, at in deeper]


def split_column(df: DataFrame, key: str, test_percent: int = 20) -> Column:
    """M1: 'test' for exactly ``test_percent`` of the rows of ``df``, rounded
    up, else 'train'; an expression over the key, for any table with it."""
    d = digest(F.col(key))
    found = cuts(df.select(F.lit(0).alias("g"), d.alias("d")), lambda n: [test_size(n, test_percent)])
    return F.when(d < F.lit(found[0][0] if found else "g"), F.lit("test")).otherwise(F.lit("train"))


def _fold(d: Column, starts: Sequence[str]) -> Column:
    return sum(((d >= F.lit(s)).cast("int") for s in starts), F.lit(0)).cast("int")


def fold_columns(df: DataFrame, key: str, k: int = 5, seed: int = 42, repeats: int | None = None) -> list[Column]:
    """M5 / M6: the fold of each row, 0 to k - 1, one expression per repeat
    (one without repeats); all repeats are selected in the same passes."""
    if repeats is None:
        digests = [digest(F.col(key), seed)]
    else:
        digests = [digest(F.col(key), seed, r) for r in range(repeats)]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(r).alias("g"), d.alias("d")) for r, d in enumerate(digests)])).alias("x")).select("x.*")
    found = cuts(long, lambda n: fold_starts(n, k))
    return [_fold(d, found.get(r, [])) for r, d in enumerate(digests)]


def grouped_folds(df: DataFrame, group: str, key: str, k: int = 5, seed: int = 42) -> Column:
    """The fold of each row within its group (few groups)."""
    d = digest(F.col(key), seed)
    found = cuts(df.select(F.col(group).alias("g"), d.alias("d")), lambda n: fold_starts(n, k))
    out = F.lit(None).cast("int")
    for g, starts in found.items():
        out = F.when(F.col(group).eqNullSafe(F.lit(g)), _fold(d, starts)).otherwise(out)
    return out
