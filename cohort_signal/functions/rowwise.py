"""Row-wise feature expressions (F1-F6), null-skipping like a spreadsheet.

Each builder works on an array of the row's values with higher-order
functions, so the whole row stays inside one codegen'd projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(cols: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())


def round_half_even(x: Column, decimals: int) -> Column:
    """Round the binary value half-to-even at ``decimals`` places (multiply,
    ``rint``, divide): the same result a numpy/pandas ``round`` gives."""
    scale = float(10 ** decimals)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def row_mean(cols: Sequence[str], decimals: int | None = None) -> Column:
    """mean of the non-null values; null when all are null."""
    vals = _present(cols)
    total = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
    out = F.try_divide(total, F.size(vals).cast("double"))
    return out if decimals is None else round_half_even(out, decimals)


def row_variance(cols: Sequence[str], decimals: int | None = None) -> Column:
    """sample variance (n-1) of the non-null values; null below 2 values."""
    vals = _present(cols)
    n = F.size(vals).cast("double")
    mean = F.try_divide(F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x), n)
    ss = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    out = F.when(n >= 2, F.try_divide(ss, n - F.lit(1.0)))
    return out if decimals is None else round_half_even(out, decimals)


def row_min(cols: Sequence[str]) -> Column:
    """smallest non-null value (``least`` skips nulls)."""
    return F.least(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])


def row_max(cols: Sequence[str]) -> Column:
    """largest non-null value."""
    return F.greatest(*[F.col(c) for c in cols]) if len(cols) > 1 else F.col(cols[0])


def improvement(final_col: str, first_midterm_col: str) -> Column:
    """final minus first midterm of one group."""
    return F.col(final_col) - F.col(first_midterm_col)


def clip(col: str | Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """clip into [lo, hi]; null and NaN are missing and give null
    (``greatest`` alone would turn a null into ``lo`` and a NaN into ``hi``)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull() | F.isnan(c.cast("double")), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(c.cast("double"), F.lit(lo)), F.lit(hi)))


def without_nan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``df`` with NaN turned into null in its (given) floating columns."""
    floating = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float") and (cols is None or f.name in cols)]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit(float("nan"))) for c in floating}) if floating else df


def nan_to_null(col: str) -> Column:
    """NaN poisons ``corr``/``avg``; the library treats NaN as missing."""
    c = F.col(col)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c).alias(col)
