"""Query catalogue: one callable per SURVEY section-2 ID, each taking
(spark, sf_dir) and returning a DataFrame over the test tables.

Double outputs are presented rounded half-even at 6 decimals (``present``)
so that engines that differ only in the last binary digit agree; the SQL
oracle applies the identical rounding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

PRESENT_DECIMALS = 6


def _significant(c: Column, digits: int) -> Column:
    e = F.floor(F.log10(F.abs(c)))
    up, down = F.pow(F.lit(10.0), digits - 1 - e), F.pow(F.lit(10.0), e - digits + 1)
    return F.when(c == 0, F.lit(0.0)).when(e < digits, F.rint(c * up) / up).otherwise(F.rint(c / down) * down)


def present(df: DataFrame, decimals: int = PRESENT_DECIMALS, digits: int | None = None) -> DataFrame:
    """Doubles rounded half-even to ``decimals``, or to ``digits`` significant
    digits where given (values whose relative error is what is bounded)."""
    scale = float(10 ** decimals)
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            v = _significant(c.cast("double"), digits) if digits else F.rint(c.cast("double") * F.lit(scale)) / F.lit(scale)
            out.append(F.when(v == 0, F.lit(0.0)).otherwise(v).alias(f.name))
        elif isinstance(f.dataType, DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def query(name: str, sql: str | None = None, decimals: int = PRESENT_DECIMALS, digits: int | None = None):
    """Register a query; ``sql`` is its oracle (None: rows-only check)."""
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir, _fn=fn: present(_fn(spark, sf_dir), decimals, digits)
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def p6(x: str, decimals: int = PRESENT_DECIMALS) -> str:
    """SQL twin of ``present`` for one double expression."""
    v = f"(round_even(({x})::DOUBLE * {10.0 ** decimals}, 0) / {10.0 ** decimals})"
    return f"(CASE WHEN {v} = 0 THEN 0.0 ELSE {v} END)"


def significant(x: str, digits: int) -> str:
    """SQL twin of ``present`` with significant digits."""
    e = f"floor(log10(abs({x})))"
    up, down = f"pow(10.0, {digits - 1} - {e})", f"pow(10.0, {e} - {digits - 1})"
    return (f"(CASE WHEN ({x}) = 0 THEN 0.0 WHEN ({x}) IS NULL THEN NULL WHEN {e} < {digits} THEN round_even(({x}) * {up}, 0) / {up} "
            f"ELSE round_even(({x}) / {down}, 0) * {down} END)")


def load_all() -> None:
    """Import every catalogue module (they register on import)."""
    from . import catalog_composites, catalog_models, catalog_pipelines, catalog_relational, catalog_stats  # noqa: F401
