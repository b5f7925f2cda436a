"""Cleaning predicates and projections as ``Column`` builders.

All builders return JVM-side expressions; nothing here runs a job.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pseudo-row marker, test-account marker and the texts that
# do not count as a remediation entry.
POINTS_POSSIBLE = "Points Possible"
TEST_ACCOUNT_PATTERN = "(?i)test"
NO_REMEDIATION_TEXT = ("N/A", "nan", "", "0", "0.0")


NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

def _c(col: str | Column) -> Column:
    return F.col(f"`{col}`") if isinstance(col, str) else col


def strip_ws(col: str | Column) -> Column:
    """Strip leading/trailing whitespace of any kind (SQL ``trim`` only
    removes spaces)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def is_points_possible(col: str | Column) -> Column:
    """P1 predicate: stripped value starts with the marker; null -> False."""
    return F.coalesce(F.startswith(strip_ws(col), F.lit(POINTS_POSSIBLE)), F.lit(False))


def drop_points_possible(df: DataFrame, col: str = "Student") -> DataFrame:
    """P1."""
    return df.filter(~is_points_possible(col))


def drop_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Complete-case filter on ``cols``."""
    return df.dropna(subset=list(cols))


def first_digit_run(col: str | Column) -> Column:
    """First run of digits, null when the text has none."""
    return F.nullif(F.regexp_extract(_c(col), r"([0-9]+)", 1), F.lit(""))


def to_number(col: str | Column) -> Column:
    """Text -> double, anything but a plain decimal number -> null: also
    'NaN', 'inf' and typed literals such as '5d' (never throws, unlike a plain
    cast under ANSI mode)."""
    text = strip_ws(col)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def entity_id(login_col: str = "SIS Login ID") -> Column:
    """P3+P4: the numeric key extracted from a login text, as double."""
    return to_number(first_digit_run(login_col))


def in_range(col: str | Column, lo: int, hi: int) -> Column:
    """Inclusive range filter."""
    return _c(col).between(lo, hi)


def is_test_account(col: str | Column = "Student") -> Column:
    """Case-insensitive 'test' anywhere in the name; null -> False."""
    return F.coalesce(_c(col).rlike(TEST_ACCOUNT_PATTERN), F.lit(False))


def clean_name(col: str | Column = "Student") -> Column:
    """Strip whitespace, then strip surrounding double quotes."""
    return F.regexp_replace(strip_ws(col), r'^"+|"+$', "")


def rename_or_null(df: DataFrame, mapping: Mapping[str, str]) -> list[Column]:
    """Friendly <- raw exam column, parsed to double; a raw column that is
    absent yields a typed null column."""
    out = []
    for friendly, raw in mapping.items():
        if raw in df.columns:
            out.append(to_number(raw).alias(friendly))
        else:
            out.append(F.lit(None).cast("double").alias(friendly))
    return out


def remediation_flag(col: str | Column) -> Column:
    """1 when the stripped text is a real entry, 0 for the no-entry
    texts; a null cell counts as no entry."""
    stripped = strip_ws(col)
    return F.when(_c(col).isNull(), F.lit(0)).otherwise(
        (~stripped.isin(list(NO_REMEDIATION_TEXT))).cast("int"))


def display_name(col: str | Column, replacements: Mapping[str, str] | None = None) -> Column:
    """P20: shorten a feature name for display: chained replacements, then
    underscores to spaces and title case."""
    out = _c(col)
    for old, new in (replacements or {}).items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.initcap(F.replace(out, F.lit("_"), F.lit(" ")))
