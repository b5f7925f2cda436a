"""Rule-based labels as ``CASE WHEN`` columns (F9-F18, F20, A11 classes).

Thresholds and label texts are fixed values of the rules they implement.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Risk tiers relative to the pass threshold T (F9):
# below T-8 HIGH RISK, below T-3 AT RISK, below T+3 BORDERLINE, else LIKELY PASS.
RISK_TIERS = ("HIGH RISK", "AT RISK", "BORDERLINE", "LIKELY PASS")
RISK_TIER_OFFSETS = (-8.0, -3.0, 3.0)


def risk_tier(pred: str | Column, threshold: float) -> Column:
    """F9."""
    p = _c(pred)
    lo, mid, hi = (threshold + o for o in RISK_TIER_OFFSETS)
    return (F.when(p < lo, RISK_TIERS[0]).when(p < mid, RISK_TIERS[1])
            .when(p < hi, RISK_TIERS[2]).when(p.isNotNull(), RISK_TIERS[3]))


# Absolute cut tiers for entities without an outcome.
FIXED_TIER_CUTS = (60.0, 65.0, 70.0)
FIXED_TIERS = ("HIGH RISK", "AT RISK", "BORDERLINE", "LIKELY OK")


def fixed_tier(pred: str | Column, cuts: tuple[float, float, float] = FIXED_TIER_CUTS) -> Column:
    """F10."""
    p = _c(pred)
    return (F.when(p < cuts[0], FIXED_TIERS[0]).when(p < cuts[1], FIXED_TIERS[1])
            .when(p < cuts[2], FIXED_TIERS[2]).when(p.isNotNull(), FIXED_TIERS[3]))


def significance_stars(p: str | Column, not_significant: str = "ns") -> Column:
    """<.001 ***, <.01 **, <.05 *, else ``not_significant``."""
    pv = _c(p)
    return (F.when(pv < 0.001, "***").when(pv < 0.01, "**").when(pv < 0.05, "*")
            .when(pv.isNotNull(), not_significant))


def effect_direction(r: str | Column, band: float = 0.1) -> Column:
    """whether entities that improve have a higher or lower outcome, or
    none of both within ``band``."""
    rv = _c(r)
    return F.when(rv > band, "higher").when(rv < -band, "lower").when(rv.isNotNull(), "none")


def usefulness(r2: str | Column) -> Column:
    """F15 (timing rule): >0.4 USEFUL, >0.25 MODERATE, >0.1 EMERGING, else ''."""
    v = _c(r2)
    return (F.when(v > 0.4, "USEFUL").when(v > 0.25, "MODERATE").when(v > 0.1, "EMERGING")
            .when(v.isNotNull(), ""))


def usefulness_band(r2: str | Column) -> Column:
    """F15 (presentation rule): <0.15 LOW, <0.3 MEDIUM, else HIGH."""
    v = _c(r2)
    return F.when(v < 0.15, "LOW").when(v < 0.3, "MEDIUM").when(v.isNotNull(), "HIGH")


def auc_class(auc: str | Column) -> Column:
    """F16: >0.8 GOOD, >0.7 MODERATE, else WEAK."""
    v = _c(auc)
    return F.when(v > 0.8, "GOOD").when(v > 0.7, "MODERATE").when(v.isNotNull(), "WEAK")


def overfit_flag(train_r2: str | Column, test_r2: str | Column, gap: float = 0.15) -> Column:
    """train R2 - test R2 above ``gap`` (0.15; the other script uses
    ``>= 0.2``, pass ``gap=0.2, inclusive=True`` through ``overfit_flag_ge``)."""
    return (_c(train_r2) - _c(test_r2)) > gap


def overfit_flag_ge(train_r2: str | Column, test_r2: str | Column, gap: float = 0.2) -> Column:
    return (_c(train_r2) - _c(test_r2)) >= gap


def confidence_positive(ci_low: str | Column) -> Column:
    """HIGH when the lower CI bound is above 0, else LOW."""
    return F.when(_c(ci_low) > 0, "HIGH").when(_c(ci_low).isNotNull(), "LOW")


def confidence_above(ci_low: str | Column, mean: str | Column, level: float) -> Column:
    """HIGH when the CI clears ``level``, MODERATE when only the mean
    does, else LOW."""
    return (F.when(_c(ci_low) > level, "HIGH").when(_c(mean) > level, "MODERATE")
            .when(_c(mean).isNotNull(), "LOW"))


def confidence_useful(ci_low: str | Column, level: float = 0.15) -> Column:
    """F18 (early-model wording): HIGH when the CI clears ``level``, else MODERATE."""
    return F.when(_c(ci_low) > level, "HIGH").when(_c(ci_low).isNotNull(), "MODERATE")


def coefficient_sign(coef: str | Column) -> Column:
    """'+' for a positive coefficient, else '-'."""
    return F.when(_c(coef) > 0, "+").when(_c(coef).isNotNull(), "-")


def correlation_strength(r: str | Column) -> Column:
    """|r| > 0.7 STRONG, > 0.4 moderate, else weak."""
    a = F.abs(_c(r))
    return F.when(a > 0.7, "STRONG").when(a > 0.4, "moderate").when(a.isNotNull(), "weak")


def correlation_band(r: str | Column) -> Column:
    """A11 (presentation colour classes): >0.6, >0.4, >0.2, else."""
    v = _c(r)
    return (F.when(v > 0.6, "very strong").when(v > 0.4, "strong").when(v > 0.2, "moderate")
            .when(v.isNotNull(), "weak"))
