"""Distribution tails as column expressions.

Neither Spark SQL nor the SQL oracle has a t or normal CDF, so both are
integrated with composite Simpson's rule inside one ``aggregate`` over a
``sequence``: a pure expression that stays in whole-stage codegen.

Student t, two-sided: with theta = atan(|t|/sqrt(nu)) the angle of T has
density proportional to cos(u)^(nu-1), so

    p = int_theta^{pi/2} cos^(nu-1) / int_0^{pi/2} cos^(nu-1).

The integrand is a bump of width ~ 1/sqrt(nu); both integrals are cut at
``SPAN`` such widths past their lower limit (the rest is below 1e-30 of the
mass), which keeps the rule accurate for any nu.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Simpson intervals (even) and span of the integration window
# in units of 1/sqrt(nu - 1).
STEPS = 2000
SPAN = 12.0
NORMAL_SPAN = 12.0


def _simpson(a: Column, b: Column, f) -> Column:
    h = (b - a) / F.lit(float(STEPS))

    def step(acc, k):
        w = (F.when((k == 0) | (k == STEPS), F.lit(1.0))
             .when(k % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0)))
        return acc + w * f(a + k.cast("double") * h)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), step) * h / F.lit(3.0)



def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic with ``df`` degrees of freedom."""
    nu = df.cast("double")
    theta = F.atan(F.abs(t) / F.sqrt(nu))
    width = F.lit(SPAN) / F.sqrt(F.greatest(nu - F.lit(1.0), F.lit(1.0)))
    half_pi = F.lit(math.pi / 2)
    power = nu - F.lit(1.0)

    def f(u):
        return F.exp(power * F.log(F.greatest(F.cos(u), F.lit(1e-300))))

    num = _simpson(theta, F.least(theta + width, half_pi), f)
    den = _simpson(F.lit(0.0), F.least(width, half_pi), f)
    p = F.least(F.try_divide(num, den), F.lit(1.0))
    return F.when(t.isNull() | df.isNull() | (nu < 1), F.lit(None).cast("double")) \
            .when(F.isnan(t), F.lit(None).cast("double")).otherwise(p)


def normal_upper_tail(z: Column) -> Column:
    """P(Z > |z|) for a standard normal Z."""
    a = F.abs(z)

    def f(u):
        return F.exp(-u * u / F.lit(2.0))

    return _simpson(a, a + F.lit(NORMAL_SPAN), f) / F.sqrt(F.lit(2.0) * F.lit(math.pi))


def normal_two_sided_p(z: Column) -> Column:
    """T8 in its only use: 2 * (1 - Phi(|z|))."""
    return F.when(z.isNull(), F.lit(None).cast("double")).otherwise(F.lit(2.0) * normal_upper_tail(z))


def normal_cdf(z: Column) -> Column:
    """Phi(z)."""
    tail = normal_upper_tail(z)
    return F.when(z.isNull(), F.lit(None).cast("double")) \
            .when(z >= 0, F.lit(1.0) - tail).otherwise(tail)
