"""Statistical column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import dbl

Z95 = 1.959963985  # fixed value: two-sided 95 %


def ratio(num, den, empty=0.0) -> Column:
    """num / den, with the given value when the denominator is zero."""
    num, den = dbl(num), dbl(den)
    other = F.lit(None).cast("double") if empty is None else dbl(empty)
    return F.when(den > 0, num / den).otherwise(other)


def wilson(successes, trials, z: float = Z95) -> Column:
    """Wilson score interval, clipped to [0, 1]; (0, 0) without trials."""
    k, n, z = dbl(successes), dbl(trials), dbl(z)
    p = k / n
    denom = 1 + z * z / n
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    lo = F.when(n > 0, F.greatest(dbl(0), (centre - half) / denom)).otherwise(dbl(0))
    hi = F.when(n > 0, F.least(dbl(1), (centre + half) / denom)).otherwise(dbl(0))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def cost_per_image(detection, false_alarm, miss_ratio) -> Column:
    """Expected cost per inspected image: ratio * escape + unnecessary re-inspection."""
    return dbl(miss_ratio) * (1 - dbl(detection)) + dbl(false_alarm)


def cost_with_prevalence(detection, clean_false_alarm, miss_ratio, prevalence) -> Column:
    """Expected cost per frame when only a share of the frames is defective."""
    p = dbl(prevalence)
    return p * dbl(miss_ratio) * (1 - dbl(detection)) + (1 - p) * dbl(clean_false_alarm)


def effective_weight(miss_ratio, prevalence) -> Column:
    """The one weight the decision depends on."""
    p = dbl(prevalence)
    return p * dbl(miss_ratio) / F.greatest(1 - p, dbl(1e-12))


def f1(precision, recall) -> Column:
    p, r = dbl(precision), dbl(recall)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(dbl(0))
