"""Applying calibrators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import dbl

# Fixed values
PROB_CLIP = 1e-6
MONOTONE_EPS = 1e-6
ECE_EDGES = (0.0, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 1.0)


def clip01(c, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(dbl(c), dbl(lo)), dbl(hi))


def logit(score) -> Column:
    p = clip01(score, PROB_CLIP, 1 - PROB_CLIP)
    return F.log(p / (1 - p))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def parametric(score, method, temperature=None, slope=None, intercept=None) -> Column:
    """identity / temperature / platt, chosen per row; an unknown method fails the job."""
    method = method if isinstance(method, Column) else F.lit(method)
    raw = clip01(score)
    t, a, b = (dbl(v) if v is not None else F.lit(None).cast("double") for v in (temperature, slope, intercept))
    return (
        F.when(method == "identity", raw)
        .when(method == "temperature", clip01(sigmoid(logit(score) / t)))
        .when(method == "platt", clip01(sigmoid(a * logit(score) + b)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown calibration method: "), method)).cast("double"))
    )


def strictly_monotone(base, score, eps: float = MONOTONE_EPS) -> Column:
    """Blend a little of the raw score into a step function so equal plateaus keep their order."""
    return clip01(dbl(base) * (1 - eps) + dbl(eps) * clip01(score))


def nll_terms(p, label) -> Column:
    p, y = clip01(p, PROB_CLIP, 1 - PROB_CLIP), dbl(label)
    return -(y * F.log(p) + (1 - y) * F.log(1 - p))
