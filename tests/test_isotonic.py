"""Monotone fits in ranges against the max-min formula, and the keyed logistic fit against a plain one."""

import numpy as np
import pytest

from coilwise.operators import calibration as cal
from coilwise.operators import isotonic as iso


def max_min(w, v):
    """Value at each place: the largest smallest mean of the ranges around it."""
    cw, cv = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(v)])
    n = len(w)
    mean = np.array([[(cv[b + 1] - cv[a]) / (cw[b + 1] - cw[a]) if b >= a else np.nan for b in range(n)] for a in range(n)])
    return [max(min(mean[a, i:]) for a in range(i + 1)) for i in range(n)]


def values(blocks, xs):
    out = {}
    for b in blocks:
        for x in xs:
            if b.lo <= x <= b.hi:
                out[x] = b.total / b.weight
    return [out[x] for x in xs]


SHAPES = {
    "noise": lambda r, n: r.random(n), "falling": lambda r, n: np.linspace(1, 0, n), "rising": lambda r, n: np.linspace(0, 1, n), "flat": lambda r, n: np.full(n, 0.5),
    "low end": lambda r, n: np.append(np.linspace(0.2, 1, n - 1), -40.0), "steps": lambda r, n: np.repeat([0.1, 0.9, 0.4, 0.6], n // 4),
}


@pytest.mark.parametrize("size", [7, 500_000])
@pytest.mark.parametrize("shape", SHAPES)
def test_pooled_equals_max_min(spark, monkeypatch, shape, size):
    monkeypatch.setattr(iso, "RANGE", size)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key in (None, "a"):
        n = 48 if key else 20
        w = rng.integers(1, 9, n).astype(float)
        v = SHAPES[shape](rng, n) * w
        rows += [(key, float(i), float(i), float(a), float(b)) for i, (a, b) in enumerate(zip(w, v, strict=True))]
        want[key] = max_min(w, v)
    got = iso.pooled(spark.createDataFrame(rows, "k string, lo double, hi double, weight double, total double").repartition(5), ["k"]).collect()
    for key, y in want.items():
        own = [b for b in got if b.k == key]
        assert values(own, range(len(y))) == pytest.approx(y)
        assert all(a.total / a.weight < b.total / b.weight + 1e-12 for a, b in zip(sorted(own, key=lambda b: b.lo), sorted(own, key=lambda b: b.lo)[1:], strict=False))


def test_pooled_is_exact_for_counts_and_empty_for_nothing(spark):
    big = 10**15
    df = spark.createDataFrame([(0.1, 0.1, 3 * big, big), (0.2, 0.2, 6 * big, 2 * big), (0.3, 0.3, 3 * big, big + 1), (0.4, 0.4, 0, 0)], "lo double, hi double, weight bigint, total bigint")
    assert sorted((b.lo, b.hi, b.weight) for b in iso.pooled(df).collect()) == [(0.1, 0.2, 9 * big), (0.3, 0.3, 3 * big)]
    assert iso.pooled(df.limit(0)).count() == 0


def test_keyed_platt_fit(spark):
    rng = np.random.default_rng(8)
    rows = []
    for key, (a, b) in enumerate([(0.7, -0.4), (2.0, 0.5)]):
        s = np.round(rng.uniform(0.02, 0.98, 400), 3)
        y = rng.random(400) < 1 / (1 + np.exp(-(a * np.log(s / (1 - s)) + b)))
        rows += [(key, float(x), int(t)) for x, t in zip(s, y, strict=True)]
    counts = cal.distinct_scores(spark.createDataFrame(rows, "key int, score double, label int"), ["key"]).cache()
    got = {r.key: (r.slope, r.intercept) for r in cal.platt_params(counts, ["key"]).collect()}
    for key, (slope, intercept) in got.items():
        z, y = np.array([(np.log(s / (1 - s)), t) for k, s, t in rows if k == key]).T
        p = 1 / (1 + np.exp(-(slope * z + intercept)))
        assert abs((y - p).sum()) < 1e-6 and abs(((y - p) * z).sum()) < 1e-6
        assert cal.fit_platt(counts.where(f"key = {key}").drop("key")) == pytest.approx((slope, intercept))
