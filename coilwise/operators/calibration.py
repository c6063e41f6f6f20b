"""Reliability, calibrator fitting, selection and checks.

All fits work on the distinct scores with their counts, which Spark combines map-side; the rows of a
split are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calibrators import ECE_EDGES, clip01, logit, nll_terms, parametric, sigmoid, strictly_monotone
from ..functions.geometry import dbl
from ..functions.hashing import unit_hash
from ..functions.stats import ratio
from ..session import checkpointed
from .isotonic import isotonic_knots
from .scale import running, threshold_steps, with_grid

MIN_BIN = 20  # fixed value: bins below this do not count for the maximum gap


def _bin_of(score: Column, edges: Sequence[float]) -> Column:
    """Right-open bins, the last one closed."""
    return F.least(threshold_steps(score, edges), F.lit(len(edges) - 1)) - 1


def reliability_bins(scores: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", edges: Sequence[float] = ECE_EDGES) -> DataFrame:
    """Count, mean score, precision and gap per bin; empty bins stay."""
    keys = list(keys)
    stats = scores.groupBy(*keys, _bin_of(F.col(score), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("m"), F.avg(dbl(label)).alias("p")
    )
    bins = F.array(*[F.struct(F.lit(i).alias("bin"), dbl(a).alias("lo"), dbl(b).alias("hi")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))])
    dense = stats.select(*keys).distinct() if keys else scores.sparkSession.range(1).select()
    out = dense.select(*keys, F.inline(bins)).join(stats, [*keys, "bin"], "left")
    return out.select(
        *keys, "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), F.round("m", 6).alias("mean_score"),
        F.round("p", 6).alias("precision"), F.round(F.col("m") - F.col("p"), 6).alias("gap"),
    )


def calibration_errors(scores: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """ECE and MCE from the bins, Brier score and negative log-likelihood from the rows."""
    keys = list(keys)
    bins = reliability_bins(scores, keys, score, label)
    e = bins.groupBy(*keys).agg(
        ratio(F.sum(F.col("n") * F.abs(F.coalesce("gap", dbl(0)))), F.sum("n"), None).alias("ece"),
        F.max(F.when(F.col("n") >= MIN_BIN, F.abs("gap"))).alias("mce"),
    )
    r = scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(score) - dbl(label), 2)).alias("brier"), F.avg(nll_terms(score, label)).alias("nll")
    )
    return r.join(e, keys) if keys else r.join(F.broadcast(e))  # one row each


def equal_bin_ece(scores: DataFrame, score: str = "score", label: str = "label", bins: int = 15) -> DataFrame:
    """ECE over equal, left-open bins."""
    idx = F.lit(0)
    for i in range(1, bins):
        idx = idx + F.when(F.col(score) > dbl(i) / bins, 1).otherwise(0)
    n = F.count(F.lit(1))
    per = scores.groupBy(F.when(F.col(score) > 0, idx).alias("bin")).agg(n.alias("n"), F.avg(score).alias("m"), F.avg(dbl(label)).alias("p"))
    hit = F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("m") - F.col("p"))).otherwise(dbl(0))
    return per.agg((F.sum(hit) / F.sum("n")).alias("ece"))


def distinct_scores(scores: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """score, n, k: what every fit needs from a split."""
    return scores.groupBy(*keys, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("k"))


# ---------------------------------------------------------------- fits

def _nll(temp: Column) -> Column:
    p = clip01(sigmoid(logit("score") / temp), 1e-6, 1 - 1e-6)
    return -(F.col("k") * F.log(p) + (F.col("n") - F.col("k")) * F.log(1 - p))


def fit_temperature(counts: DataFrame, keys: Sequence[str] = (), refinements: int = 3, steps: int = 200) -> DataFrame:
    """Temperature with the smallest NLL: a log grid on [0.02, 50], then narrower grids around the best."""
    import math

    keys = list(keys)
    lo, hi = math.log(0.02), math.log(50.0)
    log_t = [lo + (hi - lo) * i / steps for i in range(steps + 1)]
    g = with_grid(counts, "log_t", log_t).groupBy(*keys, "log_t").agg(F.sum(_nll(F.exp("log_t"))).alias("nll"))
    best = g.groupBy(*keys).agg(F.min_by("log_t", F.struct("nll", "log_t")).alias("log_t"), F.min("nll").alias("nll"))
    width = (hi - lo) / steps
    for _ in range(refinements):
        offsets = F.transform(F.sequence(F.lit(-20), F.lit(20)), lambda i: i * dbl(width) / 20)
        cand = best.select(*keys, F.explode(F.transform(offsets, lambda o: F.least(F.greatest(F.col("log_t") + o, dbl(lo)), dbl(hi)))).alias("log_t"))
        joined = counts.join(cand, keys) if keys else counts.join(F.broadcast(cand))  # 41 candidates
        g = joined.groupBy(*keys, "log_t").agg(F.sum(_nll(F.exp("log_t"))).alias("nll"))
        best = g.groupBy(*keys).agg(F.min_by("log_t", F.struct("nll", "log_t")).alias("log_t"), F.min("nll").alias("nll"))
        width /= 20
    return best.select(*keys, F.exp("log_t").alias("temperature"), "nll")


PLATT_ROUNDS, PLATT_STEP = 20, 2.0


def platt_params(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, slope, intercept) of a logistic curve on the logit, by Newton steps on (keys, score, n, k).

    All keys are fitted together; a round sums five numbers per key. A step moves either parameter by at
    most PLATT_STEP, and a key without curvature left stays where it is.
    """
    keys = list(keys)
    z, n = logit("score"), dbl("n")
    p = sigmoid(F.col("slope") * z + F.col("intercept"))
    w, off = n * p * (1 - p), dbl("k") - n * p
    now = (counts.select(*keys).distinct() if keys else counts.sparkSession.range(1).select()).select(*keys, dbl(1).alias("slope"), dbl(0).alias("intercept"))
    for _ in range(PLATT_ROUNDS):
        on = counts.join(F.broadcast(now), keys) if keys else counts.join(F.broadcast(now))  # one row per key, of which there are few
        sums = on.groupBy(*keys, "slope", "intercept").agg(
            F.sum(off * z).alias("ga"), F.sum(off).alias("gb"), F.sum(w * z * z).alias("aa"), F.sum(w * z).alias("ab"), F.sum(w).alias("bb"))
        det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
        step = lambda top: F.when(det > 1e-12, F.least(F.greatest(top / det, dbl(-PLATT_STEP)), dbl(PLATT_STEP))).otherwise(0.0)
        now = sums.select(
            *keys, (F.col("slope") + step(F.col("bb") * F.col("ga") - F.col("ab") * F.col("gb"))).alias("slope"),
            (F.col("intercept") + step(F.col("aa") * F.col("gb") - F.col("ab") * F.col("ga"))).alias("intercept"))
    return now


def fit_platt(counts: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a logistic curve on the logit; the slope has to be positive."""
    slope, intercept = platt_params(counts).first()
    if slope <= 0:
        raise ValueError("the fitted slope is not positive, the ranking would not be kept")
    return slope, intercept


def fit_isotonic(counts: DataFrame, smoothing: float = 0.5) -> DataFrame:
    """Knots (x, y) of the monotone fit: plateaus shrunk towards one half, then made monotone again."""
    return isotonic_knots(counts, (), smoothing)


# ---------------------------------------------------------------- applying knots

CELLS = 256  # score cells used to find the interval of a score


def interpolate_knots(scores: DataFrame, knots: DataFrame, score: str = "score", out: str = "calibrated", keys: Sequence[str] = ()) -> DataFrame:
    """Piecewise-linear value of a score between its knots, flat outside, plus the monotone term.

    Each interval is listed under the score cells it covers, so the as-of search is an equi-join on
    the cell. Spark broadcasts the interval table when it is small.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("x") if keys else Window.partitionBy(F.lit(0)).orderBy("x")  # knots of one calibrator
    seg = knots.select(*keys, "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"), F.row_number().over(w).alias("r"))
    first = seg.where("r = 1").select(*keys, F.lit(-1.0).alias("a"), F.col("x").alias("b"), F.col("y").alias("ya"), F.col("y").alias("yb"))
    rest = seg.select(*keys, F.col("x").alias("a"), F.coalesce("x2", F.lit(2.0)).alias("b"), F.col("y").alias("ya"), F.coalesce("y2", "y").alias("yb"))
    cell = lambda c: F.floor(clip01(c) * CELLS)
    table = first.unionByName(rest).withColumn("cell", F.explode(F.sequence(cell("a"), cell("b"))))
    s = clip01(score)
    left = scores.withColumn("cell", cell(score))
    hit = left.join(table, [*keys, "cell"]).where((s >= F.col("a")) & (s < F.col("b")))
    base = F.col("ya") + (F.col("yb") - F.col("ya")) / (F.col("b") - F.col("a")) * (s - F.col("a"))
    return hit.withColumn(out, strictly_monotone(base, score)).drop("cell", "a", "b", "ya", "yb")


# ---------------------------------------------------------------- selection and checks

def select_family(scores: DataFrame, folds: int = 5, seed: str = "folds", eligible: Sequence[str] = ("temperature", "isotonic")) -> DataFrame:
    """Out-of-fold error of each calibrator family, folds grouped by frame.

    ``scores``: frame_id, score, label. Only counts per (fold, score) are kept for fitting; the same
    counts are enough for all errors.
    """
    fold = F.floor(unit_hash(seed, "frame_id") * folds).cast("int")
    # the fits below read this table again and again, so its lineage is cut once
    counts = checkpointed(scores.withColumn("fold", fold).groupBy("fold", "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("bigint")).alias("k")))
    others = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(folds - 1)), F.array("fold")))
    train = checkpointed(counts.select(others.alias("held"), "score", "n", "k").groupBy("held", "score").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    held = counts.select(F.col("fold").alias("held"), "score", "n", "k")
    params = fit_temperature(train, ["held"]).join(platt_params(train, ["held"]), "held")
    curves = held.join(F.broadcast(params), "held")  # one row per fold
    parts = [counts.select(F.lit("identity").alias("family"), "score", "n", "k", F.col("score").alias("p"))]
    parts.append(curves.select(F.lit("temperature").alias("family"), "score", "n", "k", parametric("score", F.lit("temperature"), temperature=F.col("temperature")).alias("p")))
    parts.append(curves.select(F.lit("platt").alias("family"), "score", "n", "k", parametric("score", F.lit("platt"), slope=F.col("slope"), intercept=F.col("intercept")).alias("p")))
    knots = checkpointed(isotonic_knots(train, ["held"]))
    parts.append(interpolate_knots(held, knots, out="p", keys=["held"]).select(F.lit("isotonic").alias("family"), "score", "n", "k", "p"))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    k, n, p = F.col("k"), F.col("n"), F.col("p")
    bins = every.groupBy("family", _bin_of(p, ECE_EDGES).alias("bin")).agg(F.sum("n").alias("n"), F.sum(n * p).alias("s"), F.sum("k").alias("k"))
    ece = bins.groupBy("family").agg((F.sum(F.col("n") * F.abs(F.round(F.col("s") / F.col("n") - F.col("k") / F.col("n"), 6))) / F.sum("n")).alias("oof_ece"))
    q = clip01("p", 1e-6, 1 - 1e-6)
    rows = every.groupBy("family").agg(
        F.sum("n").alias("n"), (F.sum(k * F.pow(1 - p, 2) + (n - k) * p * p) / F.sum("n")).alias("oof_brier"),
        (F.sum(-(k * F.log(q) + (n - k) * F.log(1 - q))) / F.sum("n")).alias("oof_nll"),
    )
    out = rows.join(ece, "family").withColumn("eligible", F.col("family").isin(*eligible))
    best = out.where("eligible").agg(F.min_by("family", F.struct("oof_ece", "family")).alias("winner"))
    return out.join(F.broadcast(best)).withColumn("winner", F.col("winner") == F.col("family"))  # one row


def rank_preservation(scores: DataFrame, raw: str = "score", cal: str = "calibrated") -> DataFrame:
    """Does the calibrated score keep the order of the distinct raw scores?

    Neighbours are compared through the running maximum of everything below, in score buckets.
    """
    d = scores.groupBy(raw).agg(F.max(cal).alias("c"), F.min(cal).alias("c_lo")).withColumn("__k", F.lit(0)).withColumn("__one", F.lit(1))
    pos = running(d, ["__k"], [raw], {"i": ("__one", "sum")}).select(raw, "c", "i")
    nxt = pos.select((F.col("i") - 1).alias("i"), F.col("c").alias("c_next"))
    pair = pos.join(nxt, "i", "left")
    return pair.agg(
        F.count(F.lit(1)).alias("distinct_scores"), F.sum((F.col("c_next") <= F.col("c")).cast("int")).alias("collapsed_pairs"),
        F.coalesce(F.min(~(F.col("c_next") < F.col("c"))), F.lit(True)).alias("order_identical"), F.max(F.abs(F.col("c") - F.col(raw))).alias("max_shift"),
    )
