"""Grey histograms, drift, look-up tables and the plausibility gate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dbl
from .scale import exact_quantiles

# Fixed values
LEVELS = 256
CLIP_LOW, CLIP_HIGH = 2, 253
STRENGTH = 0.25
CELLS = 1024  # cells of cumulative mass used to find a reference level


def dense_histogram(hist: DataFrame, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """All 256 levels per key with the running count, in one shuffle.

    A histogram has at most 256 rows per key, so both the map and the window are bounded.
    """
    keys = list(keys)
    per = hist.groupBy(*keys, "level").agg(F.sum("n").alias("n"))
    m = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("level", "n"))).alias("__m"))
    rows = m.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("level"), "__m")
    rows = rows.select(*keys, "level", F.coalesce(F.try_element_at("__m", F.col("level")), F.lit(0).cast("bigint")).alias("n"))
    w = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    total = F.sum("n").over(whole)
    return rows.withColumn("cdf", F.when(total > 0, F.sum("n").over(w) / total).otherwise(dbl(0)))


def moments(hist: DataFrame, keys: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Pixel count, mean and standard deviation per key."""
    lv, n = dbl("level"), F.col("n")
    a = hist.groupBy(*keys).agg(F.sum("n").alias("pixels"), F.sum(lv * n).alias("s1"), F.sum(lv * lv * n).alias("s2"))
    mean = F.col("s1") / F.col("pixels")
    return a.withColumns({"mean": mean, "std": F.sqrt(F.greatest(F.col("s2") / F.col("pixels") - mean * mean, dbl(0)))}).drop("s1", "s2")


def reference_histogram(hist: DataFrame, frame_moments: DataFrame) -> DataFrame:
    """Two targets of 256 rows: all pixels pooled, and frames aligned on the population mean.

    Aligned frames are shifted by the rounded gap; what leaves the range falls off the end.
    """
    pooled = hist.groupBy("level").agg(F.sum("n").alias("n"))
    mean = pooled.agg((F.sum(dbl("level") * F.col("n")) / F.sum("n")).alias("__pop"))
    shift = frame_moments.join(F.broadcast(mean)).select("frame_id", F.bround(F.col("__pop") - F.col("mean"), 0).cast("int").alias("__shift"))  # one row
    moved = hist.join(shift, "frame_id").withColumn("level", F.col("level") + F.col("__shift")).where(F.col("level").between(0, LEVELS - 1))
    typical = moved.groupBy("level").agg(F.sum("n").alias("n"))
    return pooled.withColumn("target", F.lit("population")).unionByName(typical.withColumn("target", F.lit("frame"))).select("target", "level", "n")


def reference_cdf(reference: DataFrame, target: str) -> DataFrame:
    """256 rows (level, cdf) of one target."""
    one = reference.where(F.col("target") == target).select(F.lit(0).alias("__k"), "level", "n")
    return dense_histogram(one, ["__k"]).select("level", F.col("cdf").alias("ref_cdf"))


def drift(hist: DataFrame, ref: DataFrame) -> DataFrame:
    """Per frame: mean, sigma, p1, p99 and the Wasserstein-1 distance to the reference in grey levels."""
    d = dense_histogram(hist).join(F.broadcast(ref), "level")  # 256 rows
    first = lambda q: F.min(F.when(F.col("cdf") >= dbl(q), F.col("level")))
    dist = d.groupBy("frame_id").agg(F.sum(F.abs(F.col("cdf") - F.col("ref_cdf"))).alias("hist_distance"), first(0.01).alias("p1"), first(0.99).alias("p99"))
    return moments(hist).join(dist, "frame_id")


def _blend(level: Column, target: Column, strength: float) -> Column:
    s = max(0.0, min(1.0, strength))
    value = (1 - dbl(s)) * level + dbl(s) * target
    return F.least(F.greatest(F.bround(value, 0), dbl(0)), dbl(LEVELS - 1)).cast("int")


def histogram_lut(hist: DataFrame, ref: DataFrame, strength: float = STRENGTH) -> DataFrame:
    """Histogram-matching table per frame: (frame_id, level, new_level).

    The lowest reference level reaching the frame's cumulative mass is found by an equi-join on cells
    of cumulative mass; the reference side has 256 intervals.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("level")  # 256 rows
    seg = ref.select("level", F.coalesce(F.lag("ref_cdf").over(w), dbl(-1)).alias("lo"), F.col("ref_cdf").alias("hi")).where("hi > lo")
    cell = lambda c: F.floor(F.greatest(c, dbl(0)) * CELLS)
    seg = seg.select(F.col("level").alias("matched"), "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    d = dense_histogram(hist).withColumn("cell", cell(F.col("cdf")))
    hit = d.join(F.broadcast(seg), "cell").where((F.col("cdf") > F.col("lo")) & (F.col("cdf") <= F.col("hi")))
    return hit.select("frame_id", "level", _blend(F.col("level"), F.col("matched"), strength).alias("new_level"))


def affine_lut(frame_moments: DataFrame, ref_mean, ref_std, strength: float = STRENGTH, min_std: float = 1e-3) -> DataFrame:
    """Mean and sigma match as a table per frame."""
    f = frame_moments.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    target = (F.col("level") - F.col("mean")) * (dbl(ref_std) / F.greatest(F.col("std"), dbl(min_std))) + dbl(ref_mean)
    return f.select("frame_id", "level", _blend(F.col("level"), target, strength).alias("new_level"))


def apply_lut(hist: DataFrame, lut: DataFrame) -> DataFrame:
    """Histogram of each frame after its table."""
    return hist.join(lut, ["frame_id", "level"]).groupBy("frame_id", F.col("new_level").alias("level")).agg(F.sum("n").alias("n"))


def tonal_signals(hist: DataFrame) -> DataFrame:
    """Entropy over unclipped levels (bits) and the clipped share."""
    open_ = F.col("level").between(CLIP_LOW + 1, CLIP_HIGH - 1)
    per = hist.groupBy("frame_id", "level").agg(F.sum("n").alias("n"))
    n = F.when(open_ & (F.col("n") > 0), dbl("n"))
    a = per.groupBy("frame_id").agg(F.sum(n).alias("t"), F.sum(n * F.log2(n)).alias("e"), F.sum(F.when(~open_, F.col("n")).otherwise(0)).alias("c"), F.sum("n").alias("all"))
    bits = F.when(F.col("t") > 0, F.log2("t") - F.col("e") / F.col("t")).otherwise(dbl(0))
    return a.select("frame_id", F.greatest(F.coalesce(bits, dbl(0)), dbl(0)).alias("tonal_bits"), (F.col("c") / F.col("all")).alias("clipped_fraction"))


# ---------------------------------------------------------------- plausibility gate

@dataclass(frozen=True)
class GateLimits:
    """Limits of the plausibility gate."""

    min_side_px: float = 64.0
    max_aspect: float = 64.0
    max_saturation: float = 40.0
    max_edge_density: float = 0.70
    min_focus: float = 1.5
    min_tonal_bits: float = 1.8
    review_hist_distance: float = 116.5


# name, signal column, limit, "at least" (True) or "at most"
CHECKS = (
    ("resolution", "min_side", "min_side_px", True), ("aspect", "aspect", "max_aspect", False), ("colour", "saturation", "max_saturation", False),
    ("noise", "edge_density", "max_edge_density", False), ("focus", "focus", "min_focus", True), ("tonal_range", "tonal_bits", "min_tonal_bits", True),
)


def gate_checks(limits: GateLimits = GateLimits()) -> Column:
    """Array of the six checks with value, limit, outcome and margin (ratio, > 1 is safe)."""
    lim = asdict(limits)
    rows = []
    for name, col, key, at_least in CHECKS:
        v, t = dbl(col), dbl(lim[key])
        margin = v / t if at_least else F.when(v != 0, t / v).otherwise(dbl(float("inf")))
        rows.append(F.struct(F.lit(name).alias("name"), v.alias("value"), t.alias("limit"), F.lit(at_least).alias("at_least"), ((v >= t) if at_least else (v <= t)).alias("passed"), margin.alias("margin")))
    return F.array(*rows)


def gate(signals: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """reject on any failed check, review on a far-off histogram, else pass."""
    s = signals.withColumn("checks", gate_checks(limits))
    failed = F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"])
    s = s.withColumn("failed", failed)
    return s.withColumn("decision", F.when(F.size("failed") > 0, "reject").when(F.col("hist_distance") > dbl(limits.review_hist_distance), "review").otherwise("pass"))


def headroom(signals: DataFrame, limits: GateLimits = GateLimits()) -> DataFrame:
    """How much room known-good frames leave on every check."""
    rows = gate(signals, limits).select(F.inline("checks"))
    agg = rows.groupBy("name").agg(
        F.max("limit").alias("limit"), F.when(F.max(F.col("at_least").cast("int")) == 1, F.min("value")).otherwise(F.max("value")).alias("worst_value"),
        F.min("margin").alias("worst_margin"), F.sum((~F.col("passed")).cast("int")).alias("n_failed"), F.count(F.lit(1)).alias("n"),
    )
    return agg.join(exact_quantiles(rows, ["name"], "value", {"p01": 0.01, "p50": 0.5, "p99": 0.99}), "name")


def suggest_limits(room: DataFrame, safety: float = 2.0, limits: GateLimits = GateLimits()) -> DataFrame:
    """Looser limits for a new camera; none is ever tightened."""
    if safety < 1:
        raise ValueError("safety must be at least 1")
    w = lambda name: F.max(F.when(F.col("name") == name, F.col("worst_value")))
    return room.agg(
        F.greatest(dbl(limits.max_saturation), w("colour") * safety).alias("max_saturation"),
        F.least(dbl(1), F.greatest(dbl(limits.max_edge_density), w("noise") * safety)).alias("max_edge_density"),
        F.least(dbl(limits.min_focus), w("focus") / safety).alias("min_focus"), F.least(dbl(limits.min_tonal_bits), w("tonal_range") / safety).alias("min_tonal_bits"),
    )
