"""False alarms on clean surface and the operating point that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import domains as dm
from ..operators import metrics as e
from ..operators import statistics as st
from ..operators import tiling as tl
from ..session import reuse


def mine_patches(frames: DataFrame, gts: DataFrame, seed: str = "clean") -> tuple[DataFrame, DataFrame]:
    """Clean and defect patches at every scale, thinned."""
    clean = tl.clean_patches(frames, gts, seed)
    defect = tl.defect_patches(frames, gts, f"{seed}-control")
    return clean, defect


def operating_point(scored_patches: DataFrame, detection_points: DataFrame, frame_area: float, floor: float = e.MIN_DETECTION) -> DataFrame:
    """Cost-based choice per basis: patch rate as measured, and extrapolated to a frame.

    ``scored_patches``: patch_id, source_id, size, max_conf; ``detection_points``: threshold, detection_rate.
    """
    by_scale = reuse(dm.alarm_rates(scored_patches, ["size"]))
    cells = by_scale.select("threshold", (F.col("size") * F.col("size")).cast("double").alias("area"), F.col("alarmed").alias("hits"), F.col("n_patches").alias("trials"))
    frame = st.extrapolate_to_frame(st.poisson_area_fit(cells, ["threshold"]), frame_area).select("threshold", "frame_rate")
    patch = dm.alarm_rates(scored_patches).select("threshold", F.col("rate").alias("patch_rate"))
    p = detection_points.select("threshold", "detection_rate").join(patch, "threshold").join(frame, "threshold")
    long = p.select("threshold", "detection_rate", F.inline(F.array(
        F.struct(F.lit("patch").alias("basis"), F.col("patch_rate").alias("false_alarm")), F.struct(F.lit("frame").alias("basis"), F.col("frame_rate").alias("false_alarm")))))
    cost = e.cost_with_prevalence("detection_rate", "false_alarm", e.MISS_RATIO, e.PREVALENCE)
    return e.recommend(long, ["basis"], cost, floor=floor, f1_col=None)
