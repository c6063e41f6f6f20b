"""Tune a threshold on one split, report on another."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching as m
from ..operators import metrics as e
from ..session import reuse


@dataclass(frozen=True)
class Evaluation:
    points: DataFrame
    choice: DataFrame
    threshold: float
    held_out: DataFrame
    class_report: DataFrame
    failures: DataFrame
    gallery: DataFrame


def evaluate(frames: DataFrame, gts: DataFrame, dets: DataFrame, tune: str = "val", report: str = "test", floor: float = e.MIN_DETECTION, miss_ratio: float = e.MISS_RATIO) -> Evaluation:
    """Match once at the loosest threshold; everything else reads the flagged boxes."""
    if tune == report:
        raise ValueError("the tuning split must differ from the reporting split")
    hits = reuse(m.greedy_match(dets, gts))
    flag = reuse(m.flag_matches(dets, hits))
    points = reuse(e.sweep(frames.where(F.col("split").isin(tune, report)), gts, flag, keys=["split"]))
    choice = e.recommend_threshold(points.where(F.col("split") == tune), ["split"], miss_ratio, floor)
    threshold = float(choice.first()["threshold"])  # the one scalar later steps need
    part = frames.where(F.col("split") == report)
    mine = lambda df: df.join(part.select("frame_id"), "frame_id", "left_semi")
    kept, kept_hits = mine(flag).where(F.col("conf") >= threshold), hits.where(F.col("conf") >= threshold)
    found = m.flag_found(mine(gts), kept_hits)
    failures, _ = e.class_failures(part, found, kept, mine(gts))
    return Evaluation(
        points, choice, threshold, points.where((F.col("split") == report) & (F.col("threshold") == threshold)),
        e.class_report(e.image_predictions(part, mine(gts), mine(dets), threshold)), failures, e.error_gallery(found, kept))
