"""Label sets: canvas shifts, joined class spaces, censuses, and roll-ups by class and family."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dbl
from ..session import reuse
from . import metrics as e
from .scale import exact_quantiles

CENTRE = ("cx", "cy", "w", "h")


def canvas_shift(labels: DataFrame, side: int, canvas: int, names: Sequence[str] = ("px", "py", "pw", "ph")) -> DataFrame:
    """Centre boxes of a ``side`` px frame placed in the middle of a ``canvas`` px square, in units of the canvas.

    The offset is whole pixels, and widths and heights keep their size in pixels.
    """
    pad = (canvas - side) // 2
    place = lambda c: (F.col(c) * side + pad) / canvas
    return labels.withColumns(dict(zip(names, (place("cx"), place("cy"), F.col("w") * side / canvas, F.col("h") * side / canvas), strict=True)))


def canvas_error(side: int, canvas: int, names: Sequence[str] = ("px", "py", "pw", "ph")) -> Column:
    """How far a shifted box is from its original after the way back."""
    pad = (canvas - side) // 2
    back = [(F.col(n) * canvas - pad) / side if c in ("cx", "cy") else F.col(n) * canvas / side for c, n in zip(CENTRE, names, strict=True)]
    return F.greatest(*[F.abs(b - F.col(c)) for b, c in zip(back, CENTRE, strict=True)])


def join_label_spaces(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """Boxes of several vocabularies in one class space: each part's classes are shifted by its offset."""
    moved = [df.withColumn("class_id", (F.col("class_id") + offset).cast("int")) for df, offset in parts]
    out = moved[0]
    for m in moved[1:]:
        out = out.unionByName(m)
    return out


def split_census(frames: DataFrame, boxes: DataFrame, classes: int) -> DataFrame:
    """Images, labelled and background ones, and boxes of every class, per split."""
    per = boxes.groupBy("frame_id").agg(*[F.sum((F.col("class_id") == i).cast("bigint")).alias(f"class_{i}") for i in range(classes)])
    n = F.count(F.lit(1))
    return frames.join(per, "frame_id", "left").groupBy("split").agg(
        n.alias("images"), F.count("class_0").alias("labelled"), (n - F.count("class_0")).alias("background"),
        *[F.coalesce(F.sum(f"class_{i}"), F.lit(0)).alias(f"class_{i}") for i in range(classes)])


def family_rollup(found: DataFrame, families: Mapping[int, str], other: str) -> DataFrame:
    """Classes, instances and the mean of the classes' recalls, per family; ``found`` has class_id and found."""
    r = found.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("found").cast("int")).alias("recall"))
    name = F.coalesce(*[F.when(F.col("class_id") == c, f) for c, f in families.items()], F.lit(other))
    return r.groupBy(name.alias("family")).agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("instances"), F.avg("recall").alias("mean_recall"))


def right_type_rates(frames: DataFrame, boxes: DataFrame, detections: DataFrame, models: Sequence[str], clean: Column, least: float = 0.05, flag: float = 0.15) -> DataFrame:
    """How often the strongest box names the image's class, and how often it flags clean and defective images, per model."""
    f = frames.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    f = f.join(e.image_class(boxes), "frame_id", "left").join(e.dominant(detections, ["model", "frame_id"]), ["model", "frame_id"], "left")
    lab, top = F.col("image_class").isNotNull(), F.coalesce("max_conf", dbl(0))
    n = lambda c, name: F.sum(F.coalesce(c, F.lit(False)).cast("bigint")).alias(name)
    return f.groupBy("model").agg(
        n(lab & (top >= least) & (F.col("pred_class") == F.col("image_class")), "right_type"), n(lab, "labelled"),
        n(clean & (top >= flag), "clean_flagged"), n(clean, "clean"), n(lab & (top >= flag), "defect_flagged"))


def family_peaks(boxes: DataFrame, detections: DataFrame, families: DataFrame, low: float = 0.5) -> DataFrame:
    """Median of the images' strongest confidence and the share under ``low``, per family (class_id, family), best first."""
    peak = detections.groupBy("frame_id").agg(F.max("conf").alias("mc"))
    m = reuse(e.image_class(boxes).join(peak, "frame_id", "left").select(F.col("image_class").alias("class_id"), F.coalesce("mc", dbl(0)).alias("mc")))
    a = exact_quantiles(m, ["class_id"], "mc", {"median_peak": 0.5}).join(m.groupBy("class_id").agg(F.avg((F.col("mc") < low).cast("double")).alias("share_under")), "class_id")
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("median_peak").desc_nulls_last(), "family")  # one row per class
    return families.join(a, "class_id", "left").select("family", "median_peak", "share_under", F.row_number().over(w).alias("place"))


def best_all_correct_frames(boxes: DataFrame, detections: DataFrame, conf: float = 0.25, most: int = 4) -> DataFrame:
    """Per class the frame whose few detections all have the image's class, with the highest mean confidence."""
    ic = e.image_class(boxes).select("frame_id", "image_class")
    b = detections.where(F.col("conf") >= conf).join(ic, "frame_id").groupBy("frame_id", "image_class").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("class_id") == F.col("image_class")).alias("ok"), F.avg("conf").alias("score"))
    best = F.struct(F.round("score", 9).alias("s"), (-F.col("frame_id")).alias("f"))
    return b.where(F.col("ok") & (F.col("n") <= most)).groupBy(F.col("image_class").alias("class_id")).agg(F.max_by("frame_id", best).alias("frame_id"), F.max("score").alias("score"))
