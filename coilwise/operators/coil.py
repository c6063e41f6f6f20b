"""Frame verdicts, coil roll-ups and dispositions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.geometry import area, clamp_box, dbl
from ..functions.severity import band_order, class_name, detection_score, fps, physical_size, severity_band
from .scale import exact_quantiles, running


def ranks_that_count(decay: float) -> int:
    """Ranks whose share can change a double: where decay^rank is below 2^-54, a factor is exactly 1.0."""
    return math.ceil(54 / -math.log2(decay)) + 1


def score_detections(frames: DataFrame, dets: DataFrame, names: Sequence[str] = vocab.CLASSES) -> DataFrame:
    """Clamp boxes into their frame and attach area, class name, score and band."""
    size = frames.select("frame_id", "coil_id", "width", "height")
    d = dets.join(size, "frame_id")
    d = d.withColumns(clamp_box())
    d = d.withColumn("area_px", area())
    d = d.withColumn("area_frac", F.col("area_px") / F.greatest(dbl(F.col("width") * F.col("height")), dbl(1)))
    d = d.withColumn("class_name", class_name("class_id", names))
    d = d.withColumn("score", detection_score())
    return d.withColumn("band", severity_band("score"))


def noisy_or(scored: DataFrame, keys: Sequence[str] = ("frame_id",), score: str = "score", tie: str = "det_id") -> DataFrame:
    """Damped noisy-OR over the ranked scores of each key: one minus the product of the residuals.

    Later ranks multiply by exactly 1.0, so the ranking is a top-k that Spark limits before the shuffle
    without changing any result; a key with very many boxes never reaches one task whole.
    """
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), F.col(tie).asc())
    top = scored.select(*keys, score, F.row_number().over(order).alias("__r")).where(F.col("__r") <= ranks_that_count(vocab.RANK_DECAY))
    share = dbl(score) / 100 * F.pow(dbl(vocab.RANK_DECAY), F.col("__r") - 1)
    severity = 100 * (1 - F.product(1 - F.least(share, dbl(1))))
    return top.groupBy(*keys).agg(F.least(F.greatest(severity, dbl(0)), dbl(100)).alias("severity_score"))


def frame_results(
    frames: DataFrame, dets: DataFrame, names: Sequence[str] = vocab.CLASSES, flag_class: str = "inclusion"
) -> DataFrame:
    """One verdict row per frame, frames without boxes included."""
    scored = score_detections(frames, dets, names)
    latest = F.struct(F.col("conf"), (-F.col("det_id")).alias("o"))
    per_frame = scored.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("defect_count"),
        F.max_by("class_id", latest).alias("dominant_class_id"),
        F.max("conf").alias("max_confidence"),
        F.max(F.when(F.col("class_name") == flag_class, 1).otherwise(0)).alias("has_flag_class"),
    )
    out = frames.join(per_frame, "frame_id", "left").join(noisy_or(scored), "frame_id", "left")
    out = out.withColumns({
        "defect_count": F.coalesce("defect_count", F.lit(0)),
        "max_confidence": F.coalesce("max_confidence", dbl(0)),
        "severity_score": F.coalesce("severity_score", dbl(0)),
        "has_flag_class": F.coalesce("has_flag_class", F.lit(0)),
    })
    return out.withColumns({
        "verdict": F.when(F.col("defect_count") > 0, "DEFECT").otherwise("PASS"),
        "dominant_class": class_name("dominant_class_id", names),
        "severity_band": severity_band("severity_score", "defect_count"),
    })


def coil_stats(results: DataFrame, keys: Sequence[str] = ("coil_id",)) -> DataFrame:
    """Coil aggregates from frame verdicts."""
    keys = list(keys)
    total = F.count(F.lit(1))
    bad = F.sum(F.when(F.col("verdict") == "DEFECT", 1).otherwise(0))
    boxes = F.sum("defect_count")
    mean_ms = F.avg("total_ms")
    bands = [
        F.sum(F.when(F.col("severity_band") == b, 1).otherwise(0)).alias(f"frames_{b}")
        for b in ("clean", *vocab.BANDS)
    ]
    base = results.groupBy(*keys).agg(
        total.alias("total_frames"), bad.alias("defect_frames"), (total - bad).alias("clean_frames"),
        (bad / total).alias("defect_rate"), boxes.alias("total_detections"),
        (boxes / total).alias("detections_per_frame"), *bands,
        F.avg("severity_score").alias("mean_severity"), F.max("severity_score").alias("max_severity"),
        F.sum("has_flag_class").alias("flag_class_frames"),
        mean_ms.alias("mean_latency_ms"), fps(mean_ms).alias("throughput_fps"),
    )
    p95 = exact_quantiles(results, keys, "severity_score", {"p95_severity": 0.95})
    return base.join(p95, keys)


def coil_class_counts(scored: DataFrame, keys: Sequence[str] = ("coil_id",)) -> DataFrame:
    """Detections and frames per coil and class (long form of the class maps)."""
    per_frame = scored.groupBy(*keys, "class_name", "frame_id").agg(F.count(F.lit(1)).alias("n"))
    return per_frame.groupBy(*keys, "class_name").agg(
        F.sum("n").alias("detections"), F.count(F.lit(1)).alias("frames")
    )


@dataclass(frozen=True)
class DispositionRules:
    """The shipped limits of the disposition rule."""

    accept_max_defect_rate: float = 0.02
    accept_max_p95: float = 30.0
    hold_min_defect_rate: float = 0.25
    hold_min_p95: float = 70.0
    hold_min_critical_frames: int = 1
    hold_class: str = "inclusion"
    hold_class_frame_limit: int = 0


def disposition(stats: DataFrame, rules: DispositionRules | DataFrame = DispositionRules(), on: Sequence[str] = ()) -> DataFrame:
    """HOLD / DOWNGRADE / ACCEPT with reason codes.

    ``rules`` is either one rule set or a rules table joined on ``on`` (one rule set per product line).
    """
    if isinstance(rules, DataFrame):
        rule = lambda n: F.col(n)
        stats = stats.join(rules, list(on)) if on else stats
    else:
        rule = lambda n: F.lit(getattr(rules, n))

    def reasons(*pairs: tuple[Column, Column | str]) -> Column:
        items = F.array(*[F.when(cond, text if isinstance(text, Column) else F.lit(text)) for cond, text in pairs])
        return F.filter(items, lambda r: r.isNotNull())

    hold = reasons(
        (F.col("defect_rate") > rule("hold_min_defect_rate"), "defect rate over hold limit"),
        (F.col("p95_severity") >= rule("hold_min_p95"), "p95 severity at hold limit"),
        (F.col("frames_critical") >= rule("hold_min_critical_frames"), "critical frames"),
        (F.col("flag_class_frames") > rule("hold_class_frame_limit"), F.concat(F.lit("zero-tolerance class "), rule("hold_class"))),
    )
    missed = reasons(
        (F.col("defect_rate") > rule("accept_max_defect_rate"), "defect rate over accept limit"),
        (F.col("p95_severity") > rule("accept_max_p95"), "p95 severity over accept limit"),
        (F.col("frames_high") + F.col("frames_critical") > 0, "high or critical frames"),
    )
    fine = F.array(F.lit("defect rate within accept limit"), F.lit("p95 severity within accept limit"), F.lit("no high or critical frames"))
    return (
        stats.withColumn("__hold", hold).withColumn("__missed", missed)
        .withColumn("disposition", F.when(F.size("__hold") > 0, "HOLD").when(F.size("__missed") > 0, "DOWNGRADE").otherwise("ACCEPT"))
        .withColumn("reasons", F.when(F.size("__hold") > 0, F.col("__hold")).when(F.size("__missed") > 0, F.col("__missed")).otherwise(fine))
        .drop("__hold", "__missed")
    )


def worst_frames(results: DataFrame, n: int = 5, keys: Sequence[str] = ("coil_id",)) -> DataFrame:
    """Worst-n defective frames per coil: severity, then count, then confidence, then id."""
    order = Window.partitionBy(*keys).orderBy(
        F.col("severity_score").desc(), F.col("defect_count").desc(), F.col("max_confidence").desc(), F.col("frame_id").asc()
    )
    return results.where(F.col("defect_count") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def class_distribution(scored: DataFrame, dim: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Detections and distinct frames per class, classes without detections kept."""
    keys = list(keys)
    counts = scored.groupBy(*keys, "class_id", "frame_id").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy(*keys, "class_id").agg(F.sum("n").alias("detections"), F.count(F.lit(1)).alias("frames"))
    names = F.broadcast(dim.select("class_id", "class_name"))  # one row per class of the head
    if keys:
        ids = [r[0] for r in dim.select("class_id").collect()]  # class ids of the head, a handful
        names = counts.select(*keys).distinct().withColumn("class_id", F.explode(F.array(*[F.lit(i) for i in ids]))).join(names, "class_id")
    return names.join(counts, [*keys, "class_id"], "left").fillna(0, subset=["detections", "frames"])


def guidance(scored: DataFrame, dim: DataFrame) -> DataFrame:
    """One actionable row per frame and class: count, best confidence, worst band, what to do."""
    rows = scored.groupBy("frame_id", "class_name").agg(
        F.count(F.lit(1)).alias("count"), F.max("conf").alias("max_confidence"), F.max(band_order("band")).alias("__w")
    )
    kb = F.broadcast(dim.select("class_name", "tier", "cause", "action"))  # one row per class
    return rows.join(kb, "class_name", "left").select(
        "frame_id", "class_name", "count", "max_confidence",
        F.element_at(F.array(*[F.lit(b) for b in vocab.BANDS]), F.col("__w").cast("int")).alias("worst"),
        F.coalesce("tier", F.lit("unknown")).alias("base_tier"),
        F.coalesce("cause", F.lit(vocab.DEFAULT_CAUSE)).alias("cause"),
        F.coalesce("action", F.lit(vocab.DEFAULT_ACTION)).alias("action"),
    )


def running_defect_rate(results: DataFrame, keys: Sequence[str] = ("coil_id",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """Percentage of frames rejected so far, per coil in sequence order."""
    src = results.withColumn("__bad", F.when(F.col("verdict") == "DEFECT", 1).otherwise(0)).withColumn("__one", F.lit(1))
    out = running(src, list(keys), list(order), {"defects_so_far": ("__bad", "sum"), "frames_so_far": ("__one", "sum")})
    return out.withColumn("running_rate", 100 * F.col("defects_so_far") / F.col("frames_so_far")).drop(
        "__bad", "__one", "defects_so_far_total", "frames_so_far_total"
    )


def frame_export(results: DataFrame, model: str, conf: float, iou: float, calibrated: Column | None = None) -> DataFrame:
    """Coil file: one fixed-width row of 15 columns per frame."""
    clean = F.col("defect_count") == 0
    return results.select(
        F.col("frame_id").alias("frame"), "verdict", F.col("defect_count").alias("defects"),
        F.coalesce("dominant_class", F.lit("-")).alias("dominant_class"),
        F.round(calibrated if calibrated is not None else F.col("max_confidence"), 4).alias("calibrated_confidence"),
        F.round("max_confidence", 4).alias("max_confidence"), F.round("severity_score", 2).alias("severity_score"),
        F.when(clean, "-").otherwise(F.col("severity_band")).alias("severity_band"), "width", "height",
        F.round("total_ms", 2).alias("latency_ms"), F.round(fps("total_ms"), 1).alias("fps"),
        F.lit(model).alias("model"), dbl(conf).alias("conf_threshold"), dbl(iou).alias("iou_threshold"),
    )


def detection_export(scored: DataFrame, mm_per_px: float = 0.5, calibrated: Column | None = None) -> DataFrame:
    """One row per box with millimetre fields; boxes numbered by confidence inside their frame."""
    size = physical_size(mm_per_px)
    order = Window.partitionBy("frame_id").orderBy(F.col("conf").desc(), F.col("det_id").asc())
    numbered = scored.withColumn("detection", F.row_number().over(order))  # one sort, which spills where a frame is crowded
    return numbered.select(
        F.col("frame_id").alias("frame"), F.col("detection").cast("bigint").alias("detection"), "class_id",
        F.col("class_name").alias("defect"),
        F.round(calibrated if calibrated is not None else F.col("conf"), 4).alias("calibrated_confidence"),
        F.round("conf", 4).alias("confidence"), F.col("band").alias("severity"),
        *[F.round(s, 2).alias(s) for s in ("x1", "y1", "x2", "y2", "area_px")],
        F.round("area_frac", 6).alias("area_frac"),
        *[F.round(e, 3).alias(n) for n, e in size.items()], dbl(mm_per_px).alias("mm_per_px"),
    )


def latency_stats(timings: DataFrame, keys: Sequence[str], ms: str = "per_frame_ms") -> DataFrame:
    """Latency summary per key with exact quantiles and implied throughput."""
    keys = list(keys)
    n = F.count(ms)
    base = timings.groupBy(*keys).agg(
        n.alias("n"), F.avg(ms).alias("mean_ms"), F.when(n > 1, F.stddev_samp(ms)).otherwise(dbl(0)).alias("std_ms"),
        F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"),
    )
    q = exact_quantiles(timings, keys, ms, {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    out = base.join(q, keys)
    return out.withColumns({"fps_mean": fps("mean_ms"), "fps_p95": fps("p95_ms")})
