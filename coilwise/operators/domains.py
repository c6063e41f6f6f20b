"""Clean-surface, cross-domain and per-domain sweeps over scored tiles and patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio, wilson
from .metrics import FINE_SWEEP, MIN_DETECTION, MISS_RATIO, PREVALENCE, recommend, _n
from ..functions.stats import cost_with_prevalence
from .scale import survivors_per_threshold, threshold_steps


def alarm_rates(patches: DataFrame, keys: Sequence[str] = (), grid: Sequence[float] = FINE_SWEEP, conf: str = "max_conf") -> DataFrame:
    """Patches and alarmed patches per key and threshold, with Wilson intervals."""
    keys = list(keys)
    hist = patches.groupBy(*keys, threshold_steps(conf, grid).alias("step")).agg(F.count(F.lit(1)).alias("alarmed"))
    out = survivors_per_threshold(hist, keys, "step", grid, ["alarmed"])
    n = patches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_patches"))
    out = out.join(n, keys) if keys else out.join(F.broadcast(n))  # one row
    ci = wilson("alarmed", "n_patches")
    return out.withColumns({"rate": ratio("alarmed", "n_patches"), "rate_lo": ci["lo"], "rate_hi": ci["hi"]})


def boxes_at(boxes: DataFrame, keys: Sequence[str], grid: Sequence[float] = FINE_SWEEP, name: str = "boxes") -> DataFrame:
    """Boxes surviving each threshold per key (for example per predicted class)."""
    hist = boxes.groupBy(*keys, threshold_steps("conf", grid).alias("step")).agg(F.count(F.lit(1)).alias(name))
    return survivors_per_threshold(hist, list(keys), "step", grid, [name])


def clean_patch_sweep(patches: DataFrame, boxes: DataFrame, grid: Sequence[float] = FINE_SWEEP) -> DataFrame:
    """False alarms on clean patches at three groupings in one table: all, by scale, by source class.

    ``patches``: patch_id, source_id, size, source_class, max_conf. ``boxes``: patch_id, class_id, conf.
    Grouping sets over the short step histogram give all groupings in one pass.
    """
    p = patches.select("size", "source_class", threshold_steps("max_conf", grid).alias("step"))
    hist = p.groupBy("size", "source_class", "step").agg(F.count(F.lit(1)).alias("n"))
    cube = hist.groupingSets([["step"], ["size", "step"], ["source_class", "step"]], "size", "source_class", "step").agg(F.sum("n").alias("alarmed"))
    cube = cube.select(
        F.when(F.col("size").isNotNull(), "scale").when(F.col("source_class").isNotNull(), "source_class").otherwise("all").alias("grouping"),
        F.coalesce("size", "source_class", F.lit(-1)).alias("value"), "step", "alarmed",
    )
    keys = ["grouping", "value"]
    pts = survivors_per_threshold(cube, keys, "step", grid, ["alarmed"])
    n = cube.groupBy(*keys).agg(F.sum("alarmed").alias("n_patches"))
    b = boxes.join(patches.select("patch_id", "size", "source_class"), "patch_id")
    bh = b.groupBy("size", "source_class", threshold_steps("conf", grid).alias("step")).agg(
        F.count(F.lit(1)).alias("boxes"), F.sum(_n(F.col("class_id") == F.col("source_class"))).alias("same_class")
    )
    bc = bh.groupingSets([["step"], ["size", "step"], ["source_class", "step"]], "size", "source_class", "step").agg(F.sum("boxes").alias("boxes"), F.sum("same_class").alias("same_class"))
    bc = bc.select(
        F.when(F.col("size").isNotNull(), "scale").when(F.col("source_class").isNotNull(), "source_class").otherwise("all").alias("grouping"),
        F.coalesce("size", "source_class", F.lit(-1)).alias("value"), "step", "boxes", "same_class",
    )
    bp = survivors_per_threshold(bc, keys, "step", grid, ["boxes", "same_class"])
    out = pts.join(n, keys).join(bp, [*keys, "threshold"], "left").fillna(0, subset=["boxes", "same_class"])
    ci = wilson("alarmed", "n_patches")
    return out.withColumns({
        "rate": ratio("alarmed", "n_patches"), "rate_lo": ci["lo"], "rate_hi": ci["hi"],
        "boxes_per_patch": ratio("boxes", "n_patches"), "same_class_share": ratio("same_class", "boxes"),
    })


def source_rates(patches: DataFrame, grid: Sequence[float] = FINE_SWEEP, source: str = "source_id", keys: Sequence[str] = ()) -> DataFrame:
    """Alarmed patches per source and threshold in long form (cluster table of the sweep)."""
    steps = patches.groupBy(*keys, source, threshold_steps("max_conf", grid).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    size = steps.groupBy(*keys, source).agg(F.sum("n").alias("size"))
    hits = survivors_per_threshold(steps, [*keys, source], "step", grid, ["n"]).withColumnRenamed("n", "hits")
    return hits.join(size, [*keys, source])


def control_sweep(patches: DataFrame, dets_flagged: DataFrame, grid: Sequence[float], patch: str = "patch_id") -> DataFrame:
    """Positive control: share of defect patches flagged at all, and flagged on the defect."""
    step = threshold_steps("conf", grid)
    per = dets_flagged.groupBy(patch).agg(F.max(step).alias("s_any"), F.max(F.when(F.col("is_tp"), step)).alias("s_tp"))
    p = patches.select(patch).join(per, patch, "left")
    z = F.lit(0)
    rows = F.array(
        F.struct(F.coalesce("s_any", z).alias("step"), F.lit(1).alias("flagged"), F.lit(0).alias("localised")),
        F.struct(F.coalesce("s_tp", z).alias("step"), F.lit(0).alias("flagged"), F.lit(1).alias("localised")),
    )
    hist = p.select(F.inline(rows)).groupBy("step").agg(F.sum("flagged").alias("flagged"), F.sum("localised").alias("localised"))
    n = patches.agg(F.count(F.lit(1)).alias("n_patches"))
    out = survivors_per_threshold(hist, [], "step", grid, ["flagged", "localised"]).join(F.broadcast(n))  # one row
    return out.withColumns({"flag_rate": ratio("flagged", "n_patches"), "localised_rate": ratio("localised", "n_patches")})


def cross_domain_sweep(tiles: DataFrame, boxes: DataFrame, grid: Sequence[float] = FINE_SWEEP) -> DataFrame:
    """Tile and frame rates on clean and defective tiles; label -1 is kept apart from both.

    ``tiles``: tile_id, source_id, label, max_conf. A frame counts when any of its tiles does.
    """
    step = threshold_steps("max_conf", grid)
    t = tiles.withColumn("step", step).groupBy("label", "source_id", "step").agg(F.count(F.lit(1)).alias("n"))
    per_tile = t.groupBy("label", "step").agg(F.sum("n").alias("tiles"))
    per_frame = t.groupBy("label", "source_id").agg(F.max("step").alias("step")).groupBy("label", "step").agg(F.count(F.lit(1)).alias("frames"))
    hist = per_tile.unionByName(per_frame, allowMissingColumns=True).fillna(0).groupBy("label", "step").agg(F.sum("tiles").alias("tiles"), F.sum("frames").alias("frames"))
    totals = hist.groupBy("label").agg(F.sum("tiles").alias("n_tiles"), F.sum("frames").alias("n_frames"))
    pts = survivors_per_threshold(hist, ["label"], "step", grid, ["tiles", "frames"]).join(totals, "label")
    pick = lambda lab, c: F.max(F.when(F.col("label") == lab, F.col(c)))
    out = pts.groupBy("threshold").agg(
        pick(0, "tiles").alias("clean_tiles_flagged"), pick(0, "n_tiles").alias("clean_tiles"),
        pick(0, "frames").alias("clean_frames_flagged"), pick(0, "n_frames").alias("clean_frames"),
        pick(1, "tiles").alias("defect_tiles_hit"), pick(1, "n_tiles").alias("defect_tiles"),
        pick(1, "frames").alias("defect_frames_hit"), pick(1, "n_frames").alias("defect_frames"),
        pick(-1, "tiles").alias("unlabelled_flagged"), pick(-1, "n_tiles").alias("unlabelled_tiles"),
    )
    clean_boxes = boxes.join(tiles.where(F.col("label") == 0).select("tile_id"), "tile_id", "left_semi")
    b = boxes_at(clean_boxes, [], grid)
    out = out.join(b, "threshold", "left").fillna(0, subset=["boxes"])
    return out.withColumns({
        "clean_tile_fa": ratio("clean_tiles_flagged", "clean_tiles", None), "clean_frame_fa": ratio("clean_frames_flagged", "clean_frames", None),
        "boxes_per_clean_tile": ratio("boxes", "clean_tiles", None), "defect_tile_recall": ratio("defect_tiles_hit", "defect_tiles", None),
        "defect_frame_recall": ratio("defect_frames_hit", "defect_frames", None), "unlabelled_flag_rate": ratio("unlabelled_flagged", "unlabelled_tiles", None),
    })


def false_positive_classes(tiles: DataFrame, boxes: DataFrame, grid: Sequence[float] = FINE_SWEEP) -> DataFrame:
    """Class histogram of boxes on clean tiles per threshold, with shares."""
    clean = boxes.join(tiles.where(F.col("label") == 0).select("tile_id"), "tile_id", "left_semi")
    by = boxes_at(clean, ["class_id"], grid).where(F.col("boxes") > 0)
    total = by.groupBy("threshold").agg(F.sum("boxes").alias("all_boxes"))
    return by.join(total, "threshold").withColumn("share", ratio("boxes", "all_boxes"))


def domain_sweep(frames: DataFrame, dets_flagged: DataFrame, grid: Sequence[float] = FINE_SWEEP) -> DataFrame:
    """Strict detection and lenient flag rates on labelled frames, pooled and per domain.

    ``frames``: frame_id, domain, labelled. Clean frames give the false-alarm rate of the same rows.
    """
    step = threshold_steps("conf", grid)
    per = dets_flagged.groupBy("frame_id").agg(F.max(step).alias("s_any"), F.max(F.when(F.col("is_tp"), step)).alias("s_tp"))
    z = F.lit(0)
    f = frames.join(per, "frame_id", "left").select("domain", "labelled", F.coalesce("s_any", z).alias("s_any"), F.coalesce("s_tp", z).alias("s_tp"))
    rows = F.array(
        F.struct(F.col("s_any").alias("step"), F.lit(1).alias("flagged"), F.lit(0).alias("detected")),
        F.struct(F.col("s_tp").alias("step"), F.lit(0).alias("flagged"), F.lit(1).alias("detected")),
    )
    h = f.select("domain", "labelled", F.inline(rows)).groupBy("domain", "labelled", "step").agg(F.sum("flagged").alias("flagged"), F.sum("detected").alias("detected"))
    pool = lambda d: d.groupingSets([["step"], ["domain", "step"]], "domain", "step").agg(F.sum("flagged").alias("flagged"), F.sum("detected").alias("detected")).withColumn("domain", F.coalesce("domain", F.lit("all")))
    lab = pool(h.where("labelled"))
    n_lab = lab.groupBy("domain").agg(F.sum("flagged").alias("n_labelled"))
    pts = survivors_per_threshold(lab, ["domain"], "step", grid, ["flagged", "detected"]).join(n_lab, "domain")
    clean = h.where(~F.col("labelled")).groupBy("step").agg(F.sum("flagged").alias("clean_flagged"))
    n_clean = clean.agg(F.sum("clean_flagged").alias("n_clean"))
    cl = survivors_per_threshold(clean, [], "step", grid, ["clean_flagged"]).join(F.broadcast(n_clean))  # one row
    clean_boxes = dets_flagged.join(frames.where(~F.col("labelled")).select("frame_id"), "frame_id", "left_semi")
    cl = cl.join(boxes_at(clean_boxes, [], grid), "threshold")
    return pts.join(cl, "threshold").withColumns({
        "detection_rate": ratio("detected", "n_labelled"), "flag_rate": ratio("flagged", "n_labelled"),
        "clean_false_alarm": ratio("clean_flagged", "n_clean"), "boxes_per_clean_frame": ratio("boxes", "n_clean"),
    })


def domain_operating_points(sweep: DataFrame, floor: float = MIN_DETECTION, miss_ratio: float = MISS_RATIO, prevalence: float = PREVALENCE) -> DataFrame:
    """Operating point per population and per detection definition (strict or lenient)."""
    long = sweep.select(
        "domain", "threshold", "clean_false_alarm",
        F.inline(F.array(
            F.struct(F.lit("detection_rate").alias("basis"), F.col("detection_rate").alias("d")),
            F.struct(F.lit("flag_rate").alias("basis"), F.col("flag_rate").alias("d")),
        )),
    )
    cost: Column = cost_with_prevalence("d", "clean_false_alarm", miss_ratio, prevalence)
    return recommend(long, ["domain", "basis"], cost, detection="d", floor=floor, f1_col=None)
