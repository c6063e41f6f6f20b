"""Sweeps, operating points, image-level reports, failure analysis and average precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.geometry import area, dbl
from ..functions.severity import class_name
from ..functions.stats import cost_per_image, cost_with_prevalence, effective_weight, f1, ratio
from ..session import reuse
from .matching import SMALL_GROUP, box_pairs, crowded_groups
from .scale import ranked_levels, survivors_per_threshold, threshold_steps, with_grid

# Threshold grids, cost ratios and limits used by existing reports.
SWEEP = tuple(round(0.05 * i, 2) for i in range(1, 20))
FINE_SWEEP = (
    0.01, 0.02, 0.03, 0.05, 0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.45,
    0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95,
)
MISS_RATIO = 12.0
RATIOS = (3.0, 6.0, 12.0, 25.0, 50.0)
CLEAN_RATIOS = (3.0, 10.0, 12.0, 30.0)
PREVALENCE = 0.05
MIN_DETECTION = 0.90
EXTENT_IOU = 0.10
IOU_GRID = (0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80, 0.85, 0.90, 0.95)


def _n(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def image_class(gts: DataFrame) -> DataFrame:
    """Majority class of a frame: by count, then boxed area, then lowest id; flags mixed frames."""
    per = gts.groupBy("frame_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.sum(area()).alias("a"))
    rank = F.struct("n", "a", (-F.col("class_id")).alias("c"))
    return per.groupBy("frame_id").agg(
        F.max_by("class_id", rank).alias("image_class"), (F.count(F.lit(1)) > 1).alias("is_multi_class")
    )


def dominant(dets: DataFrame, on: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Class of the most confident box per frame, with its confidence."""
    return dets.groupBy(*on).agg(
        F.max_by("class_id", F.struct(F.col("conf"), (-F.col("det_id")).alias("d"))).alias("pred_class"),
        F.max("conf").alias("max_conf"), F.count(F.lit(1)).alias("n_boxes"),
    )


# ---------------------------------------------------------------- confidence sweep

def sweep(
    frames: DataFrame, gts: DataFrame, dets: DataFrame, grid: Sequence[float] = SWEEP,
    keys: Sequence[str] = (), det_keys: Sequence[str] = (),
) -> DataFrame:
    """All operating statistics at each threshold from one matching pass.

    ``dets`` carry ``is_tp`` from matching at the loosest threshold: raising the threshold removes a
    suffix of the greedy walk and changes no earlier claim. Each box and frame is turned into the
    number of thresholds it reaches, counted, and only these short histograms are expanded.
    ``frames`` hold ``keys``; ``det_keys`` are the ones detections hold as well.
    """
    keys, on = list(keys), ["frame_id", *det_keys]
    step = threshold_steps("conf", grid)
    per_frame = dets.groupBy(*on).agg(
        F.max_by("class_id", F.struct(F.col("conf"), (-F.col("det_id")).alias("d"))).alias("pred_class"),
        F.max(step).alias("s_any"),
        F.max(F.when(F.col("is_tp"), step)).alias("s_tp"),
        F.max(F.when(~F.col("is_tp"), step)).alias("s_fp"),
    )
    cls = image_class(gts).select("frame_id", "image_class")
    f = frames.select("frame_id", *keys).join(per_frame, on, "left").join(cls, "frame_id", "left")
    zero = F.lit(0)
    right = F.coalesce(F.col("pred_class") == F.col("image_class"), F.lit(False))
    kinds = {
        "detected": F.coalesce("s_tp", zero), "false_alarm": F.coalesce("s_fp", zero),
        "flagged": F.coalesce("s_any", zero), "class_right": F.when(right, F.coalesce("s_any", zero)).otherwise(zero),
    }
    rows = F.array(*[
        F.struct(expr.alias("step"), *[F.lit(1 if k == kind else 0).alias(k) for k in kinds])
        for kind, expr in kinds.items()
    ])
    img_hist = f.select(*keys, F.inline(rows)).groupBy(*keys, "step").agg(*[F.sum(k).alias(k) for k in kinds])
    boxes = dets if set(keys) <= set(det_keys) else dets.join(frames.select(*on, *[k for k in keys if k not in det_keys]), on)
    box_hist = boxes.groupBy(*keys, step.alias("step")).agg(
        F.sum(_n(F.col("is_tp"))).alias("tp"), F.sum(_n(~F.col("is_tp"))).alias("fp")
    )
    counts = ["tp", "fp", *kinds]
    hist = img_hist.unionByName(box_hist, allowMissingColumns=True).fillna(0, subset=counts)
    hist = hist.groupBy(*keys, "step").agg(*[F.sum(c).alias(c) for c in counts])
    points = survivors_per_threshold(hist, keys, "step", grid, counts)
    n_images = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_images"))
    n_gt = frames.select("frame_id", *keys).join(gts.groupBy("frame_id").agg(F.count(F.lit(1)).alias("g")), "frame_id") \
        .groupBy(*keys).agg(F.sum("g").alias("n_labels"))
    if keys:
        points = points.join(n_images, keys, "left").join(n_gt, keys, "left")
    else:  # one row each
        points = points.join(F.broadcast(n_images)).join(F.broadcast(n_gt))
    points = points.withColumn("n_labels", F.coalesce("n_labels", F.lit(0))).withColumn("fn", F.col("n_labels") - F.col("tp"))
    points = points.withColumns({
        "precision": ratio("tp", F.col("tp") + F.col("fp")), "recall": ratio("tp", "n_labels"),
        "fp_per_image": ratio("fp", "n_images"), "false_alarm_rate": ratio("false_alarm", "n_images"),
        "detection_rate": ratio("detected", "n_images"), "class_accuracy": ratio("class_right", "n_images"),
        "flagged_rate": ratio("flagged", "n_images"),
    })
    return points.withColumn("f1", f1("precision", "recall"))


# ---------------------------------------------------------------- operating points

def recommend(
    points: DataFrame, keys: Sequence[str], cost: Column, detection: str = "detection_rate",
    floor: float = MIN_DETECTION, f1_col: str | None = "f1",
) -> DataFrame:
    """Cheapest threshold whose detection clears the floor; ties go to the higher threshold.

    Without any such threshold the floor is dropped and reported as not met. A key holds one row per
    threshold of the grid, so plain aggregates are enough.
    """
    p = points.withColumn("__cost", cost).withColumn("__ok", F.col(detection) >= dbl(floor))
    best = F.struct(_n(~F.col("__ok")).alias("a"), F.col("__cost").alias("b"), (-F.col("threshold")).alias("c"))
    picks = [
        F.min_by("threshold", best).alias("threshold"), F.min_by("__cost", best).alias("cost"),
        F.min_by(detection, best).alias("detection"), F.max(_n(F.col("__ok"))).alias("__any"),
        F.min("threshold").alias("__lo"), F.max("threshold").alias("__hi"),
        F.max(F.when(F.col("__ok"), F.col("threshold"))).alias("__last_ok"),
    ]
    if f1_col:
        picks.append(F.max_by("threshold", F.struct(F.col(f1_col), F.col("threshold").alias("t"))).alias("f1_threshold"))
    out = p.groupBy(*keys).agg(*picks)
    return out.withColumns({
        "floor_met": F.col("__any") == 1,
        "at_edge": (F.col("threshold") == F.col("__lo")) | (F.col("threshold") == F.col("__hi")),
        "floor_binding": F.coalesce(F.abs(F.col("threshold") - F.col("__last_ok")) < dbl(1e-9), F.lit(False)),
    }).drop("__any", "__lo", "__hi", "__last_ok")


def recommend_threshold(points: DataFrame, keys: Sequence[str] = (), ratio_: float = MISS_RATIO, floor: float = MIN_DETECTION) -> DataFrame:
    return recommend(points, keys, cost_per_image("detection_rate", "false_alarm_rate", ratio_), floor=floor)


def cost_sensitivity(
    points: DataFrame, keys: Sequence[str] = (), ratios: Sequence[float] = RATIOS, floor: float = MIN_DETECTION,
    prevalence: float | None = None, false_alarm: str = "false_alarm_rate",
) -> DataFrame:
    """The winning threshold per cost ratio, with and without the detection floor."""
    p = with_grid(points, "miss_ratio", ratios)
    if prevalence is None:
        cost = cost_per_image("detection_rate", false_alarm, F.col("miss_ratio"))
    else:
        cost = cost_with_prevalence("detection_rate", false_alarm, F.col("miss_ratio"), prevalence)
    group = [*keys, "miss_ratio"]
    free = recommend(p, group, cost, floor=-1.0, f1_col=None).select(
        *group, F.col("threshold").alias("free_threshold"), F.col("cost").alias("free_cost"),
        F.col("detection").alias("free_detection"), (F.col("detection") >= dbl(floor)).alias("free_meets_floor"),
    )
    held = recommend(p, group, cost, floor=floor, f1_col=None).select(
        *group, F.col("threshold").alias("held_threshold"), F.col("cost").alias("held_cost"),
        F.col("detection").alias("held_detection"), F.col("floor_met").alias("floor_reachable"),
    )
    out = free.join(held, group)
    if prevalence is not None:
        out = out.withColumn("effective_weight", effective_weight(F.col("miss_ratio"), prevalence))
    return out


# ---------------------------------------------------------------- image level

def image_predictions(frames: DataFrame, gts: DataFrame, dets: DataFrame, threshold: float) -> DataFrame:
    """True and predicted class per frame; -1 = no label, NULL prediction = nothing survived."""
    pred = dominant(dets.where(F.col("conf") >= threshold)).select("frame_id", "pred_class")
    return (
        frames.select("frame_id").join(image_class(gts), "frame_id", "left").join(pred, "frame_id", "left")
        .withColumn("image_class", F.coalesce("image_class", F.lit(-1)))
        .withColumn("is_multi_class", F.coalesce("is_multi_class", F.lit(False)))
    )


def confusion(preds: DataFrame, names: Sequence[str] = vocab.CLASSES) -> DataFrame:
    """Confusion counts in long form, with an explicit no-detection column."""
    return preds.where(F.col("image_class") >= 0).groupBy("image_class", "pred_class").agg(F.count(F.lit(1)).alias("n")).select(
        class_name("image_class", names).alias("true_class"),
        F.coalesce(class_name("pred_class", names), F.lit(vocab.NO_DETECTION)).alias("predicted_class"), "n",
    )


def class_report(preds: DataFrame, n_classes: int = len(vocab.CLASSES)) -> DataFrame:
    """Precision, recall, F1 and support per class; classes without frames stay with zeros."""
    lab = preds.where(F.col("image_class") >= 0).groupBy("image_class", "pred_class").agg(F.count(F.lit(1)).alias("n"))
    side = lambda col, name, cond=None: lab.where(cond if cond is not None else F.lit(True)).groupBy(F.col(col).alias("class_id")).agg(F.sum("n").alias(name))
    ids = preds.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_id"))
    out = (
        ids.join(side("image_class", "support"), "class_id", "left").join(side("pred_class", "predicted"), "class_id", "left")
        .join(side("image_class", "hit", F.col("image_class") == F.col("pred_class")), "class_id", "left").fillna(0)
    )
    out = out.withColumns({"precision": ratio("hit", "predicted"), "recall": ratio("hit", "support")})
    return out.withColumn("f1", f1("precision", "recall"))


def image_summary(preds: DataFrame, report: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1, and the frames kept out of the matrix."""
    lab = F.col("image_class") >= 0
    flat = preds.agg(
        F.sum(_n(lab)).alias("n_images"), F.sum(_n(~lab)).alias("background_images"),
        F.sum(_n(~lab & F.col("pred_class").isNotNull())).alias("background_flagged"),
        ratio(F.sum(_n(lab & F.coalesce(F.col("image_class") == F.col("pred_class"), F.lit(False)))), F.sum(_n(lab))).alias("accuracy"),
        F.sum(_n(lab & F.col("pred_class").isNull())).alias("no_detection_images"),
        F.sum(_n(F.col("is_multi_class"))).alias("multi_class_images"),
    )
    avg = report.agg(F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"))
    return flat.join(F.broadcast(avg))  # one row each


# ---------------------------------------------------------------- failures

def class_failures(frames: DataFrame, gts_found: DataFrame, dets_flagged: DataFrame, gts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-class instance counts, and on which true classes the false positives landed (long form)."""
    found = gts_found.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("instances"), F.sum(_n(F.col("found"))).alias("detected"), F.sum(_n(~F.col("found"))).alias("missed")
    )
    fps = dets_flagged.where(~F.col("is_tp"))
    fp = fps.groupBy("class_id").agg(F.count(F.lit(1)).alias("false_positives"))
    summary = found.join(fp, "class_id", "full").fillna(0)
    summary = summary.withColumn("recall", ratio("detected", "instances"))
    per_frame = fps.groupBy("frame_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    landed = (
        per_frame.join(image_class(gts).select("frame_id", "image_class"), "frame_id", "left")
        .groupBy("class_id", F.coalesce("image_class", F.lit(-1)).alias("landed_on")).agg(F.sum("n").alias("n"))
    )
    return summary, landed


def top_landed(landed: DataFrame, k: int = 3, keys: Sequence[str] = ("class_id",), item: str = "landed_on") -> DataFrame:
    """The k most frequent targets per class (count desc, then id)."""
    order = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(item).asc())
    return landed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_overlap(missed: DataFrame, dets: DataFrame, small_group: int = SMALL_GROUP) -> DataFrame:
    """Best-overlapping detection of any class for each unmatched label (IoU desc, then det_id).

    Only overlapping pairs can beat "nothing overlaps", so crowded frames use the grid join.
    """
    crowded = crowded_groups([missed.select("frame_id"), dets.select("frame_id")], ["frame_id"], small_group)
    hot = len(crowded.take(1)) > 0
    pairs = box_pairs(missed, dets, ["frame_id"], ["box_id", "class_id"], ["det_id", "class_id", "conf"], 1e-12, crowded if hot else None)
    best = F.struct(F.col("iou"), (-F.col("b_det_id")).alias("d"))
    top = pairs.groupBy("frame_id", F.col("a_box_id").alias("box_id")).agg(
        F.max("iou").alias("best_iou"), F.max_by("b_class_id", best).alias("best_class"), F.max_by("b_conf", best).alias("best_conf")
    )
    return missed.join(top, ["frame_id", "box_id"], "left").withColumn("best_iou", F.coalesce("best_iou", dbl(0)))


def miss_verdicts(missed: DataFrame, dets: DataFrame) -> DataFrame:
    """Why each label was missed: wrong class, wrong extent, or not seen at all."""
    b = best_overlap(missed, dets)
    return b.withColumn(
        "verdict",
        F.when((F.col("best_iou") >= 0.5) & (F.col("best_class") != F.col("class_id")), "class_confusion")
        .when(F.col("best_iou") >= EXTENT_IOU, "extent_error").otherwise("blind_miss"),
    )


def failure_taxonomy(gts_found: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Counts of each miss verdict per class, with recall."""
    base = gts_found.groupBy("class_id").agg(F.count(F.lit(1)).alias("instances"), F.sum(_n(F.col("found"))).alias("matched"))
    kinds = ("class_confusion", "extent_error", "blind_miss")
    v = verdicts.groupBy("class_id").agg(
        F.count(F.lit(1)).alias("missed"), *[F.sum(_n(F.col("verdict") == k)).alias(k) for k in kinds]
    )
    return base.join(v, "class_id", "left").fillna(0).withColumn("recall", ratio("matched", "instances"))


def confused_with(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("verdict") == "class_confusion").groupBy("class_id", "best_class").agg(F.count(F.lit(1)).alias("n"))


def error_gallery(gts_found: DataFrame, dets_flagged: DataFrame, k: int = 4) -> DataFrame:
    """Worst k misses and false positives per class, at most one per frame and kind."""
    own = dets_flagged.groupBy("frame_id", "class_id").agg(F.max("conf").alias("own"))
    miss = gts_found.where(~F.col("found")).groupBy("frame_id", "class_id").agg(F.min("box_id").alias("item_id")) \
        .join(own, ["frame_id", "class_id"], "left") \
        .select("class_id", "frame_id", "item_id", F.coalesce("own", dbl(0)).alias("score"), F.lit("miss").alias("kind"))
    best = F.struct(F.col("conf"), (-F.col("det_id")).alias("d"))
    fp = dets_flagged.where(~F.col("is_tp")).groupBy("frame_id", "class_id").agg(
        F.max_by("det_id", best).alias("item_id"), F.max("conf").alias("score")
    ).select("class_id", "frame_id", "item_id", "score", F.lit("false_positive").alias("kind"))
    sign = F.when(F.col("kind") == "miss", F.col("score")).otherwise(-F.col("score"))
    order = Window.partitionBy("kind", "class_id").orderBy(sign.asc(), F.col("frame_id").asc())
    return miss.unionByName(fp).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def label_geometry(frames: DataFrame, gts: DataFrame) -> DataFrame:
    """Per class: mean area fraction, mean sibling IoU of the frame, boxes per frame.

    Sibling IoU needs overlapping pairs only; the mean divides by all n(n-1) ordered pairs, so a
    crowded frame goes through the grid join and no full pair list is built.
    """
    sized = gts.join(frames.select("frame_id", "width", "height"), "frame_id")
    clip = lambda c, lo, hi: F.greatest(dbl(lo), F.least(hi, F.bround(F.col(c), 0)))
    w, h = dbl("width"), dbl("height")
    cw = clip("x2", 1, w) - clip("x1", 0, w - 1)
    ch = clip("y2", 1, h) - clip("y1", 0, h - 1)
    rows = sized.withColumn("frac", cw * ch / (w * h)).withColumn("__ok", (cw > 0) & (ch > 0))
    crowded = crowded_groups([gts.select("frame_id")], ["frame_id"], SMALL_GROUP)
    hot = len(crowded.take(1)) > 0
    pairs = box_pairs(gts, gts, ["frame_id"], ["box_id"], ["box_id"], 1e-12, crowded if hot else None)
    over = pairs.where(F.col("a_box_id") != F.col("b_box_id")).groupBy("frame_id").agg(F.sum("iou").alias("iou_sum"))
    n = gts.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    sib = n.join(over, "frame_id", "left").select(
        "frame_id", "n", F.when(F.col("n") > 1, F.coalesce("iou_sum", dbl(0)) / (F.col("n") * (F.col("n") - 1))).otherwise(dbl(0)).alias("sib")
    )
    per = rows.where("__ok").groupBy("frame_id", "class_id").agg(F.sum("frac").alias("frac"), F.count(F.lit(1)).alias("k"))
    return per.join(sib, "frame_id").groupBy("class_id").agg(
        F.sum("k").alias("n_boxes"), (F.sum("frac") / F.sum("k")).alias("box_area_frac"),
        (F.sum(F.col("sib") * F.col("k")) / F.sum("k")).alias("mean_sibling_iou"),
        (F.sum(F.col("n") * F.col("k")) / F.sum("k")).alias("boxes_per_image"),
    )


def agreement(gts: DataFrame, matches_a: DataFrame, matches_b: DataFrame, keys: Sequence[str] = ("class_id",)) -> DataFrame:
    """Labels found by both models, one, or neither, with single and union recall."""
    on = ["frame_id", "class_id", "box_id"]
    a = matches_a.select(*on).withColumn("a", F.lit(1))
    b = matches_b.select(*on).withColumn("b", F.lit(1))
    g = gts.join(a, on, "left").join(b, on, "left").fillna(0, subset=["a", "b"])
    n = F.count(F.lit(1))
    out = g.groupBy(*keys).agg(
        n.alias("labels"), F.sum(F.col("a") * F.col("b")).alias("both"), F.sum(F.col("a") * (1 - F.col("b"))).alias("a_only"),
        F.sum((1 - F.col("a")) * F.col("b")).alias("b_only"), F.sum((1 - F.col("a")) * (1 - F.col("b"))).alias("neither"),
    )
    return out.withColumns({
        "recall_a": ratio(F.col("both") + F.col("a_only"), "labels"), "recall_b": ratio(F.col("both") + F.col("b_only"), "labels"),
        "recall_union": ratio(F.col("labels") - F.col("neither"), "labels"),
    })


# ---------------------------------------------------------------- average precision

def average_precision(
    flagged: DataFrame, n_labels: DataFrame, keys: Sequence[str] = ("class_id",), score: str = "conf",
    ties: Sequence[str] = ("frame_id", "det_id"), weight: str | None = None, points: int = 101,
) -> DataFrame:
    """Interpolated AP per key (``points`` recall levels, precision envelope, linear interpolation).

    ``flagged``: keys, score, ties, is_tp. ``n_labels``: keys, n_labels. Positions come from one sort in ranges
    of the whole order, so a class with most of the data is spread over tasks.
    """
    rows = flagged.withColumn("__h", _n(F.col("is_tp")))
    if weight:
        rows = rows.withColumn("__w", F.array(F.col(weight).cast("int")))
    return lane_precision(rows, n_labels, keys, score, ties, "__h", 1, "__w" if weight else None, points).drop("lane")


def lane_precision(
    rows: DataFrame, n_labels: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str],
    hits: str, lanes: int, weights: str | None = None, points: int = 101,
) -> DataFrame:
    """AP per key and lane (``scale.ranked_levels``) from one ranking; ``n_labels`` has a lane or counts for all.

    Only true positives carry curve information: at the k-th one the recall is k/n and the precision k/position.
    The recall grid reads the levels k and k + 1 of each point alone. Levels are dealt to ``points`` bins of k, so
    the envelope of a level is the largest precision of the later bins and of the later levels of its own.
    """
    on = [*keys, "lane"]
    levels, sizes = ranked_levels(rows, keys, score, ties, hits, lanes, weights)
    if weights:  # a repeated frame counts its boxes several times, one curve level each
        levels = levels.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") - 1)))
        levels = levels.withColumns({"k": F.col("k") - F.col("__c"), "rank": F.col("rank") - F.col("__c")})
    if "lane" not in n_labels.columns:
        n_labels = n_labels.withColumn("lane", F.explode(F.array(*[F.lit(i) for i in range(lanes)])))
    base = n_labels.select(*on, "n_labels").join(sizes.withColumnRenamed("n_rows", "n_dets"), on, "left").fillna(0, subset=["n_dets", "n_hits"])
    g = base.where(F.col("n_labels") > 0).withColumn("__x", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * (dbl(1) / (points - 1)))))
    n, x = F.col("n_labels"), F.col("__x")
    k0 = F.floor(x * n)
    up, down = (k0 + 1) / n <= x, k0 / n > x
    g = g.withColumn("__k", F.least(F.when(up, k0 + 1).when(down, k0 - 1).otherwise(k0), F.col("n_hits")))
    bin_ = F.floor(F.col("k") * points / n).cast("bigint").alias("__bin")
    want = g.select(*on, "n_labels", F.explode(F.array(F.col("__k"), F.col("__k") + 1)).alias("k")).distinct().select(*on, bin_, F.col("k").alias("__at"))
    placed = levels.join(base.where(F.col("n_labels") > 0).select(*on, "n_labels"), on).select(*on, "k", "rank", bin_, (F.col("k") / F.col("rank")).alias("p"))
    own = placed.join(want, [*on, "__bin"]).where(F.col("k") >= F.col("__at")).groupBy(*on, "__bin", "__at").agg(
        F.max("p").alias("__own"), F.max(F.when(F.col("k") == F.col("__at"), F.col("rank"))).alias("rank"))
    later = Window.partitionBy(*on).orderBy(F.col("__bin").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per bin
    after = placed.groupBy(*on, "__bin").agg(F.max("p").alias("p")).withColumn("__after", F.max("p").over(later)).drop("p")
    env = own.join(after, [*on, "__bin"]).select(*on, F.col("__at").alias("k"), "rank", F.greatest("__own", "__after").alias("env"))
    # the level of a grid point and the one after it, found in one join
    near = g.select(*on, "__x", "__k", F.explode(F.array(F.col("__k"), F.col("__k") + 1)).alias("k")).join(env, [*on, "k"]).groupBy(*on, "__x").agg(
        F.max(F.when(F.col("k") > F.col("__k"), F.col("rank"))).alias("r_next"), F.max(F.when(F.col("k") > F.col("__k"), F.col("env"))).alias("e_next"))
    g = g.join(near, [*on, "__x"], "left")
    k = F.col("__k")
    at_k = F.greatest(k / (F.col("r_next") - 1), F.col("e_next"))  # last row of level k
    inside = at_k + (F.col("e_next") - at_k) / ((k + 1) / n - k / n) * (x - k / n)
    last = F.when(x == k / n, k / F.col("n_dets")).otherwise(dbl(0))
    value = F.when(k == 0, F.coalesce("e_next", dbl(0))).when(F.col("r_next").isNull(), last).otherwise(inside)
    ap = g.withColumn("__v", value).groupBy(*on).agg(F.avg("__v").alias("ap"))
    return base.join(ap, on, "left").select(*on, "n_labels", "n_dets", "n_hits", "ap")


def max_f1_point(flagged: DataFrame, n_labels: DataFrame, keys: Sequence[str] = ("class_id",), score: str = "conf", ties: Sequence[str] = ("frame_id", "det_id")) -> DataFrame:
    """Precision and recall at the best F1 along the ranked list of each key."""
    keys = list(keys)
    pos, _ = ranked_levels(flagged.withColumn("__h", _n(F.col("is_tp"))), keys, score, ties, "__h")
    g = pos.join(n_labels.select(*keys, "n_labels"), keys).withColumn("f1", 2 * F.col("k") / (F.col("rank") + F.col("n_labels")))
    best = F.struct("f1", (-F.col("rank")).alias("r"))
    return g.groupBy(*keys).agg(
        F.max("f1").alias("f1"), F.max_by(F.col("k") / F.col("rank"), best).alias("precision"), F.max_by(F.col("k") / F.col("n_labels"), best).alias("recall")
    )


def mean_ap(per_class: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the classes that have labels."""
    return per_class.groupBy(*keys).agg(F.avg("ap").alias("mean_ap"), F.count("ap").alias("classes"))
