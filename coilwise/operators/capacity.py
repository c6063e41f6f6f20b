"""Timing folds, line capacity, training logs and model selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import dbl
from ..functions.severity import fps
from ..functions.stats import ratio
from .scale import exact_quantiles, running
from .tiling import sliding_origins

# Planning assumptions of the line study.
LINE = {
    "strip_width_m": 1.28, "mm_per_px": 0.20, "sensor_px": 2048, "overlap_across": 0.08, "overlap_along": 0.15,
    "tile_overlap": 0.20, "utilisation": 0.70, "latency_ms": 200.0, "accuracy_tolerance": 0.95,
}
SPEEDS = {
    "Bright annealing line": 45.0, "Hot-band anneal and pickle line": 90.0, "Skin-pass / inspection line": 250.0,
    "20-hi reversing cold mill": 420.0, "Continuous pickling line exit": 500.0, "Hot strip mill finishing exit": 900.0,
    "Tandem cold mill exit, thin gauge": 1500.0,
}
CELL = ("model", "device", "imgsz", "batch")


def fold_repeats(timings: DataFrame, cell: Sequence[str] = CELL, ms: str = "per_frame_ms") -> DataFrame:
    """Lower-median healthy run per cell with the spread; cells without a healthy run stay."""
    cell = list(cell)
    every = timings.groupBy(*cell).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("ok").cast("int")).alias("passes"))
    counts = timings.where("ok").groupBy(*cell, ms).agg(F.count(F.lit(1)).alias("n"))
    cum = running(counts, cell, [ms], {"c": ("n", "sum")})
    mid = cum.groupBy(*cell).agg(
        F.min(F.when(F.col("c") > F.floor((F.col("c_total") - 1) / 2), F.col(ms))).alias("median_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms")
    )
    return every.join(mid, cell, "left").withColumn("spread_ratio", ratio("max_ms", "min_ms"))


def peak_per_size(folded: DataFrame, keys: Sequence[str] = ("device", "model", "imgsz"), utilisation: float = LINE["utilisation"]) -> DataFrame:
    """Fastest batch size per input size, derated, with the rate of the slowest pass."""
    f = folded.where(F.col("median_ms").isNotNull()).withColumns({"fps": fps("median_ms"), "fps_slow": fps("max_ms")})
    best = F.struct("fps", (-F.col("batch")).alias("b"))
    return f.groupBy(*keys).agg(
        F.max("fps").alias("measured_fps"), F.max_by("batch", best).alias("at_batch"), F.max_by("median_ms", best).alias("per_frame_ms"),
        F.max_by("fps_slow", best).alias("slowest_fps"),
    ).withColumns({"sustainable_fps": F.col("measured_fps") * dbl(utilisation), "sustainable_fps_slow": F.col("slowest_fps") * dbl(utilisation)})


def tiles_per_frame(sensor_px, tile_px, overlap) -> Column:
    n = F.size(sliding_origins(sensor_px, F.greatest(F.lit(1), tile_px), overlap))
    return n * n


def line_geometry(line: dict = LINE) -> dict[str, Column]:
    fov = dbl(line["sensor_px"]) * dbl(line["mm_per_px"]) / 1000
    across = fov * (1 - dbl(line["overlap_across"]))
    cameras = F.greatest(dbl(1), F.ceil(dbl(line["strip_width_m"]) / across).cast("double"))
    return {"fov_m": fov, "cameras": cameras, "advance_m": fov * (1 - dbl(line["overlap_along"]))}


def capacity_plan(peaks: DataFrame, line: dict = LINE, speeds: dict[str, float] = SPEEDS) -> DataFrame:
    """Accelerators and latency per line speed and input size, tiled and downscaled."""
    lines = F.array(*[F.struct(F.lit(n).alias("line"), dbl(v).alias("speed_m_per_min")) for n, v in speeds.items()])
    p = peaks.select("*", F.inline(lines)).withColumns(line_geometry(line))
    p = p.withColumn("tiles", tiles_per_frame(F.lit(line["sensor_px"]), F.col("imgsz"), line["tile_overlap"]))
    # rates are rounded before they are divided, as in the published plan
    raw = F.col("speed_m_per_min") / 60 / F.col("advance_m")
    p = p.withColumns({
        "fps_per_camera": F.round(raw, 2), "inferences_tiled": F.round(raw * F.col("cameras") * F.col("tiles"), 1),
        "inferences_downscaled": F.round(raw * F.col("cameras"), 2), "per_stream_tiled": F.round(raw * F.col("tiles"), 2),
    })
    rate, slow = F.col("sustainable_fps"), F.col("sustainable_fps_slow")
    p = p.withColumns({
        "streams_tiled": F.floor(rate / F.col("per_stream_tiled")).cast("bigint"), "streams_downscaled": F.floor(rate / F.col("fps_per_camera")).cast("bigint"),
        "accelerators_tiled": F.ceil(F.col("inferences_tiled") / rate).cast("bigint"), "accelerators_downscaled": F.ceil(F.col("inferences_downscaled") / rate).cast("bigint"),
        "accelerators_tiled_slow": F.ceil(F.col("inferences_tiled") / slow).cast("bigint"),
        "travel_m": F.round(F.round(F.col("speed_m_per_min") / 60, 3) * dbl(line["latency_ms"]) / 1000, 3),
    })
    fill = 1000 * F.col("at_batch") / (F.col("inferences_tiled") / F.col("accelerators_tiled"))
    return p.withColumns({
        "batch_fill_ms": F.when(F.col("at_batch") > 1, fill),
        "meets_latency": F.when(F.col("at_batch") > 1, fill + F.col("per_frame_ms") * F.col("at_batch") <= dbl(line["latency_ms"])),
    })


def accuracy_by_size(results: DataFrame, split: str) -> DataFrame:
    """Stored accuracy per model and input size; augmented and malformed rows are skipped."""
    ok = (F.col("split") == split) & ~F.coalesce("augment", F.lit(False)) & F.col("imgsz").isNotNull() & F.col("map50").isNotNull()
    return results.where(ok).groupBy("model", "imgsz").agg(F.avg("map50").alias("map50"))


def cheapest_accurate_size(peaks: DataFrame, accuracy: DataFrame, line: dict = LINE) -> DataFrame:
    """Per device and model: sizes close to the best validation accuracy, then the fewest tiles per fps.

    A model has a handful of input sizes; plain aggregates decide.
    """
    best = accuracy.groupBy("model").agg(F.max("map50").alias("best_map50"))
    p = peaks.join(accuracy, ["model", "imgsz"], "left").join(best, "model", "left")
    p = p.withColumn("cost", tiles_per_frame(F.lit(line["sensor_px"]), F.col("imgsz"), line["tile_overlap"]) / F.col("sustainable_fps"))
    usable = F.coalesce("map50", dbl(0)) >= dbl(line["accuracy_tolerance"]) * F.coalesce("best_map50", dbl(0))
    rank = F.struct((~usable).cast("int").alias("u"), "cost", "imgsz")
    return p.groupBy("device", "model").agg(
        F.min_by("imgsz", rank).alias("imgsz"), F.min_by("cost", rank).alias("cost"), F.min_by("map50", rank).alias("map50"), F.max("best_map50").alias("best_map50")
    )


def select_then_report(results: DataFrame, tune: str = "val", report: str = "test") -> DataFrame:
    """Choose each model's input size on one split and read its accuracy on another."""
    if tune == report:
        raise ValueError("the tuning split must differ from the reporting split")
    val, test = accuracy_by_size(results, tune), accuracy_by_size(results, report).withColumnRenamed("map50", "report_map50")
    own = F.struct("map50", (-F.col("imgsz")).alias("s"))
    best = val.groupBy("model").agg(F.max_by("imgsz", own).alias("imgsz"), F.max("map50").alias("tune_map50"))
    top = best.agg(F.max_by("model", F.struct("tune_map50", "model")).alias("__top"))
    out = best.join(test, ["model", "imgsz"], "left").join(F.broadcast(top))  # one row
    return out.withColumn("chosen", F.col("model") == F.col("__top")).drop("__top")


def training_history(log: DataFrame) -> DataFrame:
    """Per run: best epoch, epoch cost, stalls and totals from cumulative wall time.

    The previous epoch comes from an equi-join on epoch - 1, which spreads a long run over tasks.
    """
    prev = log.select("run", (F.col("epoch") + 1).alias("epoch"), F.col("time_s").alias("before"))
    e = log.join(prev, ["run", "epoch"], "left").withColumn("cost", F.col("time_s") - F.coalesce("before", dbl(0)))
    e = e.withColumn("fitness", dbl(0.1) * F.col("map50") + dbl(0.9) * F.col("map50_95"))
    med = exact_quantiles(e, ["run"], "cost", {"median_epoch_s": 0.5})
    first_best = F.struct("fitness", (-F.col("epoch")).alias("e"))
    out = e.join(med, "run").groupBy("run").agg(
        F.count(F.lit(1)).alias("epochs"), F.max_by("epoch", first_best).alias("best_epoch"), F.max_by("map50", first_best).alias("best_map50"),
        F.max_by("map50_95", first_best).alias("best_map50_95"), F.max("time_s").alias("wall_s"), F.first("median_epoch_s").alias("median_epoch_s"),
        F.sum((F.col("cost") > 3 * F.col("median_epoch_s")).cast("int")).alias("stalled_epochs"),
        F.sum(F.when(F.col("cost") > 3 * F.col("median_epoch_s"), F.col("cost")).otherwise(0)).alias("stall_s"),
        F.max_by(F.col("map50") - F.col("map50_95"), "epoch").alias("final_gap"),
    )
    return out.withColumn("mean_epoch_s", F.col("wall_s") / F.greatest(F.lit(1), F.col("epochs")))
