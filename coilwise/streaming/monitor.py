"""Live line monitoring: running rate, windowed alerts and coil close.

Each transformation works on a streaming and on a finished table alike, so a stream is checked by
replaying a table and comparing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.coil import DispositionRules


def _bad():
    return F.sum(F.when(F.col("verdict") == "DEFECT", 1).otherwise(0))


def running_rate(events: DataFrame) -> DataFrame:
    """Frames, rejects and rate so far per line; the state is one row per line."""
    n = F.count(F.lit(1))
    return events.groupBy("line_id").agg(n.alias("frames"), _bad().alias("defects"), (100 * _bad() / n).alias("running_rate"), F.max("seq").alias("last_seq"))


def window_monitor(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", alert_rate: float = DispositionRules.hold_min_defect_rate) -> DataFrame:
    """Defect rate and latency per line and event-time window, with an alert flag.

    Rows later than the watermark are dropped. The quantile holds the values of one line in one
    window, which the frame rate bounds.
    """
    n = F.count(F.lit(1))
    rate = _bad() / n
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (
        events.withWatermark("ts", delay).groupBy(w.alias("w"), "line_id")
        .agg(n.alias("frames"), _bad().alias("defects"), rate.alias("defect_rate"), F.percentile("total_ms", 0.95).alias("p95_ms"), (rate > alert_rate).alias("alert"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "line_id", "frames", "defects", "defect_rate", "p95_ms", "alert")
    )


RANK_ERROR = 0.0133  # normalised rank error of a KLL sketch of k = 200, at 99 percent confidence


def window_latency(events: DataFrame, window: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", share: float = 0.95) -> DataFrame:
    """Latency quantile per line and event-time window from a mergeable KLL sketch.

    The state is a sketch of a few kilobytes, however many frames a window holds. The value's rank is within
    RANK_ERROR of ``share``. ``sketch`` may be merged over lines or windows (``kll_merge_agg_double``).
    """
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    g = events.withWatermark("ts", delay).groupBy(w.alias("w"), "line_id").agg(F.count("total_ms").alias("frames"), F.expr("kll_sketch_agg_double(total_ms, 200)").alias("sketch"))
    return g.select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "line_id", "frames",
        F.expr(f"kll_sketch_get_quantile_double(sketch, {share}D)").alias("quantile_ms"), "sketch")


def coil_sessions(events: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """A coil closes when its line is silent for the gap; counts and a verdict per closed coil."""
    n = F.count(F.lit(1))
    rate = _bad() / n
    r = DispositionRules()
    verdict = F.when(rate > r.hold_min_defect_rate, "HOLD").when(rate > r.accept_max_defect_rate, "DOWNGRADE").otherwise("ACCEPT")
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), "line_id")
        .agg(n.alias("frames"), _bad().alias("defects"), rate.alias("defect_rate"), F.avg("total_ms").alias("mean_ms"), verdict.alias("disposition"))
        .select(F.col("s.start").alias("opened"), F.col("s.end").alias("closed"), "line_id", "frames", "defects", "defect_rate", "mean_ms", "disposition")
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stream of the raw event table as frame events."""
    raw = spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double").parquet(path)
    return raw.select(
        "ts", F.col("user_id").alias("line_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "DEFECT").otherwise("PASS").alias("verdict"), F.col("value").alias("total_ms"))


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and write parquet; a complete-mode result replaces the last one."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        q = w.format("parquet").option("path", out).start()
    else:
        q = w.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start()
    q.awaitTermination()


def upsert_closed_coils(stream: DataFrame, read_table: Callable[[], DataFrame | None], write_table: Callable[[DataFrame], None], checkpoint: str):
    """Publish closed coils: each micro-batch replaces the rows of its coils in the stored table."""
    from ..sources.sinks import upsert_by_tag

    def publish(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("tag", F.concat_ws("@", "line_id", "opened")).withColumn("generated_at", F.col("closed").cast("string"))
        old = read_table()
        write_table(new if old is None else upsert_by_tag(old, new))

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(availableNow=True).start()
