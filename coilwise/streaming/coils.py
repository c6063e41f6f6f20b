"""Coil close in full: a coil's frames are summed in a session window until its line falls silent, then judged.

The state of an open coil is one row of sums and a histogram of severities (the buffer of ``percentile``), never
its frames. The window ends ``gap`` after the newest frame; when the watermark passes that, the coil's statistics
leave the stream and its state is cleared. All of it is one streaming aggregate, so no coil costs a call to
Python. The statistics have the columns of ``operators.coil.coil_stats``, so the rule of the finished tables,
with all its limits and reasons, judges streamed coils as well.

Defined cases: a frame that arrives again (same coil and frame id) counts once; frames older than the
watermark are dropped, so they neither change a closed coil nor open it again; a coil that runs again after
a silence of ``gap`` is a row of its own, told apart by ``opened``, wherever the batches are cut; a batch that
is written again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.severity import fps
from ..operators.coil import DispositionRules, disposition

BANDS = ("clean", *vocab.BANDS)
FRAME = "coil_id bigint, frame_id bigint, ts timestamp, verdict string, defect_count bigint, severity_score double, severity_band string, has_flag_class int, total_ms double"
SHARE = 0.95


def close_coils(frames: DataFrame, gap_ms: int = 30 * 60_000, delay: str = "10 minutes", rules: DispositionRules = DispositionRules()) -> DataFrame:
    """Statistics, disposition and reasons of every coil of a stream of judged frames (columns of FRAME), once it is closed.

    State in RocksDB (``state_in_rocksdb``) keeps open coils out of the executors' heap.
    """
    once = frames.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["coil_id", "frame_id"])
    total, mean_ms = F.count(F.lit(1)), F.avg("total_ms")
    bad, boxes = F.count_if(F.col("verdict") == "DEFECT"), F.sum("defect_count")
    closed = once.groupBy("coil_id", F.session_window("ts", f"{gap_ms} milliseconds")).agg(
        F.min("ts").alias("opened"), F.max("ts").alias("closed"), total.alias("total_frames"), bad.alias("defect_frames"),
        (total - bad).alias("clean_frames"), (bad / total).alias("defect_rate"), boxes.alias("total_detections"),
        (boxes / total).alias("detections_per_frame"), *[F.count_if(F.col("severity_band") == b).alias(f"frames_{b}") for b in BANDS],
        F.avg("severity_score").alias("mean_severity"), F.max("severity_score").alias("max_severity"),
        F.sum("has_flag_class").alias("flag_class_frames"), mean_ms.alias("mean_latency_ms"), fps(mean_ms).alias("throughput_fps"),
        F.percentile("severity_score", SHARE).alias("p95_severity"),
    )
    return disposition(closed.drop("session_window"), rules)


def state_in_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FRAME).parquet(path)


def publish(closed: DataFrame, table: str, checkpoint: str) -> None:
    """Process what is there and publish closed coils: batch ``i`` owns the folder ``batch_id=i``.

    Nothing written before is read or moved, and writing a batch again gives the same table.
    """
    def write(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch_id={i}")

    closed.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def published(spark: SparkSession, table: str) -> DataFrame:
    """The newest row of every run of a coil (coil_id, opened)."""
    rows = spark.read.parquet(table)
    rest = [c for c in rows.columns if c not in ("coil_id", "opened", "batch_id")]
    newest = rows.groupBy("coil_id", "opened").agg(F.max_by(F.struct(*rest), "batch_id").alias("newest"))
    return newest.select("coil_id", "opened", "newest.*")
