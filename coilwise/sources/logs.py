"""Training logs and stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """CSV log with padded header names trimmed; the run is the folder name."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = raw.select(*[F.col(f"`{c}`").alias(c.strip()) for c in raw.columns], F.col("_metadata.file_path").alias("file"))
    num = lambda c: F.col(f"`{c}`").cast("double")
    return named.select(
        F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("run"), F.col("epoch").cast("int").alias("epoch"), num("time").alias("time_s"),
        num("metrics/mAP50(B)").alias("map50"), num("metrics/mAP50-95(B)").alias("map50_95"))


def read_operating_points(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, conf_threshold double, iou_threshold double, source string, tuned_on_split string").json(path, multiLine=True)


def operating_conf(stored: Column | str = "conf_threshold", fallback: float = 0.15) -> Column:
    """Stored threshold, or the fallback when it is missing or outside (0, 1)."""
    c = F.col(stored) if isinstance(stored, str) else stored
    return F.when((c > 0) & (c < 1), c).otherwise(F.lit(float(fallback)))
