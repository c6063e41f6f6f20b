"""Label text: reading, writing and round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import centre_to_corner, dbl
from ..operators.scale import running

LINES_PER_CHUNK = 1000  # lines in one text value; a longer file is a few ordered chunks


def label_lines(boxes: DataFrame, frames: DataFrame, offset: int = 0) -> DataFrame:
    """One ``cls cx cy w h`` line per box with six decimals."""
    j = boxes.join(frames.select("frame_id", "width", "height"), "frame_id")
    w, h = dbl("width"), dbl("height")
    line = F.format_string(
        "%d %.6f %.6f %.6f %.6f", (F.col("class_id") + offset).cast("int"), (F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h,
        (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h,
    )
    return j.select("frame_id", "box_id", line.alias("line"))


def label_texts(lines: DataFrame, frames: DataFrame, per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Label files as text; background frames get an empty text.

    Lines are numbered with bucketed running counts and joined in chunks of bounded length, so a frame
    with very many boxes is several rows (frame_id, chunk) rather than one value.
    """
    n = running(lines.withColumn("__one", F.lit(1)), ["frame_id"], ["box_id"], {"__r": ("__one", "sum")})
    n = n.withColumn("chunk", F.floor((F.col("__r") - 1) / per_chunk).cast("int"))
    parts = n.groupBy("frame_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("__r", "line"))).alias("__l"))
    text = F.concat(F.array_join(F.transform("__l", lambda r: r["line"]), "\n"), F.lit("\n"))
    texts = parts.select("frame_id", "chunk", text.alias("text"))
    out = frames.select("frame_id").join(texts, "frame_id", "left")
    return out.select("frame_id", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("text", F.lit("")).alias("text"))


def parse_label_lines(lines: DataFrame, frames: DataFrame, n_classes: int = 6, strict_fields: int | None = None) -> DataFrame:
    """Lines back to pixel boxes. Short lines are skipped; a class outside the range fails the job."""
    parts = F.split(F.trim("line"), r"\s+")
    p = lines.withColumn("__p", parts)
    p = p.where(F.size("__p") == strict_fields if strict_fields else F.size("__p") >= 5)
    num = lambda i: F.get("__p", F.lit(i)).cast("double")
    cid = num(0).cast("int")
    checked = F.when((cid >= 0) & (cid < n_classes), cid).otherwise(
        F.raise_error(F.concat(F.lit("label class out of range: "), F.col("line"))).cast("int"))
    j = p.join(frames.select("frame_id", "width", "height"), "frame_id")
    j = j.withColumns({"class_id": checked, "cx": num(1), "cy": num(2), "bw": num(3), "bh": num(4)})
    j = j.withColumns(centre_to_corner("cx", "cy", "bw", "bh", "width", "height"))
    return j.select("frame_id", "class_id", "x1", "y1", "x2", "y2")


def read_label_files(spark: SparkSession, path: str) -> DataFrame:
    """Label lines with split and stem taken from ``<split>/labels/<stem>.txt``."""
    raw = spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return raw.select(
        "line", F.regexp_extract("file", r"([^/]+)\.txt$", 1).alias("stem"), F.regexp_extract("file", r"([^/]+)/labels/[^/]+$", 1).alias("split"))
