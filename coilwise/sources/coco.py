"""Annotation documents in the images / annotations / categories layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import corner_box_to_centre

SCHEMA = (
    "categories array<struct<id:int,name:string,supercategory:string>>, images array<struct<id:bigint,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>>>"
)


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of one or many documents, each row with its file."""
    doc = spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    part = lambda c: doc.select("file", F.inline(c))
    return part("images"), part("annotations"), part("categories")


def coco_boxes(images: DataFrame, annotations: DataFrame, categories: DataFrame, names: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """Normalised boxes; categories outside ``names`` (placeholders) are dropped, images without boxes stay.

    ``clipped`` and ``degenerate`` mark what happened to a box, so counters are plain sums.
    """
    on = list(on)
    ids = F.array(*[F.lit(n) for n in names])
    cat = categories.select(*on, F.col("id").alias("category_id"), (F.array_position(ids, F.col("name")) - 1).cast("int").alias("class_id")).where("class_id >= 0")
    img = images.select(*on, F.col("id").alias("image_id"), "width", "height")
    ann = annotations.withColumnRenamed("id", "annotation_id").join(cat, [*on, "category_id"])
    x, y, w, h = (F.get("bbox", F.lit(i)) for i in range(4))
    j = img.join(ann, [*on, "image_id"], "left")
    clipped = (x < 0) | (y < 0) | (x + w > F.col("width")) | (y + h > F.col("height"))
    box = corner_box_to_centre(x, y, w, h, F.col("width"), F.col("height"))
    has = F.col("annotation_id").isNotNull()
    return j.select(*on, "image_id", "annotation_id", "class_id", box.alias("box"), (has & clipped).alias("clipped"), (has & box.isNull()).alias("degenerate"))


def coco_counters(boxes: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return boxes.agg(
        F.count("annotation_id").alias("boxes"), n(F.col("clipped")).alias("clipped"), n(F.col("degenerate")).alias("degenerate"), n(F.col("annotation_id").isNull()).alias("images_without_boxes"))
