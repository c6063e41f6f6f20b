"""Inspection tables derived from the order/lineitem star schema used for testing.

Every view is a projection of whole input tables; nothing is sampled or cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import split_by_hash
from ..functions.geometry import dbl
from ..operators.scale import running
from ..session import by_frame

SPLIT_CUTS = {"train": 0.8, "val": 0.9, "test": 1.0}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pct(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("int")


def _base(spark: SparkSession, d: str) -> DataFrame:
    """Distinct line rows as integers; (orderkey, linenumber) alone is not unique.

    Rows are dealt by frame, once (``by_frame``): all that is done per frame or per frame and class afterwards stays in
    its task.
    """
    rows = read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").cast("bigint").alias("ln"),
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").cast("bigint").alias("q"), _pct("l_discount").alias("d"), _pct("l_tax").alias("tx"),
        F.col("l_returnflag").alias("rf"), F.col("l_linestatus").alias("ls"),
    )
    return by_frame(rows).distinct()


def _geometry(df: DataFrame) -> DataFrame:
    gx = (F.col("pk") * 7 + F.col("ln") * 31) % 140
    gy = (F.col("sk") * 13 + F.col("q") * 5) % 140
    return df.select(
        "*",
        (F.col("pk") * 1000000 + F.col("sk") * 1000 + F.col("ln") * 100 + F.col("q")).alias("id"),
        gx.alias("gx"), gy.alias("gy"),
        (F.col("q") + 12).alias("w"), (F.col("pk") % 40 + 12).alias("h"),
        (F.col("pk") % 6).cast("int").alias("cls"),
    )


def gt_boxes(spark: SparkSession, d: str) -> DataFrame:
    rows = _geometry(_base(spark, d).where((F.col("rf") != "N") & (F.col("frame_id") % 4 != 0)))
    return rows.select(
        "frame_id", F.col("id").alias("box_id"), F.col("cls").alias("class_id"),
        dbl("gx").alias("x1"), dbl("gy").alias("y1"),
        (F.col("gx") + F.col("w")).cast("double").alias("x2"),
        (F.col("gy") + F.col("h")).cast("double").alias("y2"),
    )


def detections(spark: SparkSession, d: str, model: str = "A") -> DataFrame:
    mult, flag = (37, "F") if model == "A" else (41, "O")
    rows = _geometry(_base(spark, d).where(~((F.col("ls") == flag) & (F.col("tx") == 0))))
    level = (
        F.col("pk") * mult + F.col("sk") * 11 + F.col("q") * 3 + F.when(F.col("rf") == "N", 0).otherwise(400)
    ) % 960
    x1, y1 = F.col("gx") + F.col("d"), F.col("gy") + F.col("tx")
    return rows.select(
        F.lit(model).alias("model"), "frame_id", F.col("id").alias("det_id"),
        F.when(F.col("d") == 10, (F.col("cls") + 1) % 6).otherwise(F.col("cls")).cast("int").alias("class_id"),
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + F.col("w")).cast("double").alias("x2"), (y1 + F.col("h")).cast("double").alias("y2"),
        ((level + 20) / dbl(1000)).alias("conf"),
    )


def frames(spark: SparkSession, d: str, with_seq: bool = False) -> DataFrame:
    """One row per image. ``seq`` costs a sort per coil and is added only where it is read."""
    o = read(spark, d, "orders").select(
        F.col("o_orderkey").alias("frame_id"), F.col("o_custkey").alias("coil_id"),
        F.col("o_orderpriority").alias("camera"),
        F.when(F.col("o_orderstatus") == "F", "neu").otherwise("sev").alias("domain"),
        split_by_hash("split", ["o_orderkey"], SPLIT_CUTS).alias("split"),
        F.lit(200).alias("width"), F.lit(200).alias("height"),
        (F.lit(4) + (F.col("o_orderkey") * 7 % 120) / dbl(10)).alias("total_ms"),
        *([F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("shot_us"), F.lit(1).alias("one")] if with_seq else []),
    )
    if not with_seq:
        return o
    o = running(o, ["coil_id"], ["shot_us", "frame_id"], {"seq": ("one", "sum")})
    return o.withColumn("seq", F.col("seq").cast("int")).drop("one", "shot_us", "seq_total")


def mask_runs(spark: SparkSession, d: str) -> DataFrame:
    """Run-length rows of class masks, overlapping runs on a row merged."""
    e = read(spark, d, "events").select(
        F.col("user_id").alias("frame_id"), (1 + F.col("event_id") % 4).cast("int").alias("class_id"),
        (F.floor(F.col("event_id") / 4) % 64).cast("int").alias("y"),
        (F.col("event_id") * 37 % 180).cast("int").alias("x_start"),
        (F.col("event_id") * 37 % 180 + F.col("event_id") % 19).cast("int").alias("x_end"),
    )
    return merge_runs(e)


def merge_runs(runs: DataFrame, keys=("frame_id", "class_id", "y")) -> DataFrame:
    """Union of overlapping or touching runs on one mask row.

    Runs are integers on a row of bounded width, so equal runs are combined before the window and a
    row keeps at most one run per (start, end) pair.
    """
    keys = list(keys)
    # one run per start is enough: the longest covers the others; this bounds a row by its width
    longest = runs.groupBy(*keys, "x_start").agg(F.max("x_end").alias("x_end"))
    order = Window.partitionBy(*keys).orderBy("x_start")
    before = F.max("x_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(F.col("x_start") > before + 1, F.lit(True)), 1).otherwise(0)
    grouped = longest.withColumn("__opens", opens).withColumn("__island", F.sum("__opens").over(order))
    return grouped.groupBy(*keys, "__island").agg(
        F.min("x_start").alias("x_start"), F.max("x_end").alias("x_end")
    ).drop("__island")


def grey_hist(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    return li.groupBy(
        F.col("l_suppkey").alias("frame_id"),
        (F.floor("l_extendedprice") % 256).cast("int").alias("level"),
    ).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("n"))


def timings(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    sizes = F.array(*[F.lit(v) for v in (256, 320, 416, 512, 640)])
    batches = F.array(*[F.lit(v) for v in (1, 4, 8, 16)])
    return li.select(
        (F.col("l_linenumber") % 2).cast("string").alias("model"), F.col("l_linestatus").alias("device"),
        F.get(sizes, (F.col("l_suppkey") % 5).cast("int")).alias("imgsz"),
        F.get(batches, (F.col("l_partkey") % 4).cast("int")).alias("batch"),
        F.col("l_orderkey").alias("pass_id"),
        (F.lit(2) + F.col("l_quantity").cast("int") / dbl(10)).alias("per_frame_ms"),
        (_pct("l_tax") != 8).alias("ok"),
    )


def train_log(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select(
        F.col("o_orderpriority").alias("run"), F.col("o_orderkey").alias("k"),
        (10 + F.col("o_orderkey") % 7 + F.when(F.col("o_orderkey") % 97 == 0, 60).otherwise(0)).alias("cost"),
        F.lit(1).alias("one"),
    )
    o = running(o, ["run"], ["k"], {"epoch": ("one", "sum"), "time_s": ("cost", "sum")})
    return o.select(
        "run", F.col("epoch").cast("bigint").alias("epoch"), F.col("time_s").cast("double").alias("time_s"),
        ((F.col("k") * 13 % 1000) / dbl(1000)).alias("map50"), ((F.col("k") * 7 % 600) / dbl(1000)).alias("map50_95"),
    )


def content(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(
        F.col("doc_id").alias("item_id"), split_by_hash("split", ["doc_id"], SPLIT_CUTS).alias("split"),
        F.col("source").alias("sequence_id"), F.sha2(F.col("text"), 256).alias("content_sha256"),
    )


def frame_events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        "ts", F.col("user_id").alias("line_id"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "DEFECT").otherwise("PASS").alias("verdict"),
        F.col("value").alias("total_ms"),
    )


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tile scores: a tile is a frame, its source is the coil, label is 1 / 0 / -1."""
    best = detections(spark, d).groupBy("frame_id").agg(F.max("conf").alias("max_conf"))
    labelled = gt_boxes(spark, d).select("frame_id").distinct().withColumn("has_label", F.lit(True))
    return (
        frames(spark, d).join(best, "frame_id", "left").join(labelled, "frame_id", "left")
        .select(
            F.col("frame_id").alias("tile_id"), F.col("coil_id").alias("source_id"), "domain", "camera",
            F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(200).alias("size"),
            F.when(F.col("frame_id") % 4 == 0, 0).when(F.col("has_label"), 1).otherwise(-1).alias("label"),
            F.coalesce("max_conf", F.lit(0.0)).alias("max_conf"),
        )
    )
