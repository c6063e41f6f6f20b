"""Writers: exports, upserts, guarded publishing, report rows and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import running


def upsert_by_tag(existing: DataFrame, new: DataFrame, tag: str = "tag", order: str = "generated_at") -> DataFrame:
    """Replace the rows of the new tags, keep the others. Write the result to a new path, then swap."""
    kept = existing.join(new.select(tag).distinct(), tag, "left_anti")
    return kept.unionByName(new).orderBy(order, tag)


def latest_per_tag(log: DataFrame, tag: str = "tag", order: str = "generated_at") -> DataFrame:
    """The last record of each tag of an append-only log, by partial aggregation."""
    rest = [c for c in log.columns if c not in (tag, order)]
    best = log.groupBy(tag).agg(F.max(F.struct(order, *rest)).alias("__b"))
    return best.select(tag, "__b.*")


def guarded_publish(published: DataFrame, new: DataFrame, key: Sequence[str], producer: str = "source", force: bool = False) -> DataFrame:
    """Decide per key whether a new row may replace a published one of another producer.

    Returns the row to keep with a status: created, overwritten, refused or kept.
    """
    key = list(key)
    cols = [c for c in new.columns if c not in key]
    o = published.select(*key, *[F.col(c).alias(f"__o_{c}") for c in cols], F.lit(True).alias("__old"))
    n = new.select(*key, *[F.col(c).alias(f"__n_{c}") for c in cols], F.lit(True).alias("__new"))
    j = o.join(n, key, "full")
    foreign = F.col(f"__o_{producer}") != F.col(f"__n_{producer}")
    status = (
        F.when(F.col("__new").isNull(), "kept").when(F.col("__old").isNull(), "created")
        .when(foreign & F.lit(not force), "refused").otherwise("overwritten")
    )
    take = status.isin("created", "overwritten")
    return j.select(*key, *[F.when(take, F.col(f"__n_{c}")).otherwise(F.col(f"__o_{c}")).alias(c) for c in cols], status.alias("status"))


def set_digest(rows: DataFrame, keys: Sequence[str], item: str, per_block: int = 4096) -> DataFrame:
    """SHA-256 of the sorted ids of each key, one id per line.

    Ids are hashed as one text when a key fits one block. A larger key is cut into sorted blocks of
    bounded size whose digests are hashed in order, so no key is gathered whole.
    """
    keys = list(keys)
    src = rows.select(*keys, F.col(item).cast("string").alias("__s")).distinct()
    # order by text: the first characters as a number give the bucket, the text breaks ties
    lead = F.conv(F.substring(F.hex(F.rpad("__s", 6, "\0")), 1, 12), 16, 10).cast("bigint")
    src = src.withColumn("__lead", lead).withColumn("__one", F.lit(1))
    n = running(src, keys, ["__lead", "__s"], {"__r": ("__one", "sum")})
    n = n.withColumn("__block", F.floor((F.col("__r") - 1) / per_block))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__s"))), lambda x: x["__s"]), "\n")
    blocks = n.groupBy(*keys, "__block").agg(F.sha2(text, 256).alias("__d"))
    # digests of blocks, of blocks of blocks, ...: four levels cover 4096^5 ids, each group stays small
    for _ in range(4):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__block", "__d"))), lambda x: x["__d"]), "\n")
        blocks = blocks.groupBy(*keys, F.floor(F.col("__block") / per_block).alias("__up")).agg(
            F.when(F.count(F.lit(1)) == 1, F.max("__d")).otherwise(F.sha2(joined, 256)).alias("__d")
        ).withColumnRenamed("__up", "__block")
    return blocks.select(*keys, F.col("__d").alias("digest"))


TREE_LEVELS = (6, 4, 2, 0)  # hex digits of an id's hash that name its bucket, from the leaves to the root


def set_buckets(rows: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """(keys, bucket, digest, n): the lowest level of the tree of each key's set of ids.

    Buckets are 16^6 prefixes of the ids' own hashes, so they fill evenly whatever the ids look like, and ten
    billion ids put some 600 in each.
    """
    keys = list(keys)
    h = F.sha2(F.col(item).cast("string"), 256)
    ids = rows.where(F.col(item).isNotNull()).select(*keys, h.alias("__h")).distinct()
    return ids.groupBy(*keys, F.substring("__h", 1, TREE_LEVELS[0]).alias("bucket")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("__h")), ""), 256).alias("digest"), F.count(F.lit(1)).alias("n"))


def set_root(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, digest, n) of each key: every node hashes its children's names and digests, at most 256 of them.

    One rule at every size. Sets that share no bucket can be united by their buckets, and two sets differ in
    the buckets under the nodes that differ.
    """
    keys = list(keys)
    for digits in TREE_LEVELS[1:]:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda x: F.concat(x["bucket"], x["digest"])), "")
        up = F.substring("bucket", 1, digits) if digits else F.lit("")
        buckets = buckets.groupBy(*keys, up.alias("__up")).agg(F.sha2(text, 256).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("__up", "bucket")
    return buckets.drop("bucket")


def nan_to_null(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def frame_documents(results: DataFrame, scored: DataFrame) -> DataFrame:
    """JSON of each frame with up to its detections, rounded, non-finite numbers as null.

    Detections are nested per frame in bounded parts of ``labels.LINES_PER_CHUNK`` boxes.
    """
    from .labels import LINES_PER_CHUNK

    n = running(scored.withColumn("__one", F.lit(1)), ["frame_id"], ["conf", "det_id"], {"__r": ("__one", "sum")}, descending=True)
    n = n.withColumn("part", F.floor((F.col("__r") - 1) / LINES_PER_CHUNK).cast("int"))
    box = F.struct(
        F.col("__r"), F.struct(
            F.col("class_name"), F.round(nan_to_null("conf"), 4).alias("confidence"), F.col("band").alias("severity"),
            F.round(nan_to_null("score"), 2).alias("severity_score"), F.array(*[F.round(s, 1) for s in ("x1", "y1", "x2", "y2")]).alias("bbox"),
        ).alias("d"))
    dets = n.groupBy("frame_id", "part").agg(F.transform(F.array_sort(F.collect_list(box)), lambda b: b["d"]).alias("detections"))
    out = results.join(dets, "frame_id", "left")
    doc = F.struct(
        "frame_id", "verdict", "defect_count", "dominant_class", F.round(nan_to_null("severity_score"), 2).alias("severity_score"), "severity_band",
        F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("detections", F.array().cast("array<struct<class_name:string,confidence:double,severity:string,severity_score:double,bbox:array<double>>>")).alias("detections"),
    )
    return out.select("coil_id", "frame_id", F.coalesce("part", F.lit(0)).alias("part"), F.to_json(doc).alias("document"))


def coil_documents(disposed: DataFrame) -> DataFrame:
    """JSON header of each coil; its frames follow as separate rows of the same partition folder."""
    num = lambda c, n: F.round(nan_to_null(c), n).alias(c)
    doc = F.struct(
        "coil_id", "disposition", "reasons", "total_frames", "defect_frames", num("defect_rate", 4), num("mean_severity", 2), num("max_severity", 2), num("p95_severity", 2),
        num("mean_latency_ms", 3), num("throughput_fps", 2),
    )
    return disposed.select("coil_id", F.to_json(doc).alias("document"))


def write_by(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options) -> None:
    """Write to a new folder, partitioned; CSV gets a header."""
    w = df.write.mode("errorifexists").format(fmt)
    if fmt == "csv":
        options.setdefault("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.options(**options).save(path)
