"""Session helpers: engine defaults and the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def builder(app: str = "coilwise") -> SparkSession.Builder:
    b = SparkSession.builder.appName(app)
    for key, value in DEFAULTS.items():
        b = b.config(key, value)
    return b


def by_frame(df: DataFrame) -> DataFrame:
    """Rows dealt by ``frame_id`` to a fixed number of tasks, the same for every table.

    Sides dealt this way meet on frame_id and any further keys without a shuffle of their own. Steps that have to
    spread a crowded frame deal its rows again.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame_id")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder named by the session; a scratch folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        shared = tempfile.mkdtemp(prefix="coilwise-ckpt-")
    sc.setCheckpointDir(shared)
    return shared


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Keep a result that several branches of one job read.

    Lineage stays, so a lost executor only costs the recomputation of its blocks; blocks that do not
    fit in memory go to disk.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)
