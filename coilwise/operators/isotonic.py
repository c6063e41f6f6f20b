"""Monotone fits of any size: pool adjacent violators inside score ranges, then across their borders.

Pooling neighbours whose means fall (or are equal) leads to the same blocks in any order. So blocks are
dealt to sorted ranges of at most RANGE blocks, every range is pooled by itself with a stack, and the pooled
blocks are dealt again with other borders, until no pair of neighbours violates the order. Usually the first
round leaves so few blocks that the second holds them all. All keys, such as the folds of a selection,
are fitted together. Weights and weighted sums that are whole numbers are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

RANGE = 500_000


def pool(lo: Sequence, hi: Sequence, weight: Sequence, total: Sequence) -> list[tuple]:
    """Blocks (lo, hi, weight, total) with rising means, from neighbours in order."""
    stack: list[tuple] = []
    for block in zip(lo, hi, weight, total, strict=True):
        while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
            a = stack.pop()
            block = (a[0], block[1], a[2] + block[2], a[3] + block[3])
        stack.append(block)
    return stack


def pooled(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, lo, hi, weight, total) blocks of the monotone fit of rows with those columns; total / weight is the value.

    Null weights and weights of 0 are left out; an empty table gives no blocks.
    """
    keys = list(keys)
    whole = all(rows.schema[c].dataType.simpleString() == "bigint" for c in ("weight", "total"))
    kind = "bigint" if whole else "double"
    blocks = rows.where("weight > 0").select(*keys, "lo", "hi", F.col("weight").cast(kind).alias("weight"), F.col("total").cast(kind).alias("total"))
    schema = blocks.select(*keys, "lo", "hi", "weight", "total").schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        held = pa.Table.from_batches(some)
        rows = zip(*(c.to_pylist() for c in held.columns), strict=True)
        out = [(*key, *block) for key, own in groupby(rows, lambda r: r[: len(keys)]) for block in pool(*list(zip(*own, strict=True))[len(keys) :])]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), held.schema, strict=True)], schema=held.schema)

    blocks = checkpointed(blocks)
    turn = 0
    while True:
        ranges = ceil(blocks.count() / RANGE)
        one = ranges <= 1
        # other borders in every round, so no border between two violators stays for ever
        dealt = blocks.coalesce(1) if one else blocks.repartitionByRange(ranges + 1 + turn % 3, *keys, "lo")
        blocks = checkpointed(dealt.sortWithinPartitions(*keys, "lo").mapInArrow(run, schema).withColumn("__part", F.spark_partition_id()))
        if one or not _violated(blocks, keys):
            return blocks.drop("__part")
        blocks, turn = blocks.drop("__part"), turn + 1


def _violated(blocks: DataFrame, keys: Sequence[str]) -> bool:
    """Whether the last block of a range and the first one behind it fall; one row per key and range."""
    ends = blocks.groupBy(*keys, "__part").agg(F.min(F.struct("lo", "weight", "total")).alias("a"), F.max(F.struct("lo", "weight", "total")).alias("z"))
    w = Window.partitionBy(*keys).orderBy("a.lo") if keys else Window.partitionBy(F.lit(0)).orderBy("a.lo")
    before = F.lag("z").over(w)
    return bool(ends.withColumn("b", before).where(F.col("b.total") / F.col("b.weight") >= F.col("a.total") / F.col("a.weight")).take(1))


def isotonic_knots(counts: DataFrame, keys: Sequence[str] = (), smoothing: float = 0.5) -> DataFrame:
    """(keys, x, y): both ends of every plateau of the monotone fit of (keys, score, n, k).

    Plateaus are shrunk towards one half by ``smoothing`` counts on either side and made monotone again.
    """
    keys = list(keys)
    flat = pooled(counts.select(*keys, F.col("score").alias("lo"), F.col("score").alias("hi"), F.col("n").cast("bigint").alias("weight"), F.col("k").cast("bigint").alias("total")), keys)
    if smoothing > 0:
        n = F.col("weight").cast("double")
        shrunk = flat.select(*keys, "lo", "hi", n.alias("weight"), (n * (F.col("total") + smoothing) / (n + 2 * smoothing)).alias("total"))
        level = pooled(shrunk, keys)
    else:
        level = flat
    y = F.least(F.greatest(F.col("total") / F.col("weight"), F.lit(0.0)), F.lit(1.0))
    return level.select(*keys, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), y.alias("y"))
