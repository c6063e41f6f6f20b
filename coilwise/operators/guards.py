"""Checks that run inside the job they guard: paired tables that fit or fail, and assertions from the writing pass."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def aligned(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both tables side by side, one per key; the job fails if a key is missing on a side or repeats.

    Other columns must have different names. Null keys match each other. The check is part of the join: no
    further shuffle, and no row of a key that doesn't fit is ever passed on.
    """
    keys = list(keys)
    a = left.withColumn("__a", F.lit(True))
    b = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys], F.lit(True).alias("__b"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    j = a.join(b, same, "full")
    j = j.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], *[c for c in j.columns if c not in keys and c not in {f"__{k}" for k in keys}])
    name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    stop = lambda text: F.raise_error(F.concat(F.lit(text), name)).cast("boolean")
    many = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    fits = (
        F.when(F.col("__a").isNull(), stop("missing on the left: ")).when(F.col("__b").isNull(), stop("missing on the right: "))
        .when(F.col("__n") > 1, stop("repeated: ")).otherwise(True)
    )
    return j.withColumn("__n", many).where(fits).drop("__a", "__b", "__n")


def write_checked(rows: DataFrame, path: str, bad: Mapping[str, Column], partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``rows`` and return (name, ok, detail) of every check, counted while they were written.

    ``bad`` holds a condition per check that is true for rows that break it (null counts as fine). The rows are
    read once, whatever the number of checks; a task that runs again is counted once.
    """
    seen = Observation(f"checks-{uuid.uuid4().hex}")
    names = list(bad)
    counts = [F.coalesce(F.sum(F.coalesce(bad[n], F.lit(False)).cast("bigint")), F.lit(0)).alias(f"c{i}") for i, n in enumerate(names)]
    w = rows.observe(seen, F.count(F.lit(1)).alias("total"), *counts).write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    got = seen.get
    out = [(n, got[f"c{i}"] == 0, f"{got[f'c{i}']} of {got['total']}") for i, n in enumerate(names)]
    return rows.sparkSession.createDataFrame(out, "name string, ok boolean, detail string")
