"""Ordered totals and exact quantiles that do not funnel a hot key through one task.

A plain window over one key sends all its rows to a single task. Here each key is cut into buckets
by a monotone function of the ordering column; totals are kept per bucket, and only the small bucket
table is windowed per key. A bucket total plus the running value inside the bucket is the exact
running value.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse

# Buckets per unit of log1p(|value|). 1024 gives about 700 buckets on [0, 1], 4.7k on [0, 100] and at
# most 45k on any BIGINT, which bounds the per-key bucket table.
BUCKETS_PER_LOG = 1024


def monotone_bucket(col: str | Column) -> Column:
    """Bucket number that never decreases as the value grows."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.floor(F.signum(c) * F.log1p(F.abs(c)) * BUCKETS_PER_LOG).cast("bigint")


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + here
    return F.greatest(before, here)  # ignores NULL, the first bucket has none before it


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, str]],
    descending: bool = False,
) -> DataFrame:
    """Add an inclusive running value per output name, ``values[name] = (column, 'sum'|'max')``.

    ``order[0]`` must be numeric and is followed by tie-breakers; ``descending`` reverses only
    ``order[0]``. For sums, ``<name>_total`` holds the total of the key as well.
    """
    keys = list(keys)
    b = "__bucket"
    lead = -F.col(order[0]) if descending else F.col(order[0])
    src = df.withColumn(b, monotone_bucket(lead))
    first = F.col(order[0]).desc() if descending else F.col(order[0]).asc()
    inside = (
        Window.partitionBy(*keys, b).orderBy(first, *[F.col(c).asc() for c in order[1:]])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    agg = {"sum": F.sum, "max": F.max}
    local = src.select("*", *[agg[kind](col).over(inside).alias(name) for name, (col, kind) in values.items()])

    per_bucket = src.groupBy(*keys, b).agg(
        *[agg[kind](col).alias(f"__t_{name}") for name, (col, kind) in values.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_bucket.select(
        *keys, b,
        *[agg[kind](f"__t_{name}").over(earlier).alias(f"__o_{name}") for name, (_, kind) in values.items()],
        *[F.sum(f"__t_{name}").over(whole).alias(f"{name}_total")
          for name, (_, kind) in values.items() if kind == "sum"],
    )
    out = local.join(offsets, [*keys, b])
    done = [_combine(kind, F.col(f"__o_{name}"), F.col(name)).alias(name) for name, (_, kind) in values.items()]
    totals = [f"{name}_total" for name, (_, kind) in values.items() if kind == "sum"]
    return out.select(*[c for c in df.columns if c not in values], *done, *totals)


def ordered_positions(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    ties: Sequence[str],
    values: dict[str, str],
) -> DataFrame:
    """Running sums in the order (score desc, ties asc) where one score may hold many rows.

    Distinct scores are totalled first, with map-side combining; equal scores are then ordered by
    ``ties`` in buckets of ``ties[0]``. The result is the exact position of each row.
    """
    keys = list(keys)
    names = list(values)
    per_score = df.groupBy(*keys, score).agg(*[F.sum(values[n]).alias(f"__s_{n}") for n in names])
    prefix = running(per_score, keys, [score], {f"__p_{n}": (f"__s_{n}", "sum") for n in names}, descending=True)
    prefix = prefix.select(
        *keys, score,
        *[(F.col(f"__p_{n}") - F.col(f"__s_{n}")).alias(f"__before_{n}") for n in names],
        *[F.col(f"__p_{n}_total").alias(f"{n}_total") for n in names],
    )
    inside = running(df, [*keys, score], list(ties), {f"__i_{n}": (values[n], "sum") for n in names})
    out = inside.join(prefix, [*keys, score])
    here = [(F.col(f"__before_{n}") + F.col(f"__i_{n}")).alias(n) for n in names]
    return out.select(*[c for c in df.columns if c not in names], *here, *[f"{n}_total" for n in names])


def ranked_levels(
    df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str], hits: str, lanes: int = 1, weights: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Places of the hits in the order (score desc, ties asc), for several ``lanes`` from one sort.

    Lanes share rows and order and differ in what counts: bit ``i`` of ``hits`` marks a hit of lane ``i``. With
    ``weights`` (an array of one whole number per lane) a row counts that often in a lane, and ``hits`` is 0 or 1
    for all lanes. Rows are dealt to ranges of the whole order, so neither a hot key nor a hot score shares a task;
    a range is counted once, in order, and hands on its hits and its totals alone.

    Returns (keys, lane, k, rank, w): running hits and rows up to and with each hit and how often it counts, and
    (keys, lane, n_rows, n_hits).
    """
    keys = list(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = None, None  # the key of the run that is open
        rank, k = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)

        def out(cols, lane, k, rank, w, total):
            rest = [pa.array(np.asarray(x)) for x in (lane.astype(np.int32), k, rank, w)]
            return pa.RecordBatch.from_arrays([*cols, *rest, pa.array(np.full(len(lane), total))], [*names, "lane", "k", "rank", "w", "total"])

        def totals():
            return out([pa.concat_arrays([c] * lanes) for c in held], np.arange(lanes), k, rank, np.zeros(lanes, np.int64), True)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            cols = b.columns[: len(keys) + 1]
            names = b.schema.names[: len(cols)]
            hit = b.column("__hits").to_numpy(zero_copy_only=False).astype(np.int64)
            if weights:
                w = b.column("__weights").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, lanes)
                h = w * hit[:, None]
            else:
                w, h = np.ones((n, 1), np.int64), (hit[:, None] >> np.arange(lanes)) & 1
            new = np.zeros(n, bool)
            for i, c in enumerate(cols):
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[0] |= held is None or held[i][0] != c[0]
            edges = np.flatnonzero(new)
            for a, z in zip(np.r_[0, edges[edges > 0]], np.r_[edges[edges > 0], n]):
                if new[a]:
                    if held is not None:
                        yield totals()
                    rank, k = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
                ranks, ks = rank + np.cumsum(w[a:z], axis=0), k + np.cumsum(h[a:z], axis=0)
                rank, k = ranks[-1], ks[-1]
                held = [c.slice(z - 1, 1) for c in cols]
                row, lane = np.nonzero(h[a:z])
                if len(row):
                    yield out([c.take(pa.array(a + row)) for c in cols], lane, ks[row, lane], ranks[row, lane], h[a:z][row, lane], False)
        if held is not None:
            yield totals()

    if weights:
        df = df.withColumn("__weights", F.col(weights))
    use = df.where(F.greatest(*[F.col(c).isNull().cast("int") for c in keys], F.lit(0)) == 0).withColumn("__hits", F.col(hits).cast("bigint"))
    order = [*[F.col(c).asc() for c in keys], F.col(score).desc(), *[F.col(c).asc() for c in ties]]
    dealt = use.select(*keys, score, *ties, "__hits", *(["__weights"] if weights else [])).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = dealt.select(*keys, F.spark_partition_id().alias("__range"), "__hits", *(["__weights"] if weights else []))
    types = dict(use.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keys] + ["__range int, lane int, k bigint, rank bigint, w bigint, total boolean"])
    done = reuse(rows.mapInArrow(count, schema))
    on = [*keys, "lane"]
    # one row per range, key and lane
    per = done.where("total").select(*on, "__range", F.col("k").alias("__k"), F.col("rank").alias("__rank"))
    before = Window.partitionBy(*on).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*on, "__range", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in ("k", "rank")])
    levels = done.where("not total").join(F.broadcast(offsets), [*on, "__range"]).select(
        *on, (F.col("k") + F.col("__k")).alias("k"), (F.col("rank") + F.col("__rank")).alias("rank"), "w")
    return levels, per.groupBy(*on).agg(F.sum("__rank").alias("n_rows"), F.sum("__k").alias("n_hits"))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolation quantiles per key, without holding a key's values in one buffer."""
    keys = list(keys)
    one = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(one.alias("__n"))
    cum = running(counts, keys, [value], {"__cum": ("__n", "sum")})
    picks = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("__cum_total") - 1)
        picks += [
            F.min(F.when(F.col("__cum") > F.floor(pos), F.col(value))).alias(f"__lo_{name}"),
            F.min(F.when(F.col("__cum") > F.ceil(pos), F.col(value))).alias(f"__hi_{name}"),
        ]
    g = cum.groupBy(*keys).agg(F.max("__cum_total").alias("__n_total"), *picks)
    out = []
    for name, q in qs.items():
        pos = F.lit(float(q)) * (F.col("__n_total") - 1)
        lo, hi = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return g.select(*keys, *out)


def threshold_steps(conf: str | Column, grid: Sequence[float]) -> Column:
    """How many thresholds of an ascending grid a confidence reaches (0..len(grid))."""
    c = F.col(conf) if isinstance(conf, str) else conf
    total = F.lit(0)
    for t in grid:
        total = total + F.when(c >= F.lit(float(t)), 1).otherwise(0)
    return total


def survivors_per_threshold(
    hist: DataFrame, keys: Sequence[str], step: str, grid: Sequence[float], counts: Sequence[str]
) -> DataFrame:
    """Turn a histogram over reached steps into counts at each threshold.

    ``hist`` has at most ``len(grid) + 1`` rows per key. A row that reaches step ``s`` survives the
    first ``s`` thresholds, so it is added to each of them: the expansion is bounded by the grid.
    """
    levels = F.array(*[
        F.struct(F.lit(i + 1).alias("lvl"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)
    ])
    present = hist.select(*keys).distinct() if keys else hist.sparkSession.range(1).select()
    dense = present.select(*keys, F.inline(levels))
    expanded = hist.where(F.col(step) > 0).select(
        *keys, *counts, F.explode(F.sequence(F.lit(1), F.col(step))).alias("lvl")
    )
    summed = expanded.groupBy(*keys, "lvl").agg(*[F.sum(c).alias(c) for c in counts])
    return dense.join(summed, [*keys, "lvl"], "left").fillna(0, subset=list(counts)).drop("lvl")


def with_grid(df: DataFrame, name: str, values: Sequence[float], type_: str = "double") -> DataFrame:
    """One row per input row and grid value; the grid is a fixed, short list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v).cast(type_) for v in values])))
