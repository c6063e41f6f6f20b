"""Cluster bootstraps by weights: a cluster weighs Poisson(1) in a resample, drawn from its id alone.

Nothing is drawn up in advance and no row is copied per resample. A task draws the weights of the clusters it
meets as one vector over all resamples, adds the vectors of its rows, and hands on one vector per task (or
score range). So exchanges don't grow with the number of resamples, apart from that one vector per task.

A weight comes from 32 bits of md5(seed:cluster:block), four resamples a block, by the fixed limits below, so
it is the same on every executor, on retries and in any SQL engine. Unlike draws with replacement, the number
of clusters varies by resample. Where a row has to be weighed by itself, in the order of scores (``Lanes``),
the weight comes from 16 bits of a mixed 64-bit hash of the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache
from math import ceil, exp, factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse

#: Weight k or less has a chance of LIMITS[k] / 2^32.
LIMITS = [int(2**32 * sum(exp(-1) / factorial(i) for i in range(k + 1))) for k in range(12)]
_STEPS = np.array(LIMITS, np.int64)
KNOWN = 16_384  # clusters whose weights a task keeps
SCORES = 4096  # distinct scores up to which a task sums the weights of its clusters by score


def weights(cluster, resamples: int, seed: str) -> np.ndarray:
    """How often the cluster counts in each resample."""
    head, md5 = f"{seed}:{cluster}:".encode(), hashlib.md5
    drawn = b"".join([md5(head + k).digest() for k in _blocks(ceil(resamples / 4))])
    return np.searchsorted(_STEPS, np.frombuffer(drawn, ">u4")[:resamples].astype(np.int64), "right").astype(np.uint8)


@cache
def _blocks(n: int) -> list[bytes]:
    return [b"%d" % k for k in range(n)]


class Drawn(dict):
    """Weights of clusters by text, drawn when first asked for."""

    def __init__(self, resamples: int, seed: str):
        self.resamples, self.seed = resamples, seed

    def __missing__(self, cluster) -> np.ndarray:
        if len(self) >= KNOWN:
            self.clear()
        self[cluster] = w = weights(cluster, self.resamples, self.seed)
        return w


def weighted_sums(clusters: DataFrame, cluster: str, sums: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """(b, sums): weighted sums of whole-number columns in every resample; nulls count as 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(sums), resamples), np.int64)
        for b in batches:
            v = np.array([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]).reshape(len(sums), b.num_rows)
            for i, key in enumerate(b.column(0).to_pylist()):
                total += v[:, i : i + 1] * weights(key, resamples, seed)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), *map(pa.array, total)], ["b", *sums])

    rows = clusters.select(F.col(cluster).cast("string").alias("__c"), *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in sums])
    return rows.mapInArrow(run, ", ".join(["b bigint", *(f"{c} bigint" for c in sums)])).groupBy("b").agg(*[F.sum(c).alias(c) for c in sums])


def weighted_auc(scores: DataFrame, cluster: str, resamples: int, seed: str, score: str = "score", label: str = "label") -> DataFrame:
    """(b, n_pos, n_neg, auc): tie-corrected AUC of every resample, the clusters of either arm weighed by themselves.

    Cells (cluster, label, score) are dealt to ranges of the score. A range is read once in order and gives
    three vectors: its positives, its negatives, and the pairs that its positives win inside it. The
    negatives of lower ranges are added when the ranges come together. Null scores don't count.

    With up to ``SCORES`` distinct scores, cells are first dealt by cluster, so that a cluster is drawn once and not
    by every range it meets; a task hands on one vector per label and score.
    """
    spark = scores.sparkSession
    hit = F.when(F.col(label) == 1, 1).otherwise(0)
    rows = scores.where(F.col(score).isNotNull()).select(F.col(cluster).cast("string").alias("c"), hit.alias("hit"), F.col(score).cast("double").alias("s"))
    few = rows.select("s").distinct().limit(SCORES + 1).count() <= SCORES
    tasks = 2 * spark.sparkContext.defaultParallelism  # few bytes, much work: not left to the size of partitions
    cells = (rows.repartition(tasks, "c") if few else rows).groupBy("c", "hit", "s").agg(F.count(F.lit(1)).alias("n"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, now, drawn = {}, None, {}
        for b in batches:
            for c, arm, s, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != now:
                    now, drawn = c, {}
                if arm not in drawn:
                    drawn[arm] = weights(c, resamples, f"{seed}{arm}")
                if (s, arm) not in sums:
                    sums[s, arm] = np.zeros(resamples, np.int64)
                sums[s, arm] += drawn[arm] if n == 1 else n * drawn[arm].astype(np.int64)
        for (s, arm), v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()]), pa.array([arm], pa.int32()), pa.array([s]), pa.array([1])], ["c", "hit", "s", "n"])

    if few:
        cells = cells.sortWithinPartitions("c").mapInArrow(add, "c binary, hit int, s double, n bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = [Drawn(resamples, f"{seed}{arm}") for arm in (0, 1)]
        pos, below, won = (np.zeros(resamples, np.int64) for _ in range(3))  # won counts half pairs
        here, first, now = np.zeros((2, resamples), np.int64), None, None
        for b in batches:
            for c, arm, s, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if s != now:
                    won += here[1] * (2 * below + here[0])
                    below += here[0]
                    pos += here[1]
                    here[:] = 0
                    first, now = s if first is None else first, s
                here[arm] += np.frombuffer(c, np.int64) if few else n * drawn[arm][c].astype(np.int64)
        won += here[1] * (2 * below + here[0])
        if first is not None:
            cols = [np.full(resamples, first), np.arange(resamples), pos + here[1], below + here[0], won]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["first", "b", "pos", "neg", "won"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = cells.repartitionByRange(parts, "s").sortWithinPartitions("s").mapInArrow(run, "first double, b bigint, pos bigint, neg bigint, won bigint")
    lower = Window.partitionBy("b").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    r = ranges.withColumn("below", F.coalesce(F.sum("neg").over(lower), F.lit(0)))
    t = r.groupBy("b").agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("won").cast("double") + 2.0 * F.col("pos") * F.col("below")).alias("won"))
    pairs = 2.0 * F.col("n_pos") * F.col("n_neg")
    return t.select("b", "n_pos", "n_neg", F.when(pairs > 0, F.col("won") / pairs).alias("auc"))


# ---------------------------------------------------------------- average precision

#: 65,536 times the chance of a weight of k or less, rounded so that the weights are 1 on average.
LIMITS_16 = np.array([24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535], np.uint16)
BLOCK = 31  # rows weighed at once: so many weights of at most 8 add up within a byte
_ODD = 0x9E3779B9


class Lanes:
    """Weights of the clusters of up to BLOCK rows over all resamples, in buffers that are used again."""

    def __init__(self, resamples: int):
        half = (resamples + 1) // 2
        self.resamples = resamples
        self.steps = (np.arange(1, half + 1, dtype=np.uint64) * _ODD).astype(np.uint32)
        self.bits, self.shifted = np.empty((2, BLOCK, half), np.uint32)
        self.out, self.over = np.empty((BLOCK, 2 * half), np.uint8), np.empty((BLOCK, 2 * half), bool)

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """One row of weights for each 64-bit hash; valid until the next call."""
        m = len(hashes)
        x, t, out, over = self.bits[:m], self.shifted[:m], self.out[:m], self.over[:m]
        h = hashes.astype(np.int64).view(np.uint64)
        low, high = ((v & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None] for v in (h, h >> np.uint64(32)))

        def mix(shift: int, by: int) -> None:
            np.right_shift(x, np.uint32(shift), out=t)
            np.bitwise_xor(x, t, out=x)
            np.multiply(x, np.uint32(by), out=x)

        np.add(low, self.steps, out=x)
        mix(16, 0x85EBCA6B)
        np.add(x, high, out=x)
        mix(13, 0xC2B2AE35)
        mix(16, 0x27D4EB2F)
        np.right_shift(x, np.uint32(15), out=t)
        np.bitwise_xor(x, t, out=x)
        u = x.view(np.uint16)
        np.greater_equal(u, LIMITS_16[0], out=out.view(bool))
        for limit in LIMITS_16[1:]:
            np.greater_equal(u, limit, out=over)
            np.add(out, over.view(np.uint8), out=out)
        return out[:, : self.resamples]


def _hashed(cluster: str, seed: str):
    return F.xxhash64(F.lit(seed), F.col(cluster).cast("string")).alias("__h")


def _per_lane(names: Sequence[str], schema: pa.Schema, key: tuple, n: int) -> list[pa.Array]:
    return [pa.array([v] * n, schema.field(c).type) for c, v in zip(names, key, strict=True)]


def _in_blocks(batches: Iterator[pa.RecordBatch], keys: int, columns: Sequence[str], resamples: int) -> Iterator[tuple]:
    """(schema, key, values of the columns, weights) of up to BLOCK neighbouring rows of one key (the first columns)."""
    lanes = Lanes(resamples)
    for b in batches:
        if not b.num_rows:
            continue
        of, new = b.columns[:keys], np.zeros(b.num_rows, bool)
        for c in of:
            new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)), True).to_numpy(zero_copy_only=False)
        h, *values = (b.column(c).to_numpy(zero_copy_only=False) for c in ("__h", *columns))
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(edges, edges[1:]):
            key = tuple(c[a].as_py() for c in of)
            for i in range(a, z, BLOCK):
                to = min(i + BLOCK, z)
                yield b.schema, key, [v[i:to] for v in values], lanes.weights(h[i:to])


def weighted_counts(rows: DataFrame, keys: Sequence[str], cluster: str, count: str, resamples: int, seed: str) -> DataFrame:
    """(keys, b, n): the counts of each key, weighed by cluster, in every resample."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, schema = {}, None
        for schema, key, (n,), w in _in_blocks(batches, len(keys), ["__n"], resamples):
            one = n == 1
            if key not in sums:
                sums[key] = np.zeros(resamples, np.int64)
            sums[key] += np.add.reduce(w[one], axis=0, dtype=np.uint8)
            sums[key] += (w[~one] * n[~one, None]).sum(0)
        for key, v in sums.items():
            yield pa.RecordBatch.from_arrays([*_per_lane(keys, schema, key, resamples), pa.array(np.arange(resamples)), pa.array(v)], [*keys, "b", "n"])

    types = dict(rows.dtypes)
    made = rows.select(*keys, _hashed(cluster, seed), F.col(count).cast("bigint").alias("__n"))
    return made.sortWithinPartitions(*keys).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), "b bigint, n bigint"])).groupBy(*keys, "b").agg(F.sum("n").alias("n"))


def _goals(n: np.ndarray, hits: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Recall grid, level below each of its points, and the level after that (infinite if there is none), by lane."""
    x = (np.arange(points) * (1.0 / (points - 1)))[:, None]
    some = np.maximum(n, 1)
    k = np.floor(x * n)
    k = np.minimum(np.where((k + 1) / some <= x, k + 1, np.where(k / some > x, k - 1, k)), hits)
    return x, k, np.where((k + 1 <= hits) & (n > 0), k + 1, np.inf)


def weighted_precision(
    rows: DataFrame, n_labels: dict[tuple, np.ndarray], keys: Sequence[str], score: str, ties: Sequence[str], cluster: str, hit: str,
    resamples: int, seed: str, points: int = 101,
) -> DataFrame:
    """(keys, b, ap): ``metrics.lane_precision`` of every resample for the keys of ``n_labels``, rows weighed by cluster.

    Rows are dealt to ranges of the whole order once and are kept as key, hit and hash. A first pass adds up the
    weights of each range (two vectors for each range and key, which the driver turns into the sums before it); a second
    one walks the range from there with one vector of levels and ranks, and hands on the rank and the largest precision
    behind each point of the recall grid that it meets. So nothing but those grows with the number of resamples.
    """
    spark, keys, types = rows.sparkSession, list(keys), dict(rows.dtypes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    use = rows.where(F.greatest(*[F.col(c).isNull().cast("int") for c in keys], F.lit(0)) == 0)
    order = [*[F.col(c).asc() for c in keys], F.col(score).desc(), *[F.col(c).asc() for c in ties]]
    dealt = use.select(*dict.fromkeys([*keys, score, *ties, cluster, hit])).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = reuse(dealt.select(*keys, F.spark_partition_id().alias("__range"), (F.col(hit).cast("int") > 0).alias("__hit"), _hashed(cluster, seed)))
    typed = ", ".join(f"`{c}` {types[c]}" for c in keys)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, schema = {}, None
        for schema, key, (hits, part), w in _in_blocks(batches, len(keys), ["__hit", "__range"], resamples):
            part = int(part[0])
            if (key, part) not in sums:
                sums[key, part] = np.zeros((2, resamples), np.int64)
            k, r = sums[key, part]
            r += np.add.reduce(w, axis=0, dtype=np.uint8)
            k += np.add.reduce(w[hits], axis=0, dtype=np.uint8)
        for (key, part), v in sums.items():
            yield pa.RecordBatch.from_arrays([*_per_lane(keys, schema, key, 1), pa.array([part], pa.int32()), pa.array([v.tobytes()], pa.binary())], [*keys, "part", "sums"])

    totals, before = {}, {}
    for row in sorted(kept.mapInArrow(add, f"{typed}, part int, sums binary").collect(), key=lambda r: r["part"]):
        key = tuple(row[: len(keys)])
        if key in n_labels:
            before[key, row["part"]] = totals.get(key, np.zeros((2, resamples), np.int64))
            totals[key] = before[key, row["part"]] + np.frombuffer(row["sums"], np.int64).reshape(2, resamples)
    none = np.zeros((2, resamples), np.int64)
    known = spark.sparkContext.broadcast((before, {key: (n, *totals.get(key, none)) for key, n in n_labels.items()}))
    every, fields = np.arange(resamples), [*keys, "b", "point", "best", "rank"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None

        def met():
            best[passed, every] = largest
            point, lane = np.nonzero((best[1:] > 0) | (rank > 0))
            return pa.RecordBatch.from_arrays([*_per_lane(keys, schema, held, len(lane)), *map(pa.array, (lane, point, best[1:][point, lane], rank[point, lane]))], fields)

        for schema, key, (hits, part), w in _in_blocks(batches, len(keys), ["__hit", "__range"], resamples):
            if key != held:
                if held in known.value[1]:
                    yield met()
                held = key
                if key in known.value[1]:
                    n, n_hits, _ = known.value[1][key]
                    k, r = known.value[0][key, int(part[0])].astype(np.float64)
                    goals = np.vstack([_goals(n, n_hits, points)[2], np.full(resamples, np.inf)])
                    passed = (goals <= k).sum(0)
                    goal, best, rank = goals[passed, every], np.zeros((points + 1, resamples)), np.zeros((points, resamples))
                    # the largest precision since the last point; what lies before the first one is not looked at
                    largest = np.where(passed > 0, 0.0, np.inf)
            if key not in known.value[1]:
                continue
            more = np.add.reduce(w[hits], axis=0, dtype=np.uint8)
            end = k + more
            # a lane is walked if it meets a point here, or if its precision may rise above the largest: with k <= r,
            # a row's (k + x) / (r + y), x <= y, is at most that of all hits of the block without a miss
            on = np.flatnonzero((end >= goal) | (end > largest * np.maximum(r + more, 1)))
            if len(on) and hits.any():
                sub = w[:, on]
                level = np.cumsum(sub[hits], axis=0, dtype=np.int64) + k[on]
                at = np.cumsum(sub, axis=0, dtype=np.int64)[hits] + r[on]
                # rows of weight 0 before all others of their lane have neither level nor rank
                p = level / np.maximum(at, 1)
                largest[on] = np.maximum(largest[on], p.max(0))
                meets = np.flatnonzero(end[on] >= goal[on])
                while len(meets):
                    lane, has = on[meets], level[:, meets]
                    first = (has < goal[lane]).sum(0)
                    best[passed[lane], lane] = largest[lane]
                    rank[passed[lane], lane] = at[first, meets] - (has[first, np.arange(len(meets))] - goal[lane])
                    passed[lane] += 1
                    largest[lane] = np.where(np.arange(len(has))[:, None] >= first, p[:, meets], 0).max(0)
                    goal[lane] = goals[passed[lane], lane]
                    meets = meets[end[lane] >= goal[lane]]
            k, r = end, r + np.add.reduce(w, axis=0, dtype=np.uint8)
        if held in known.value[1]:
            yield met()

    def precision(key: tuple, table: pa.Table) -> pa.Table:
        key = tuple(v.as_py() for v in key)
        n, hits, dets = known.value[1][key]
        x, k, _ = _goals(n, hits, points)
        best, rank = np.zeros((2, points, resamples))
        lane, point = (table.column(c).to_numpy() for c in ("b", "point"))
        best[point, lane], rank[point, lane] = (table.column(c).to_numpy() for c in ("best", "rank"))
        best = np.maximum.accumulate(best[::-1])[::-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            last_row = np.maximum(k / (rank - 1), best)  # last row of level k
            inside = last_row + (best - last_row) / ((k + 1) / n - k / n) * (x - k / n)
            value = np.where(rank > 0, inside, np.where(x == k / n, k / dets, 0))
            ap = np.where(k == 0, np.where(rank > 0, best, 0), value).mean(0)
        return pa.Table.from_arrays([*_per_lane(keys, table.schema, key, resamples), pa.array(every), pa.array(ap, mask=n == 0)], [*keys, "b", "ap"])

    met = kept.mapInArrow(walk, f"{typed}, b bigint, point bigint, best double, rank double")
    all_keys = spark.createDataFrame([(*key, 0, 0, 0.0, 0.0) for key in n_labels], f"{typed}, b bigint, point bigint, best double, rank double")
    points_met = met.unionByName(all_keys).groupBy(*keys, "b", "point").agg(F.max("best").alias("best"), F.max("rank").alias("rank"))
    return points_met.groupBy(*keys).applyInArrow(precision, f"{typed}, b bigint, ap double")
