"""Dataset splits, sampling orders, duplicate and leakage checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import dbl
from ..functions.hashing import order_key, unit_hash
from ..session import checkpointed
from .scale import ordered_positions, running

RATIOS = {"train": 0.8, "val": 0.1, "test": 0.1}  # fixed values


def hash_rank(df: DataFrame, keys: Sequence[str], seed: str, id_col: str, name: str = "rank") -> DataFrame:
    """1-based position of each id in a reproducible random order per key (bucketed)."""
    src = df.withColumns({"__u": unit_hash(seed, id_col), "__one": F.lit(1)})
    out = running(src, list(keys), ["__u", id_col], {name: ("__one", "sum")})
    return out.drop("__u", "__one")


def stratified_carve_out(pool: DataFrame, stratum: str, n: int, seed: str, id_col: str = "frame_id") -> DataFrame:
    """n random items of each stratum go to val, the rest to train.

    Only the first n per stratum are ranked: Spark limits the groups before the shuffle.
    """
    order = Window.partitionBy(stratum).orderBy(order_key(seed, id_col), id_col)
    val = pool.select(stratum, id_col, F.row_number().over(order).alias("__r")).where(F.col("__r") <= n).select(id_col, F.lit(1).alias("__v"))
    return pool.join(val, id_col, "left").withColumn("split", F.when(F.col("__v") == 1, "val").otherwise("train")).drop("__v")


def random_split(ids: DataFrame, keys: Sequence[str], id_col: str, seed: str, ratios: dict[str, float] = RATIOS) -> DataFrame:
    """Split whole sources by rounded counts, separately per key (for example positives and negatives)."""
    ranked = hash_rank(ids, keys, seed, id_col)
    n = F.col("rank_total")
    n_train = F.least(F.bround(n * dbl(ratios["train"]), 0), n)
    n_val = F.least(F.bround(n * dbl(ratios["val"]), 0), n - n_train)
    split = F.when(F.col("rank") <= n_train, "train").when(F.col("rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("rank", "rank_total")


def stratified_group_split(groups: DataFrame, group: str = "group_id", seed: str = "groups", ratios: dict[str, float] = RATIOS) -> DataFrame:
    """Assign whole groups to splits so that every class keeps the ratios.

    ``groups``: group_id, class_id (NULL for groups without boxes), n boxes, images. The rarest class
    is served first, its groups in the order of largest contribution. Instead of placing one group
    after the other on one machine, the contributions are accumulated with bucketed running sums and
    the accumulated amount is cut in the proportions each split still needs; the larger groups of a
    class are dealt in blocks so that every split receives its share of them.
    """
    names = list(ratios)
    size = groups.groupBy(group).agg(F.max("images").alias("images"))
    boxes = checkpointed(groups.where(F.col("class_id").isNotNull()).groupBy(group, "class_id").agg(F.sum("n").alias("n")))
    totals = {r["class_id"]: r["n"] for r in boxes.groupBy("class_id").agg(F.sum("n").alias("n")).collect()}  # one row per class
    done: DataFrame | None = None
    for cls in sorted(totals, key=lambda c: (totals[c], c)):
        mine = boxes.where(F.col("class_id") == cls).select(group, "n").join(size, group)
        placed = {}
        if done is not None:
            got = boxes.where(F.col("class_id") == cls).join(done, group).groupBy("split").agg(F.sum("n").alias("n"))
            placed = {r["split"]: r["n"] for r in got.collect()}  # one row per split
            mine = mine.join(done, group, "left_anti")
        need = {s: max(totals[cls] * ratios[s] - placed.get(s, 0), 0.0) for s in names}
        part = _deal(mine, group, "n", need, f"{seed}:{cls}")
        done = checkpointed(part if done is None else done.unionByName(part))
    rest = size if done is None else size.join(done, group, "left_anti")
    counted = {} if done is None else {r["split"]: r["i"] for r in done.join(size, group).groupBy("split").agg(F.sum("images").alias("i")).collect()}
    all_images = size.agg(F.sum("images")).first()[0] or 0
    need = {s: max(all_images * ratios[s] - counted.get(s, 0), 0.0) for s in names}
    part = _deal(rest, group, "images", need, f"{seed}:none")
    return part if done is None else done.unionByName(part)


def _deal(pending: DataFrame, group: str, amount: str, need: dict[str, float], seed: str) -> DataFrame:
    """Cut the running amount, largest groups first, in the proportions of ``need``."""
    whole = sum(need.values())
    share = {s: (v / whole if whole > 0 else (1.0 if i == 0 else 0.0)) for i, (s, v) in enumerate(need.items())}
    src = pending.withColumns({"__k": F.lit(0), "__u": unit_hash(seed, group)})
    run = ordered_positions(src, ["__k"], amount, ["__u", group], {"__c": amount})  # equal amounts are cut again by their draw
    top = pending.agg(F.max(amount).alias("__top"))
    run = run.join(F.broadcast(top))  # one row
    # equal blocks of at least ten of the largest groups, so no partial block is left over
    block = dbl("__c_total") / F.greatest(dbl(1), F.floor(dbl("__c_total") / (10 * dbl("__top"))))
    middle = (F.col("__c") - F.col(amount) / 2) / block
    inside = middle - F.floor(middle)
    split: Column | None = None
    edge = 0.0
    for s in list(share)[:-1]:
        edge += share[s]
        cond = inside < dbl(edge)
        split = F.when(cond, s) if split is None else split.when(cond, s)
    return run.select(group, split.otherwise(list(share)[-1]).alias("split"))


# ---------------------------------------------------------------- sampling orders

def round_robin(df: DataFrame, stratum: str, n: int, seed: str, id_col: str = "frame_id") -> DataFrame:
    """n items drawn in turn from the strata."""
    order = Window.partitionBy(stratum).orderBy(order_key(seed, id_col), id_col)
    top = df.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n)
    return top.orderBy("turn", stratum).limit(n)


def rarest_first_order(frame_classes: DataFrame, seed: str, id_col: str = "frame_id") -> DataFrame:
    """Order frames in turn over their rarest class, rarer classes first in each turn.

    ``frame_classes``: frame_id, class_id (distinct). The position follows from the turn and the class
    sizes, so no global sort is needed.
    """
    freq = frame_classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("freq"))
    tagged = frame_classes.join(freq, "class_id")
    primary = tagged.groupBy(id_col).agg(F.min_by("class_id", F.struct("freq", "class_id")).alias("primary"))
    ranked = hash_rank(primary, ["primary"], seed, id_col, "turn")
    sizes = ranked.groupBy("primary").agg(F.max("turn").alias("size"))
    ordered = sizes.join(freq.withColumnRenamed("class_id", "primary"), "primary")
    items = ordered.agg(F.array_sort(F.collect_list(F.struct("freq", "primary", "size"))).alias("__s"))  # one entry per class
    out = ranked.join(F.broadcast(items))  # one row
    before = F.aggregate("__s", F.lit(0).cast("bigint"), lambda acc, s: acc + F.least(s["size"], F.col("turn") - 1))
    me = F.filter("__s", lambda s: s["primary"] == F.col("primary"))[0]
    same_turn = F.size(F.filter("__s", lambda s: (F.struct(s["freq"], s["primary"]) < F.struct(me["freq"], me["primary"])) & (s["size"] >= F.col("turn"))))
    return out.withColumn("position", before + same_turn + 1).drop("__s", "turn_total")


def tiles_per_source(tiles: DataFrame, k: int, seed: str, budget: int, source: str = "frame_id") -> DataFrame:
    """k random tiles of each source, up to a total budget in a reproducible order."""
    order = Window.partitionBy(source).orderBy(order_key(seed, source, "x0", "y0"))
    picked = tiles.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)
    return picked.withColumn("__o", order_key(seed, source)).orderBy("__o", source, "pick").limit(budget).drop("__o")


def to_budget(rows: DataFrame, order: Sequence[str], budget: int) -> DataFrame:
    """The first rows of an order, up to the budget."""
    return rows.orderBy(*order).limit(budget)


# ---------------------------------------------------------------- duplicates and leakage

def cross_split_duplicates(content: DataFrame, digest: str = "content_sha256") -> DataFrame:
    """Digests present in more than one split, and copies inside a split."""
    per = content.groupBy(digest, "split").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(digest).agg(
        F.sum("n").alias("copies"), F.count(F.lit(1)).alias("splits"), F.sum(F.col("n") - 1).alias("within_split_copies")
    ).where(F.col("copies") > 1)


def split_overlap(content: DataFrame, key: str, splits: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Number of shared keys for each pair of splits, zero pairs included.

    Keys are reduced to the set of splits they occur in; pairs come from that set of at most three.
    """
    sets = content.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s"))
    counts = sets.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1:]]
    cols = [F.sum(F.when(F.array_contains("s", a) & F.array_contains("s", b), F.col("n")).otherwise(0)).alias(f"{a}^{b}") for a, b in pairs]
    wide = counts.agg(*cols)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(f"{a}^{b}").alias("pair"), F.coalesce(F.col(f"`{a}^{b}`"), F.lit(0)).cast("bigint").alias("shared")) for a, b in pairs])))


def upstream_leakage(content: DataFrame, a: str = "train", b: str = "test", examples: int = 8) -> DataFrame:
    """How much an existing split leaks: shared sequences and digests, with a few examples."""
    def shared(key: str) -> DataFrame:
        return content.where(F.col("split").isin(a, b)).groupBy(key).agg(
            F.max((F.col("split") == a).cast("int")).alias("a"), F.max((F.col("split") == b).cast("int")).alias("b"))
    seq, dig = shared("sequence_id"), shared("content_sha256")
    both = (F.col("a") == 1) & (F.col("b") == 1)
    s = seq.agg(F.sum("a").alias("a_sequences"), F.sum("b").alias("b_sequences"), F.sum(both.cast("int")).alias("shared_sequences"))
    h = dig.agg(F.sum(both.cast("int")).alias("shared_hashes"))
    ex = seq.where(both).orderBy("sequence_id").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("sequence_id")), ",").alias("examples"))
    return s.join(F.broadcast(h)).join(F.broadcast(ex))  # one row each


def first_occurrence(rows: DataFrame, digest: str, order: Sequence[str]) -> DataFrame:
    """Exact dedup: of equal digests, the first in order stays (combined map-side)."""
    rest = [c for c in rows.columns if c not in (digest, *order)]
    best = rows.groupBy(digest).agg(F.min(F.struct(*order, *rest)).alias("__b"))
    return best.select(digest, "__b.*")


def label_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows on one side only, duplicates counted. Both sides are read and totalled once."""
    cols = expected.columns
    both = expected.withColumn("__n", F.lit(1)).union(found.select(*cols, F.lit(-1).alias("__n")))
    n = F.col("__n")
    odd = both.groupBy(*cols).agg(F.sum("__n").alias("__n")).where(n != 0)
    copies = odd.withColumn("side", F.when(n > 0, "expected").otherwise("found")).withColumn("__i", F.explode(F.sequence(F.lit(1), F.abs(n))))
    return copies.select(*cols, "side")


def assertions(checks: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """One (name, ok, detail) row per check; a check is a one-row table with ``bad`` and ``total``."""
    rows = [
        c.select(F.lit(n).alias("name"), (F.col("bad") == 0).alias("ok"), F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("total").cast("string")).alias("detail"))
        for n, c in checks
    ]
    return reduce(DataFrame.unionByName, rows)


def holdout_view(frames: DataFrame, held: Column, filter_splits: Sequence[str] = ("train", "val")) -> tuple[DataFrame, DataFrame]:
    """Training view without held-out sources in the chosen splits, and per-split statistics."""
    tagged = frames.withColumn("kept", ~(F.col("split").isin(*filter_splits) & held))
    stats = tagged.groupBy("split").agg(
        F.count(F.lit(1)).alias("images_in"), F.sum(F.col("kept").cast("int")).alias("images_kept"),
        F.sum((~F.col("kept")).cast("int")).alias("images_dropped"),
    )
    dropped = tagged.where(~F.col("kept")).select("split", "coil_id").distinct().groupBy("split").agg(F.count(F.lit(1)).alias("sources_dropped"))
    return tagged.where("kept").drop("kept"), stats.join(dropped, "split", "left").fillna(0)


def reconcile(counted: DataFrame, claimed: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Recounted against claimed values, rows missing on either side included."""
    c = counted.select(*on, F.col(value).alias("counted"))
    k = claimed.select(*on, F.col(value).alias("claimed"))
    return c.join(k, list(on), "full").withColumn("agrees", F.col("counted").eqNullSafe(F.col("claimed")))


def reproduction(published: DataFrame, recomputed: DataFrame, on: Sequence[str], value: str, exact: float = 1e-9) -> DataFrame:
    """Largest difference between published and recomputed values, and whether it is float noise."""
    j = published.select(*on, F.col(value).alias("p")).join(recomputed.select(*on, F.col(value).alias("r")), list(on))
    diff = F.max(F.abs(F.col("p") - F.col("r")))
    return j.agg(F.count(F.lit(1)).alias("cells"), diff.alias("max_abs_diff"), (diff < dbl(exact)).alias("exact"))
