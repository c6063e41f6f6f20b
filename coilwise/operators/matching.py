"""Box joins, greedy claims, suppression and parity.

Boxes compete only inside a group such as (frame, class). Groups up to ``SMALL_GROUP`` boxes are
folded in one Catalyst ``aggregate`` over the pairs that pass the IoU test. Larger groups are never
collected: they are joined on a spatial grid and resolved in rounds, each a few joins and
aggregations, with a reliable checkpoint between rounds. Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import SIDES, contains, dbl, iou, overlaps
from ..session import checkpointed

SMALL_GROUP = 300  # boxes per group and side; bounds a folded group to 300 x 300 pairs
GRID_CELL_PX = 64


# ---------------------------------------------------------------- joins

def prefixed(df: DataFrame, prefix: str, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """Keep the keys, prefix everything else that is named."""
    return df.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in (*extra, *SIDES)])


def grid_cells(df: DataFrame, prefix: str, cell: int = GRID_CELL_PX) -> DataFrame:
    """Repeat a box for each grid cell it covers, boundaries included."""
    span = lambda a, b: F.sequence(F.floor(F.col(f"{prefix}{a}") / cell), F.floor(F.col(f"{prefix}{b}") / cell))
    return df.withColumn("cell_x", F.explode(span("x1", "x2"))).withColumn("cell_y", F.explode(span("y1", "y2")))


def grid_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], pa: str, pb: str, cell: int = GRID_CELL_PX) -> DataFrame:
    """Overlapping pairs of two prefixed box sets in the same group.

    The grid cell is part of the join key, so a crowded group spreads over many tasks. A pair is
    emitted only in the cell holding the corner of its intersection, hence exactly once.
    """
    on = [*keys, "cell_x", "cell_y"]
    # dealt by cell, also where the sides are dealt by group already
    left, right = (grid_cells(df, p, cell).repartition(*on) for df, p in ((a, pa), (b, pb)))
    home = (F.col("cell_x") == F.floor(F.greatest(f"{pa}x1", f"{pb}x1") / cell)) & (
        F.col("cell_y") == F.floor(F.greatest(f"{pa}y1", f"{pb}y1") / cell)
    )
    return left.join(right, on).where(home & overlaps(pa, pb)).drop("cell_x", "cell_y")


def crowded_groups(sides: Sequence[DataFrame], keys: Sequence[str], limit: int) -> DataFrame:
    """Groups with more than ``limit`` boxes on either side (counted with map-side combining)."""
    parts = [s.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*keys) for s in sides]
    return reduce(DataFrame.unionByName, parts).distinct()


def _has_rows(df: DataFrame) -> bool:
    return len(df.take(1)) > 0


def box_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_cols: Sequence[str], right_cols: Sequence[str],
    min_iou: float, crowded: DataFrame | None = None, strict: bool = False,
) -> DataFrame:
    """IoU join: pairs in the same group with IoU >= ``min_iou`` (or > when strict).

    Ordinary groups use a plain equi-join. Groups listed in ``crowded`` take the grid join.
    """
    keys = list(keys)
    a, b = prefixed(left, "a_", keys, left_cols), prefixed(right, "b_", keys, right_cols)
    if crowded is None:
        pairs = a.join(b, keys)
    else:
        calm = a.join(crowded, keys, "left_anti").join(b.join(crowded, keys, "left_anti"), keys)
        hot = grid_pairs(a.join(crowded, keys, "left_semi"), b.join(crowded, keys, "left_semi"), keys, "a_", "b_")
        pairs = calm.unionByName(hot)
    value = iou("a_", "b_")
    keep = value > dbl(min_iou) if strict else value >= dbl(min_iou)
    cond = keep & overlaps("a_", "b_") if min_iou > 0 else keep
    return pairs.where(cond).withColumn("iou", value)


# ---------------------------------------------------------------- greedy matching

def greedy_match(
    dets: DataFrame, gts: DataFrame, keys: Sequence[str] = ("frame_id", "class_id"), min_iou: float = 0.5,
    gt_keys: Sequence[str] | None = None, small_group: int = SMALL_GROUP, iou_grid: Sequence[float] | None = None,
) -> DataFrame:
    """Greedy claims: detections in the order (conf desc, det_id) take the best free box of their group.

    ``keys`` group the detections (they may hold a model name, for example); ``gt_keys`` are the ones the
    labels have as well. Returns keys, det_id, box_id, conf, iou (and ``iou_thr`` with ``iou_grid``).
    """
    keys = list(keys)
    shared = list(gt_keys) if gt_keys is not None else keys
    floor = min(iou_grid) if iou_grid else min_iou
    crowded = crowded_groups([dets.select(*shared), gts.select(*shared)], shared, small_group)
    hot = _has_rows(crowded)
    extra = [k for k in keys if k not in shared]
    pairs = box_pairs(dets, gts, shared, [*extra, "det_id", "conf"], ["box_id"], floor, crowded if hot else None)
    pairs = pairs.select(
        *shared, *[F.col(f"a_{k}").alias(k) for k in extra],
        F.col("a_det_id").alias("det_id"), F.col("a_conf").alias("conf"), F.col("b_box_id").alias("box_id"), "iou",
    )
    group = list(keys)
    if iou_grid:
        grid = F.array(*[dbl(v) for v in iou_grid])
        pairs = pairs.withColumn("iou_thr", F.explode(F.filter(grid, lambda t: t <= F.col("iou"))))
        group.append("iou_thr")
    if not hot:
        return _fold_claims(pairs, group)
    calm = _fold_claims(pairs.join(crowded, shared, "left_anti"), group)
    rounds = claim_rounds(pairs.join(crowded, shared, "left_semi"), group)
    return calm.unionByName(rounds)


def _fold_claims(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """Walk the sorted pairs of a small group once, keeping a pair when both sides are still free."""
    item = F.struct(
        (-F.col("conf")).alias("o"), F.col("det_id"), (-F.col("iou")).alias("i"), F.col("box_id")
    )
    ordered = F.array_sort(F.collect_list(item))
    empty = F.array().cast("array<struct<o:double,det_id:bigint,i:double,box_id:bigint>>")

    def step(kept: Column, p: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["det_id"] == p["det_id"]) | (k["box_id"] == p["box_id"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(p)))

    walked = pairs.groupBy(*group).agg(ordered.alias("__p"))
    # one candidate pair needs no walk
    kept = F.when(F.size("__p") == 1, F.col("__p")).otherwise(F.aggregate("__p", empty, step))
    return walked.select(*group, F.inline(kept)).select(
        *group, "det_id", "box_id", (-F.col("o")).alias("conf"), (-F.col("i")).alias("iou")
    )


def claim_rounds(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """The same claims for groups of any size, in rounds.

    A pair is final when the box is the detection's best free box and no stronger detection wants
    that box. The strongest remaining detection always settles, so the rounds end; nothing is cut.
    """
    group = list(group)
    rest = checkpointed(pairs)
    done: list[DataFrame] = []
    while _has_rows(rest):
        best_box = rest.groupBy(*group, "det_id").agg(
            F.max_by("box_id", F.struct(F.col("iou"), (-F.col("box_id")).alias("b"))).alias("box_id"),
        )
        best_det = rest.groupBy(*group, "box_id").agg(
            F.max_by("det_id", F.struct(F.col("conf"), (-F.col("det_id")).alias("d"))).alias("det_id"),
        )
        final = checkpointed(best_box.join(best_det, [*group, "det_id", "box_id"]))
        done.append(final.join(rest, [*group, "det_id", "box_id"]).select(*group, "det_id", "box_id", "conf", "iou"))
        rest = checkpointed(
            rest.join(final.select(*group, "det_id"), [*group, "det_id"], "left_anti")
            .join(final.select(*group, "box_id"), [*group, "box_id"], "left_anti")
        )
    if not done:
        return rest.select(*group, "det_id", "box_id", "conf", "iou")
    return reduce(DataFrame.unionByName, done)


def flag_matches(dets: DataFrame, matches: DataFrame, keys: Sequence[str] = ("frame_id", "class_id")) -> DataFrame:
    """Detections with ``is_tp``; every detection stays."""
    hit = matches.select(*keys, "det_id").withColumn("is_tp", F.lit(True))
    return dets.join(hit, [*keys, "det_id"], "left").withColumn("is_tp", F.coalesce("is_tp", F.lit(False)))


def flag_found(gts: DataFrame, matches: DataFrame, keys: Sequence[str] = ("frame_id", "class_id")) -> DataFrame:
    """Labels with ``found``; every label stays."""
    hit = matches.select(*keys, "box_id").withColumn("found", F.lit(True))
    return gts.join(hit, [*keys, "box_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


# ---------------------------------------------------------------- suppression

def suppress(
    boxes: DataFrame, group: Sequence[str], rank: Sequence[Column], id_col: str, max_iou: float,
    inclusive: bool = False, small_group: int = SMALL_GROUP, first: int | None = None,
) -> DataFrame:
    """Greedy suppression: walk by ``rank`` and drop a box overlapping a kept one too much.

    ``first`` lets a small group stop after that many kept boxes; a caller that wants exactly the
    first ones still ranks the result, because crowded groups return all kept boxes.

    A box goes when IoU > ``max_iou`` with a kept box (>= when ``inclusive``). ``rank`` are sort
    columns, smallest first; they become one struct so the order is total.
    """
    group = list(group)
    ranked = boxes.withColumn("__rank", F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], F.col(id_col).alias("id")))
    crowded = crowded_groups([boxes.select(*group)], group, small_group)
    if not _has_rows(crowded):
        return _fold_suppress(ranked, group, id_col, max_iou, inclusive, first).drop("__rank")
    calm = _fold_suppress(ranked.join(crowded, group, "left_anti"), group, id_col, max_iou, inclusive, first)
    hot = suppress_rounds(ranked.join(crowded, group, "left_semi"), group, id_col, max_iou, inclusive)
    return calm.unionByName(hot.select(calm.columns)).drop("__rank")


def _too_close(a: str, b: str, max_iou: float, inclusive: bool) -> Column:
    v = iou(a, b)
    return v >= dbl(max_iou) if inclusive else v > dbl(max_iou)


def _fold_suppress(
    ranked: DataFrame, group: Sequence[str], id_col: str, max_iou: float, inclusive: bool, first: int | None = None
) -> DataFrame:
    """Small groups: one array per group, folded while carrying the kept boxes."""
    cols = [c for c in ranked.columns if c not in group]
    item = F.struct("__rank", *[c for c in cols if c != "__rank"])
    arr = ranked.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("__a"))

    def far_from(kept: Column, b: Column) -> Column:
        def clash(k: Column) -> Column:
            iw = F.least(k["x2"], b["x2"]) - F.greatest(k["x1"], b["x1"])
            ih = F.least(k["y2"], b["y2"]) - F.greatest(k["y1"], b["y1"])
            inter = F.greatest(dbl(0), iw) * F.greatest(dbl(0), ih)
            size = lambda r: F.greatest(dbl(0), r["x2"] - r["x1"]) * F.greatest(dbl(0), r["y2"] - r["y1"])
            union = size(k) + size(b) - inter
            value = F.when(union > 0, inter / union).otherwise(dbl(0))
            return value >= dbl(max_iou) if inclusive else value > dbl(max_iou)
        return ~F.exists(kept, clash)

    start = F.slice(F.col("__a"), 1, 1)
    rest = F.slice(F.col("__a"), 2, F.greatest(F.size("__a") - 1, F.lit(0)))
    def step(k: Column, b: Column) -> Column:
        more = F.when(far_from(k, b), F.concat(k, F.array(b))).otherwise(k)
        return more if first is None else F.when(F.size(k) >= first, k).otherwise(more)

    kept = F.when(F.size("__a") == 1, F.col("__a")).otherwise(F.aggregate(rest, start, step))
    return arr.select(*group, F.inline(kept))


def suppress_rounds(
    ranked: DataFrame, group: Sequence[str], id_col: str, max_iou: float, inclusive: bool, cell: int = GRID_CELL_PX
) -> DataFrame:
    """Suppression for groups of any size, linear per round.

    A box that is first by rank in each grid cell it covers overlaps nothing stronger, so it is kept.
    Kept boxes (at most one per cell) are then joined to the undecided ones of the cell to drop those
    they suppress. No all-pairs list is built.
    """
    group = list(group)
    open_ = checkpointed(ranked)
    kept: list[DataFrame] = []
    while _has_rows(open_):
        cells = grid_cells(open_, "", cell)
        leaders = cells.groupBy(*group, "cell_x", "cell_y").agg(F.min("__rank").alias("__lead"))
        led = cells.join(leaders, [*group, "cell_x", "cell_y"])
        winners = led.groupBy(*group, id_col).agg(F.min((F.col("__rank") == F.col("__lead")).cast("int")).alias("__w")).where("__w = 1")
        keep = checkpointed(open_.join(winners.select(*group, id_col), [*group, id_col]).select(ranked.columns))
        kept.append(keep)
        strong = grid_cells(prefixed(keep, "k_", group, ["__rank"]), "k_", cell)
        weak = grid_cells(prefixed(open_, "o_", group, [id_col]), "o_", cell)
        gone = (
            strong.join(weak, [*group, "cell_x", "cell_y"]).where(_too_close("k_", "o_", max_iou, inclusive))
            .select(*group, F.col(f"o_{id_col}").alias(id_col)).distinct()
        )
        settled = gone.unionByName(keep.select(*group, id_col)).distinct()
        open_ = checkpointed(open_.join(settled, [*group, id_col], "left_anti").select(ranked.columns))
    return reduce(DataFrame.unionByName, kept) if kept else open_


def nms(dets: DataFrame, keys: Sequence[str] = ("frame_id", "class_id"), max_iou: float = 0.45, small_group: int = SMALL_GROUP) -> DataFrame:
    """Class-aware suppression of overlapping detections (confidence desc, then id)."""
    return suppress(dets, keys, [-F.col("conf")], "det_id", max_iou, small_group=small_group)


# ---------------------------------------------------------------- parity of two detectors

def parity_pairs(ref: DataFrame, cand: DataFrame, min_iou: float = 0.9, small_group: int = SMALL_GROUP) -> DataFrame:
    """Pair the boxes of two detectors frame by frame.

    Reference boxes walk by confidence; each looks at its best free candidate of any class and pairs
    with it only at IoU >= ``min_iou`` and equal class. A candidate below the limit ends the search,
    so only pairs at or above it matter; a class mismatch there ends the search as well.
    """
    key = ["frame_id"]
    crowded = crowded_groups([ref.select(*key), cand.select(*key)], key, small_group)
    hot = _has_rows(crowded)
    cols = ["det_id", "class_id", "conf", *SIDES]
    a, b = ref.select("frame_id", *cols), cand.select("frame_id", *cols)
    keep = ["det_id", "class_id", "conf"]
    pairs = box_pairs(
        a.withColumns({f"p_{s}": F.col(s) for s in SIDES}), b.withColumns({f"p_{s}": F.col(s) for s in SIDES}),
        key, [*keep, *[f"p_{s}" for s in SIDES]], [*keep, *[f"p_{s}" for s in SIDES]], min_iou, crowded if hot else None,
    )
    delta = F.greatest(*[F.abs(F.col(f"a_p_{s}") - F.col(f"b_p_{s}")) for s in SIDES])
    pairs = pairs.select(
        "frame_id", F.col("a_det_id").alias("det_id"), F.col("a_conf").alias("conf"), F.col("b_det_id").alias("box_id"), "iou",
        (F.col("a_class_id") == F.col("b_class_id")).alias("same"), delta.alias("box_delta"),
        F.abs(F.col("a_conf") - F.col("b_conf")).alias("conf_delta"),
    )
    calm = pairs.join(crowded, key, "left_anti") if hot else pairs
    out = _fold_parity(calm)
    return out.unionByName(_parity_rounds(pairs.join(crowded, key, "left_semi"))) if hot else out


_PAIR = "array<struct<o:double,det_id:bigint,i:double,box_id:bigint,same:boolean,box_delta:double,conf_delta:double>>"


def _fold_parity(pairs: DataFrame) -> DataFrame:
    item = F.struct(
        (-F.col("conf")).alias("o"), "det_id", (-F.col("iou")).alias("i"), "box_id", "same", "box_delta", "conf_delta"
    )
    # state: accepted pairs, and the reference box whose search has ended
    start = F.struct(F.array().cast(_PAIR).alias("kept"), F.lit(-1).cast("bigint").alias("closed"))

    def step(s: Column, p: Column) -> Column:
        skip = (p["det_id"] == s["closed"]) | F.exists(s["kept"], lambda k: k["box_id"] == p["box_id"])
        take = F.when(p["same"], F.concat(s["kept"], F.array(p))).otherwise(s["kept"])
        return F.when(skip, s).otherwise(F.struct(take.alias("kept"), p["det_id"].alias("closed")))

    grouped = pairs.groupBy("frame_id").agg(F.array_sort(F.collect_list(item)).alias("__p"))
    folded = grouped.select("frame_id", F.aggregate("__p", start, step, lambda s: s["kept"]).alias("__k"))
    return folded.select("frame_id", F.inline("__k")).select(
        "frame_id", "det_id", "box_id", (-F.col("i")).alias("iou"), "box_delta", "conf_delta"
    )


def _parity_rounds(pairs: DataFrame) -> DataFrame:
    """Crowded frames: settle each reference box once no stronger one wants its best free candidate."""
    key = ["frame_id"]
    rest, done = checkpointed(pairs), []
    while _has_rows(rest):
        best = rest.groupBy(*key, "det_id").agg(F.max_by("box_id", F.struct(F.col("iou"), (-F.col("box_id")).alias("b"))).alias("box_id"))
        lead = rest.groupBy(*key, "box_id").agg(F.max_by("det_id", F.struct(F.col("conf"), (-F.col("det_id")).alias("d"))).alias("det_id"))
        final = checkpointed(best.join(lead, [*key, "det_id", "box_id"]).join(rest, [*key, "det_id", "box_id"]))
        taken = final.where("same")
        done.append(taken.select(*key, "det_id", "box_id", "iou", "box_delta", "conf_delta"))
        rest = checkpointed(
            rest.join(final.select(*key, "det_id"), [*key, "det_id"], "left_anti")
            .join(taken.select(*key, "box_id"), [*key, "box_id"], "left_anti")
        )
    return reduce(DataFrame.unionByName, done) if done else rest.select(*key, "det_id", "box_id", "iou", "box_delta", "conf_delta")


def parity_report(frames: DataFrame, ref: DataFrame, cand: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per frame: counts, largest differences, and a verdict."""
    count = lambda df, name: df.groupBy("frame_id").agg(F.count(F.lit(1)).alias(name))
    matched = pairs.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("n_matched"), F.max("box_delta").alias("max_box_delta"),
        F.max("conf_delta").alias("max_conf_delta"), F.min("iou").alias("min_iou"),
    )
    out = frames.select("frame_id").join(count(ref, "n_ref"), "frame_id", "left").join(count(cand, "n_cand"), "frame_id", "left")
    out = out.join(matched, "frame_id", "left").fillna(0, subset=["n_ref", "n_cand", "n_matched"])
    same = (F.col("n_ref") == F.col("n_cand")) & (F.col("n_ref") == F.col("n_matched"))
    verdict = (
        F.when((F.col("n_ref") == 0) & (F.col("n_cand") == 0), "inconclusive")
        .when(same, "identical").otherwise("differ")
    )
    return out.withColumn("verdict", verdict)


# ---------------------------------------------------------------- relations between boxes

def clear_of(crops: DataFrame, boxes: DataFrame, margin: float, on: Sequence[str] = ("frame_id",)) -> DataFrame:
    """Crops whose surroundings, grown by ``margin``, touch no box of the same frame.

    Crops carry x1..y2; both sides meet on a grid cell, so a crowded frame spreads over tasks.
    """
    on = list(on)
    ids = [c for c in crops.columns if c not in SIDES]
    grown = crops.select(
        *ids, (F.col("x1") - margin).alias("c_x1"), (F.col("y1") - margin).alias("c_y1"),
        (F.col("x2") + margin).alias("c_x2"), (F.col("y2") + margin).alias("c_y2"),
    )
    blocked = touching(grown, boxes, on).select(*ids).distinct()
    return crops.join(blocked, ids, "left_anti")


def touching(crops: DataFrame, boxes: DataFrame, on: Sequence[str] = ("frame_id",), cell: int = GRID_CELL_PX) -> DataFrame:
    """(crop, box) rows with positive overlap; crops are prefixed ``c_`` and boxes ``b_``."""
    b = boxes.select(*on, *[F.col(c).alias(f"b_{c}") for c in boxes.columns if c not in on])
    return grid_pairs(crops, b, on, "c_", "b_", cell)


def fully_inside(crops: DataFrame, boxes: DataFrame, on: Sequence[str] = ("frame_id",)) -> DataFrame:
    """(crop, box) rows where the crop holds the whole box."""
    return touching(crops, boxes, on).where(contains("c_", "b_"))
