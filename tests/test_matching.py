import random

import pytest
from pyspark.sql import functions as F

from coilwise.operators import matching as m
from coilwise.sources import tables as t

KEYS = ["frame_id", "class_id"]


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    i = w * h
    return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)


@pytest.fixture(scope="module")
def crowd(spark):
    """Two frames; the first holds most boxes, many of them on top of each other."""
    rnd = random.Random(5)
    def box():
        x, y = rnd.randrange(0, 90), rnd.randrange(0, 60)
        return x, y, x + rnd.randrange(10, 40), y + rnd.randrange(10, 40)
    dets = [(1 if i < 150 else 2, i % 2, i, rnd.randrange(1, 40) / 40, *map(float, box())) for i in range(180)]
    gts = [(1 if i < 60 else 2, i % 2, i, *map(float, box())) for i in range(75)]
    d = spark.createDataFrame(dets, "frame_id bigint, class_id int, det_id bigint, conf double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame(gts, "frame_id bigint, class_id int, box_id bigint, x1 double, y1 double, x2 double, y2 double")
    return dets, gts, d, g


def brute_match(dets, gts, thr):
    out, taken = set(), set()
    for d in sorted(dets, key=lambda r: (-r[3], r[2])):
        best = max(((iou(d[4:], g[3:]), -g[2]) for g in gts if g[:2] == d[:2] and g[2] not in taken), default=(0, 0))
        if best[0] >= thr:
            taken.add(-best[1])
            out.add((d[2], -best[1]))
    return out


@pytest.mark.parametrize("small", [0, 40, 300])
def test_greedy_match_equals_brute_force(crowd, small):
    dets, gts, d, g = crowd
    got = {(r.det_id, r.box_id) for r in m.greedy_match(d, g, small_group=small).collect()}
    assert got == brute_match(dets, gts, 0.5)


def test_match_grid_is_match_per_threshold(crowd):
    dets, gts, d, g = crowd
    rows = m.greedy_match(d, g, iou_grid=(0.5, 0.7, 0.8)).collect()
    for thr in (0.5, 0.7, 0.8):
        assert {(r.det_id, r.box_id) for r in rows if r.iou_thr == thr} == brute_match(dets, gts, thr)


@pytest.mark.parametrize("small", [0, 300])
@pytest.mark.parametrize("inclusive", [False, True])
def test_suppression_equals_brute_force(crowd, small, inclusive):
    dets, _, d, _ = crowd
    keep = {}
    for r in sorted(dets, key=lambda r: (-r[3], r[2])):
        mine = keep.setdefault(r[:2], [])
        clash = (lambda v: v >= 0.3) if inclusive else (lambda v: v > 0.3)
        if not any(clash(iou(r[4:], k[4:])) for k in mine):
            mine.append(r)
    want = {r[2] for v in keep.values() for r in v}
    got = m.suppress(d, KEYS, [-F.col("conf")], "det_id", 0.3, inclusive=inclusive, small_group=small)
    assert {r.det_id for r in got.collect()} == want


@pytest.mark.parametrize("small", [0, 300])
def test_parity_same_in_folds_and_rounds(spark, sf, small):
    a, b = t.detections(spark, sf), t.detections(spark, sf, "B")
    want = {(r.frame_id, r.det_id, r.box_id) for r in m.parity_pairs(a, b).collect()}
    one = b.where("frame_id % 7 = 0")
    half = {w for w in want if w[0] % 7 == 0}
    got = {(r.frame_id, r.det_id, r.box_id) for r in m.parity_pairs(a.where("frame_id % 7 = 0"), one, small_group=small).collect()}
    assert got == half


def test_identical_detections_are_identical(spark, sf):
    a = t.detections(spark, sf)
    rep = m.parity_report(t.frames(spark, sf), a, a, m.parity_pairs(a, a))
    assert {r[0] for r in rep.select("verdict").distinct().collect()} <= {"identical", "inconclusive"}


def test_grid_pairs_equal_plain_join(crowd):
    dets, gts, d, g = crowd
    a, b = m.prefixed(d, "a_", ["frame_id"], ["det_id"]), m.prefixed(g, "b_", ["frame_id"], ["box_id"])
    got = [(r.a_det_id, r.b_box_id) for r in m.grid_pairs(a, b, ["frame_id"], "a_", "b_", cell=16).collect()]
    want = [(x[2], y[2]) for x in dets for y in gts if x[0] == y[0] and iou(x[4:], y[3:]) > 0]
    assert sorted(got) == sorted(want)


def test_empty_inputs_keep_schema(crowd):
    _, _, d, g = crowd
    none = d.where("false")
    assert m.greedy_match(none, g).count() == 0
    assert m.nms(none).columns == d.select("frame_id", "class_id", *[c for c in d.columns if c not in KEYS]).columns


def test_rows_dealt_by_frame_are_matched_where_they_lie(spark, sf):
    """Claims, flags and counts of labels need no shuffle beyond the one by frame that the tables bring."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dets, gts = t.detections(spark, sf), t.gt_boxes(spark, sf)
        hits = m.greedy_match(dets, gts)
        for df in (hits, m.flag_matches(dets, hits), m.flag_found(gts, hits), m.crowded_groups([dets, gts], KEYS, 300).groupBy(*KEYS).count()):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("Exchange SinglePartition, ENSURE_REQUIREMENTS", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
