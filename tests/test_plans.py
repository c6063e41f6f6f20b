import pytest
from pyspark.sql import functions as F

from coilwise.plans.clean_surface import mine_patches, operating_point
from coilwise.plans.coil_report import coil_report
from coilwise.plans.evaluate import evaluate
from coilwise.sources import tables as t


def test_evaluate(spark, sf):
    f, g, d = t.frames(spark, sf), t.gt_boxes(spark, sf), t.detections(spark, sf)
    with pytest.raises(ValueError):
        evaluate(f, g, d, "val", "val")
    ev = evaluate(f, g, d, floor=0.5)
    assert 0.05 <= ev.threshold <= 0.95 and ev.held_out.count() == 1 and ev.class_report.count() == 6 and ev.gallery.count() > 0


def test_clean_surface(spark, sf):
    f, g = t.frames(spark, sf), t.gt_boxes(spark, sf)
    few = f.where("frame_id < 40")
    clean, defect = mine_patches(few, g.where("frame_id < 40"))
    assert clean.count() > 0 and defect.count() > 0
    scored = clean.select(F.xxhash64("frame_id", "size", "x0", "y0").alias("patch_id"), F.col("frame_id").alias("source_id"), "size", ((F.col("x0") + F.col("frame_id") * 7) % 100 / 100.0).alias("max_conf"))
    pts = spark.createDataFrame([(0.1, 0.99), (0.5, 0.95), (0.9, 0.5)], "threshold double, detection_rate double")
    out = {r.basis: r for r in operating_point(scored, pts, 40000.0).collect()}
    assert set(out) == {"patch", "frame"} and all(r.floor_met for r in out.values()) and out["patch"].threshold == 0.5


def test_coil_report(spark, sf, tmp_path):
    rep = coil_report(t.frames(spark, sf), t.detections(spark, sf), 0.96)
    rep.write(str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "coils")).count() == rep.coils.count()
    assert spark.read.parquet(str(tmp_path / "report" / "frames")).count() == t.frames(spark, sf).count()


def test_detections_are_numbered_in_one_sort(spark):
    """Numbers follow confidence, then id; rows are sorted once and not totalled, also where one frame holds most of them."""
    from coilwise.operators import coil as op

    rows = [(i % 40 and 1, i, 0.01 * (i * 7 % 50)) for i in range(2000)]
    boxes = spark.createDataFrame(rows, "frame_id bigint, det_id bigint, conf double").selectExpr(
        "*", "0 AS class_id", "'patches' AS class_name", "'low' AS band", "1D AS x1", "1D AS y1", "9D AS x2", "9D AS y2", "64D AS area_px", "0.1D AS area_frac")
    out = op.detection_export(boxes)
    assert "HashAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.frame, r.detection): r.confidence for r in out.collect()}
    for f in (0, 1):
        want = sorted((-c, i) for k, i, c in rows if k == f)
        assert [got[f, n + 1] for n in range(len(want))] == [round(-c, 4) for c, _ in want]
