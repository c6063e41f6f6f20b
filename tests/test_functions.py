import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from coilwise.functions import calibrators, geometry, hashing, names, severity, stats
from coilwise.operators import coil as c


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_severity_examples(spark):
    r = one(spark, severity.detection_score(F.lit("inclusion"), F.lit(1.0), F.lit(0.25)).alias("a"), severity.detection_score(F.lit("class_8"), F.lit(0.0), F.lit(0.0)).alias("b"),
            severity.severity_band(F.lit(30.0)).alias("c"), severity.severity_band(F.lit(29.99)).alias("d"), severity.class_name(F.lit(12)).alias("e"), severity.class_name(F.lit(-1)).alias("f"))
    assert tuple(r) == (100.0, 21.0, "medium", "low", "class_12", "(no labelled defect)")


def test_noisy_or(spark):
    df = spark.createDataFrame([(1, 1, 50.0), (2, 1, 50.0), (2, 2, 40.0), (3, 1, 100.0), (3, 2, 10.0)], "frame_id bigint, det_id bigint, score double")
    out = {r.frame_id: r.severity_score for r in c.noisy_or(df).collect()}
    assert out[1] == pytest.approx(50) and out[2] == pytest.approx(100 * (1 - 0.5 * (1 - 0.4 * 0.6))) and out[3] == 100


def test_many_boxes_saturate_without_collecting(spark):
    df = spark.range(5000).select(F.lit(1).cast("bigint").alias("frame_id"), F.col("id").alias("det_id"), F.lit(20.0).alias("score"))
    want = 1.0
    for r in range(200):
        want *= 1 - 0.2 * 0.6 ** r
    assert c.noisy_or(df).first()["severity_score"] == pytest.approx(100 * (1 - want), abs=1e-9)


def test_wilson(spark):
    r = one(spark, stats.wilson(F.lit(0), F.lit(0)).alias("a"), stats.wilson(F.lit(5), F.lit(10)).alias("b"))
    assert tuple(r["a"]) == (0.0, 0.0) and r["b"]["lo"] == pytest.approx(0.2366, abs=1e-4) and r["b"]["hi"] == pytest.approx(0.7634, abs=1e-4)


def test_holdouts(spark):
    ids = spark.range(2000).withColumn("s", F.col("id").cast("string"))
    out = ids.select("s", hashing.blake2b_holdout("seed", 0.5, "s").alias("h"), hashing.in_holdout("x", 0.2, "id").alias("a"), hashing.in_holdout("x", 0.6, "id").alias("b")).collect()
    for r in out[:50]:
        want = int.from_bytes(hashlib.blake2b(f"seed:{r.s}".encode(), digest_size=8).digest(), "big") / 2**64 < 0.5
        assert r.h == want
    assert all(r.b for r in out if r.a) and abs(sum(r.a for r in out) - 400) < 80


def test_names(spark):
    r = one(spark, names.class_of(F.lit("rolled-in_scale_42")).alias("a"), names.class_of(F.lit("other_1")).alias("b"),
            names.sequence_id(names.original_stem(F.lit("img_03_425005700_00156_jpg.rf.ab.jpg"))).alias("c"), names.crop_offset(F.lit("sev_0a1b_x0064")).alias("d"), names.source_frame(F.lit("crazing_1")).alias("e"))
    assert tuple(r) == ("rolled-in_scale", None, "425005700", 64, None)


def test_unknown_calibration_method_fails(spark):
    with pytest.raises(Exception, match="unknown calibration method"):
        spark.range(1).select(calibrators.parametric(F.lit(0.5), "magic")).collect()


def test_clamp_and_clip(spark):
    df = spark.createDataFrame([(-5.0, 10.0, 250.0, 260.0), (300.0, 0.0, 310.0, 5.0)], "x1 double, y1 double, x2 double, y2 double")
    rows = [tuple(r) for r in df.withColumns(geometry.clamp_box(F.lit(200), F.lit(200))).collect()]
    assert rows == [(0.0, 10.0, 200.0, 200.0), (200.0, 0.0, 200.0, 5.0)]
    assert one(spark, geometry.corner_box_to_centre(F.lit(199.5), F.lit(0), F.lit(30), F.lit(10), F.lit(200), F.lit(200)).alias("b"))["b"] is None


def test_disposition_rules(spark):
    base = dict(defect_rate=0.0, p95_severity=0.0, frames_critical=0, frames_high=0, flag_class_frames=0)
    cases = [({}, "ACCEPT"), ({"defect_rate": 0.25}, "DOWNGRADE"), ({"defect_rate": 0.26}, "HOLD"), ({"p95_severity": 70.0}, "HOLD"), ({"p95_severity": 30.0}, "ACCEPT"),
             ({"frames_critical": 1}, "HOLD"), ({"frames_high": 1}, "DOWNGRADE"), ({"flag_class_frames": 1}, "HOLD")]
    df = spark.createDataFrame([{**base, **k, "i": i} for i, (k, _) in enumerate(cases)])
    got = {r.i: r.disposition for r in c.disposition(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    rules = spark.createDataFrame([("thin", 0.5, 99.0, 0.9, 99.0, 9, "inclusion", 9)], "line string, accept_max_defect_rate double, accept_max_p95 double, hold_min_defect_rate double, hold_min_p95 double, hold_min_critical_frames int, hold_class string, hold_class_frame_limit int")
    lined = df.where("i = 2").withColumn("line", F.lit("thin"))
    assert c.disposition(lined, rules, ["line"]).first()["disposition"] == "ACCEPT"


def test_empty_frames_keep_schema(spark):
    frames = spark.createDataFrame([], "frame_id bigint, coil_id bigint, width int, height int, total_ms double")
    dets = spark.createDataFrame([], "frame_id bigint, det_id bigint, class_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    res = c.frame_results(frames, dets)
    assert len(c.frame_export(res, "m", 0.1, 0.4).columns) == 15 and c.disposition(c.coil_stats(res)).count() == 0


def test_md5_prefixes_equal_hashlib():
    from coilwise.functions.hashing import md5_prefixes

    rng = np.random.default_rng(2)
    heads = [f"seed:{v}:60:".encode() for v in (0, 7, -12, 99, 12345, 10**18, "x" * 60, "é")]
    tails = [b"%d:%d" % (x, y) for x in (0, 5, 130, 99990) for y in (0, 10, 1000)]
    head, tail = rng.integers(0, len(heads), 20_000), rng.integers(0, len(tails), 20_000)
    want = [int(hashlib.md5(heads[h] + tails[t]).hexdigest()[:16], 16) for h, t in zip(head, tail, strict=True)]
    assert md5_prefixes(heads, tails, head, tail).tolist() == want
