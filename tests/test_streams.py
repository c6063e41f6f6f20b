"""Coil close with state and timers: repeated, late and replayed frames, and every limit of the rule."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coilwise.operators import coil as op
from coilwise.streaming import coils as live

HOUR = 3600


def frame(coil, i, at, severity=0.0, flag=0, ms=5.0):
    band = "clean" if severity == 0 else next((b for b, top in (("low", 30), ("medium", 55), ("high", 80)) if severity < top), "critical")
    return (coil, i, at + HOUR, "DEFECT" if severity else "PASS", int(severity > 0), float(severity), band, flag, ms)


def write(spark, folder, rows):
    cols = live.FRAME.replace("ts timestamp", "s bigint")
    spark.createDataFrame(rows, cols).withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1).write.mode("append").parquet(folder)


def run(spark, at, rows):
    write(spark, f"{at}/frames", rows)
    live.publish(live.close_coils(live.read_frames(spark, f"{at}/frames")), f"{at}/closed", f"{at}/ckpt")
    return {r.coil_id: r for r in live.published(spark, f"{at}/closed").collect()}


@pytest.fixture
def at(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    live.state_in_rocksdb(spark)
    yield str(tmp_path)
    spark.conf.set(key, before)


def test_every_limit_and_reason(spark, at):
    rng = np.random.default_rng(1)
    severities = {
        1: [0.0] * 60, 2: [40.0] * 20 + [0.0] * 40, 3: [29.0] + [0.0] * 99, 4: [81.0] + [0.0] * 99, 5: [20.0] * 2 + [0.0] * 98, 6: [60.0] + [0.0] * 99,
        7: [75.0] * 10 + [0.0] * 90, 8: [33.0] * 6 + [0.0] * 60, 9: list(np.round(rng.uniform(1, 60, 50), 3)),
    }
    rows = [frame(c, 1000 * c + i, c * 2 * HOUR + i, s, flag=int(c == 5 and i == 0)) for c, v in severities.items() for i, s in enumerate(v)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = run(spark, at, rows + [frame(99, 1, 40 * HOUR)])
    cols = live.FRAME.replace("ts timestamp", "s bigint")
    want = op.disposition(op.coil_stats(spark.createDataFrame(rows, cols)))
    for w in want.collect():
        g = got[w.coil_id]
        assert (g.disposition, g.reasons, g.total_frames, g.defect_frames, g.total_detections, g.flag_class_frames) == (w.disposition, w.reasons, w.total_frames, w.defect_frames, w.total_detections, w.flag_class_frames)
        for c in ("defect_rate", "p95_severity", "mean_severity", "max_severity", "mean_latency_ms", "throughput_fps"):
            assert g[c] == pytest.approx(w[c])
    assert {g.disposition for g in got.values()} == {"HOLD", "DOWNGRADE", "ACCEPT"} and 99 not in got


def test_batches_that_repeat_or_come_late(spark, at):
    first = [frame(1, i, i, 40.0 if i < 2 else 0.0) for i in range(50)] + [frame(2, 100 + i, HOUR + i) for i in range(5)]
    assert 2 not in run(spark, at, first)
    # coil 2 goes on, its first frames come again, and time passes
    got = run(spark, at, first[-5:] + [frame(2, 105, HOUR + 60, 90.0), frame(3, 200, 4 * HOUR)])
    assert set(got) == {1, 2} and got[2].total_frames == 6 and got[2].disposition == "HOLD" and got[1].defect_rate == 0.04
    # frames of closed coils change nothing, a coil that runs again is a row of its own
    again = run(spark, at, [frame(1, 300, 51, 99.0), frame(2, 100, HOUR, 99.0), frame(2, 400, 5 * HOUR)] + [frame(4, 500, 9 * HOUR)])
    assert again[1] == got[1]
    runs = live.published(spark, f"{at}/closed").where("coil_id = 2").orderBy("opened").collect()
    assert [r.total_frames for r in runs] == [6, 1]


def test_a_batch_written_again_changes_nothing(spark, at):
    run(spark, at, [frame(1, i, i) for i in range(9)] + [frame(2, 100, 5 * HOUR)])
    table = spark.read.parquet(f"{at}/closed")
    before = sorted(map(str, live.published(spark, f"{at}/closed").collect()))
    rows = table.where("coil_id = 1").collect()
    spark.createDataFrame([r[:-1] for r in rows], table.drop("batch_id").schema).write.mode("overwrite").parquet(f"{at}/closed/batch_id={rows[0].batch_id}")
    assert len(rows) == 1 and sorted(map(str, live.published(spark, f"{at}/closed").collect())) == before


def test_latency_sketch_is_within_its_rank_error(spark, tmp_path):
    """Streamed sketches against exact ranks, and merged over all lines of a window."""
    from coilwise.streaming import monitor as mo

    rng = np.random.default_rng(4)
    rows = [(int(i), 1_700_000_000 + int(i) // 20, int(i) % 3, float(np.round(rng.lognormal(2, 0.7), 3))) for i in range(60_000)]
    frames = spark.createDataFrame(rows, "seq bigint, s bigint, line_id bigint, total_ms double").select("seq", F.timestamp_seconds("s").alias("ts"), "line_id", "total_ms")
    frames.coalesce(2).write.parquet(f"{tmp_path}/in")
    stream = mo.window_latency(spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/in"), "10 minutes", delay="1 minute")
    mo.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/ckpt")
    got = spark.read.parquet(f"{tmp_path}/out").cache()
    assert got.count() >= 9
    for r in got.collect():
        lo, hi = r.window_start.timestamp(), r.window_end.timestamp()
        own = np.sort([ms for _, s, line, ms in rows if line == r.line_id and lo <= s < hi])
        assert len(own) == r.frames and abs(np.searchsorted(own, r.quantile_ms) / len(own) - 0.95) <= mo.RANK_ERROR
        assert len(r.sketch) < 8000
    merged = got.groupBy("window_start").agg(F.expr("kll_merge_agg_double(sketch)").alias("s"), F.min("window_end").alias("e")).select("window_start", "e", F.expr("kll_sketch_get_quantile_double(s, 0.95D)").alias("q")).first()
    own = np.sort([ms for _, s, _, ms in rows if merged.window_start.timestamp() <= s < merged.e.timestamp()])
    assert abs(np.searchsorted(own, merged.q) / len(own) - 0.95) <= mo.RANK_ERROR


def test_silence_parts_runs_within_one_batch(spark, at):
    """A coil that runs again after a silence has two rows also where both runs arrive together; p95 is that of each run."""
    rows = [frame(7, i, i, float(i)) for i in range(40)] + [frame(7, 100 + i, 3 * HOUR + i) for i in range(5)]
    run(spark, at, rows + [frame(8, 900, 9 * HOUR)])
    runs = live.published(spark, f"{at}/closed").where("coil_id = 7").orderBy("opened").collect()
    assert [(r.total_frames, r.defect_frames, r.disposition) for r in runs] == [(40, 39, "HOLD"), (5, 0, "ACCEPT")]
    assert runs[0].p95_severity == pytest.approx(np.quantile(range(40), 0.95)) and runs[1].p95_severity == 0
