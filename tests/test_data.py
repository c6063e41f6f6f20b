import base64
import io
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from coilwise.operators import photometric as ph
from coilwise.operators import scoring as sc
from coilwise.operators import splits as sp
from coilwise.registry.io_and_streams import stripe_scorer
from coilwise.sources import coco, images, labels, logs, sinks
from coilwise.streaming import monitor as mo


def bmp(path, arr):
    """24-bit bitmap of an RGB array."""
    h, w, _ = arr.shape
    pad = (-w * 3) % 4
    body = b"".join(arr[y, :, ::-1].astype(np.uint8).tobytes() + b"\0" * pad for y in range(h - 1, -1, -1))
    path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body)


@pytest.fixture(scope="module")
def pictures(tmp_path_factory):
    d = tmp_path_factory.mktemp("pics")
    rng = np.random.default_rng(4)
    grey = rng.integers(90, 160, (40, 60, 1)).repeat(3, axis=2)
    bmp(d / "steel.bmp", grey)
    bmp(d / "flat.bmp", np.full((30, 30, 3), 255))
    bmp(d / "logo.bmp", np.stack([np.full((20, 20), 200), np.zeros((20, 20)), np.zeros((20, 20))], axis=2))
    (d / "notes.txt").write_text("no image")
    return d, grey


def test_images(spark, pictures):
    d, grey = pictures
    assert images.image_inventory(spark, [str(d)]).count() == 3
    with pytest.raises(Exception):
        images.image_inventory(spark, [str(d / "*.png")])
    img = images.read_images(spark, f"{d}/*.bmp").cache()
    h = images.pixel_histograms(img).toPandas()
    steel = h[h.origin.str.endswith("steel.bmp")].set_index("level")["n"]
    assert steel.to_dict() == {int(k): int(v) for k, v in zip(*np.unique(grey[..., 0], return_counts=True))}
    s = images.pixel_signals(img).toPandas().set_index("origin")
    s.index = [i.rsplit("/", 1)[1] for i in s.index]
    assert s.loc["steel.bmp", "saturation"] == 0 and s.loc["logo.bmp", "saturation"] == 255 and s.loc["flat.bmp", "focus"] == 0
    assert s.loc["logo.bmp", "grey_mean"] == 60  # 0.299 * 200
    origins = [r[0] for r in img.select("origin").collect() if r[0].endswith("steel.bmp")]
    boxes = spark.createDataFrame([(origins[0], 1, 0, 5.0, 5.0, 25.0, 20.0)], "origin string, box_id bigint, class_id int, x1 double, y1 double, x2 double, y2 double")
    b = images.box_pixel_stats(img, boxes).first()
    assert b.in_box_std == pytest.approx(grey[5:20, 5:25, 0].std()) and 0.5 < b.edge_ratio < 1.5
    more = spark.createDataFrame([(origins[0], k, 1, *map(float, c)) for k, c in enumerate([(5, 5, 25, 20), (20, 10, 70, 30), (-9, 2, 8, 9), (30, 8, 30, 9)])], boxes.schema)
    taken, got = np.zeros((40, 60), bool), {r.box_id: r for r in images.box_pixel_stats(img, more).collect()}
    cuts = [(5, 5, 25, 20), (20, 10, 60, 30), (0, 2, 8, 9)]
    for x1, y1, x2, y2 in cuts:
        taken[y1:y2, x1:x2] = True
    rest = grey[..., 0][~taken]
    for k, (x1, y1, x2, y2) in enumerate(cuts):
        inside = grey[y1:y2, x1:x2, 0]
        assert got[k].in_box_std == pytest.approx(inside.std()) and got[k].separability == pytest.approx(abs(inside.mean() - rest.mean()) / rest.std())
    assert sorted(got) == [0, 1, 2]
    full = spark.createDataFrame([(origins[0], 9, 1, 0.0, 0.0, 60.0, 40.0)], boxes.schema)
    assert images.box_pixel_stats(img, full).first()[3:] == pytest.approx((None, 1.0, grey[..., 0].std()))
    assert [r[0].rsplit("/", 1)[1] for r in images.rejected_images(spark, str(d)).collect()] == ["notes.txt"]
    with pytest.raises(Exception, match="undecodable"):
        images.read_images(spark, str(d), strict=True).collect()
    inverse = spark.createDataFrame([(origins[0], list(range(255, -1, -1)))], "origin string, lut array<int>")
    out = images.apply_lut_to_pixels(img, inverse).first()
    assert np.frombuffer(out.data, np.uint8).sum() == (255 - grey).sum()


def test_mask_payloads(spark):
    m = np.zeros((6, 10), np.uint8)
    m[1, 2:5], m[1, 5:7], m[3, 9] = 1, 2, 4
    buf = io.BytesIO()
    np.save(buf, m)
    good = base64.b64encode(zlib.compress(buf.getvalue())).decode()
    df = spark.createDataFrame([(1, good), (2, None)], "frame_id bigint, payload string")
    assert sorted(tuple(r) for r in images.decode_masks(df, 6, 10).collect()) == [(1, 1, 1, 2, 4), (1, 2, 1, 5, 6), (1, 4, 3, 9, 9)]
    with pytest.raises(Exception, match="mask shape"):
        images.decode_masks(df, 5, 10).collect()


def test_label_files(spark, tmp_path):
    for split, stem, text in (("train", "a", "0 0.5 0.5 0.2 0.4\n1 2 3\n"), ("val", "b", "")):
        (tmp_path / split / "labels").mkdir(parents=True)
        (tmp_path / split / "labels" / f"{stem}.txt").write_text(text)
    lines = labels.read_label_files(spark, str(tmp_path))
    frames = spark.createDataFrame([("a", 100, 200), ("b", 100, 200)], "frame_id string, width int, height int")
    got = labels.parse_label_lines(lines.withColumnRenamed("stem", "frame_id"), frames).collect()
    assert [(r.frame_id, r.class_id, r.x1, r.y1, r.x2, r.y2) for r in got] == [("a", 0, 40.0, 60.0, 60.0, 140.0)]
    bad = spark.createDataFrame([("a", "9 0.5 0.5 0.1 0.1")], "frame_id string, line string")
    with pytest.raises(Exception, match="out of range"):
        labels.parse_label_lines(bad, frames).collect()


def test_long_label_text_is_chunked(spark):
    lines = spark.range(25).select(F.lit(1).cast("bigint").alias("frame_id"), F.col("id").alias("box_id"), F.col("id").cast("string").alias("line"))
    frames = spark.createDataFrame([(1,), (2,)], "frame_id bigint")
    out = sorted((r.frame_id, r.chunk, r.text) for r in labels.label_texts(lines, frames, per_chunk=10).collect())
    assert [o[:2] for o in out] == [(1, 0), (1, 1), (1, 2), (2, 0)] and "".join(o[2] for o in out[:3]) == "".join(f"{i}\n" for i in range(25)) and out[3][2] == ""


def test_coco_document(spark, tmp_path):
    doc = {"categories": [{"id": 0, "name": "placeholder", "supercategory": "none"}, {"id": 1, "name": "crazing"}], "images": [{"id": 5, "file_name": "a.jpg", "width": 100, "height": 50}, {"id": 6, "file_name": "b.jpg", "width": 100, "height": 50}],
           "annotations": [{"id": 1, "image_id": 5, "category_id": 1, "bbox": [90, 10, 20, 20]}, {"id": 2, "image_id": 5, "category_id": 0, "bbox": [0, 0, 5, 5]}, {"id": 3, "image_id": 5, "category_id": 1, "bbox": [99.5, 0, 9, 9]}]}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    boxes = coco.coco_boxes(*coco.read_coco(spark, str(tmp_path)), ["crazing"], on=["file"])
    assert tuple(coco.coco_counters(boxes).first()) == (2, 2, 1, 1)
    b = boxes.where("box is not null").first()["box"]
    assert (b.cx, b.cy, b.w, b.h) == (0.95, 0.4, 0.1, 0.4)


def test_training_log_and_operating_points(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "results.csv").write_text("   epoch,  time, metrics/mAP50(B), metrics/mAP50-95(B)\n 1, 10.5, 0.2, 0.1\n 2, 21.0, 0.3, 0.2\n")
    log = logs.read_training_log(spark, str(tmp_path / "*" / "results.csv"))
    assert [tuple(r) for r in log.orderBy("epoch").collect()] == [("run1", 1, 10.5, 0.2, 0.1), ("run1", 2, 21.0, 0.3, 0.2)]
    (tmp_path / "op.json").write_text('{"model": "a", "conf_threshold": 0.3}')
    assert logs.read_operating_points(spark, str(tmp_path / "op.json")).select(logs.operating_conf()).first()[0] == 0.3


def test_publish_and_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, 0.1, "x"), (2, 0.1, "y"), (4, 0.1, "x")], "k int, conf double, source string")
    new = spark.createDataFrame([(1, 0.2, "x"), (2, 0.2, "x"), (3, 0.2, "x")], "k int, conf double, source string")
    run = lambda force: {r.k: (r.status, r.conf) for r in sinks.guarded_publish(old, new, ["k"], force=force).collect()}
    assert run(False) == {1: ("overwritten", 0.2), 2: ("refused", 0.1), 3: ("created", 0.2), 4: ("kept", 0.1)}
    assert run(True)[2] == ("overwritten", 0.2)
    log = spark.createDataFrame([("a", "2024-01", 1), ("a", "2024-03", 2), ("b", "2024-02", 3)], "tag string, generated_at string, v int")
    assert {(r.tag, r.v) for r in sinks.latest_per_tag(log).collect()} == {("a", 2), ("b", 3)}
    sinks.write_by(log, str(tmp_path / "out"), "csv", ["tag"])
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_group_split_keeps_ratios(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(600):
        size = int(rng.integers(1, 6))
        held = {c: int(rng.integers(1, 9)) for c, p in enumerate((0.6, 0.25, 0.05)) if rng.random() < p}
        rows += [(g, c, n, size) for c, n in held.items()] or [(g, None, 0, size)]
    df = spark.createDataFrame(rows, "group_id bigint, class_id int, n int, images int").cache()
    out = sp.stratified_group_split(df).toPandas()
    assert sorted(out["group_id"]) == list(range(600))
    assert sp.stratified_group_split(df).toPandas().sort_values("group_id")["split"].tolist() == out.sort_values("group_id")["split"].tolist()
    where = dict(zip(out["group_id"], out["split"]))
    for c in range(3):
        total = {s: 0 for s in sp.RATIOS}
        for g, k, n, _ in rows:
            if k == c:
                total[where[g]] += n
        whole = sum(total.values())
        assert all(abs(total[s] / whole - r) < 0.05 for s, r in sp.RATIOS.items()), (c, total)


def test_gate_and_drift(spark):
    s = spark.createDataFrame([(1, 200, 1.0, 0.0, 0.3, 9.0, 6.0, 20.0), (2, 40, 1.0, 90.0, 0.3, 9.0, 6.0, 20.0), (3, 200, 1.0, 0.0, 0.3, 9.0, 6.0, 120.0)],
                              "frame_id bigint, min_side int, aspect double, saturation double, edge_density double, focus double, tonal_bits double, hist_distance double")
    out = {r.frame_id: (r.decision, list(r.failed)) for r in ph.gate(s).collect()}
    assert out == {1: ("pass", []), 2: ("reject", ["resolution", "colour"]), 3: ("review", [])}
    sug = ph.suggest_limits(ph.headroom(s)).first()
    assert sug.max_saturation == 180 and sug.min_focus == 1.5
    with pytest.raises(ValueError):
        ph.suggest_limits(ph.headroom(s), safety=0.5)
    hist = spark.createDataFrame([(1, 100, 50), (1, 101, 50), (2, 90, 100)], "frame_id bigint, level int, n bigint")
    ref = ph.reference_cdf(ph.reference_histogram(hist.where("frame_id = 1"), ph.moments(hist.where("frame_id = 1"))), "population")
    d = {r.frame_id: r for r in ph.drift(hist, ref).collect()}
    assert d[1].hist_distance == 0 and d[2].hist_distance == pytest.approx(10.5) and d[2].p1 == 90
    lut = {(r.frame_id, r.level): r.new_level for r in ph.histogram_lut(hist, ref, strength=1.0).collect()}
    assert lut[(2, 90)] == 101 and lut[(1, 100)] == 100 and len(lut) == 512


def test_scores_do_not_depend_on_neighbours(spark):
    items = spark.range(40).select(F.col("id").alias("frame_id"), (F.col("id") % 3 * 100).cast("int").alias("x0"), F.lit(0).alias("y0"), (F.col("id") % 2 * 64 + 128).cast("int").alias("tile_w"), F.lit(256).alias("tile_h"))
    run = lambda df, chunk: {tuple(r)[:-1] for r in sc.score_batches(df, stripe_scorer, ["frame_id", "x0"], chunk=chunk).collect()}
    whole = run(items, 8)
    assert whole == run(items, 1) and run(items.where("frame_id < 10"), 8) == {r for r in whole if r[0] < 10} and whole


def test_tiles_of_one_small_file_are_scored_by_many_tasks(spark, tmp_path):
    at = str(tmp_path)

    def scorer(tiles):
        open(f"{at}/{TaskContext.get().partitionId()}", "a").close()
        return stripe_scorer(tiles)

    frames = spark.range(200).coalesce(1).select(F.col("id").alias("frame_id"), F.col("id").alias("coil_id"), F.lit(1200).alias("width"), F.lit(300).alias("height"), F.lit(1.0).alias("total_ms"))
    assert sc.tiled_inspection(frames, scorer).count() == 200
    assert len(list(tmp_path.iterdir())) >= 4


def test_late_rows_are_dropped(spark, tmp_path):
    src = tmp_path / "in"
    mk = lambda rows, n: spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").coalesce(1).write.mode("append").parquet(str(src))
    from datetime import datetime as dt
    mk([(1, dt(2024, 1, 1, 0, 5), 1, "error", 1.0), (2, dt(2024, 1, 1, 3, 0), 1, "click", 1.0)], 1)
    win = lambda: mo.run_to_table(mo.window_monitor(mo.read_events(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "ck"))
    win()
    mk([(3, dt(2024, 1, 1, 0, 6), 1, "error", 1.0), (4, dt(2024, 1, 1, 9, 0), 1, "click", 1.0)], 2)
    win()
    rows = {(str(r.window_start)[11:13], r.frames, r.alert) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert rows == {("00", 1, True), ("03", 1, False)}


def test_closed_coils_are_upserted(spark, tmp_path):
    from datetime import datetime as dt
    rows = [(i, dt(2024, 1, 1, 0, i), 1, "error" if i < 3 else "click", 1.0) for i in range(10)] + [(99, dt(2024, 1, 2), 1, "click", 1.0)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "in"))
    table: list = []
    read = lambda: spark.createDataFrame(table[-1]) if table else None
    def write(df):
        got = df.collect()
        if got:
            table.append(got)
    mo.upsert_closed_coils(mo.coil_sessions(mo.read_events(spark, str(tmp_path / "in"))), read, write, str(tmp_path / "ck")).awaitTermination()
    assert [(r.frames, r.defects, r.disposition) for r in table[-1]] == [(10, 3, "HOLD")]


def test_set_digest_levels(spark):
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    ids = spark.range(10).select((F.col("id") % 2).alias("k"), F.col("id").alias("i")).unionByName(spark.range(3).select(F.lit(9).cast("bigint").alias("k"), F.col("id").alias("i")))
    got = {r.k: r.digest for r in sinks.set_digest(ids, ["k"], "i", per_block=2).collect()}
    assert got[9] == sha(sha("0\n1") + "\n" + sha("2"))
    assert got[0] == sha(sha(sha("0\n2") + "\n" + sha("4\n6")) + "\n" + sha("8"))
    whole = {r.k: r.digest for r in sinks.set_digest(ids, ["k"], "i").collect()}
    assert whole[1] == sha("1\n3\n5\n7\n9")


def test_label_diff_counts_copies_and_reads_each_side_once(spark):
    from coilwise.operators import splits as sp

    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    side = lambda rows: spark.createDataFrame(rows, "k bigint, x double").coalesce(1).mapInArrow(count, "k bigint, x double")
    got = sp.label_diff(side([(1, 1.0)] * 3 + [(2, None), (3, 0.0)]), side([(1, 1.0)] + [(2, None), (4, 2.0), (4, 2.0)]))
    assert sorted(map(tuple, got.collect())) == [(1, 1.0, "expected")] * 2 + [(3, 0.0, "expected")] + [(4, 2.0, "found")] * 2
    assert seen.value == 9
