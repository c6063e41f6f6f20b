"""Files written by tasks, payloads set aside, and label lines with faults."""

import base64
import zlib

import numpy as np
import pytest

from coilwise.sources import files, images


def test_written_files_come_back(spark, tmp_path):
    rows = [("a/b/1.bin", b"one"), ("a/2.bin", b""), ("3.bin", None), ("ü 4.bin", bytes(range(256)))]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    for _ in range(2):  # a task that runs again writes the same
        assert sorted(tuple(r) for r in files.write_files(df, str(tmp_path)).collect()) == sorted((n, len(c or b"")) for n, c in rows)
    got = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*.bin")}
    assert got == {n: c or b"" for n, c in rows}


def test_bitmaps_are_pictures(spark, tmp_path):
    rng = np.random.default_rng(0)
    pixels = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8)
    files.write_files(spark.createDataFrame([("p.bmp", files.bitmap(pixels))], "name string, content binary"), str(tmp_path)).collect()
    row = images.read_images(spark, f"{tmp_path}/*.bmp").first()
    assert (row.height, row.width) == (5, 7) and (np.frombuffer(row.data, np.uint8).reshape(5, 7, 3)[:, :, ::-1] == pixels).all()


def test_masks_round_trip_and_quarantine(spark):
    rng = np.random.default_rng(2)
    masks = {i: (rng.random((9, 12)) < 0.5) * rng.integers(0, 5, (9, 12)) for i in range(6)}
    masks[6] = np.full((9, 12), 3)
    samples = [(i, files.mask_payload(m.astype(np.uint8))) for i, m in masks.items()]
    bad = {
        50: "not base64!", 51: base64.b64encode(b"plain").decode(), 52: base64.b64encode(zlib.compress(b"no array")).decode(),
        53: files.mask_payload(np.zeros((3, 3), np.uint8)), 54: samples[0][1][:20],
    }
    read = files.read_masks(spark.createDataFrame([*samples, *bad.items(), (60, None), (61, "")], files.MASK_SAMPLE).repartition(3), 9, 12).cache()
    assert {r.frame_id for r in files.quarantined(read).collect()} == set(bad)
    back = {i: np.zeros((9, 12), int) for i in masks}
    for r in files.mask_runs_of(read).collect():
        assert (back[r.frame_id][r.y, r.x_start : r.x_end + 1] == 0).all()
        back[r.frame_id][r.y, r.x_start : r.x_end + 1] = r.class_id
    assert all((back[i] == m).all() for i, m in masks.items())
    again = files.encode_masks(files.mask_runs_of(read), 9, 12)
    assert dict(map(tuple, again.collect())) == {i: p for i, p in samples if masks[i].any()}


@pytest.mark.parametrize("line,fault", [
    ("1 0.5 0.5 0.1 0.1", None), (" 1  .5 .5 .1 .1 extra", None), ("1 0.5 0.5 0.1", "short"), ("", "short"), ("6 0.5 0.5 0.1 0.1", "class"), ("-1 0.5 0.5 0.1 0.1", "class"), ("x 0.5 0.5 0.1 0.1", "class"), ("1 0.5 y 0.1 0.1", "number"),
])
def test_label_line_faults(spark, line, fault):
    assert files.label_line_faults(spark.createDataFrame([(line,)], "line string"), 6).first()["fault"] == fault


def test_pictures_are_read_once_for_their_tables_and_pixels(spark, sf):
    from coilwise.registry.files import image_file_lut

    plan = image_file_lut(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("InMemoryRelation") == 2  # the same stored rows on both sides of the join
