"""Files written from the test tables and read back: label text, pictures and mask payloads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.hashing import in_holdout
from ..operators import guards
from ..operators import splits as sp
from ..operators import tiling as tl
from ..session import ensure_checkpoint_dir, reuse
from ..sources import files, images, labels
from ..sources import tables as t
from . import sql as sqltext
from .base import det, gt, query, r6
from .sql import cte
from .tiling import mask_frames, runs

HEIGHT, WIDTH = 64, 200


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- label text

PLACE_SQL = cte("gt") + ", sk AS (SELECT gt.*, CAST(box_id // 1000 % 1000 AS BIGINT) AS place FROM gt)"


def _placed(spark, d):
    """Labels filed under the supplier that their id names: one label file each."""
    return gt(spark, d).withColumn("place", F.floor(F.col("box_id") / 1000) % 1000)


@query("label_text_file_scan", "A1", PLACE_SQL + """
SELECT 'box' AS kind, place AS frame_id, class_id, count(*) AS n, round(sum(x1 + 2*y1 + 3*x2 + 5*y2), 3) AS checksum FROM sk GROUP BY 2, 3
UNION ALL SELECT fault, place, -1, count(*), 0 FROM (SELECT DISTINCT place, unnest(['short', 'class', 'number']) AS fault FROM sk WHERE place % 3 = 0) GROUP BY 1, 2""")
def label_text_file_scan(spark, d):
    """One text file per place under split/labels, some with lines that can't be read; those are set aside."""
    g = _placed(spark, d)
    size = g.select(F.col("place").alias("frame_id")).distinct().select("frame_id", F.lit(200).alias("width"), F.lit(200).alias("height"))
    lines = labels.label_lines(g.drop("frame_id").withColumnRenamed("place", "frame_id"), size).select("frame_id", "line")
    wrong = size.where("frame_id % 3 = 0").select("frame_id", F.explode(F.array(*[F.lit(x) for x in ("3 0.5 0.5", "9 0.5 0.5 0.1 0.1", "1 0.5 x 0.1 0.1")])).alias("line"))
    texts = lines.unionByName(wrong).groupBy("frame_id").agg(F.array_join(F.collect_list("line"), "\n").alias("content"))
    split = F.when(F.col("frame_id") % 5 == 0, "val").otherwise("train")
    at = _folder(spark, "labels")
    files.write_files(texts.select(F.concat(split, F.lit("/labels/"), F.col("frame_id").cast("string"), F.lit(".txt")).alias("name"), "content"), at).agg(F.sum("length")).collect()
    read = labels.read_label_files(spark, at).select(F.col("stem").cast("bigint").alias("frame_id"), "line")
    marked = reuse(files.label_line_faults(read, 6))
    boxes = labels.parse_label_lines(marked.where("fault is null").drop("fault"), size)
    good = boxes.groupBy("frame_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(sum(k * F.round(c, 3) for k, c in ((1, "x1"), (2, "y1"), (3, "x2"), (5, "y2")))), 3).alias("checksum"))
    aside = marked.where("fault is not null").groupBy("fault", "frame_id").agg(F.count(F.lit(1)).alias("n"))
    return good.select(F.lit("box").alias("kind"), "frame_id", "class_id", "n", "checksum").unionByName(
        aside.select(F.col("fault").alias("kind"), "frame_id", F.lit(-1).alias("class_id"), "n", F.lit(0.0).alias("checksum")))


# ---------------------------------------------------------------- pictures

SIDE = 16


def _pictures(spark, d):
    """A folder with one small colour picture per supplier, and a text file among them."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = (b.column(0).to_numpy()[:, None] * 31 + np.arange(SIDE * SIDE) * 7) % 256
            pixels = np.stack([v, v * 3 % 256, v * 5 % 256], axis=2).astype(np.uint8).reshape(-1, SIDE, SIDE, 3)
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.bmp" for k in b.column(0).to_pylist()]), pa.array([files.bitmap(p) for p in pixels], pa.binary())], ["name", "content"])

    drawn = t.read(spark, d, "supplier").select("s_suppkey").mapInArrow(draw, "name string, content binary")
    at = _folder(spark, "pictures")
    note = spark.range(1).select(F.lit("readme.txt").alias("name"), F.lit("no picture").cast("binary").alias("content"))
    files.write_files(drawn.unionByName(note), at).agg(F.sum("length")).collect()
    return at


@query("image_file_inventory", "A3", f"SELECT s_suppkey AS frame_id, CAST(54 + {SIDE} * {SIDE} * 3 AS BIGINT) AS length FROM supplier")
def image_file_inventory(spark, d):
    return images.image_inventory(spark, [_pictures(spark, d)]).select(F.regexp_extract("path", r"([0-9]+)\.bmp$", 1).cast("bigint").alias("frame_id"), "length")


GREY_SQL = f"""WITH p AS (SELECT s_suppkey AS frame_id, (s_suppkey*31 + i*7) % 256 AS v FROM supplier, range({SIDE * SIDE}) r(i)),
g AS (SELECT frame_id, CAST((v*4899 + (v*3 % 256)*9617 + (v*5 % 256)*1868 + 8192) >> 14 AS INT) AS level FROM p)"""


@query("image_file_grey_levels", "A5 K1", GREY_SQL + "SELECT frame_id, level, count(*) AS n FROM g GROUP BY 1, 2")
def image_file_grey_levels(spark, d):
    """Pictures decoded by Spark's image source, to grey level counts."""
    h = images.pixel_histograms(images.read_images(spark, f"{_pictures(spark, d)}/*.bmp"))
    return h.select(F.regexp_extract("origin", r"([0-9]+)\.bmp$", 1).cast("bigint").alias("frame_id"), "level", "n")


@query("image_file_lut", "K6 A5", GREY_SQL.replace("FROM p)", "FROM (SELECT frame_id, 255 - v AS v, 255 - (v*3 % 256) AS v3, 255 - (v*5 % 256) AS v5 FROM p))").replace("(v*3 % 256)*9617 + (v*5 % 256)*1868", "v3*9617 + v5*1868") + "SELECT frame_id, level, count(*) AS n FROM g GROUP BY 1, 2")
def image_file_lut(spark, d):
    """The negative of every picture, by a level table of its own, to grey level counts."""
    img = reuse(images.read_images(spark, f"{_pictures(spark, d)}/*.bmp"))  # tables and pixels come from one read of the files
    luts = img.select("origin", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: 255 - i).alias("lut"))
    h = images.pixel_histograms(images.apply_lut_to_pixels(img, luts))
    return h.select(F.regexp_extract("origin", r"([0-9]+)\.bmp$", 1).cast("bigint").alias("frame_id"), "level", "n")


# ---------------------------------------------------------------- mask payloads

MASK_SQL = cte("mask_runs", "frames") + """, px AS (SELECT frame_id, y, x, max(class_id) AS class_id FROM (SELECT frame_id, y, class_id, unnest(range(x_start, x_end + 1)) AS x FROM mask_runs) GROUP BY 1, 2, 3),
flat AS MATERIALIZED (SELECT frame_id, class_id, y, CAST(min(x) AS INT) AS x_start, CAST(max(x) AS INT) AS x_end FROM (SELECT *, x - row_number() OVER (PARTITION BY frame_id, class_id, y ORDER BY x) AS g FROM px) GROUP BY frame_id, class_id, y, g)"""


def _mask_files(spark, d):
    """Payloads of all masks as JSON lines, with a broken copy of some under negative ids and empty ones, read back."""
    whole = reuse(files.encode_masks(runs(spark, d), HEIGHT, WIDTH))
    cut = F.when(F.col("frame_id") % 2 == 0, F.concat(F.lit("*"), F.col("payload"))).otherwise(F.expr("substring(payload, 1, 40)"))
    broken = whole.where("frame_id % 7 = 0").select((-F.col("frame_id") - 1).alias("frame_id"), cut.alias("payload"))
    empty = whole.where("frame_id % 11 = 0").select((F.col("frame_id") + 10_000_000).alias("frame_id"), F.lit(None).cast("string").alias("payload"))
    at = _folder(spark, "masks")
    whole.unionByName(broken).unionByName(empty).write.option("ignoreNullFields", "false").json(at)
    return files.read_masks(files.read_mask_samples(spark, at), HEIGHT, WIDTH)


@query("mask_payload_files", "A4", MASK_SQL + "SELECT frame_id, class_id, y, x_start, x_end FROM flat")
def mask_payload_files(spark, d):
    return files.mask_runs_of(_mask_files(spark, d))


@query("mask_payload_quarantine", "A4", cte("mask_runs") + "SELECT DISTINCT -frame_id - 1 AS frame_id FROM mask_runs WHERE frame_id % 7 = 0")
def mask_payload_quarantine(spark, d):
    return files.quarantined(_mask_files(spark, d)).select("frame_id")


REDERIVE_SQL = MASK_SQL + """, rn AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY frame_id, class_id, y, x_start) AS id FROM flat),
ed AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM rn a JOIN rn b ON a.frame_id=b.frame_id AND a.class_id=b.class_id AND abs(a.y-b.y)=1 AND a.x_start<=b.x_end AND a.x_end>=b.x_start),
cc AS (SELECT id, id AS root FROM rn UNION SELECT ed.v, cc.root FROM cc JOIN ed ON ed.u = cc.id),
comp AS (SELECT rn.*, c.root AS component FROM rn JOIN (SELECT id, min(root) AS root FROM cc GROUP BY 1) c USING (id)),
tb AS (SELECT c.frame_id, x0, class_id, component, min(greatest(x_start,x0)-x0) AS x_min, max(least(x_end,x0+63)-x0) AS x_max, min(y) AS y_min, max(y) AS y_max,
  sum(least(x_end,x0+63)-greatest(x_start,x0)+1) AS pixels FROM comp c JOIN frames f USING (frame_id), (SELECT unnest([0,48,96,136]) AS x0) WHERE x_end >= x0 AND x_start < x0+64 GROUP BY ALL),
bx AS MATERIALIZED (SELECT frame_id, x0, CAST(class_id AS INT) AS class_id, x_min, y_min, x_max, y_max FROM tb WHERE x_max-x_min+1 >= 2 AND y_max-y_min+1 >= 2),
st AS MATERIALIZED (SELECT frame_id, x0, CAST(CASE WHEN frame_id % 11 = 0 THEN class_id % 4 + 1 ELSE class_id END AS INT) AS class_id, x_min, y_min, x_max, y_max FROM bx WHERE frame_id % 7 <> 0 UNION ALL SELECT * FROM bx WHERE frame_id % 13 = 0 AND frame_id % 7 <> 0)
SELECT class_id, count(*) FILTER (side = 'expected') AS expected_only, count(*) FILTER (side = 'found') AS found_only FROM (
 SELECT 'expected' AS side, class_id FROM (SELECT * FROM st EXCEPT ALL SELECT * FROM bx) UNION ALL SELECT 'found', class_id FROM (SELECT * FROM bx EXCEPT ALL SELECT * FROM st)) GROUP BY 1"""


@query("mask_label_rederivation", "I6 A4 C6 C7", REDERIVE_SQL)
def mask_label_rederivation(spark, d):
    """Tile labels derived again from the mask files, against stored ones of which some are missing, doubled or misfiled."""
    cols = ["frame_id", "x0", "class_id", "x_min", "y_min", "x_max", "y_max"]
    comp = tl.connected_components(reuse(files.mask_runs_of(_mask_files(spark, d))))
    boxes = reuse(tl.component_tiles(comp, mask_frames(spark, d), 64, 48).where("x_max - x_min + 1 >= 2 and y_max - y_min + 1 >= 2").select(*cols))
    kept = boxes.where("frame_id % 7 <> 0")
    misfiled = F.when(F.col("frame_id") % 11 == 0, F.col("class_id") % 4 + 1).otherwise(F.col("class_id")).cast("int")
    stored = kept.withColumn("class_id", misfiled).unionByName(kept.where("frame_id % 13 = 0"))
    n = lambda side: F.sum((F.col("side") == side).cast("bigint"))
    return sp.label_diff(stored.select(*cols), boxes).groupBy("class_id").agg(n("expected").alias("expected_only"), n("found").alias("found_only"))


# ---------------------------------------------------------------- guards

@query("aligned_models", "D10", cte("det", "det2") + """, a AS (SELECT frame_id, count(*) AS n, max(conf) AS c FROM det GROUP BY 1), b AS (SELECT frame_id, count(*) AS n, max(conf) AS c FROM det2 GROUP BY 1)
SELECT frame_id, a.n AS boxes_a, b.n AS boxes_b, round(a.c - b.c, 6) AS confidence_gap FROM a JOIN b USING (frame_id)""")
def aligned_models(spark, d):
    """Both models on the frames that both have seen, one row a frame or no result at all."""
    per = lambda model, e: det(spark, d, model).groupBy("frame_id").agg(F.count(F.lit(1)).alias(f"boxes_{e}"), F.max("conf").alias(f"conf_{e}"))
    a, b = per("A", "a"), per("B", "b")
    both = guards.aligned(a.join(b.select("frame_id"), "frame_id", "left_semi"), b.join(a.select("frame_id"), "frame_id", "left_semi"), ["frame_id"])
    return both.select("frame_id", "boxes_a", "boxes_b", r6(F.col("conf_a") - F.col("conf_b"), "confidence_gap"))


OBSERVED_SQL = cte("gt", "frames") + f""", j AS (SELECT f.*, g.box_id, g.class_id, g.x1, g.y1, g.x2, g.y2, {sqltext.unit('holdout', 'coil_id')} < 0.5 AS held, g.box_id IS NOT NULL AS boxed FROM frames f LEFT JOIN gt g USING (frame_id)), c AS (
 SELECT 'class in the vocabulary' AS name, class_id NOT BETWEEN 0 AND 5 AS bad FROM j UNION ALL SELECT 'class of its domain', boxed AND domain = 'neu' AND class_id = 5 FROM j
 UNION ALL SELECT 'clipped box', boxed AND (x2 > 160 OR y2 > 160) FROM j UNION ALL SELECT 'degenerate box', boxed AND (x2 - x1 < 14 OR y2 - y1 < 14) FROM j
 UNION ALL SELECT 'background is certified', NOT boxed AND frame_id % 4 <> 0 FROM j UNION ALL SELECT 'clean frame has a box', boxed AND frame_id % 4 = 0 FROM j
 UNION ALL SELECT 'held-out source in training', split = 'train' AND held FROM j UNION ALL SELECT 'row differs from its source', boxed AND CAST(x1 + 2*y1 + 3*x2 + 5*y2 AS BIGINT) % 1000 = 7 FROM j)
SELECT name, count(*) FILTER (bad) = 0 AS ok, count(*) FILTER (bad) || ' of ' || count(*) AS detail FROM c GROUP BY 1"""


@query("assertions_while_writing", "I5", OBSERVED_SQL)
def assertions_while_writing(spark, d):
    """Eight checks of the training table, counted in the pass that writes it; some rows are written with an error on purpose."""
    j = t.frames(spark, d).join(gt(spark, d), "frame_id", "left")
    boxed = F.col("box_id").isNotNull()
    place = F.col("x1") + 2 * F.col("y1") + 3 * F.col("x2") + 5 * F.col("y2")
    source = F.sha2(F.concat_ws(",", "box_id", "class_id", "x1", "y1", "x2", "y2"), 256)
    j = j.withColumn("digest", source).withColumn("x1", F.when(place.cast("bigint") % 1000 == 7, F.col("x1") + 0.5).otherwise(F.col("x1")))
    return guards.write_checked(j, _folder(spark, "training"), {
        "class in the vocabulary": ~F.col("class_id").between(0, 5), "class of its domain": boxed & (F.col("domain") == "neu") & (F.col("class_id") == 5),
        "clipped box": (F.col("x2") > 160) | (F.col("y2") > 160), "degenerate box": boxed & ((F.col("x2") - F.ceil(F.col("x1") - 0.5) < 14) | (F.col("y2") - F.col("y1") < 14)),
        "background is certified": ~boxed & (F.col("frame_id") % 4 != 0), "clean frame has a box": boxed & (F.col("frame_id") % 4 == 0),
        "held-out source in training": (F.col("split") == "train") & in_holdout("holdout", 0.5, "coil_id"), "row differs from its source": boxed & (F.col("digest") != source),
    }, ["split"])
