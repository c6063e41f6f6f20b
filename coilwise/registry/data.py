"""Name parsing, box conversion, splits, checks, capacity, orders and scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as nm
from ..functions import vocab
from ..functions.geometry import corner_box_to_centre, dbl
from ..functions.hashing import in_holdout
from ..operators import census as ce
from ..operators import capacity as cp
from ..operators import splits as sp
from ..operators import tiling as tl
from ..session import reuse
from ..sources import tables as t
from . import sql as s
from .base import big, det, gt, query, r6
from .evaluation import AT_SQL, _at
from .sql import cte
from .tiling import TILE_BOX_SQL, components, mask_frames

# ---------------------------------------------------------------- names and boxes

NAMES_SQL = """, nm AS (SELECT frame_id, class_name || '_' || frame_id AS a, 'img_0' || (frame_id % 8 + 1) || '_' || (425000000 + coil_id) || '_' || lpad(CAST(frame_id % 100000 AS VARCHAR), 5, '0') || '_jpg.rf.' || md5(CAST(frame_id AS VARCHAR)) || '.jpg' AS b,
 'sev_' || substr(md5(CAST(coil_id AS VARCHAR)), 1, 8) || '_x' || lpad(CAST(frame_id % 1344 AS VARCHAR), 4, '0') AS c, (['2b','ba','hl','mirror','raw'])[frame_id % 5 + 1] || '_' || CASE WHEN frame_id % 3 = 0 THEN 'Clean' ELSE 'Scratch' END || '_' || (frame_id % 97) AS d
 FROM frames JOIN dim ON dim.class_id = frame_id % 6)"""


def names(spark, d):
    f = t.frames(spark, d)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    i = F.col("frame_id")
    cls = F.get(F.array(*[F.lit(c) for c in vocab.CLASSES]), (i % 6).cast("int"))
    fin = F.get(F.array(*[F.lit(c) for c in ("2b", "ba", "hl", "mirror", "raw")]), (i % 5).cast("int"))
    return f.select(
        "frame_id", F.concat_ws("_", cls, i.cast("string")).alias("a"),
        F.concat(F.lit("img_0"), (i % 8 + 1).cast("string"), F.lit("_"), (F.col("coil_id") + 425000000).cast("string"), F.lit("_"), pad(i % 100000, 5),
                 F.lit("_jpg.rf."), F.md5(i.cast("string")), F.lit(".jpg")).alias("b"),
        F.concat(F.lit("sev_"), F.substring(F.md5(F.col("coil_id").cast("string")), 1, 8), F.lit("_x"), pad(i % 1344, 4)).alias("c"),
        F.concat_ws("_", fin, F.when(i % 3 == 0, "Clean").otherwise("Scratch"), (i % 97).cast("string")).alias("d"),
    )


@query("file_name_parsing", "B2", cte("frames", "dim") + NAMES_SQL + """, o AS (SELECT *, split_part(b, '_jpg.rf.', 1) AS stem FROM nm)
SELECT frame_id, regexp_replace(a, '_[^_]*$', '') AS class_name, regexp_replace(a, '_[^_]*$', '') AS family, stem AS original, split_part(stem, '_', 3) AS sequence,
 split_part(c, '_', 2) AS source_frame, CAST(split_part(c, '_x', 2) AS INT) AS x_offset, CASE WHEN split_part(d, '_', 1) IN ('2b','ba','hl','mirror') THEN split_part(d, '_', 1) ELSE 'other' END AS finish, lower(split_part(d, '_', 2)) AS label FROM o""")
def file_name_parsing(spark, d):
    return names(spark, d).select(
        "frame_id", nm.class_of("a").alias("class_name"), nm.family("a").alias("family"), nm.original_stem("b").alias("original"),
        nm.sequence_id(nm.original_stem("b")).alias("sequence"), nm.source_frame("c").alias("source_frame"), nm.crop_offset("c").alias("x_offset"),
        *[c.alias(n) for n, c in nm.finish_and_label("d").items()])


@query("corner_to_centre_boxes", "B3", cte("det") + """, c AS (SELECT *, greatest(0, x1-5) AS l, greatest(0, y1-5) AS t, least(150, x2-5) AS r, least(150, y2-5) AS b FROM det)
SELECT frame_id, det_id, CASE WHEN r-l >= 1 AND b-t >= 1 THEN round((l+r)/2/150, 6) END AS cx, CASE WHEN r-l >= 1 AND b-t >= 1 THEN round((t+b)/2/150, 6) END AS cy,
 CASE WHEN r-l >= 1 AND b-t >= 1 THEN round((r-l)/150, 6) END AS w, CASE WHEN r-l >= 1 AND b-t >= 1 THEN round((b-t)/150, 6) END AS h FROM c""")
def corner_to_centre_boxes(spark, d):
    box = corner_box_to_centre(F.col("x1") - 5, F.col("y1") - 5, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(150), F.lit(150))
    return det(spark, d).withColumn("b", box).select("frame_id", "det_id", *[r6(f"b.{c}", c) for c in ("cx", "cy", "w", "h")])


@query("canvas_pad_shift", "B4", cte("gt") + """, n AS (SELECT frame_id, box_id, class_id, (x1+x2)/2/200 AS cx, (y1+y2)/2/200 AS cy, (x2-x1)/200 AS w, (y2-y1)/200 AS h FROM gt),
p AS (SELECT *, (cx*200+28)/256 AS px, (cy*200+28)/256 AS py, w*200/256 AS pw, h*200/256 AS ph FROM n)
SELECT class_id, count(*) AS n, round(avg(px), 6) AS mean_cx, round(avg(py), 6) AS mean_cy, round(avg(pw), 6) AS mean_w, round(avg(ph), 6) AS mean_h,
 max(greatest(abs((px*256-28)/200-cx), abs((py*256-28)/200-cy), abs(pw*256/200-w), abs(ph*256/200-h))) < 1e-9 AS round_trip_exact FROM p GROUP BY 1""")
def canvas_pad_shift(spark, d):
    """Labels of a 200 px frame placed centrally on a 256 px canvas, and back."""
    n = gt(spark, d).select("class_id", ((F.col("x1") + F.col("x2")) / 400).alias("cx"), ((F.col("y1") + F.col("y2")) / 400).alias("cy"),
                            ((F.col("x2") - F.col("x1")) / 200).alias("w"), ((F.col("y2") - F.col("y1")) / 200).alias("h"))
    return ce.canvas_shift(n, 200, 256).groupBy("class_id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("px"), "mean_cx"), r6(F.avg("py"), "mean_cy"), r6(F.avg("pw"), "mean_w"),
        r6(F.avg("ph"), "mean_h"), (F.max(ce.canvas_error(200, 256)) < 1e-9).alias("round_trip_exact"))


@query("tile_box_lift", "B5", cte("det") + """SELECT frame_id, det_id, (frame_id % 3)*160 + x1 AS x1, (frame_id % 2)*160 + y1 AS y1, (frame_id % 3)*160 + x2 AS x2, (frame_id % 2)*160 + y2 AS y2 FROM det""")
def tile_box_lift(spark, d):
    tiles = t.frames(spark, d).select("frame_id", (F.col("frame_id") % 3 * 160).alias("x0"), (F.col("frame_id") % 2 * 160).alias("y0"))
    return tl.lift_boxes(det(spark, d), tiles, ["frame_id"]).select("frame_id", "det_id", "x1", "y1", "x2", "y2")


@query("joined_label_spaces", "B13 I7", cte("gt", "det2") + """SELECT class_id, count(*) AS n FROM (SELECT class_id FROM gt UNION ALL SELECT class_id % 4 + 6 FROM det2) GROUP BY 1""")
def joined_label_spaces(spark, d):
    second = det(spark, d, "B").select((F.col("class_id") % 4).alias("class_id"))
    return ce.join_label_spaces([(gt(spark, d).select("class_id"), 0), (second, 6)]).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))


@query("hash_holdout", "B14", f"SELECT o_orderkey AS frame_id, {s.unit('holdout', 'o_orderkey')} < 0.5 AS held, {s.unit('holdout', 'o_orderkey')} < 0.2 AS held_small FROM orders")
def hash_holdout(spark, d):
    return t.frames(spark, d).select("frame_id", in_holdout("holdout", 0.5, "frame_id").alias("held"), in_holdout("holdout", 0.2, "frame_id").alias("held_small"))


@query("content_digests", "B15", "SELECT doc_id AS item_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def content_digests(spark, d):
    return t.read(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("coil_manifest_digest", "B15", """SELECT o_custkey AS coil_id, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY CAST(o_orderkey AS VARCHAR))) AS manifest
FROM orders GROUP BY 1""")
def coil_manifest_digest(spark, d):
    from ..sources.sinks import set_digest

    return set_digest(t.frames(spark, d), ["coil_id"], "frame_id").withColumnRenamed("digest", "manifest")


_UP = lambda digits, below: f"SELECT coil_id, substr(b, 1, {digits}) AS b, sha256(string_agg(b || x, '' ORDER BY b)) AS x, sum(n) AS n FROM {below} GROUP BY 1, 2"


@query("coil_manifest_tree", "B15", f"""WITH h AS (SELECT DISTINCT o_custkey AS coil_id, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders),
l6 AS (SELECT coil_id, substr(h, 1, 6) AS b, sha256(string_agg(h, '' ORDER BY h)) AS x, count(*) AS n FROM h GROUP BY 1, 2), l4 AS ({_UP(4, 'l6')}), l2 AS ({_UP(2, 'l4')}), l0 AS ({_UP(0, 'l2')})
SELECT coil_id, x AS manifest, CAST(n AS BIGINT) AS frames FROM l0""")
def coil_manifest_tree(spark, d):
    """Digest of each coil's set of frames by a tree over hash prefixes, the same rule at every size."""
    from ..sources.sinks import set_buckets, set_root

    return set_root(set_buckets(t.frames(spark, d), ["coil_id"], "frame_id"), ["coil_id"]).select("coil_id", F.col("digest").alias("manifest"), big("n", "frames"))


# ---------------------------------------------------------------- splits and checks

@query("stratified_carve_out", "J1", """SELECT o_orderkey AS frame_id, CASE WHEN o_orderstatus <> 'F' THEN 'test' WHEN rn <= 300 THEN 'val' ELSE 'train' END AS split FROM (
 SELECT *, row_number() OVER (PARTITION BY o_orderstatus = 'F', o_orderpriority ORDER BY md5('carve:' || o_orderkey), o_orderkey) AS rn FROM orders)""")
def stratified_carve_out(spark, d):
    f = t.frames(spark, d)
    pool = sp.stratified_carve_out(f.where("domain = 'neu'").drop("split"), "camera", 300, "carve").select("frame_id", "split")
    return pool.unionByName(f.where("domain <> 'neu'").select("frame_id", F.lit("test").alias("split")))


@query("source_level_split", "J3", f"""SELECT coil_id, arm, CASE WHEN r <= nt THEN 'train' WHEN r <= nt + nv THEN 'val' ELSE 'test' END AS split FROM (
 SELECT *, round_even(n*0.8::DOUBLE, 0) AS nt, round_even(n*0.1::DOUBLE, 0) AS nv FROM (SELECT coil_id, coil_id % 4 = 0 AS arm, row_number() OVER (PARTITION BY coil_id % 4 = 0 ORDER BY {s.unit('source', 'coil_id')}, coil_id) AS r,
 count(*) OVER (PARTITION BY coil_id % 4 = 0) AS n FROM (SELECT DISTINCT o_custkey AS coil_id FROM orders)))""")
def source_level_split(spark, d):
    ids = t.frames(spark, d).select("coil_id").distinct().withColumn("arm", F.col("coil_id") % 4 == 0)
    return sp.random_split(ids, ["arm"], "coil_id", "source").select("coil_id", "arm", "split")


def group_table(spark, d):
    per = gt(spark, d).join(t.frames(spark, d).select("frame_id", "coil_id"), "frame_id").groupBy("coil_id", "class_id").agg(F.count(F.lit(1)).alias("n"))
    size = t.frames(spark, d).groupBy("coil_id").agg(F.count(F.lit(1)).alias("images"))
    return size.join(per, "coil_id", "left").select(F.col("coil_id").alias("group_id"), "class_id", F.coalesce("n", F.lit(0)).alias("n"), "images")


@query("stratified_group_split", "J2")
def stratified_group_split(spark, d):
    return sp.stratified_group_split(reuse(group_table(spark, d)))


CLEAN_TILES_SQL = cte("frames", "mask_runs") + """, tl AS (SELECT frame_id, x0 FROM frames, (SELECT unnest([0,48,96,136]) AS x0)),
ok AS (SELECT * FROM tl WHERE NOT EXISTS (SELECT 1 FROM mask_runs r WHERE r.frame_id = tl.frame_id AND r.x_end >= x0 AND r.x_start < x0+64)),
pk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY md5('neg:' || frame_id || ':' || x0 || ':0')) AS pick FROM ok)"""


@query("negative_tiles", "J4", CLEAN_TILES_SQL + """SELECT frame_id, x0, pick FROM pk WHERE pick <= 2 ORDER BY md5('neg:' || frame_id), frame_id, pick LIMIT 20000""")
def negative_tiles(spark, d):
    """Two random clean tiles per source, proven empty on the mask, up to a budget."""
    f = mask_frames(spark, d)
    tiles = f.select("frame_id", F.explode(tl.candidate_origins("width", 64, 48)).alias("x0"), F.lit(0).alias("y0"))
    starts = f.select("frame_id", tl.candidate_origins("width", 64, 48).alias("xs"))
    hit = t.mask_runs(spark, d).join(starts, "frame_id").select(
        "frame_id", F.explode(F.filter("xs", lambda x: (F.col("x_end") >= x) & (F.col("x_start") < x + 64))).alias("x0")).distinct()
    clean = tiles.join(hit, ["frame_id", "x0"], "left_anti")
    return sp.tiles_per_source(clean, 2, "neg", 20000).select("frame_id", "x0", "pick")


RARE_SQL = """, fc AS (SELECT DISTINCT frame_id, class_id FROM mask_runs), fq AS (SELECT class_id, count(*) AS freq FROM fc GROUP BY 1),
pr AS (SELECT frame_id, arg_min(class_id, (freq, class_id)) AS prim FROM fc JOIN fq USING (class_id) GROUP BY 1),
tn AS (SELECT pr.*, freq, row_number() OVER (PARTITION BY prim ORDER BY """ + s.unit("rare", "frame_id") + """, frame_id) AS turn FROM pr JOIN fq ON fq.class_id = prim),
po AS (SELECT *, row_number() OVER (ORDER BY turn, freq, prim) AS position FROM tn)"""


def rare_order(spark, d):
    return sp.rarest_first_order(reuse(t.mask_runs(spark, d).select("frame_id", "class_id").distinct()), "rare")


@query("rarest_first_order", "H7", cte("mask_runs") + RARE_SQL + "SELECT frame_id, prim AS primary, turn, position FROM po")
def rarest_first_order(spark, d):
    return rare_order(spark, d).select("frame_id", "primary", big("turn"), big("position"))


# the runs of the test table are a few pixels thick, so the size limits are set accordingly
@query("positive_tiles_to_budget", "J5", TILE_BOX_SQL.replace(">= 8 AND y_max", ">= 1 AND y_max").replace("y_min+1 >= 8", "y_min+1 >= 1").replace("pixels >= 64", "pixels >= 1") + RARE_SQL + """SELECT frame_id, x0, position FROM (SELECT DISTINCT frame_id, x0 FROM kp WHERE keep) JOIN po USING (frame_id) ORDER BY position, x0 LIMIT 500""")
def positive_tiles_to_budget(spark, d):
    boxes = tl.component_tiles(components(spark, d), mask_frames(spark, d), 64, 48, min_side=1, min_px=1)
    tiles = boxes.where("keep").select("frame_id", "x0").distinct()
    rows = tiles.join(rare_order(spark, d).select("frame_id", big("position")), "frame_id")
    return sp.to_budget(rows, ["position", "x0"], 500).select("frame_id", "x0", "position")


@query("round_robin_draw", "H6", """SELECT o_orderpriority AS camera, o_orderkey AS frame_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('rr:' || o_orderkey), o_orderkey) AS turn FROM orders)
ORDER BY turn, camera LIMIT 120""")
def round_robin_draw(spark, d):
    return sp.round_robin(t.frames(spark, d).select("camera", "frame_id"), "camera", 120, "rr").select("camera", "frame_id", "turn")


@query("seeded_strip_order", "H8", f"SELECT o_custkey AS coil_id, o_orderkey AS frame_id, row_number() OVER (PARTITION BY o_custkey ORDER BY {s.unit('shuffle', 'o_orderkey')}, o_orderkey) AS place FROM orders")
def seeded_strip_order(spark, d):
    return sp.hash_rank(t.frames(spark, d).select("coil_id", "frame_id"), ["coil_id"], "shuffle", "frame_id", "place").select("coil_id", "frame_id", big("place"))


@query("cross_split_duplicates", "I1", cte("content") + """SELECT content_sha256, CAST(sum(n) AS BIGINT) AS copies, count(*) AS splits, CAST(sum(n-1) AS BIGINT) AS within_split_copies FROM (SELECT content_sha256, split, count(*) AS n FROM content GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) > 1""")
def cross_split_duplicates(spark, d):
    return sp.cross_split_duplicates(t.content(spark, d))


def _pairs_sql(key):
    return cte("content") + f"""SELECT a || '^' || b AS pair, (SELECT count(*) FROM (SELECT {key} FROM content WHERE split = a INTERSECT SELECT {key} FROM content WHERE split = b)) AS shared
FROM (VALUES ('train','val'), ('train','test'), ('val','test')) v(a, b)"""


@query("split_hash_overlap", "I2", _pairs_sql("content_sha256"))
def split_hash_overlap(spark, d):
    return sp.split_overlap(t.content(spark, d), "content_sha256")


@query("split_source_overlap", "I2", _pairs_sql("sequence_id"))
def split_source_overlap(spark, d):
    return sp.split_overlap(t.content(spark, d), "sequence_id")


@query("upstream_leakage", "I3", cte("content") + """, q AS (SELECT sequence_id FROM content WHERE split='train' INTERSECT SELECT sequence_id FROM content WHERE split='test'),
h AS (SELECT content_sha256 FROM content WHERE split='train' INTERSECT SELECT content_sha256 FROM content WHERE split='test')
SELECT count(DISTINCT sequence_id) FILTER (split='train') AS a_sequences, count(DISTINCT sequence_id) FILTER (split='test') AS b_sequences, (SELECT count(*) FROM q) AS shared_sequences,
 (SELECT count(*) FROM h) AS shared_hashes, (SELECT string_agg(sequence_id, ',' ORDER BY sequence_id) FROM (SELECT * FROM q ORDER BY 1 LIMIT 8)) AS examples FROM content""")
def upstream_leakage(spark, d):
    out = sp.upstream_leakage(t.content(spark, d))
    return out.select(*[big(c) for c in ("a_sequences", "b_sequences", "shared_sequences", "shared_hashes")], "examples")


@query("first_occurrence_dedup", "I4", """SELECT sha256(text) AS content_sha256, arg_min(doc_id, (source, doc_id)) AS doc_id, min(source) AS source FROM documents GROUP BY 1""")
def first_occurrence_dedup(spark, d):
    rows = t.read(spark, d, "documents").select(F.sha2("text", 256).alias("content_sha256"), "source", "doc_id")
    return sp.first_occurrence(rows, "content_sha256", ["source", "doc_id"])


@query("dataset_assertions", "I5", cte("gt", "frames", "content") + f"""
SELECT 'class ids in the vocabulary' AS name, count(*) FILTER (class_id NOT BETWEEN 0 AND 5) = 0 AS ok, count(*) FILTER (class_id NOT BETWEEN 0 AND 5) || ' of ' || count(*) AS detail FROM gt
UNION ALL SELECT 'boxes have positive size', count(*) FILTER (NOT (x2 > x1 AND y2 > y1)) = 0, count(*) FILTER (NOT (x2 > x1 AND y2 > y1)) || ' of ' || count(*) FROM gt
UNION ALL SELECT 'boxes inside the frame', count(*) FILTER (x1 < -1e-6 OR y1 < -1e-6 OR x2 > 200+1e-6 OR y2 > 200+1e-6) = 0, count(*) FILTER (x1 < -1e-6 OR y1 < -1e-6 OR x2 > 200+1e-6 OR y2 > 200+1e-6) || ' of ' || count(*) FROM gt
UNION ALL SELECT 'certified clean frames have no box', count(*) FILTER (frame_id % 4 = 0) = 0, count(*) FILTER (frame_id % 4 = 0) || ' of ' || count(*) FROM gt
UNION ALL SELECT 'splits share no content', count(*) FILTER (k > 1) = 0, count(*) FILTER (k > 1) || ' of ' || count(*) FROM (SELECT content_sha256, count(DISTINCT split) AS k FROM content GROUP BY 1)
UNION ALL SELECT 'no source in two splits', count(*) FILTER (k > 1) = 0, count(*) FILTER (k > 1) || ' of ' || count(*) FROM (SELECT coil_id, count(DISTINCT split) AS k FROM frames GROUP BY 1)
UNION ALL SELECT 'labels refer to a frame', count(*) FILTER (f.frame_id IS NULL) = 0, count(*) FILTER (f.frame_id IS NULL) || ' of ' || count(*) FROM gt LEFT JOIN frames f USING (frame_id)""")
def dataset_assertions(spark, d):
    g, f, c = gt(spark, d), t.frames(spark, d), t.content(spark, d)
    eps = 1e-6
    tally = lambda df, bad: df.agg(F.coalesce(F.sum(bad.cast("bigint")), F.lit(0)).alias("bad"), F.count(F.lit(1)).alias("total"))
    straddle = lambda df, key: tally(df.groupBy(key).agg((F.min("split") != F.max("split")).alias("x")), F.col("x"))
    return sp.assertions([
        ("class ids in the vocabulary", tally(g, ~F.col("class_id").between(0, 5))),
        ("boxes have positive size", tally(g, ~((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))))),
        ("boxes inside the frame", tally(g, (F.col("x1") < -eps) | (F.col("y1") < -eps) | (F.col("x2") > 200 + eps) | (F.col("y2") > 200 + eps))),
        ("certified clean frames have no box", tally(g, F.col("frame_id") % 4 == 0)),
        ("splits share no content", straddle(c, "content_sha256")),
        ("no source in two splits", straddle(f, "coil_id")),
        ("labels refer to a frame", tally(g.join(f.select("frame_id", F.lit(1).alias("ok")), "frame_id", "left"), F.col("ok").isNull())),
    ])


@query("label_rederivation", "I6", cte("gt") + """SELECT class_id, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM gt GROUP BY 1""")
def label_rederivation(spark, d):
    """Labels written as text, read back, and compared with the originals in both directions."""
    from ..sources.labels import label_lines, parse_label_lines

    g, f = gt(spark, d), t.frames(spark, d)
    near = lambda df: df.select("frame_id", "class_id", *[F.round(c, 3).alias(c) for c in ("x1", "y1", "x2", "y2")])
    back = parse_label_lines(label_lines(g, f), f)
    diff = sp.label_diff(near(g), near(back)).groupBy("class_id").agg(F.count(F.lit(1)).alias("differing"))
    n = g.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(diff, "class_id", "left").fillna(0)


@query("holdout_safe_view", "A12 B14", cte("frames") + f""", h AS (SELECT *, NOT (split IN ('train','val') AND domain = 'sev' AND {s.unit('holdout', 'coil_id')} < 0.5) AS kept FROM frames)
SELECT split, count(*) AS images_in, count(*) FILTER (kept) AS images_kept, count(*) FILTER (NOT kept) AS images_dropped, count(DISTINCT coil_id) FILTER (NOT kept) AS sources_dropped FROM h GROUP BY 1""")
def holdout_safe_view(spark, d):
    _, stats = sp.holdout_view(t.frames(spark, d), (F.col("domain") == "sev") & in_holdout("holdout", 0.5, "coil_id"))
    return stats.select("split", *[big(c) for c in ("images_in", "images_kept", "images_dropped", "sources_dropped")])


@query("exclusion_list", "D7 B14", cte("frames", "gt", "mask_runs") + f""", ex AS (SELECT frame_id FROM frames WHERE coil_id % 50 = 7),
c AS (SELECT frame_id, frame_id % 4 = 0 AS clean, frame_id IN (SELECT frame_id FROM gt) AS defect, frame_id IN (SELECT frame_id FROM mask_runs) AS masked, frame_id IN (SELECT frame_id FROM ex) AS ex, {s.unit('holdout', 'frame_id')} < 0.5 AS held FROM frames)
SELECT count(*) FILTER (clean AND NOT ex AND held) AS clean_scored, count(*) FILTER (clean AND (ex OR NOT held)) AS clean_train, count(*) FILTER (defect AND masked AND NOT ex AND held) AS defect_scored,
 count(*) FILTER (defect AND masked AND (ex OR NOT held)) AS defect_train, count(*) FILTER (defect AND NOT masked) AS defect_without_mask, count(*) FILTER (clean AND defect) AS overlap FROM c""")
def exclusion_list(spark, d):
    f = t.frames(spark, d)
    ex = f.where("coil_id % 50 = 7").select("frame_id").withColumn("ex", F.lit(True))
    has = lambda df, n: df.select("frame_id").distinct().withColumn(n, F.lit(True))
    c = f.join(has(gt(spark, d), "defect"), "frame_id", "left").join(has(t.mask_runs(spark, d), "masked"), "frame_id", "left").join(ex, "frame_id", "left")
    c = c.fillna(False, subset=["defect", "masked", "ex"]).withColumn("clean", F.col("frame_id") % 4 == 0).withColumn("held", in_holdout("holdout", 0.5, "frame_id"))
    n = lambda cond, name: F.sum(F.expr(cond).cast("bigint")).alias(name)
    return c.agg(n("clean and not ex and held", "clean_scored"), n("clean and (ex or not held)", "clean_train"), n("defect and masked and not ex and held", "defect_scored"),
                 n("defect and masked and (ex or not held)", "defect_train"), n("defect and not masked", "defect_without_mask"), n("clean and defect", "overlap"))


@query("paired_alignment", "D10", cte("det", "det2") + """, a AS (SELECT frame_id, count(*) AS n FROM det GROUP BY 1), b AS (SELECT frame_id, count(*) AS n FROM det2 GROUP BY 1)
SELECT count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS paired, count(*) FILTER (b.n IS NULL) AS missing_in_b, count(*) FILTER (a.n IS NULL) AS missing_in_a FROM a FULL JOIN b USING (frame_id)""")
def paired_alignment(spark, d):
    a = det(spark, d).groupBy("frame_id").agg(F.count(F.lit(1)).alias("na"))
    b = det(spark, d, "B").groupBy("frame_id").agg(F.count(F.lit(1)).alias("nb"))
    n = lambda c, name: F.sum(c.cast("bigint")).alias(name)
    return a.join(b, "frame_id", "full").agg(n(F.col("na").isNotNull() & F.col("nb").isNotNull(), "paired"), n(F.col("nb").isNull(), "missing_in_b"), n(F.col("na").isNull(), "missing_in_a"))


@query("manifest_reconciliation", "D11", cte("gt", "frames", "base") + """, c AS (SELECT coil_id, count(*) AS n FROM gt JOIN frames USING (frame_id) GROUP BY 1), k AS (SELECT coil_id, count(*) AS n FROM base JOIN frames USING (frame_id) WHERE rf <> 'N' GROUP BY 1)
SELECT coil_id, c.n AS counted, k.n AS claimed, c.n IS NOT DISTINCT FROM k.n AS agrees FROM c FULL JOIN k USING (coil_id)""")
def manifest_reconciliation(spark, d):
    f = t.frames(spark, d).select("frame_id", "coil_id")
    counted = gt(spark, d).join(f, "frame_id").groupBy("coil_id").agg(F.count(F.lit(1)).alias("n"))
    claimed = t._base(spark, d).where("rf <> 'N'").join(f, "frame_id").groupBy("coil_id").agg(F.count(F.lit(1)).alias("n"))
    return sp.reconcile(counted, claimed, ["coil_id"], "n")


@query("published_vs_recomputed", "D12", cte("timings") + """, r AS (SELECT model, imgsz, avg(per_frame_ms) AS v FROM timings GROUP BY 1, 2)
SELECT count(*) AS cells, round(max(abs(v - round(v, 2))), 6) AS max_abs_diff, max(abs(v - round(v, 2))) < 1e-9 AS exact FROM r""")
def published_vs_recomputed(spark, d):
    r = t.timings(spark, d).groupBy("model", "imgsz").agg(F.avg("per_frame_ms").alias("v"))
    out = sp.reproduction(r.withColumn("v", F.round("v", 2)), r, ["model", "imgsz"], "v")
    return out.select("cells", r6("max_abs_diff"), "exact")


# ---------------------------------------------------------------- capacity, logs, selection

RESULTS_SQL = f""", res AS (SELECT CAST(o_orderkey % 2 AS VARCHAR) AS model, ([256,320,416,512,640])[o_custkey % 5 + 1] AS imgsz, split, o_orderkey % 10 = 0 AS augment,
 CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE (o_orderkey*13 % 1000)/CAST(1000 AS DOUBLE) END AS map50 FROM orders JOIN (SELECT frame_id, split FROM frames) f ON frame_id = o_orderkey),
acc AS (SELECT model, imgsz, split, avg(map50) AS m FROM res WHERE NOT augment AND map50 IS NOT NULL GROUP BY 1, 2, 3)"""


def results(spark, d):
    """Stored accuracy rows; some are augmented runs and some lack their figure."""
    i = F.col("frame_id")
    return t.frames(spark, d).select(
        (i % 2).cast("string").alias("model"), F.get(F.array(*[F.lit(v) for v in (256, 320, 416, 512, 640)]), (F.col("coil_id") % 5).cast("int")).alias("imgsz"),
        "split", (i % 10 == 0).alias("augment"), F.when(i % 23 != 0, (i * 13 % 1000) / dbl(1000)).alias("map50"))


@query("stored_accuracy", "A7", cte("frames") + RESULTS_SQL + "SELECT model, imgsz, round(m, 6) AS map50 FROM acc WHERE split = 'val'")
def stored_accuracy(spark, d):
    return cp.accuracy_by_size(results(spark, d), "val").select("model", "imgsz", r6("map50"))


FOLD_SQL = cte("timings", "frames") + RESULTS_SQL + """, rk AS (SELECT *, row_number() OVER (PARTITION BY model, device, imgsz, batch ORDER BY per_frame_ms) AS r, count(*) OVER (PARTITION BY model, device, imgsz, batch) AS n FROM timings WHERE ok),
fd AS (SELECT c.*, m.median_ms, m.min_ms, m.max_ms, CASE WHEN m.min_ms > 0 THEN m.max_ms/m.min_ms ELSE 0 END AS spread_ratio FROM (SELECT model, device, imgsz, batch, count(*) AS runs, count(*) FILTER (ok) AS passes FROM timings GROUP BY 1,2,3,4) c
 LEFT JOIN (SELECT model, device, imgsz, batch, max(per_frame_ms) FILTER (r = (n-1)//2 + 1) AS median_ms, min(per_frame_ms) AS min_ms, max(per_frame_ms) AS max_ms FROM rk GROUP BY 1,2,3,4) m USING (model, device, imgsz, batch)),
fr AS (SELECT *, 1000/median_ms AS fps, 1000/max_ms AS fps_slow FROM fd WHERE median_ms IS NOT NULL),
pk AS (SELECT device, model, imgsz, max(fps) AS measured_fps, arg_max(batch, (fps, -batch)) AS at_batch, arg_max(median_ms, (fps, -batch)) AS per_frame_ms, arg_max(fps_slow, (fps, -batch)) AS slowest_fps FROM fr GROUP BY 1,2,3),
ps AS (SELECT *, measured_fps*0.7::DOUBLE AS sus, slowest_fps*0.7::DOUBLE AS sus_slow, (CASE WHEN imgsz >= 2048 THEN 1 ELSE len(list_distinct(list_append(range(0, 2048-imgsz+1, CAST(round_even(imgsz*0.8::DOUBLE, 0) AS BIGINT)), 2048-imgsz))) END) AS side FROM pk)"""


@query("repeat_folding", "E24", FOLD_SQL + "SELECT model, device, imgsz, batch, runs, passes, median_ms, min_ms, max_ms, round(spread_ratio, 6) AS spread_ratio FROM fd")
def repeat_folding(spark, d):
    return cp.fold_repeats(t.timings(spark, d)).select("model", "device", "imgsz", "batch", "runs", big("passes"), "median_ms", "min_ms", "max_ms", r6("spread_ratio"))


def peaks(spark, d):
    return cp.peak_per_size(cp.fold_repeats(t.timings(spark, d)))


@query("peak_per_input_size", "E25", FOLD_SQL + "SELECT device, model, imgsz, round(measured_fps, 6) AS measured_fps, at_batch, per_frame_ms, round(sus, 6) AS sustainable_fps, round(sus_slow, 6) AS sustainable_fps_slow FROM ps")
def peak_per_input_size(spark, d):
    return peaks(spark, d).select("device", "model", "imgsz", r6("measured_fps"), "at_batch", "per_frame_ms", r6("sustainable_fps"), r6("sustainable_fps_slow"))


_LINES = ", ".join(f"('{n}', {v}::DOUBLE)" for n, v in cp.SPEEDS.items())


@query("capacity_plan", "E26", FOLD_SQL + f""", ln AS (SELECT * FROM (VALUES {_LINES}) v(line, speed)), g AS (SELECT 2048*0.2::DOUBLE/1000 AS fov),
q AS (SELECT ps.*, line, speed, greatest(1, ceil(1.28::DOUBLE/(fov*(1-0.08::DOUBLE)))) AS cams, speed/60/(fov*(1-0.15::DOUBLE)) AS raw, side*side AS tiles FROM ps, ln, g),
w AS (SELECT *, round(raw, 2) AS fpc, round(raw*cams*tiles, 1) AS it, round(raw*cams, 2) AS idn, round(raw*tiles, 2) AS pst FROM q)
SELECT device, model, imgsz, line, CAST(tiles AS BIGINT) AS tiles, CAST(cams AS BIGINT) AS cameras, fpc AS fps_per_camera, it AS inferences_tiled, CAST(floor(sus/pst) AS BIGINT) AS streams_tiled, CAST(floor(sus/fpc) AS BIGINT) AS streams_downscaled,
 CAST(ceil(it/sus) AS BIGINT) AS accelerators_tiled, CAST(ceil(idn/sus) AS BIGINT) AS accelerators_downscaled, CAST(ceil(it/sus_slow) AS BIGINT) AS accelerators_tiled_slow, round(round(speed/60, 3)*200/1000, 3) AS travel_m,
 CASE WHEN at_batch > 1 THEN round(1000*at_batch/(it/ceil(it/sus)), 6) END AS batch_fill_ms FROM w""")
def capacity_plan(spark, d):
    out = cp.capacity_plan(peaks(spark, d))
    return out.select("device", "model", "imgsz", "line", big("tiles"), big("cameras"), "fps_per_camera", "inferences_tiled", "streams_tiled", "streams_downscaled",
                      "accelerators_tiled", "accelerators_downscaled", "accelerators_tiled_slow", "travel_m", r6("batch_fill_ms"))


@query("cheapest_accurate_size", "E27", FOLD_SQL + """, v AS (SELECT model, imgsz, m FROM acc WHERE split='val'), b AS (SELECT model, max(m) AS bm FROM v GROUP BY 1),
c AS (SELECT ps.*, m, bm, side*side/sus AS cost, CASE WHEN coalesce(m, 0) >= 0.95::DOUBLE*bm THEN 0 ELSE 1 END AS u FROM ps LEFT JOIN v USING (model, imgsz) JOIN b USING (model))
SELECT device, model, arg_min(imgsz, (u, cost, imgsz)) AS imgsz, round(arg_min(cost, (u, cost, imgsz)), 6) AS cost, round(arg_min(m, (u, cost, imgsz)), 6) AS map50, round(max(bm), 6) AS best_map50 FROM c GROUP BY 1, 2""")
def cheapest_accurate_size(spark, d):
    out = cp.cheapest_accurate_size(peaks(spark, d), cp.accuracy_by_size(results(spark, d), "val"))
    return out.select("device", "model", "imgsz", r6("cost"), r6("map50"), r6("best_map50"))


@query("select_on_val_report_on_test", "H5 A7", cte("frames") + RESULTS_SQL + """, b AS (SELECT model, arg_max(imgsz, (m, -imgsz)) AS imgsz, max(m) AS tm FROM acc WHERE split='val' GROUP BY 1)
SELECT b.model, b.imgsz, round(tm, 6) AS tune_map50, round(m, 6) AS report_map50, b.model = (SELECT arg_max(model, (tm, model)) FROM b) AS chosen FROM b LEFT JOIN acc ON acc.split='test' AND acc.model=b.model AND acc.imgsz=b.imgsz""")
def select_on_val_report_on_test(spark, d):
    return cp.select_then_report(results(spark, d)).select("model", "imgsz", r6("tune_map50"), r6("report_map50"), "chosen")


@query("training_history", "G2 A6", cte("train_log") + """, c AS (SELECT *, time_s - coalesce(lag(time_s) OVER (PARTITION BY run ORDER BY epoch), 0) AS cost, 0.1::DOUBLE*map50 + 0.9::DOUBLE*map50_95 AS fit FROM train_log), m AS (SELECT run, quantile_cont(cost, 0.5) AS med FROM c GROUP BY 1)
SELECT run, count(*) AS epochs, arg_max(epoch, (fit, -epoch)) AS best_epoch, arg_max(map50, (fit, -epoch)) AS best_map50, arg_max(map50_95, (fit, -epoch)) AS best_map50_95, max(time_s) AS wall_s, any_value(med) AS median_epoch_s,
 CAST(sum((cost > 3*med)::INT) AS BIGINT) AS stalled_epochs, sum(CASE WHEN cost > 3*med THEN cost ELSE 0 END) AS stall_s, round(max(time_s)/count(*), 6) AS mean_epoch_s, round(arg_max(map50-map50_95, epoch), 6) AS final_gap FROM c JOIN m USING (run) GROUP BY 1""")
def training_history(spark, d):
    out = cp.training_history(reuse(t.train_log(spark, d)))
    return out.select("run", "epochs", "best_epoch", "best_map50", "best_map50_95", "wall_s", "median_epoch_s", big("stalled_epochs"), "stall_s", r6("mean_epoch_s"), r6("final_gap"))


# ---------------------------------------------------------------- scorecards and picks

@query("split_census", "E28", cte("gt", "frames") + """, n AS (SELECT frame_id, count(*) AS n, """ + ", ".join(f"count(*) FILTER (class_id = {i}) AS c{i}" for i in range(6)) + """ FROM gt GROUP BY 1)
SELECT split, count(*) AS images, count(n.n) AS labelled, count(*) - count(n.n) AS background, """ + ", ".join(f"CAST(coalesce(sum(c{i}), 0) AS BIGINT) AS class_{i}" for i in range(6)) + " FROM frames LEFT JOIN n USING (frame_id) GROUP BY 1")
def split_census(spark, d):
    return ce.split_census(t.frames(spark, d), gt(spark, d), 6)


@query("family_rollup", "E29", AT_SQL + """, r AS (SELECT class_id, count(*) AS n, avg(found::INT) AS recall FROM found GROUP BY 1)
SELECT CASE WHEN class_id IN (0, 4) THEN 'texture' WHEN class_id IN (1, 3) THEN 'material' ELSE 'surface' END AS family, count(*) AS classes, CAST(sum(n) AS BIGINT) AS instances, round(avg(recall), 6) AS mean_recall FROM r GROUP BY 1""")
def family_rollup(spark, d):
    _, found, _ = _at(spark, d)
    out = ce.family_rollup(found, {0: "texture", 4: "texture", 1: "material", 3: "material"}, "surface")
    return out.select("family", "classes", "instances", r6("mean_recall"))


@query("finish_scorecard", "E30 B2", cte("frames", "gt", "det", "dim") + NAMES_SQL + """, p AS (SELECT CASE WHEN split_part(d, '_', 1) IN ('2b','ba','hl','mirror') THEN split_part(d, '_', 1) ELSE 'other' END AS finish, lower(split_part(d, '_', 2)) <> 'clean' AS defective,
 frame_id IN (SELECT frame_id FROM det WHERE conf >= 0.5) AS flagged FROM nm)
SELECT finish, count(*) AS photos, count(*) FILTER (NOT defective) AS clean, count(*) FILTER (NOT defective AND flagged) AS clean_flagged, count(*) FILTER (defective) AS defective, count(*) FILTER (defective AND flagged) AS defective_flagged FROM p GROUP BY 1""")
def finish_scorecard(spark, d):
    p = names(spark, d).select("frame_id", *[c.alias(n) for n, c in nm.finish_and_label("d").items()])
    hit = det(spark, d).where("conf >= 0.5").select("frame_id").distinct().withColumn("flagged", F.lit(1))
    p = p.join(hit, "frame_id", "left").withColumn("bad", F.col("label") != "clean")
    n = lambda c, name: F.sum(c.cast("bigint")).alias(name)
    fl = F.col("flagged").isNotNull()
    return p.groupBy("finish").agg(F.count(F.lit(1)).alias("photos"), n(~F.col("bad"), "clean"), n(~F.col("bad") & fl, "clean_flagged"), n(F.col("bad"), "defective"), n(F.col("bad") & fl, "defective_flagged"))


@query("types_reported", "E30", cte("det", "dim") + "SELECT class_name, count(*) AS n FROM det JOIN dim USING (class_id) WHERE conf >= 0.5 GROUP BY 1")
def types_reported(spark, d):
    from ..functions.severity import class_name

    return det(spark, d).where("conf >= 0.5").groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).select(class_name("class_id").alias("class_name"), "n")


@query("right_type_rates", "E31", cte("det", "det2", "gt", "frames") + """, ic AS (SELECT frame_id, arg_max(class_id, (n, a, -class_id)) AS image_class FROM (SELECT frame_id, class_id, count(*) AS n, sum((x2-x1)*(y2-y1)) AS a FROM gt GROUP BY 1, 2) GROUP BY 1),
dd AS (SELECT * FROM det UNION ALL SELECT * FROM det2), p AS (SELECT model, frame_id, arg_max(class_id, (conf, -det_id)) AS pc, max(conf) AS mc FROM dd GROUP BY 1, 2),
f AS (SELECT m.model, frames.frame_id, image_class, CASE WHEN mc >= 0.05 THEN pc END AS pc, coalesce(mc, 0) AS mc FROM frames, (SELECT unnest(['A','B']) AS model) m LEFT JOIN ic ON ic.frame_id = frames.frame_id LEFT JOIN p ON p.frame_id = frames.frame_id AND p.model = m.model)
SELECT model, count(*) FILTER (image_class IS NOT NULL AND pc = image_class) AS right_type, count(*) FILTER (image_class IS NOT NULL) AS labelled, count(*) FILTER (frame_id % 4 = 0 AND mc >= 0.15) AS clean_flagged, count(*) FILTER (frame_id % 4 = 0) AS clean,
 count(*) FILTER (image_class IS NOT NULL AND mc >= 0.15) AS defect_flagged FROM f GROUP BY 1""")
def right_type_rates(spark, d):
    every = det(spark, d).unionByName(det(spark, d, "B"))
    return ce.right_type_rates(t.frames(spark, d).select("frame_id"), gt(spark, d), every, ["A", "B"], F.col("frame_id") % 4 == 0)


@query("family_peak_confidence", "E32", cte("det", "gt", "dim") + """, ic AS (SELECT frame_id, arg_max(class_id, (n, a, -class_id)) AS class_id FROM (SELECT frame_id, class_id, count(*) AS n, sum((x2-x1)*(y2-y1)) AS a FROM gt GROUP BY 1, 2) GROUP BY 1),
m AS (SELECT ic.class_id, coalesce((SELECT max(conf) FROM det WHERE det.frame_id = ic.frame_id), 0) AS mc FROM ic), a AS (SELECT class_id, quantile_cont(mc, 0.5) AS med, avg((mc < 0.5)::INT) AS low FROM m GROUP BY 1),
f AS (SELECT class_name AS family, med, low FROM dim LEFT JOIN a USING (class_id) UNION ALL SELECT 'unmeasured', NULL, NULL)
SELECT family, round(med, 6) AS median_peak, round(low, 6) AS share_under_half, row_number() OVER (ORDER BY med DESC NULLS LAST, family) AS place FROM f""")
def family_peak_confidence(spark, d):
    fam = vocab.dim_class(spark).select("class_id", F.col("class_name").alias("family")).unionByName(spark.createDataFrame([(99, "unmeasured")], "class_id int, family string"))
    return ce.family_peaks(gt(spark, d), det(spark, d), fam).select("family", r6("median_peak"), r6("share_under", "share_under_half"), "place")


@query("best_all_correct_frame", "H4", cte("det", "gt") + """, ic AS (SELECT frame_id, arg_max(class_id, (n, a, -class_id)) AS c FROM (SELECT frame_id, class_id, count(*) AS n, sum((x2-x1)*(y2-y1)) AS a FROM gt GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT frame_id, any_value(c) AS c, count(*) AS n, bool_and(class_id = c) AS ok, avg(conf) AS score FROM det JOIN ic USING (frame_id) WHERE conf >= 0.25 GROUP BY 1)
SELECT c AS class_id, arg_max(frame_id, (round(score, 9), -frame_id)) AS frame_id, round(max(score), 6) AS score FROM b WHERE ok AND n <= 4 GROUP BY 1""")
def best_all_correct_frame(spark, d):
    return ce.best_all_correct_frames(gt(spark, d), det(spark, d)).select("class_id", "frame_id", r6("score"))


PICKS = ((0, 4), (1, 3), (2, 5))


def _pick_sql():
    out, used = [], "SELECT -1"
    ctes = []
    for i, (a, b) in enumerate(PICKS):
        ctes.append(f"""s{i} AS (SELECT frame_id, row_number() OVER (ORDER BY (split NOT IN ('test','val'))::INT, (ca{a} = 0)::INT, (fr IS NULL)::INT, -(ca{a}+ca{b}), other, -coalesce(fr, 0), frame_id) AS place FROM
 (SELECT f.frame_id, f.split, x.* EXCLUDE (frame_id), (SELECT max((x2-x1)*(y2-y1)/40000) FROM gt g WHERE g.frame_id = f.frame_id AND g.class_id IN ({a},{b}) AND (x2-x1)*(y2-y1)/40000 BETWEEN 0.0005 AND 0.35) AS fr,
   (SELECT count(DISTINCT class_id) FROM gt g WHERE g.frame_id = f.frame_id AND class_id NOT IN ({a},{b})) AS other FROM frames f JOIN cnt x USING (frame_id) WHERE ca{a}+ca{b} > 0 AND f.frame_id NOT IN ({used}))),
p{i} AS (SELECT coalesce(arg_min(frame_id, place) FILTER (frame_id*31 % 256 >= 60), arg_min(frame_id, place)) AS frame_id FROM s{i} WHERE place <= 25)""")
        out.append(f"SELECT {i} AS pick, frame_id, frame_id*31 % 256 AS level FROM p{i}")
        used += f" UNION ALL SELECT frame_id FROM p{i}"
    cnt = "cnt AS (SELECT frame_id, " + ", ".join(f"count(*) FILTER (class_id={i}) AS ca{i}" for i in range(6)) + " FROM gt GROUP BY 1)"
    return cte("gt", "frames") + ", " + cnt + ", " + ", ".join(ctes) + " " + " UNION ALL ".join(out)


@query("representative_picks", "H3", _pick_sql())
def representative_picks(spark, d):
    """One well-lit, representative frame per family, without reuse; brightness comes from the frame table."""
    frac = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / 40000
    g, f = gt(spark, d), t.frames(spark, d)
    chosen: list[int] = []
    rows = []
    for i, want in enumerate(PICKS):
        mine = F.col("class_id").isin(*want)
        per = g.groupBy("frame_id").agg(
            F.sum((F.col("class_id") == want[0]).cast("int")).alias("lead"), F.sum(mine.cast("int")).alias("hits"),
            F.count_distinct(F.when(~mine, F.col("class_id"))).alias("other"), F.max(F.when(mine & frac.between(0.0005, 0.35), frac)).alias("fr"))
        pool = f.join(per.where("hits > 0"), "frame_id").where(~F.col("frame_id").isin(*chosen) if chosen else F.lit(True))
        order = [(~F.col("split").isin("test", "val")).cast("int"), (F.col("lead") == 0).cast("int"), F.col("fr").isNull().cast("int"), -F.col("hits"), F.col("other"),
                 -F.coalesce("fr", dbl(0)), F.col("frame_id")]
        short = pool.orderBy(*order).limit(25).select("frame_id", (F.col("frame_id") * 31 % 256).alias("level")).collect()  # shortlist of 25
        if short:
            pick = next((r for r in short if r["level"] >= 60), short[0])
            chosen.append(pick["frame_id"])
            rows.append((i, pick["frame_id"], pick["level"]))
    return spark.createDataFrame(rows, "pick int, frame_id bigint, level bigint")
