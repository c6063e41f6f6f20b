"""Sources and sinks, photometrics, streams, scoring and SQL functions."""

from __future__ import annotations


import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import sql as fsql
from ..functions import vocab
from ..functions.geometry import dbl
from ..operators import coil as op
from ..operators import photometric as ph
from ..operators import scoring as sc
from ..session import ensure_checkpoint_dir, reuse
from ..sources import coco, labels, sinks
from ..sources import logs
from ..sources import tables as t
from ..streaming import coils as live
from ..streaming import monitor as mo
from . import sql as s
from .base import big, det, gt, query, r6
from .coil import DISPOSE_SQL, STATS_SQL, _kept, _results, _results_sql
from .sql import cte
from .statistics import wilson_sql
from .tiling import strips

# ---------------------------------------------------------------- label text, annotations, sinks

LINE = "printf('%d %.6f %.6f %.6f %.6f', class_id, (x1+x2)/2/200, (y1+y2)/2/200, (x2-x1)/200, (y2-y1)/200)"


@query("label_text_files", "A9", cte("gt", "frames") + f"""SELECT frame_id, 0 AS chunk, coalesce(txt, '') AS text FROM frames LEFT JOIN
 (SELECT frame_id, string_agg({LINE}, chr(10) ORDER BY box_id) || chr(10) AS txt FROM gt GROUP BY 1) USING (frame_id)""")
def label_text_files(spark, d):
    f = t.frames(spark, d)
    return labels.label_texts(labels.label_lines(gt(spark, d), f), f)


@query("label_text_scan", "A1", cte("gt", "frames") + """SELECT f.frame_id, g.class_id, round(g.x1, 3) AS x1, round(g.y1, 3) AS y1, round(g.x2, 3) AS x2, round(g.y2, 3) AS y2 FROM frames f LEFT JOIN gt g USING (frame_id)""")
def label_text_scan(spark, d):
    """Text lines, some of them short, back to boxes; frames without lines stay as background."""
    f = t.frames(spark, d)
    lines = labels.label_lines(gt(spark, d), f).select("frame_id", "line")
    short = f.select("frame_id", F.lit("3 0.5 0.5").alias("line"))
    boxes = labels.parse_label_lines(lines.unionByName(short), f)
    return f.select("frame_id").join(boxes, "frame_id", "left").select("frame_id", "class_id", *[r6(c, digits=3) for c in ("x1", "y1", "x2", "y2")])


@query("coco_annotation_scan", "A2 B3", cte("det", "dim", "frames") + """, a AS (SELECT * FROM det WHERE class_id <> 5),
c AS (SELECT *, greatest(0, x1) AS l, greatest(0, y1) AS tt, least(160, x2) AS r, least(160, y2) AS b FROM a)
SELECT count(*) AS boxes, count(*) FILTER (x2 > 160 OR y2 > 160) AS clipped, count(*) FILTER (r-l < 1 OR b-tt < 1) AS degenerate, (SELECT count(*) FROM frames WHERE frame_id NOT IN (SELECT frame_id FROM a)) AS images_without_boxes FROM c""")
def coco_annotation_scan(spark, d):
    """The last class plays the placeholder category without a name in the vocabulary."""
    images = t.frames(spark, d).select(F.col("frame_id").alias("id"), F.lit(160).alias("width"), F.lit(160).alias("height"))
    ann = det(spark, d).select(F.col("det_id").alias("id"), F.col("frame_id").alias("image_id"), (F.col("class_id") + 1).alias("category_id"),
                               F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    cats = vocab.dim_class(spark).select((F.col("class_id") + 1).alias("id"), F.when(F.col("class_id") == 5, "placeholder").otherwise(F.col("class_name")).alias("name"))
    return coco.coco_counters(coco.coco_boxes(images, ann, cats, vocab.CLASSES))


@query("upsert_by_tag", "A10", """SELECT tag, CAST(max(v) AS BIGINT) AS orders, arg_max(src, v) AS source FROM (
 SELECT 'coil-' || o_custkey AS tag, count(*) AS v, 'old' AS src FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0) GROUP BY o_custkey
 UNION ALL SELECT 'coil-' || o_custkey, count(*), 'new' FROM orders WHERE o_custkey % 3 = 0 GROUP BY o_custkey) GROUP BY 1""")
def upsert_by_tag(spark, d):
    per = t.frames(spark, d).groupBy("coil_id").agg(F.count(F.lit(1)).alias("orders"))
    row = lambda df, src, at: df.select(F.concat(F.lit("coil-"), F.col("coil_id").cast("string")).alias("tag"), F.lit(at).alias("generated_at"), "orders", F.lit(src).alias("source"))
    out = sinks.upsert_by_tag(row(per, "old", "2024-01-01"), row(per.where("coil_id % 3 = 0"), "new", "2024-02-01"))
    return out.select("tag", "orders", "source")


@query("guarded_publish", "A11", """SELECT o_custkey AS coil_id, CASE WHEN o_custkey % 5 = 4 THEN 'kept' WHEN o_custkey % 5 = 3 THEN 'created' WHEN o_custkey % 2 = 0 THEN 'refused' ELSE 'overwritten' END AS status,
 CASE WHEN o_custkey % 5 = 4 THEN 0.1 WHEN o_custkey % 5 = 3 THEN 0.2 WHEN o_custkey % 2 = 0 THEN 0.1 ELSE 0.2 END::DOUBLE AS conf FROM (SELECT DISTINCT o_custkey FROM orders)""")
def guarded_publish(spark, d):
    ids = t.frames(spark, d).select("coil_id").distinct()
    mine = F.when(F.col("coil_id") % 2 == 0, "other-tool").otherwise("this-tool")
    old = ids.where("coil_id % 5 <> 3").select("coil_id", dbl(0.1).alias("conf"), mine.alias("source"))
    new = ids.where("coil_id % 5 <> 4").select("coil_id", dbl(0.2).alias("conf"), F.lit("this-tool").alias("source"))
    return sinks.guarded_publish(old, new, ["coil_id"]).select("coil_id", "status", "conf")


@query("operating_point_defaults", "A7", """SELECT o_custkey AS coil_id, CASE WHEN c > 0 AND c < 1 THEN c ELSE 0.15::DOUBLE END AS conf FROM (SELECT o_custkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_custkey % 13)/CAST(10 AS DOUBLE) END AS c FROM (SELECT DISTINCT o_custkey FROM orders))""")
def operating_point_defaults(spark, d):
    ids = t.frames(spark, d).select("coil_id").distinct()
    stored = ids.withColumn("conf_threshold", F.when(F.col("coil_id") % 7 != 0, (F.col("coil_id") % 13) / dbl(10)))
    return stored.select("coil_id", logs.operating_conf().alias("conf"))


@query("coil_report_documents", "A13 E20", _results_sql() + STATS_SQL + DISPOSE_SQL.replace("round(defect_rate, 6)", "round(defect_rate, 4)").replace("round(p95_severity, 6)", "round(p95_severity, 2)"))
def coil_report_documents(spark, d):
    """Written as JSON and read back, so the check covers the document and not only its columns."""
    docs = sinks.coil_documents(op.disposition(op.coil_stats(_results(spark, d))))
    back = docs.select("coil_id", F.from_json("document", "disposition string, reasons array<string>, defect_rate double, p95_severity double").alias("x"))
    return back.select("coil_id", "x.disposition", F.array_join("x.reasons", "; ").alias("reasons"), "x.defect_rate", "x.p95_severity")


@query("frame_report_documents", "A13", _results_sql() + """SELECT frame_id, verdict, defect_count, round(severity_score, 2) AS severity_score, severity_band, round(max_confidence, 4) AS first_conf FROM results""")
def frame_report_documents(spark, d):
    res = _results(spark, d)
    docs = sinks.frame_documents(res, op.score_detections(t.frames(spark, d), _kept(spark, d)))
    x = F.from_json("document", "verdict string, defect_count bigint, severity_score double, severity_band string, detections array<struct<confidence:double>>")
    return docs.withColumn("x", x).select("frame_id", "x.verdict", "x.defect_count", "x.severity_score", "x.severity_band", F.coalesce(F.get("x.detections", F.lit(0))["confidence"], dbl(0)).alias("first_conf"))


# ---------------------------------------------------------------- photometrics

@query("grey_histogram", "K1", cte("grey_hist") + "SELECT * FROM grey_hist")
def grey_histogram(spark, d):
    return t.grey_hist(spark, d)


def hist(spark, d):
    return reuse(t.grey_hist(spark, d))


MOM = cte("grey_hist") + """, mo AS (SELECT frame_id, CAST(sum(n) AS BIGINT) AS pixels, sum(level::DOUBLE*n)/sum(n) AS mean, sqrt(sum(level::DOUBLE*level*n)/sum(n) - pow(sum(level::DOUBLE*n)/sum(n), 2)) AS std FROM grey_hist GROUP BY 1),
pop AS (SELECT sum(level::DOUBLE*n)/sum(n) AS m FROM grey_hist),
rf AS (SELECT 'population' AS target, level, CAST(sum(n) AS BIGINT) AS n FROM grey_hist GROUP BY 2 UNION ALL
 SELECT 'frame', level, CAST(sum(n) AS BIGINT) FROM (SELECT CAST(level + round_even((SELECT m FROM pop) - mean, 0) AS INT) AS level, n FROM grey_hist JOIN mo USING (frame_id)) WHERE level BETWEEN 0 AND 255 GROUP BY 2),
lv AS (SELECT CAST(i AS INT) AS level FROM range(256) r(i)),
rc AS (SELECT lv.level, sum(coalesce(n, 0)) OVER (ORDER BY lv.level) / sum(coalesce(n, 0)) OVER () AS rcdf FROM lv LEFT JOIN rf ON rf.level = lv.level AND target = 'frame'),
dn AS (SELECT f.frame_id, lv.level, coalesce(h.n, 0) AS n, sum(coalesce(h.n, 0)) OVER (PARTITION BY f.frame_id ORDER BY lv.level) / sum(coalesce(h.n, 0)) OVER (PARTITION BY f.frame_id) AS cdf
  FROM (SELECT DISTINCT frame_id FROM grey_hist) f CROSS JOIN lv LEFT JOIN grey_hist h ON h.frame_id = f.frame_id AND h.level = lv.level)"""


def reference(spark, d):
    h = hist(spark, d)
    return ph.reference_histogram(h, ph.moments(h))


@query("reference_distribution", "K3", MOM + "SELECT * FROM rf")
def reference_distribution(spark, d):
    return reference(spark, d)


@query("photometric_drift", "K2", MOM + """, q AS (SELECT frame_id, sum(abs(cdf-rcdf)) AS dist, min(level) FILTER (cdf >= 0.01) AS p1, min(level) FILTER (cdf >= 0.99) AS p99 FROM dn JOIN rc USING (level) GROUP BY 1)
SELECT frame_id, pixels, round(mean, 6) AS mean, round(std, 6) AS std, round(dist, 6) AS hist_distance, p1, p99 FROM mo JOIN q USING (frame_id)""")
def photometric_drift(spark, d):
    ref = ph.reference_cdf(reference(spark, d), "frame")
    return ph.drift(hist(spark, d), ref).select("frame_id", big("pixels"), r6("mean"), r6("std"), r6("hist_distance"), "p1", "p99")


LUT_SQL = MOM + """, lu AS (SELECT frame_id, level, CAST(least(255, greatest(0, round_even((1-0.25::DOUBLE)*level + 0.25::DOUBLE*(SELECT min(rc.level) FROM rc WHERE rc.rcdf >= dn.cdf), 0))) AS INT) AS new_level FROM dn)"""


@query("histogram_lut", "K4", LUT_SQL + "SELECT frame_id, level, new_level FROM lu")
def histogram_lut(spark, d):
    return ph.histogram_lut(hist(spark, d), ph.reference_cdf(reference(spark, d), "frame"))


@query("histogram_after_lut", "K6", LUT_SQL + "SELECT frame_id, new_level AS level, CAST(sum(n) AS BIGINT) AS n FROM grey_hist JOIN lu USING (frame_id, level) GROUP BY 1, 2")
def histogram_after_lut(spark, d):
    h = hist(spark, d)
    return ph.apply_lut(h, ph.histogram_lut(h, ph.reference_cdf(reference(spark, d), "frame")))


@query("affine_lut", "K5", MOM + """SELECT frame_id, level, CAST(least(255, greatest(0, round_even((1-0.25::DOUBLE)*level + 0.25::DOUBLE*((level-mean)*(30.1::DOUBLE/greatest(std, 1e-3)) + 128.0::DOUBLE), 0))) AS INT) AS new_level FROM mo CROSS JOIN lv""")
def affine_lut(spark, d):
    return ph.affine_lut(ph.moments(hist(spark, d)), 128.0, 30.1).select("frame_id", "level", "new_level")


@query("tonal_signals", "K7", MOM + """, u AS (SELECT frame_id, sum(n) AS tot, sum(n) FILTER (level BETWEEN 3 AND 252) AS tt FROM grey_hist GROUP BY 1)
SELECT frame_id, round(-sum(n/tt*log2(n/tt)) FILTER (level BETWEEN 3 AND 252), 6) AS tonal_bits, round(coalesce(sum(n) FILTER (level NOT BETWEEN 3 AND 252), 0)/any_value(tot), 6) AS clipped_fraction FROM grey_hist JOIN u USING (frame_id) GROUP BY 1""")
def tonal_signals(spark, d):
    return ph.tonal_signals(hist(spark, d)).select("frame_id", r6("tonal_bits"), r6("clipped_fraction"))


SIG = """WITH sg AS (SELECT o_orderkey AS frame_id, 40 + o_orderkey*7 % 400 AS min_side, 1 + (o_orderkey*11 % 700)/CAST(10 AS DOUBLE) AS aspect, (o_orderkey*13 % 450)/CAST(10 AS DOUBLE) AS saturation,
 (o_orderkey*17 % 80)/CAST(100 AS DOUBLE) AS edge_density, 0.5 + (o_orderkey*19 % 300)/CAST(10 AS DOUBLE) AS focus, 1.5 + (o_orderkey*23 % 60)/CAST(10 AS DOUBLE) AS tonal_bits, (o_orderkey*29 % 1300)/CAST(10 AS DOUBLE) AS hist_distance FROM orders),
ck AS (SELECT *, list_filter([CASE WHEN min_side < 64 THEN 'resolution' END, CASE WHEN aspect > 64 THEN 'aspect' END, CASE WHEN saturation > 40 THEN 'colour' END, CASE WHEN edge_density > 0.7::DOUBLE THEN 'noise' END, CASE WHEN focus < 1.5::DOUBLE THEN 'focus' END,
 CASE WHEN tonal_bits < 1.8::DOUBLE THEN 'tonal_range' END], lambda x: x IS NOT NULL) AS failed FROM sg)"""


def signals(spark, d):
    i = F.col("frame_id")
    v = lambda m, n, k: (i * m % n) / dbl(k)
    return t.frames(spark, d).select(
        "frame_id", (40 + i * 7 % 400).alias("min_side"), (1 + v(11, 700, 10)).alias("aspect"), v(13, 450, 10).alias("saturation"), v(17, 80, 100).alias("edge_density"),
        (dbl(0.5) + v(19, 300, 10)).alias("focus"), (dbl(1.5) + v(23, 60, 10)).alias("tonal_bits"), v(29, 1300, 10).alias("hist_distance"))


@query("plausibility_gate", "K8", SIG + "SELECT frame_id, CASE WHEN len(failed) > 0 THEN 'reject' WHEN hist_distance > 116.5 THEN 'review' ELSE 'pass' END AS decision, array_to_string(failed, ',') AS failed FROM ck")
def plausibility_gate(spark, d):
    return ph.gate(signals(spark, d)).select("frame_id", "decision", F.array_join("failed", ",").alias("failed"))


ROOM_SQL = SIG + """, lg AS (SELECT 'resolution' AS name, true AS ge, min_side::DOUBLE AS v, 64::DOUBLE AS lim FROM sg UNION ALL SELECT 'aspect', false, aspect, 64 FROM sg UNION ALL SELECT 'colour', false, saturation, 40 FROM sg
 UNION ALL SELECT 'noise', false, edge_density, 0.7::DOUBLE FROM sg UNION ALL SELECT 'focus', true, focus, 1.5::DOUBLE FROM sg UNION ALL SELECT 'tonal_range', true, tonal_bits, 1.8::DOUBLE FROM sg),
rm AS (SELECT name, max(lim) AS lim, CASE WHEN bool_or(ge) THEN min(v) ELSE max(v) END AS worst_value, min(CASE WHEN ge THEN v/lim WHEN v <> 0 THEN lim/v ELSE 'inf'::DOUBLE END) AS worst_margin,
 count(*) FILTER (CASE WHEN ge THEN v < lim ELSE v > lim END) AS n_failed, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.99) AS p99 FROM lg GROUP BY 1)"""


@query("gate_headroom", "K9", ROOM_SQL + 'SELECT name, lim AS "limit", worst_value, round(worst_margin, 6) AS worst_margin, n_failed, round(p01, 6) AS p01, round(p50, 6) AS p50, round(p99, 6) AS p99 FROM rm')
def gate_headroom(spark, d):
    return ph.headroom(signals(spark, d)).select("name", "limit", "worst_value", r6("worst_margin"), big("n_failed"), r6("p01"), r6("p50"), r6("p99"))


@query("gate_suggestion", "K10", ROOM_SQL + """SELECT greatest(40, max(worst_value) FILTER (name='colour')*2) AS max_saturation, least(1, greatest(0.7::DOUBLE, max(worst_value) FILTER (name='noise')*2)) AS max_edge_density,
 least(1.5::DOUBLE, max(worst_value) FILTER (name='focus')/2) AS min_focus, least(1.8::DOUBLE, max(worst_value) FILTER (name='tonal_range')/2) AS min_tonal_bits FROM rm""")
def gate_suggestion(spark, d):
    return ph.suggest_limits(ph.headroom(signals(spark, d)))


# ---------------------------------------------------------------- streams

def _scratch(spark) -> str:
    """A new folder under the checkpoint folder of the session."""
    base = ensure_checkpoint_dir(spark)
    return f"{base}/stream-{uuid.uuid4().hex}"


@query("live_running_rate", "L1", cte("frame_events") + """SELECT line_id, count(*) AS frames, count(*) FILTER (verdict='DEFECT') AS defects, round(100*count(*) FILTER (verdict='DEFECT')/count(*), 6) AS running_rate, max(seq) AS last_seq FROM frame_events GROUP BY 1""")
def live_running_rate(spark, d):
    """The event table replayed as a stream; the last state equals the last row of the batch rate."""
    at = _scratch(spark)
    mo.run_to_table(mo.running_rate(mo.read_events(spark, f"{d}/events*.parquet")), f"{at}/out", f"{at}/ckpt", "complete")
    out = spark.read.parquet(f"{at}/out")
    last = out.agg(F.max("batch")).first()[0]
    return out.where(F.col("batch") == last).select("line_id", "frames", big("defects"), r6("running_rate"), "last_seq")


@query("windowed_line_monitor", "L2", cte("frame_events") + """, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, * FROM frame_events)
SELECT epoch_us(window_start) // 1000000 AS window_start, line_id, count(*) AS frames, count(*) FILTER (verdict='DEFECT') AS defects, round(count(*) FILTER (verdict='DEFECT')/count(*), 6) AS defect_rate, round(quantile_cont(total_ms, 0.95), 6) AS p95_ms,
 count(*) FILTER (verdict='DEFECT')/count(*) > 0.25 AS alert FROM w GROUP BY window_start, line_id HAVING window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM frame_events)""")
def windowed_line_monitor(spark, d):
    at = _scratch(spark)
    mo.run_to_table(mo.window_monitor(mo.read_events(spark, f"{d}/events*.parquet")), f"{at}/out", f"{at}/ckpt")
    out = spark.read.parquet(f"{at}/out")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "line_id", "frames", big("defects"), r6("defect_rate"), r6("p95_ms"), "alert")


@query("coil_close_sessions", "L3", cte("frame_events") + """, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY line_id ORDER BY ts, seq) + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM frame_events),
k AS (SELECT *, sum(cut) OVER (PARTITION BY line_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT line_id, epoch_us(min(ts)) AS opened, count(*) AS frames, count(*) FILTER (verdict='DEFECT') AS defects, round(avg(total_ms), 6) AS mean_ms,
 CASE WHEN count(*) FILTER (verdict='DEFECT')/count(*) > 0.25 THEN 'HOLD' WHEN count(*) FILTER (verdict='DEFECT')/count(*) > 0.02 THEN 'DOWNGRADE' ELSE 'ACCEPT' END AS disposition
FROM k GROUP BY line_id, s HAVING max(ts) + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM frame_events)""")
def coil_close_sessions(spark, d):
    at = _scratch(spark)
    mo.run_to_table(mo.coil_sessions(mo.read_events(spark, f"{d}/events*.parquet")), f"{at}/out", f"{at}/ckpt")
    out = spark.read.parquet(f"{at}/out")
    return out.select("line_id", F.unix_micros("opened").alias("opened"), "frames", big("defects"), r6("mean_ms"), "disposition")


COIL_TIME = "(o_custkey * 7200 + o_orderkey % 600)"  # coils run one after the other, two hours apart


@query("coil_close_dispositions", "L3 E19 E20", _results_sql() + STATS_SQL + DISPOSE_SQL + f""" WHERE coil_id IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING max({COIL_TIME}) + 1800 <= (SELECT max({COIL_TIME}) - 600 FROM orders))""")
def coil_close_dispositions(spark, d):
    """All frames replayed in two runs of one stream, cut inside a coil; the second run brings the frames of that coil again."""
    at = _scratch(spark)
    second = F.col("coil_id") * 7200 + F.col("frame_id") % 600
    rows = _results(spark, d).select(
        "coil_id", "frame_id", F.timestamp_seconds(second).alias("ts"), "verdict", big("defect_count"), dbl("severity_score").alias("severity_score"), "severity_band",
        F.col("has_flag_class").cast("int").alias("has_flag_class"), "total_ms")
    cut = rows.agg(F.max("coil_id")).first()[0] // 2 * 7200 + 300
    live.state_in_rocksdb(spark)
    for part in (F.unix_seconds("ts") < cut, F.unix_seconds("ts") >= cut - 300):
        rows.where(part).write.mode("append").parquet(f"{at}/frames")
        live.publish(live.close_coils(live.read_frames(spark, f"{at}/frames")), f"{at}/closed", f"{at}/ckpt")
    return live.published(spark, f"{at}/closed").select("coil_id", "disposition", F.array_join("reasons", "; ").alias("reasons"), r6("defect_rate"), r6("p95_severity"))


# ---------------------------------------------------------------- scoring and SQL functions

def stripe_scorer(tiles: pd.DataFrame) -> pd.DataFrame:
    """Stands for a detector: reports fixed 40 px marks of the strip where they fall inside a tile."""
    fid, x0, y0, w, h = (tiles[c].to_numpy(np.int64)[:, None] for c in ("frame_id", "x0", "y0", "tile_w", "tile_h"))
    k = np.arange(6)
    gx, gy = (fid * 37 + k * 331) % 2000, (fid * 11 + k * 53) % 360
    row, mark = np.nonzero((x0 <= gx) & (gx + 40 <= x0 + w) & (y0 <= gy) & (gy + 40 <= y0 + h))
    x, y = ((g - o)[row, mark].astype(float) for g, o in ((gx, x0), (gy, y0)))
    conf = 0.2 + ((fid + k * 7) % 80)[row, mark] / 100
    return pd.DataFrame({"row_ix": row, "class_id": mark.astype(np.int32), "conf": conf, "x1": x, "y1": y, "x2": x + 40, "y2": y + 40})


def _one_axis(ext):
    return f"(CASE WHEN {ext} <= 256 THEN [0] ELSE list_distinct(list_append(range(0, {ext}-256+1, 205), {ext}-256)) END)"


@query("tiled_scoring_pipeline", "M1 M2 B5 B11 C1 D3 E2", cte("frames") + """, st AS (SELECT frame_id, CAST(200 + frame_id*37 % 1848 AS INT) AS width, CAST(100 + frame_id*11 % 300 AS INT) AS height FROM frames),
tg AS (SELECT *, greatest(width,height)/least(width,height) >= 3 OR greatest(width,height)/256 >= 3 AS tiled FROM st),
mk AS (SELECT tg.*, k, (frame_id*37 + k*331) % 2000 AS gx, (frame_id*11 + k*53) % 360 AS gy, 0.2::DOUBLE + ((frame_id + k*7) % 80)/100 AS conf FROM tg, (SELECT unnest(range(6)) AS k)),
vis AS (SELECT * FROM mk WHERE CASE WHEN tiled THEN len(list_filter(""" + _one_axis("width") + """, lambda x: x <= gx AND gx+40 <= x + least(256, width))) > 0 AND len(list_filter(""" + _one_axis("height") + """, lambda y: y <= gy AND gy+40 <= y + least(256, height))) > 0
  ELSE gx+40 <= width AND gy+40 <= height END)
SELECT frame_id, CASE WHEN n > 0 THEN 'DEFECT' ELSE 'PASS' END AS verdict, n AS defect_count, round(mc, 6) AS max_confidence FROM (SELECT st.frame_id, count(v.k) AS n, coalesce(max(v.conf), 0) AS mc FROM st LEFT JOIN vis v USING (frame_id) GROUP BY 1)""")
def tiled_scoring_pipeline(spark, d):
    f = strips(spark, d).withColumn("coil_id", F.col("frame_id")).withColumn("total_ms", dbl(1))
    return sc.tiled_inspection(f, stripe_scorer).select("frame_id", "verdict", big("defect_count"), r6("max_confidence"))


_LO, _HI = wilson_sql("k::DOUBLE", "n::DOUBLE")


@query("sql_functions", "M3", cte("det", "dim") + f""", a AS (SELECT class_id, class_name, frame_id, conf, (x2-x1)*(y2-y1)/40000 AS fr, x1, y1, x2, y2 FROM det JOIN dim USING (class_id)),
b AS (SELECT *, least(100, CASE class_name WHEN 'inclusion' THEN 84 WHEN 'patches' THEN 42 WHEN 'scratches' THEN 42 ELSE 64 END*(0.5::DOUBLE+0.5::DOUBLE*conf)*(1+0.55::DOUBLE*least(1, fr/0.25::DOUBLE))) AS sc,
 greatest(0, least(x2,150)-greatest(x1,50))*greatest(0, least(y2,150)-greatest(y1,50)) AS it FROM a),
c AS (SELECT class_id, avg(sc) AS sc, count(*) AS n, count(*) FILTER (sc >= 80) AS k, avg(it/((x2-x1)*(y2-y1)+10000-it)) AS iou, avg({s.unit('s', 'frame_id')}) AS u, avg(1/(1+exp(-ln(conf/(1-conf))/1.5::DOUBLE))) AS cal FROM b GROUP BY 1)
SELECT class_id, round(sc, 6) AS mean_score, k AS critical, round({_LO}, 6) AS lo, round({_HI}, 6) AS hi, round(iou, 6) AS mean_iou, round(u, 6) AS mean_hash, round(cal, 6) AS mean_calibrated FROM c""")
def sql_functions(spark, d):
    fsql.register(spark)
    from ..functions.severity import class_name

    det(spark, d).withColumn("class_name", class_name()).createOrReplaceTempView("coilwise_detections")
    return spark.sql("""
        WITH b AS (SELECT class_id, severity_score(class_name, conf, (x2-x1)*(y2-y1)/40000D) AS sc, box_iou(x1, y1, x2, y2, 50D, 50D, 150D, 150D) AS i,
                          unit_hash('s', cast(frame_id AS string)) AS u, calibrate_temperature(conf, 1.5D) AS c FROM coilwise_detections),
             g AS (SELECT class_id, avg(sc) AS sc, count(*) AS n, count_if(severity_band(sc) = 'critical') AS k, avg(i) AS i, avg(u) AS u, avg(c) AS c FROM b GROUP BY class_id)
        SELECT class_id, round(sc, 6) AS mean_score, k AS critical, round(wilson_lo(cast(k as double), cast(n as double)), 6) AS lo, round(wilson_hi(cast(k as double), cast(n as double)), 6) AS hi,
               round(i, 6) AS mean_iou, round(u, 6) AS mean_hash, round(c, 6) AS mean_calibrated FROM g""")
