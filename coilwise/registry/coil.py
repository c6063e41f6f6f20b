"""Frame verdicts, coil roll-ups, dispositions and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.severity import fps, physical_size
from ..operators import coil as op
from ..sources import tables as t
from ..session import reuse
from .base import big, det, query, r6
from .sql import cte

COIL_CONF = 0.96  # operating threshold of the coil runs


def _kept(spark, d):
    return det(spark, d).where(F.col("conf") >= COIL_CONF)


def _results(spark, d, with_seq=False):
    return reuse(op.frame_results(t.frames(spark, d, with_seq), _kept(spark, d)))


SCORED = """
scored AS (
 SELECT s.*, CASE WHEN score < 30 THEN 'low' WHEN score < 55 THEN 'medium' WHEN score < 80 THEN 'high' ELSE 'critical' END AS band
 FROM (SELECT c.*, least(greatest(
        CASE c.tier WHEN 'low' THEN 22 WHEN 'medium' THEN 42 WHEN 'high' THEN 64 ELSE 84 END
        * (0.5::DOUBLE + 0.5::DOUBLE * least(greatest(conf, 0), 1)) * (1 + 0.55::DOUBLE * least(1, greatest(0, area_frac) / 0.25::DOUBLE)), 0), 100) AS score
   FROM (SELECT b.*, (x2 - x1) * (y2 - y1) AS area_px, (x2 - x1) * (y2 - y1) / greatest(width * height, 1) AS area_frac
     FROM (SELECT d.model, d.frame_id, f.coil_id, d.det_id, d.class_id, m.class_name, m.tier, d.conf, f.width, f.height,
             least(greatest(0, d.x1), f.width) AS x1, least(greatest(0, d.y1), f.height) AS y1,
             least(greatest(least(greatest(0, d.x1), f.width), d.x2), f.width) AS x2,
             least(greatest(least(greatest(0, d.y1), f.height), d.y2), f.height) AS y2
           FROM det d JOIN frames f USING (frame_id) JOIN dim m USING (class_id) WHERE %s) b) c) s)"""
RESULTS = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_id) AS r FROM scored),
results AS (
 SELECT f.*, coalesce(a.n, 0) AS defect_count, a.dominant_class, coalesce(a.mc, 0) AS max_confidence,
   coalesce(a.flag, 0) AS flag, coalesce(a.sev, 0) AS severity_score,
   CASE WHEN a.n IS NULL THEN 'PASS' ELSE 'DEFECT' END AS verdict,
   CASE WHEN a.n IS NULL THEN 'clean' WHEN a.sev < 30 THEN 'low' WHEN a.sev < 55 THEN 'medium' WHEN a.sev < 80 THEN 'high' ELSE 'critical' END AS severity_band
 FROM frames f LEFT JOIN (
   SELECT frame_id, count(*) AS n, max(conf) AS mc, max(CASE WHEN class_name = 'inclusion' THEN 1 ELSE 0 END) AS flag,
     arg_max(class_name, (conf, -det_id)) AS dominant_class,
     least(greatest(100 * (1 - product(1 - score / 100 * pow(0.6::DOUBLE, r - 1))), 0), 100) AS sev
   FROM ranked GROUP BY frame_id) a USING (frame_id))"""


def _scored_sql(where="d.conf >= 0.96"):
    return cte("dim", "det", "frames") + "," + SCORED % where


def _results_sql():
    return _scored_sql() + "," + RESULTS


@query("detection_scores", "B1 B6 B7 B8 B9", _scored_sql("d.conf >= 0.15") + """
SELECT frame_id, det_id, class_name, x1, y1, x2, y2, area_px, round(area_frac, 8) AS area_frac, round(score, 9) AS score, band FROM scored""")
def detection_scores(spark, d):
    dets = det(spark, d).where(F.col("conf") >= 0.15)
    return op.score_detections(t.frames(spark, d), dets).select(
        "frame_id", "det_id", "class_name", "x1", "y1", "x2", "y2", "area_px", r6("area_frac", digits=8), r6("score", digits=9), "band"
    )


@query("frame_verdicts", "E2 E3 B9", _results_sql() + """
SELECT frame_id, verdict, defect_count, dominant_class, max_confidence, round(severity_score, 6) AS severity_score, severity_band FROM results""")
def frame_verdicts(spark, d):
    return _results(spark, d).select(
        "frame_id", "verdict", big("defect_count"), "dominant_class", "max_confidence", r6("severity_score"), "severity_band"
    )


STATS_SQL = """,
stats AS (
 SELECT coil_id, count(*) AS total_frames, CAST(sum((verdict='DEFECT')::INT) AS BIGINT) AS defect_frames,
  sum((verdict='DEFECT')::INT) / count(*) AS defect_rate, CAST(sum(defect_count) AS BIGINT) AS total_detections,
  sum(defect_count) / count(*) AS detections_per_frame,
  CAST(sum((severity_band='clean')::INT) AS BIGINT) AS frames_clean, CAST(sum((severity_band='low')::INT) AS BIGINT) AS frames_low,
  CAST(sum((severity_band='medium')::INT) AS BIGINT) AS frames_medium, CAST(sum((severity_band='high')::INT) AS BIGINT) AS frames_high,
  CAST(sum((severity_band='critical')::INT) AS BIGINT) AS frames_critical, avg(severity_score) AS mean_severity,
  max(severity_score) AS max_severity, quantile_cont(severity_score, 0.95) AS p95_severity,
  CAST(sum(flag) AS BIGINT) AS flag_class_frames, avg(total_ms) AS mean_latency_ms
 FROM results GROUP BY coil_id)"""


@query("coil_rollup", "E19", _results_sql() + STATS_SQL + """
SELECT coil_id, total_frames, defect_frames, round(defect_rate, 6) AS defect_rate, total_detections,
 round(detections_per_frame, 6) AS detections_per_frame, frames_clean, frames_low, frames_medium, frames_high, frames_critical,
 round(mean_severity, 6) AS mean_severity, round(max_severity, 6) AS max_severity, round(p95_severity, 6) AS p95_severity,
 flag_class_frames, round(mean_latency_ms, 6) AS mean_latency_ms,
 round(CASE WHEN mean_latency_ms > 0 THEN 1000 / mean_latency_ms ELSE 0 END, 6) AS throughput_fps FROM stats""")
def coil_rollup(spark, d):
    return op.coil_stats(_results(spark, d)).select(
        "coil_id", big("total_frames"), big("defect_frames"), r6("defect_rate"), big("total_detections"),
        r6("detections_per_frame"), *[big(f"frames_{b}") for b in ("clean", *vocab.BANDS)], r6("mean_severity"),
        r6("max_severity"), r6("p95_severity"), big("flag_class_frames"), r6("mean_latency_ms"), r6("throughput_fps"),
    )


DISPOSE_SQL = """,
judged AS (
 SELECT *, list_filter([CASE WHEN defect_rate > 0.25 THEN 'defect rate over hold limit' END,
   CASE WHEN p95_severity >= 70 THEN 'p95 severity at hold limit' END, CASE WHEN frames_critical >= 1 THEN 'critical frames' END,
   CASE WHEN flag_class_frames > 0 THEN 'zero-tolerance class inclusion' END], lambda x: x IS NOT NULL) AS hold,
  list_filter([CASE WHEN defect_rate > 0.02 THEN 'defect rate over accept limit' END,
   CASE WHEN p95_severity > 30 THEN 'p95 severity over accept limit' END,
   CASE WHEN frames_high + frames_critical > 0 THEN 'high or critical frames' END], lambda x: x IS NOT NULL) AS missed FROM stats)
SELECT coil_id, CASE WHEN len(hold) > 0 THEN 'HOLD' WHEN len(missed) > 0 THEN 'DOWNGRADE' ELSE 'ACCEPT' END AS disposition,
 CASE WHEN len(hold) > 0 THEN array_to_string(hold, '; ') WHEN len(missed) > 0 THEN array_to_string(missed, '; ')
  ELSE 'defect rate within accept limit; p95 severity within accept limit; no high or critical frames' END AS reasons,
 round(defect_rate, 6) AS defect_rate, round(p95_severity, 6) AS p95_severity FROM judged"""


@query("coil_disposition", "E19 E20", _results_sql() + STATS_SQL + DISPOSE_SQL)
def coil_disposition(spark, d):
    return op.disposition(op.coil_stats(_results(spark, d))).select(
        "coil_id", "disposition", F.array_join("reasons", "; ").alias("reasons"), r6("defect_rate"), r6("p95_severity")
    )


@query("coil_class_counts", "E19", _scored_sql() + """
SELECT coil_id, class_name, count(*) AS detections, count(DISTINCT frame_id) AS frames FROM scored GROUP BY 1, 2""")
def coil_class_counts(spark, d):
    return op.coil_class_counts(op.score_detections(t.frames(spark, d), _kept(spark, d)))


@query("worst_frames_per_coil", "H1", _results_sql() + """
SELECT coil_id, frame_id, rank, round(severity_score, 6) AS severity_score, defect_count, max_confidence FROM (
 SELECT *, row_number() OVER (PARTITION BY coil_id ORDER BY severity_score DESC, defect_count DESC, max_confidence DESC, frame_id) AS rank
 FROM results WHERE defect_count > 0) WHERE rank <= 5""")
def worst_frames_per_coil(spark, d):
    return op.worst_frames(_results(spark, d)).select(
        "coil_id", "frame_id", "rank", r6("severity_score"), big("defect_count"), "max_confidence"
    )


@query("class_distribution", "E21", _scored_sql() + """
SELECT m.class_id, m.class_name, count(s.det_id) AS detections, count(DISTINCT s.frame_id) AS frames
FROM dim m LEFT JOIN scored s USING (class_id) GROUP BY 1, 2""")
def class_distribution(spark, d):
    scored = op.score_detections(t.frames(spark, d), _kept(spark, d))
    return op.class_distribution(scored, vocab.dim_class(spark))


@query("guidance_per_frame", "E22 D8 B1", _scored_sql("d.conf >= 0.15") + """
SELECT frame_id, class_name, count(*) AS count, max(conf) AS max_confidence,
 (['low','medium','high','critical'])[max(CASE band WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END)] AS worst,
 any_value(m.tier) AS base_tier, any_value(m.cause) AS cause, any_value(m.action) AS action
FROM scored JOIN dim m USING (class_name) GROUP BY frame_id, class_name""")
def guidance_per_frame(spark, d):
    dets = det(spark, d).where(F.col("conf") >= 0.15)
    return op.guidance(op.score_detections(t.frames(spark, d), dets), vocab.dim_class(spark))


@query("running_defect_rate", "G1", _results_sql() + """
SELECT coil_id, frame_id, seq, round(100 * sum((verdict='DEFECT')::INT) OVER w / count(*) OVER w, 6) AS running_rate
FROM results WINDOW w AS (PARTITION BY coil_id ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def running_defect_rate(spark, d):
    return op.running_defect_rate(_results(spark, d, with_seq=True)).select("coil_id", "frame_id", "seq", r6("running_rate"))


@query("coil_file_export", "A8", _results_sql() + """
SELECT frame_id AS frame, verdict, defect_count AS defects, coalesce(dominant_class, '-') AS dominant_class,
 round(max_confidence, 4) AS calibrated_confidence, round(max_confidence, 4) AS max_confidence, round(severity_score, 2) AS severity_score,
 CASE WHEN defect_count = 0 THEN '-' ELSE severity_band END AS severity_band, width, height, round(total_ms, 2) AS latency_ms,
 round(1000 / total_ms, 1) AS fps, 'A' AS model, CAST(0.96 AS DOUBLE) AS conf_threshold, CAST(0.45 AS DOUBLE) AS iou_threshold FROM results""")
def coil_file_export(spark, d):
    return op.frame_export(_results(spark, d), "A", COIL_CONF, 0.45).withColumn("defects", big("defects"))


@query("detection_export", "A8 B10", _scored_sql("d.conf >= 0.15") + """
SELECT frame_id AS frame, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, det_id) AS detection, class_id, class_name AS defect,
 round(conf, 4) AS calibrated_confidence, round(conf, 4) AS confidence, band AS severity, x1, y1, x2, y2, area_px, round(area_frac, 6) AS area_frac,
 round(greatest(x2-x1, y2-y1)*0.5, 3) AS length_mm, round(least(x2-x1, y2-y1)*0.5, 3) AS width_mm,
 round((x1+x2)/2*0.5, 3) AS across_strip_mm, CAST(0.5 AS DOUBLE) AS mm_per_px FROM scored""")
def detection_export(spark, d):
    dets = det(spark, d).where(F.col("conf") >= 0.15)
    return op.detection_export(op.score_detections(t.frames(spark, d), dets))


@query("physical_size", "B10", cte("det", "frames") + """
SELECT d.frame_id, d.det_id, greatest(x2-x1, y2-y1)*0.5 AS length_mm, least(x2-x1, y2-y1)*0.5 AS width_mm,
 (x1+x2)/2*0.5 AS across_strip_mm, round(1000 / total_ms, 6) AS fps FROM det d JOIN frames f USING (frame_id)""")
def physical_size_query(spark, d):
    dets = det(spark, d).join(t.frames(spark, d).select("frame_id", "total_ms"), "frame_id")
    cols = physical_size(0.5)
    return dets.select("frame_id", "det_id", *[e.alias(n) for n, e in cols.items()], r6(fps("total_ms"), "fps"))


@query("latency_summary", "E23", cte("timings") + """
SELECT model, device, imgsz, batch, count(*) AS n, round(avg(per_frame_ms), 6) AS mean_ms, round(CASE WHEN count(*) > 1 THEN stddev_samp(per_frame_ms) ELSE 0 END, 6) AS std_ms,
 min(per_frame_ms) AS min_ms, max(per_frame_ms) AS max_ms, round(quantile_cont(per_frame_ms, 0.5), 6) AS median_ms,
 round(quantile_cont(per_frame_ms, 0.95), 6) AS p95_ms, round(quantile_cont(per_frame_ms, 0.99), 6) AS p99_ms,
 round(1000/avg(per_frame_ms), 6) AS fps_mean, round(1000/quantile_cont(per_frame_ms, 0.95), 6) AS fps_p95 FROM timings GROUP BY 1,2,3,4""")
def latency_summary(spark, d):
    out = op.latency_stats(t.timings(spark, d), ["model", "device", "imgsz", "batch"])
    return out.select(
        "model", "device", "imgsz", "batch", "n", r6("mean_ms"), r6("std_ms"), "min_ms", "max_ms", r6("median_ms"),
        r6("p95_ms"), r6("p99_ms"), r6("fps_mean"), r6("fps_p95"),
    )
