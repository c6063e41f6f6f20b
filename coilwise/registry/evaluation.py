"""Matching, sweeps, operating points, failures and average precision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import dbl, iou, overlaps
from ..functions.severity import class_name
from ..operators import matching as m
from ..operators import metrics as e
from ..sources import tables as t
from . import sql as s
from ..session import reuse
from .base import big, det, gt, query, r6
from .sql import cte, grid

CONF = 0.15  # deployment threshold


def matched(spark, d, model="A"):
    dets, gts = det(spark, d, model), gt(spark, d)
    return dets, gts, reuse(m.greedy_match(dets, gts))


def flagged(spark, d, model="A"):
    dets, gts, hits = matched(spark, d, model)
    return reuse(m.flag_matches(dets, hits)), gts, hits


def _at(spark, d, conf=CONF):
    """Labels and detections at one threshold: earlier claims do not depend on it."""
    dets, gts, hits = matched(spark, d)
    kept = hits.where(F.col("conf") >= conf)
    return m.flag_matches(dets.where(F.col("conf") >= conf), kept), m.flag_found(gts, kept), gts


@query("box_iou_pairs", "D1", cte("det", "gt") + f"""
SELECT d.frame_id, d.class_id, d.det_id, g.box_id, round({s.iou('d','g')}, 6) AS iou
FROM det d JOIN gt g ON d.frame_id = g.frame_id AND d.class_id = g.class_id WHERE {s.overlaps('d','g')}""")
def box_iou_pairs(spark, d):
    pairs = m.box_pairs(det(spark, d), gt(spark, d), ["frame_id", "class_id"], ["det_id"], ["box_id"], 1e-12)
    return pairs.select("frame_id", "class_id", F.col("a_det_id").alias("det_id"), F.col("b_box_id").alias("box_id"), r6("iou"))


@query("greedy_match", "D2", cte("matches") + "SELECT frame_id, class_id, det_id, box_id FROM matches")
def greedy_match(spark, d):
    return matched(spark, d)[2].select("frame_id", "class_id", "det_id", "box_id")


def _nms_sql(thr):
    return cte("det") + f""", ranked AS (
 SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY conf DESC, det_id) AS rn FROM det),
sup AS (SELECT b.frame_id, b.class_id, b.rn, list(a.rn) AS stronger FROM ranked a JOIN ranked b
  ON a.frame_id = b.frame_id AND a.class_id = b.class_id AND a.rn < b.rn WHERE {s.iou('a','b')} > {thr} GROUP BY ALL),
steps AS (SELECT r.*, coalesce(x.stronger, []) AS stronger FROM ranked r LEFT JOIN sup x USING (frame_id, class_id, rn)),
walk2 AS (
 SELECT frame_id, class_id, rn, det_id, [rn] AS kept, true AS keep FROM steps WHERE rn = 1
 UNION ALL
 SELECT q.frame_id, q.class_id, q.rn, q.det_id, CASE WHEN list_has_any(p.kept, q.stronger) THEN p.kept ELSE list_append(p.kept, q.rn) END,
   NOT list_has_any(p.kept, q.stronger)
 FROM walk2 p JOIN steps q ON q.frame_id = p.frame_id AND q.class_id = p.class_id AND q.rn = p.rn + 1)
SELECT frame_id, class_id, det_id FROM walk2 WHERE keep"""


@query("cross_tile_nms", "D3", _nms_sql(0.45))
def cross_tile_nms(spark, d):
    return m.nms(det(spark, d)).select("frame_id", "class_id", "det_id")


@query("detector_parity", "D4", cte("det", "det2", "frames") + f""", prs AS (
 SELECT a.frame_id, a.det_id, a.conf, b.det_id AS box_id, {s.iou('a','b')} AS iou, a.class_id = b.class_id AS same,
  greatest(abs(a.x1-b.x1), abs(a.y1-b.y1), abs(a.x2-b.x2), abs(a.y2-b.y2)) AS bd, abs(a.conf-b.conf) AS cd
 FROM det a JOIN det2 b USING (frame_id) WHERE {s.iou('a','b')} >= 0.9),
wish AS (SELECT frame_id, det_id, list({{'b': box_id, 'same': same}} ORDER BY iou DESC, box_id) AS w,
  row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, det_id) AS rn FROM prs GROUP BY frame_id, det_id, conf),
wk AS (
 SELECT frame_id, rn, det_id, CASE WHEN w[1].same THEN w[1].b END AS box_id, CASE WHEN w[1].same THEN [w[1].b] ELSE []::BIGINT[] END AS taken FROM wish WHERE rn = 1
 UNION ALL
 SELECT n.frame_id, n.rn, n.det_id, CASE WHEN n.f.same THEN n.f.b END, CASE WHEN n.f.same THEN list_append(n.taken, n.f.b) ELSE n.taken END
 FROM (SELECT w.frame_id, w.rn, w.det_id, p.taken, list_filter(w.w, lambda x: NOT list_contains(p.taken, x.b))[1] AS f
   FROM wk p JOIN wish w ON w.frame_id = p.frame_id AND w.rn = p.rn + 1) n),
ok AS (SELECT prs.* FROM wk JOIN prs USING (frame_id, det_id, box_id)),
agg AS (SELECT frame_id, count(*) AS n_matched, max(bd) AS max_box_delta, max(cd) AS max_conf_delta, min(iou) AS min_iou FROM ok GROUP BY 1),
ca AS (SELECT frame_id, count(*) AS n_ref FROM det GROUP BY 1), cb AS (SELECT frame_id, count(*) AS n_cand FROM det2 GROUP BY 1)
SELECT frame_id, coalesce(n_ref, 0) AS n_ref, coalesce(n_cand, 0) AS n_cand, coalesce(n_matched, 0) AS n_matched, max_box_delta,
 round(max_conf_delta, 6) AS max_conf_delta, round(min_iou, 6) AS min_iou,
 CASE WHEN n_ref IS NULL AND n_cand IS NULL THEN 'inconclusive'
  WHEN coalesce(n_ref,0) = coalesce(n_cand,0) AND coalesce(n_ref,0) = coalesce(n_matched,0) THEN 'identical' ELSE 'differ' END AS verdict
FROM frames LEFT JOIN ca USING (frame_id) LEFT JOIN cb USING (frame_id) LEFT JOIN agg USING (frame_id)""")
def detector_parity(spark, d):
    a, b = det(spark, d), det(spark, d, "B")
    rep = m.parity_report(t.frames(spark, d), a, b, m.parity_pairs(a, b))
    return rep.select("frame_id", big("n_ref"), big("n_cand"), big("n_matched"), "max_box_delta", r6("max_conf_delta"), r6("min_iou"), "verdict")


@query("image_class", "E1", cte("gt") + """
SELECT frame_id, arg_max(class_id, (n, a, -class_id)) AS image_class, count(*) > 1 AS is_multi_class
FROM (SELECT frame_id, class_id, count(*) AS n, sum((x2-x1)*(y2-y1)) AS a FROM gt GROUP BY 1, 2) GROUP BY 1""")
def image_class(spark, d):
    return e.image_class(gt(spark, d))


SWEEP_SQL = """, tpd AS (SELECT d.*, x.det_id IS NOT NULL AS tp FROM {det} d LEFT JOIN {matches} x USING (frame_id, class_id, det_id)),
ic AS (SELECT frame_id, arg_max(class_id, (n, a, -class_id)) AS image_class FROM
  (SELECT frame_id, class_id, count(*) AS n, sum((x2-x1)*(y2-y1)) AS a FROM gt GROUP BY 1, 2) GROUP BY 1),
perf AS (SELECT g.threshold, t.frame_id, sum(tp::INT) AS tp, sum((NOT tp)::INT) AS fp, arg_max(class_id, (conf, -det_id)) AS pc
  FROM tpd t JOIN {grid} g ON t.conf >= g.threshold GROUP BY 1, 2),
fr AS (SELECT f.*, g.threshold, coalesce(p.tp, 0) AS tp, coalesce(p.fp, 0) AS fp, p.pc, ic.image_class, coalesce(l.n, 0) AS labels
  FROM {frames} f CROSS JOIN {grid} g LEFT JOIN perf p ON p.frame_id = f.frame_id AND p.threshold = g.threshold
  LEFT JOIN ic ON ic.frame_id = f.frame_id LEFT JOIN (SELECT frame_id, count(*) AS n FROM gt GROUP BY 1) l ON l.frame_id = f.frame_id),
pts AS (SELECT {keys} threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(labels) - sum(tp) AS BIGINT) AS fn,
  CASE WHEN sum(tp)+sum(fp) > 0 THEN sum(tp) / (sum(tp)+sum(fp)) ELSE 0 END AS precision,
  CASE WHEN sum(labels) > 0 THEN sum(tp) / sum(labels) ELSE 0 END AS recall, sum(fp) / count(*) AS fp_per_image,
  sum((fp > 0)::INT) / count(*) AS false_alarm_rate, sum((tp > 0)::INT) / count(*) AS detection_rate,
  sum(coalesce(pc = image_class, false)::INT) / count(*) AS class_accuracy, sum((tp+fp > 0)::INT) / count(*) AS flagged_rate
  FROM fr GROUP BY ALL),
points AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1 FROM pts)"""


def sweep_sql(values=e.SWEEP, keys="", frames="frames", extra=()):
    return cte("det", "gt", "matches", "frames", *extra) + SWEEP_SQL.format(
        det="det", matches="matches", grid=grid(values), frames=frames, keys=keys
    )


_RATES = ("precision", "recall", "fp_per_image", "false_alarm_rate", "detection_rate", "class_accuracy", "flagged_rate", "f1")
_RATES_SQL = ", ".join(f"round({c}, 6) AS {c}" for c in _RATES)


def _points(spark, d, values=e.SWEEP, keys=()):
    flag, gts, _ = flagged(spark, d)
    return e.sweep(t.frames(spark, d), gts, flag, values, keys=keys)


@query("confidence_sweep", "E4 B7", sweep_sql() + f"SELECT threshold, tp, fp, fn, {_RATES_SQL} FROM points")
def confidence_sweep(spark, d):
    return _points(spark, d).select("threshold", big("tp"), big("fp"), big("fn"), *[r6(c) for c in _RATES])


@query("confidence_sweep_by_split", "E4", sweep_sql(keys="split,") + f"SELECT split, threshold, tp, fp, fn, {_RATES_SQL} FROM points")
def confidence_sweep_by_split(spark, d):
    return _points(spark, d, keys=["split"]).select("split", "threshold", big("tp"), big("fp"), big("fn"), *[r6(c) for c in _RATES])


@query("recommended_threshold", "E5 B16", sweep_sql(keys="split,") + """, c AS (
 SELECT *, 12::DOUBLE * (1 - detection_rate) + false_alarm_rate AS cost FROM points),
k AS (SELECT *, CASE WHEN detection_rate >= 0.6 THEN 0 ELSE 1 END AS bad FROM c)
SELECT split, arg_min(threshold, (bad, cost, -threshold)) AS threshold, round(arg_min(cost, (bad, cost, -threshold)), 6) AS cost,
 round(arg_min(detection_rate, (bad, cost, -threshold)), 6) AS detection, arg_max(threshold, (f1, threshold)) AS f1_threshold, min(bad) = 0 AS floor_met,
 arg_min(threshold, (bad, cost, -threshold)) IN (min(threshold), max(threshold)) AS at_edge,
 coalesce(abs(arg_min(threshold, (bad, cost, -threshold)) - max(threshold) FILTER (bad = 0)) < 1e-9, false) AS floor_binding
FROM k GROUP BY split""")
def recommended_threshold(spark, d):
    # a quarter of the test frames is clean, so the detection floor is set below the share of defective frames
    out = e.recommend_threshold(_points(spark, d, keys=["split"]), ["split"], floor=0.6)
    return out.select("split", "threshold", r6("cost"), r6("detection"), "f1_threshold", "floor_met", "at_edge", "floor_binding")


@query("cost_sensitivity", "E6 B16", sweep_sql() + """, c AS (
 SELECT p.*, r.ratio, r.ratio * (1 - detection_rate) + false_alarm_rate AS cost, CASE WHEN detection_rate >= 0.6 THEN 0 ELSE 1 END AS bad
 FROM points p, (SELECT unnest([3,6,12,25,50]::DOUBLE[]) AS ratio) r)
SELECT ratio AS miss_ratio, arg_min(threshold, (cost, -threshold)) AS free_threshold, round(min(cost), 6) AS free_cost,
 round(arg_min(detection_rate, (cost, -threshold)), 6) AS free_detection, arg_min(detection_rate, (cost, -threshold)) >= 0.6 AS free_meets_floor,
 arg_min(threshold, (bad, cost, -threshold)) AS held_threshold, round(arg_min(cost, (bad, cost, -threshold)), 6) AS held_cost,
 round(arg_min(detection_rate, (bad, cost, -threshold)), 6) AS held_detection, min(bad) = 0 AS floor_reachable
FROM c GROUP BY ratio""")
def cost_sensitivity(spark, d):
    out = e.cost_sensitivity(_points(spark, d), floor=0.6)
    return out.select("miss_ratio", "free_threshold", r6("free_cost"), r6("free_detection"), "free_meets_floor",
                      "held_threshold", r6("held_cost"), r6("held_detection"), "floor_reachable")


PRED_SQL = cte("dim", "det", "gt", "frames") + """, ic AS (SELECT frame_id, arg_max(class_id, (n, a, -class_id)) AS image_class, count(*) > 1 AS multi FROM
  (SELECT frame_id, class_id, count(*) AS n, sum((x2-x1)*(y2-y1)) AS a FROM gt GROUP BY 1, 2) GROUP BY 1),
preds AS (SELECT f.frame_id, coalesce(ic.image_class, -1) AS image_class, coalesce(multi, false) AS multi, p.pred_class FROM frames f LEFT JOIN ic USING (frame_id)
 LEFT JOIN (SELECT frame_id, arg_max(class_id, (conf, -det_id)) AS pred_class FROM det WHERE conf >= 0.15 GROUP BY 1) p USING (frame_id)),
rep AS (SELECT m.class_id, support, predicted, hit, precision, recall, CASE WHEN precision+recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1
 FROM (SELECT class_id, support, predicted, hit, CASE WHEN predicted > 0 THEN hit/predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit/support ELSE 0 END AS recall
  FROM (SELECT class_id, (SELECT count(*) FROM preds WHERE image_class = dim.class_id) AS support,
   (SELECT count(*) FROM preds WHERE image_class >= 0 AND pred_class = dim.class_id) AS predicted,
   (SELECT count(*) FROM preds WHERE image_class = dim.class_id AND pred_class = dim.class_id) AS hit FROM dim)) m)"""


def _preds(spark, d):
    return e.image_predictions(t.frames(spark, d), gt(spark, d), det(spark, d), CONF)


@query("image_confusion", "E7", PRED_SQL + """
SELECT a.class_name AS true_class, coalesce(b.class_name, '(no detection)') AS predicted_class, count(*) AS n
FROM preds p JOIN dim a ON a.class_id = p.image_class LEFT JOIN dim b ON b.class_id = p.pred_class GROUP BY 1, 2""")
def image_confusion(spark, d):
    return e.confusion(_preds(spark, d))


@query("image_class_report", "E7", PRED_SQL + """
SELECT class_id, support, predicted, hit, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM rep""")
def image_class_report(spark, d):
    return e.class_report(_preds(spark, d)).select("class_id", big("support"), big("predicted"), big("hit"), r6("precision"), r6("recall"), r6("f1"))


@query("image_summary", "E7", PRED_SQL + """
SELECT count(*) FILTER (image_class >= 0) AS n_images, count(*) FILTER (image_class < 0) AS background_images,
 count(*) FILTER (image_class < 0 AND pred_class IS NOT NULL) AS background_flagged,
 round(count(*) FILTER (image_class >= 0 AND image_class = pred_class) / count(*) FILTER (image_class >= 0), 6) AS accuracy,
 count(*) FILTER (image_class >= 0 AND pred_class IS NULL) AS no_detection_images, count(*) FILTER (multi) AS multi_class_images,
 (SELECT round(avg(f1), 6) FROM rep) AS macro_f1, (SELECT round(sum(f1*support)/sum(support), 6) FROM rep) AS weighted_f1 FROM preds""")
def image_summary(spark, d):
    p = _preds(spark, d)
    out = e.image_summary(p, e.class_report(p))
    return out.select(*[big(c) for c in ("n_images", "background_images", "background_flagged")], r6("accuracy"),
                      big("no_detection_images"), big("multi_class_images"), r6("macro_f1"), r6("weighted_f1"))


AT_SQL = cte("dim", "det", "gt", "matches") + """, kept AS (SELECT * FROM det WHERE conf >= 0.15),
hits AS (SELECT x.* FROM matches x JOIN kept USING (frame_id, class_id, det_id)),
found AS (SELECT g.*, h.box_id IS NOT NULL AS found FROM gt g LEFT JOIN hits h USING (frame_id, class_id, box_id)),
fp AS (SELECT k.* FROM kept k ANTI JOIN hits h USING (frame_id, class_id, det_id)),
ic AS (SELECT frame_id, arg_max(class_id, (n, a, -class_id)) AS image_class FROM
  (SELECT frame_id, class_id, count(*) AS n, sum((x2-x1)*(y2-y1)) AS a FROM gt GROUP BY 1, 2) GROUP BY 1)"""


@query("class_failures", "E8", AT_SQL + """
SELECT class_id, instances, detected, instances - detected AS missed, false_positives, round(detected / instances, 6) AS recall
FROM (SELECT class_id, count(*) AS instances, count(*) FILTER (found) AS detected FROM found GROUP BY 1)
JOIN (SELECT class_id, count(*) AS false_positives FROM fp GROUP BY 1) USING (class_id)""")
def class_failures(spark, d):
    flag, found, gts = _at(spark, d)
    out, _ = e.class_failures(t.frames(spark, d), found, flag, gts)
    return out.select("class_id", *[big(c) for c in ("instances", "detected", "missed", "false_positives")], r6("recall"))


@query("false_positive_landing", "E8", AT_SQL + """
SELECT class_id, landed_on, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY n DESC, landed_on) AS rank FROM
 (SELECT fp.class_id, coalesce(image_class, -1) AS landed_on, count(*) AS n FROM fp LEFT JOIN ic USING (frame_id) GROUP BY 1, 2)) WHERE rank <= 3""")
def false_positive_landing(spark, d):
    flag, found, gts = _at(spark, d)
    _, landed = e.class_failures(t.frames(spark, d), found, flag, gts)
    return e.top_landed(landed)


TAX_SQL = AT_SQL + f""", bo AS (SELECT g.frame_id, g.box_id, max({s.iou('g','k')}) AS best_iou, arg_max(k.class_id, ({s.iou('g','k')}, -k.det_id)) AS best_class
  FROM found g JOIN kept k USING (frame_id) WHERE NOT g.found AND {s.overlaps('g','k')} GROUP BY 1, 2),
vd AS (SELECT g.*, coalesce(best_iou, 0) AS best_iou, best_class, CASE WHEN best_iou >= 0.5 AND best_class <> class_id THEN 'class_confusion'
  WHEN best_iou >= 0.1 THEN 'extent_error' ELSE 'blind_miss' END AS verdict FROM found g LEFT JOIN bo USING (frame_id, box_id) WHERE NOT g.found)"""


def _verdicts(spark, d):
    flag, found, _ = _at(spark, d)
    return found, e.miss_verdicts(found.where(~F.col("found")), flag)


@query("miss_verdicts", "D9", TAX_SQL + "SELECT frame_id, box_id, class_id, round(best_iou, 6) AS best_iou, best_class, verdict FROM vd")
def miss_verdicts(spark, d):
    return _verdicts(spark, d)[1].select("frame_id", "box_id", "class_id", r6("best_iou"), "best_class", "verdict")


@query("miss_taxonomy", "E9 D9", TAX_SQL + """
SELECT class_id, instances, matched, missed, class_confusion, extent_error, blind_miss, round(matched/instances, 6) AS recall FROM
 (SELECT class_id, count(*) AS instances, count(*) FILTER (found) AS matched FROM found GROUP BY 1) JOIN
 (SELECT class_id, count(*) AS missed, count(*) FILTER (verdict='class_confusion') AS class_confusion, count(*) FILTER (verdict='extent_error') AS extent_error,
   count(*) FILTER (verdict='blind_miss') AS blind_miss FROM vd GROUP BY 1) USING (class_id)""")
def miss_taxonomy(spark, d):
    found, v = _verdicts(spark, d)
    out = e.failure_taxonomy(found, v)
    return out.select("class_id", *[big(c) for c in ("instances", "matched", "missed", "class_confusion", "extent_error", "blind_miss")], r6("recall"))


@query("confused_with", "E9", TAX_SQL + "SELECT class_id, best_class, count(*) AS n FROM vd WHERE verdict = 'class_confusion' GROUP BY 1, 2")
def confused_with(spark, d):
    return e.confused_with(_verdicts(spark, d)[1])


@query("landed_on_class", "E9", AT_SQL + """
SELECT image_class, class_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_class ORDER BY n DESC, class_id) AS rank FROM
 (SELECT image_class, fp.class_id, count(*) AS n FROM fp JOIN ic USING (frame_id) GROUP BY 1, 2)) WHERE rank <= 4""")
def landed_on_class(spark, d):
    flag, found, gts = _at(spark, d)
    _, landed = e.class_failures(t.frames(spark, d), found, flag, gts)
    rows = landed.where(F.col("landed_on") >= 0).withColumnRenamed("landed_on", "image_class")
    return e.top_landed(rows, 4, ("image_class",), "class_id")


@query("error_gallery", "H2", AT_SQL + """
SELECT kind, class_id, frame_id, item_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind, class_id ORDER BY CASE WHEN kind='miss' THEN score ELSE -score END, frame_id) AS rank FROM (
 SELECT 'miss' AS kind, g.class_id, g.frame_id, min(g.box_id) AS item_id, coalesce(max(k.conf), 0) AS score
 FROM found g LEFT JOIN kept k ON k.frame_id = g.frame_id AND k.class_id = g.class_id WHERE NOT g.found GROUP BY 2, 3
 UNION ALL SELECT 'false_positive', class_id, frame_id, arg_max(det_id, (conf, -det_id)), max(conf) FROM fp GROUP BY 2, 3)) WHERE rank <= 4""")
def error_gallery(spark, d):
    flag, found, _ = _at(spark, d)
    return e.error_gallery(found, flag).select("kind", "class_id", "frame_id", "item_id", "score", "rank")


@query("label_geometry", "E10", cte("gt", "frames") + f""", sib AS (SELECT a.frame_id, CASE WHEN count(*) FILTER (a.box_id <> b.box_id) > 0
   THEN sum(CASE WHEN a.box_id <> b.box_id THEN {s.iou('a','b')} ELSE 0 END) / count(*) FILTER (a.box_id <> b.box_id) ELSE 0 END AS sib, count(DISTINCT a.box_id) AS n
  FROM gt a JOIN gt b USING (frame_id) GROUP BY 1),
r AS (SELECT g.class_id, greatest(1, least(200, round_even(x2,0))) - greatest(0, least(199, round_even(x1,0))) AS cw,
   greatest(1, least(200, round_even(y2,0))) - greatest(0, least(199, round_even(y1,0))) AS ch, sib, n FROM gt g JOIN sib USING (frame_id))
SELECT class_id, count(*) AS n_boxes, round(avg(cw*ch/40000), 6) AS box_area_frac, round(avg(sib), 6) AS mean_sibling_iou, round(avg(n), 6) AS boxes_per_image
FROM r WHERE cw > 0 AND ch > 0 GROUP BY 1""")
def label_geometry(spark, d):
    out = e.label_geometry(t.frames(spark, d), gt(spark, d))
    return out.select("class_id", big("n_boxes"), r6("box_area_frac"), r6("mean_sibling_iou"), r6("boxes_per_image"))


def _matches2():
    return """, pairs_b AS (SELECT d.frame_id, d.class_id, d.det_id, d.conf, g.box_id, %s AS iou FROM det2 d JOIN gt g ON d.frame_id=g.frame_id AND d.class_id=g.class_id WHERE %s >= 0.5),
wishes_b AS (SELECT frame_id, class_id, det_id, conf, list(box_id ORDER BY iou DESC, box_id) AS wish, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY conf DESC, det_id) AS rn
 FROM pairs_b GROUP BY frame_id, class_id, det_id, conf),
walk_b AS (SELECT frame_id, class_id, rn, det_id, wish[1] AS box_id, [wish[1]] AS taken FROM wishes_b WHERE rn = 1
 UNION ALL SELECT n.frame_id, n.class_id, n.rn, n.det_id, n.box_id, CASE WHEN n.box_id IS NULL THEN n.taken ELSE list_append(n.taken, n.box_id) END
 FROM (SELECT w.frame_id, w.class_id, w.rn, w.det_id, p.taken, list_filter(w.wish, lambda b: NOT list_contains(p.taken, b))[1] AS box_id
   FROM walk_b p JOIN wishes_b w ON w.frame_id=p.frame_id AND w.class_id=p.class_id AND w.rn=p.rn+1) n),
matches_b AS (SELECT frame_id, class_id, det_id, box_id FROM walk_b WHERE box_id IS NOT NULL)""" % (s.iou("d", "g"), s.iou("d", "g"))


@query("model_agreement", "D13", cte("det", "det2", "gt", "matches") + _matches2() + """,
x AS (SELECT g.class_id, a.box_id IS NOT NULL AS a, b.box_id IS NOT NULL AS b FROM gt g LEFT JOIN matches a USING (frame_id, class_id, box_id)
  LEFT JOIN matches_b b USING (frame_id, class_id, box_id))
SELECT class_id, count(*) AS labels, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS a_only, count(*) FILTER (b AND NOT a) AS b_only,
 count(*) FILTER (NOT a AND NOT b) AS neither, round(count(*) FILTER (a)/count(*), 6) AS recall_a, round(count(*) FILTER (b)/count(*), 6) AS recall_b,
 round(count(*) FILTER (a OR b)/count(*), 6) AS recall_union FROM x GROUP BY 1""")
def model_agreement(spark, d):
    _, gts, a = matched(spark, d)
    _, _, b = matched(spark, d, "B")
    out = e.agreement(gts, a, b)
    return out.select("class_id", "labels", *[big(c) for c in ("both", "a_only", "b_only", "neither")], r6("recall_a"), r6("recall_b"), r6("recall_union"))


AP_SQL = """, tpd AS (SELECT d.*, (x.det_id IS NOT NULL)::INT AS tp FROM {det} d LEFT JOIN {hits} x USING (frame_id, class_id, det_id{also})),
rk AS (SELECT {keys}, row_number() OVER w AS rk, sum(tp) OVER w AS ctp FROM tpd WINDOW w AS (PARTITION BY {keys} ORDER BY {score} DESC, frame_id, det_id ROWS UNBOUNDED PRECEDING)),
ng AS (SELECT class_id, count(*) AS n FROM gt GROUP BY 1),
pr AS (SELECT rk.*, ctp / n AS recall, max(ctp / rk) OVER (PARTITION BY {keys} ORDER BY rk DESC ROWS UNBOUNDED PRECEDING) AS env,
   lead(ctp / n) OVER (PARTITION BY {keys} ORDER BY rk) AS nrecall, n FROM rk JOIN ng USING (class_id)),
pe AS (SELECT *, lead(env) OVER (PARTITION BY {keys} ORDER BY rk) AS nenv FROM pr),
lv AS (SELECT {keys}, recall, max(rk) AS rk FROM pe GROUP BY ALL),
gx AS (SELECT k.*, i * 0.01::DOUBLE AS x FROM (SELECT DISTINCT {keys} FROM rk) k, range(101) r(i)),
hit AS (SELECT gx.*, lv.rk FROM gx ASOF LEFT JOIN lv ON {asof} AND gx.x >= lv.recall),
val AS (SELECT h.*, CASE WHEN h.rk IS NULL THEN (SELECT f.env FROM pe f WHERE f.rk = 1 AND {first})
   WHEN p.nrecall IS NULL THEN CASE WHEN h.x = p.recall THEN p.env ELSE 0 END
   ELSE p.env + (p.nenv - p.env) / (p.nrecall - p.recall) * (h.x - p.recall) END AS v FROM hit h LEFT JOIN pe p ON {pj} AND p.rk = h.rk)"""


def ap_sql(det="det", hits="matches", keys=("class_id",), score="conf", also=""):
    on = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)
    return AP_SQL.format(det=det, hits=hits, keys=", ".join(keys), score=score, also=also, asof=on("gx", "lv"), first=on("f", "h"), pj=on("p", "h"))


def label_counts(gts):
    return gts.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_labels"))


@query("average_precision_50", "E13", cte("det", "gt", "matches") + ap_sql() + """
SELECT class_id, (SELECT n FROM ng WHERE ng.class_id = val.class_id) AS n_labels, round(avg(v), 6) AS ap FROM val GROUP BY class_id""")
def average_precision_50(spark, d):
    flag, gts, _ = flagged(spark, d)
    return e.average_precision(flag, label_counts(gts)).select("class_id", "n_labels", r6("ap"))


@query("mean_ap_50", "E13", cte("det", "gt", "matches") + ap_sql() + """
SELECT round(avg(ap), 6) AS mean_ap, count(*) AS classes FROM (SELECT class_id, avg(v) AS ap FROM val GROUP BY class_id)""")
def mean_ap_50(spark, d):
    flag, gts, _ = flagged(spark, d)
    return e.mean_ap(e.average_precision(flag, label_counts(gts))).select(r6("mean_ap"), "classes")


@query("average_precision_50_95", "E14", cte("det", "gt") + f""", grd AS (SELECT unnest([0.5,0.55,0.6,0.65,0.7,0.75,0.8,0.85,0.9,0.95]::DOUBLE[]) AS iou_thr),
prs AS (SELECT r.iou_thr, d.frame_id, d.class_id, d.det_id, d.conf, g.box_id, {s.iou('d','g')} AS iou FROM det d JOIN gt g ON d.frame_id=g.frame_id AND d.class_id=g.class_id
  JOIN grd r ON {s.iou('d','g')} >= r.iou_thr),
wsh AS (SELECT iou_thr, frame_id, class_id, det_id, conf, list(box_id ORDER BY iou DESC, box_id) AS wish,
  row_number() OVER (PARTITION BY iou_thr, frame_id, class_id ORDER BY conf DESC, det_id) AS rn FROM prs GROUP BY iou_thr, frame_id, class_id, det_id, conf),
wkk AS (SELECT iou_thr, frame_id, class_id, rn, det_id, wish[1] AS box_id, [wish[1]] AS taken FROM wsh WHERE rn = 1
 UNION ALL SELECT n.iou_thr, n.frame_id, n.class_id, n.rn, n.det_id, n.box_id, CASE WHEN n.box_id IS NULL THEN n.taken ELSE list_append(n.taken, n.box_id) END
 FROM (SELECT w.iou_thr, w.frame_id, w.class_id, w.rn, w.det_id, p.taken, list_filter(w.wish, lambda b: NOT list_contains(p.taken, b))[1] AS box_id
   FROM wkk p JOIN wsh w ON w.iou_thr=p.iou_thr AND w.frame_id=p.frame_id AND w.class_id=p.class_id AND w.rn=p.rn+1) n),
hits AS (SELECT * FROM wkk WHERE box_id IS NOT NULL),
det_all AS (SELECT d.*, r.iou_thr FROM det d, grd r)""" + ap_sql("det_all", "hits", ("class_id", "iou_thr"), also=", iou_thr") + """
SELECT class_id, iou_thr, round(avg(v), 6) AS ap FROM val GROUP BY ALL""")
def average_precision_50_95(spark, d):
    per = _ap_grid(spark, d)
    return per.select("class_id", "iou_thr", r6("ap"))


def _ap_grid(spark, d):
    dets, gts = det(spark, d), gt(spark, d)
    hits = m.greedy_match(dets, gts, iou_grid=e.IOU_GRID)
    bit = sum((F.when(F.col("iou_thr") == dbl(v), 1 << i).otherwise(0) for i, v in enumerate(e.IOU_GRID)), F.lit(0))
    on = ["frame_id", "class_id", "det_id"]
    marked = hits.groupBy("frame_id", "class_id", "det_id").agg(F.sum(bit).alias("hits"))
    rows = reuse(dets.select(*on, "conf").join(marked, on, "left").fillna(0, subset=["hits"]))
    out = e.lane_precision(rows, label_counts(gts), ("class_id",), "conf", ("frame_id", "det_id"), "hits", len(e.IOU_GRID))
    return out.withColumn("iou_thr", F.get(F.array(*[dbl(v) for v in e.IOU_GRID]), "lane"))


@query("max_f1_point", "E14", cte("det", "gt", "matches") + """, tpd AS (SELECT d.*, (x.det_id IS NOT NULL)::INT AS tp FROM det d LEFT JOIN matches x USING (frame_id, class_id, det_id)),
rk AS (SELECT class_id, tp, row_number() OVER w AS rk, sum(tp) OVER w AS k FROM tpd WINDOW w AS (PARTITION BY class_id ORDER BY conf DESC, frame_id, det_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT class_id, rk, k, n, 2*k/(rk+n) AS f1 FROM rk JOIN (SELECT class_id, count(*) AS n FROM gt GROUP BY 1) USING (class_id) WHERE tp = 1)
SELECT class_id, round(max(f1), 6) AS f1, round(arg_max(k/rk, (f1, -rk)), 6) AS precision, round(arg_max(k/n, (f1, -rk)), 6) AS recall FROM c GROUP BY 1""")
def max_f1_point(spark, d):
    flag, gts, _ = flagged(spark, d)
    return e.max_f1_point(flag, label_counts(gts)).select("class_id", r6("f1"), r6("precision"), r6("recall"))
