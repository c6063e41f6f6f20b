"""AUC, bootstraps, clean-surface and cross-domain sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import coil as c
from ..operators import domains as dm
from ..operators import matching as m
from ..operators import metrics as e
from ..operators import statistics as st
from ..operators.resampling import LIMITS
from ..session import reuse
from ..sources import tables as t
from . import sql as s
from .base import big, det, query, r6
from .coil import DISPOSE_SQL
from .evaluation import flagged, matched
from .sql import cte, grid

FINE = grid(e.FINE_SWEEP)


def tiles(spark, d):
    return reuse(t.tiles(spark, d))


def _scores(spark, d):
    """Defective against certified clean tiles; unlabelled regions (-1) belong to neither."""
    return tiles(spark, d).where(F.col("label") >= 0).select(
        "tile_id", "source_id", "domain", "camera", F.col("max_conf").alias("score"), "label"
    )


RESAMPLES = 2000


def _weights(name, clusters, col, seed):
    """CTE of the weights above 0 of every cluster in every resample."""
    u = "('0x' || substr(h, 1 + 8 * j, 8))::BIGINT"
    w = " + ".join(f"(u >= {x})::INT" for x in LIMITS)
    return f"""{name} AS MATERIALIZED (SELECT * FROM (SELECT {col}, b, {w} AS w FROM (SELECT {col}, 4 * k + j AS b, {u} AS u FROM
 (SELECT {col}, k, md5('{seed}:' || {col} || ':' || k) AS h FROM {clusters}, (SELECT unnest(range({(RESAMPLES + 3) // 4})) AS k)), (SELECT unnest([0, 1, 2, 3]) AS j)) WHERE b < {RESAMPLES}) WHERE w > 0)"""


@query("roc_auc_by_domain", "F3", cte("tiles") + """, x AS (SELECT domain, max_conf AS s, sum((label=1)::INT) AS p, sum((label=0)::INT) AS n FROM tiles WHERE label >= 0 GROUP BY 1, 2),
y AS (SELECT *, sum(n) OVER (PARTITION BY domain ORDER BY s ROWS UNBOUNDED PRECEDING) AS below FROM x)
SELECT domain, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(p*(below - n/2)) / (sum(p)*sum(n)), 6) AS auc FROM y GROUP BY 1""")
def roc_auc_by_domain(spark, d):
    return st.roc_auc(_scores(spark, d), ["domain"]).select("domain", big("n_pos"), big("n_neg"), r6("auc"))


@query("stratified_auc", "F5", cte("tiles") + """, x AS (SELECT domain, camera, max_conf AS s, sum((label=1)::INT) AS p, sum((label=0)::INT) AS n FROM tiles WHERE label >= 0 GROUP BY ALL),
y AS (SELECT *, sum(n) OVER (PARTITION BY domain, camera ORDER BY s ROWS UNBOUNDED PRECEDING) AS below FROM x),
a AS (SELECT domain, camera, sum(p)*sum(n) AS w, sum(p*(below - n/2)) / (sum(p)*sum(n)) AS auc FROM y GROUP BY ALL)
SELECT domain, round(sum(auc*w)/sum(w), 6) AS auc_stratified FROM a GROUP BY 1""")
def stratified_auc(spark, d):
    return st.stratified_auc(_scores(spark, d), "camera", ["domain"]).select("domain", r6("auc_stratified"))


@query("design_effect_by_domain", "F2 F1", cte("tiles") + """, g AS (SELECT domain, source_id, count(*) AS s, sum((max_conf >= 0.5)::INT) AS h FROM tiles WHERE label = 0 GROUP BY 1, 2),
a AS (SELECT domain, count(*) AS g, sum(s) AS n, sum(h) AS h, sum(h*h) AS hh, sum(h*s) AS hs, sum(s*s) AS ss FROM g GROUP BY 1),
b AS (SELECT *, h/n AS p FROM a), c AS (SELECT *, p*(1-p)/n AS srs, (hh - 2*p*hs + p*p*ss)*g/((g-1)*n*n) AS vc FROM b)
SELECT domain, g AS n_clusters, CAST(n AS BIGINT) AS n, CAST(h AS BIGINT) AS hits, round(p, 6) AS rate,
 round(CASE WHEN srs <= 0 OR g < 2 THEN 1 ELSE vc/srs END, 6) AS design_effect FROM c""")
def design_effect_by_domain(spark, d):
    g = tiles(spark, d).where("label = 0").groupBy("domain", "source_id").agg(
        F.count(F.lit(1)).alias("s"), F.sum((F.col("max_conf") >= 0.5).cast("int")).alias("h"))
    return st.design_effect(g, "h", "s", ["domain"]).select("domain", "n_clusters", big("n"), big("hits"), r6("rate"), r6("design_effect"))


CLUST = cte("tiles") + """, g AS (SELECT source_id, count(*) AS s, sum((max_conf >= 0.5)::INT) AS h FROM tiles WHERE label = 0 GROUP BY 1)"""


def _clusters(spark, d):
    return reuse(tiles(spark, d).where("label = 0").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("s"), F.sum((F.col("max_conf") >= 0.5).cast("int")).alias("h")))


@query("cluster_bootstrap_rate", "F2", CLUST + f""", {_weights('wt', 'g', 'source_id', 'boot')}, q AS (SELECT b, sum(w*h)/greatest(sum(w*s), 1) AS rate FROM wt JOIN g USING (source_id) GROUP BY 1),
a AS (SELECT count(*) AS g, sum(s) AS n, sum(h) AS h, sum(h*h) AS hh, sum(h*s) AS hs, sum(s*s) AS ss FROM g), b2 AS (SELECT *, h/n AS p FROM a)
SELECT g AS n_clusters, CAST(n AS BIGINT) AS n, CAST(h AS BIGINT) AS hits, round(p, 6) AS rate, round((hh-2*p*hs+p*p*ss)*g/((g-1)*n*n)/(p*(1-p)/n), 6) AS design_effect,
 round((SELECT quantile_cont(rate, 0.025) FROM q), 6) AS lo, round((SELECT quantile_cont(rate, 0.975) FROM q), 6) AS hi FROM b2""")
def cluster_bootstrap_rate(spark, d):
    out = st.cluster_rate_interval(_clusters(spark, d), "source_id", "h", "s", RESAMPLES, "boot")
    return out.select("n_clusters", big("n"), big("hits"), r6("rate"), r6("design_effect"), r6("lo"), r6("hi"))


@query("cluster_bootstrap_profiles", "F2")
def cluster_bootstrap_profiles(spark, d):
    return st.profile_bootstrap(_clusters(spark, d), "h", "s", 2000)


@query("cluster_bootstrap_auc", "F4", cte("tiles") + f""", cl AS (SELECT DISTINCT source_id FROM tiles WHERE label >= 0), {_weights('w1', 'cl', 'source_id', 'auc1')}, {_weights('w0', 'cl', 'source_id', 'auc0')},
ce AS MATERIALIZED (SELECT source_id, label, max_conf AS s, count(*) AS n FROM tiles WHERE label >= 0 GROUP BY ALL),
x AS (SELECT b, s, sum(p) AS p, sum(n) AS n FROM (SELECT b, s, n*w AS p, 0 AS n FROM ce JOIN w1 USING (source_id) WHERE label = 1 UNION ALL SELECT b, s, 0, n*w FROM ce JOIN w0 USING (source_id) WHERE label = 0) GROUP BY 1, 2),
y AS (SELECT *, sum(n) OVER (PARTITION BY b ORDER BY s ROWS UNBOUNDED PRECEDING) AS below FROM x),
a AS (SELECT b, sum(p*(below - n/2)) / (sum(p)*sum(n)) AS auc FROM y GROUP BY 1)
SELECT round(quantile_cont(auc, 0.025), 6) AS lo, round(quantile_cont(auc, 0.975), 6) AS hi FROM a""")
def cluster_bootstrap_auc(spark, d):
    return st.cluster_auc_interval(_scores(spark, d), "source_id", RESAMPLES).select(r6("lo"), r6("hi"))


@query("paired_map_bootstrap", "F6 D10")
def paired_map_bootstrap(spark, d):
    a, gts, _ = flagged(spark, d)
    b, _, _ = flagged(spark, d, "B")
    both = a.unionByName(b)
    draws = reuse(st.paired_map_draws(both, gts, t.frames(spark, d), RESAMPLES))
    return st.paired_summary(draws, "A", "B")


@query("recall_contrast", "F7", cte("det", "det2", "gt", "matches", "frames") + f""", pairs_b AS (SELECT d.frame_id, d.class_id, d.det_id, d.conf, g.box_id, {s.iou('d','g')} AS iou FROM det2 d JOIN gt g ON d.frame_id=g.frame_id AND d.class_id=g.class_id WHERE {s.iou('d','g')} >= 0.5),
wishes_b AS (SELECT frame_id, class_id, det_id, conf, list(box_id ORDER BY iou DESC, box_id) AS wish, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY conf DESC, det_id) AS rn
 FROM pairs_b GROUP BY frame_id, class_id, det_id, conf),
walk_b AS (SELECT frame_id, class_id, rn, det_id, wish[1] AS box_id, [wish[1]] AS taken FROM wishes_b WHERE rn = 1
 UNION ALL SELECT n.frame_id, n.class_id, n.rn, n.det_id, n.box_id, CASE WHEN n.box_id IS NULL THEN n.taken ELSE list_append(n.taken, n.box_id) END
 FROM (SELECT w.frame_id, w.class_id, w.rn, w.det_id, p.taken, list_filter(w.wish, lambda b: NOT list_contains(p.taken, b))[1] AS box_id
   FROM walk_b p JOIN wishes_b w ON w.frame_id=p.frame_id AND w.class_id=p.class_id AND w.rn=p.rn+1) n),
k AS (SELECT f.coil_id, count(*) AS labels, count(a.box_id) AS fa, count(b.box_id) AS fb FROM gt g JOIN frames f USING (frame_id)
  LEFT JOIN matches a USING (frame_id, class_id, box_id) LEFT JOIN (SELECT * FROM walk_b WHERE box_id IS NOT NULL) b USING (frame_id, class_id, box_id) GROUP BY 1),
{_weights('wt', 'k', 'coil_id', 'contrast')},
q AS (SELECT b, sum(w*fb)/sum(w*labels) - sum(w*fa)/sum(w*labels) AS delta FROM wt JOIN k USING (coil_id) GROUP BY 1)
SELECT 'B' AS model, round(avg(delta), 6) AS mean_delta, round(quantile_cont(delta, 0.0125), 6) AS lo, round(quantile_cont(delta, 0.9875), 6) AS hi,
 quantile_cont(delta, 0.0125) > 0 OR quantile_cont(delta, 0.9875) < 0 AS excludes_zero FROM q""")
def recall_contrast(spark, d):
    _, gts, a = matched(spark, d)
    _, _, b = matched(spark, d, "B")
    on = ["frame_id", "class_id", "box_id"]
    g = gts.join(a.select(*on, F.lit(1).alias("fa")), on, "left").join(b.select(*on, F.lit(1).alias("fb")), on, "left")
    k = reuse(g.join(t.frames(spark, d).select("frame_id", "coil_id"), "frame_id").groupBy("coil_id").agg(
        F.count(F.lit(1)).alias("labels"), F.count("fa").alias("fa"), F.count("fb").alias("fb")))
    sums = st.bootstrap_sums(k, "coil_id", ["labels", "fa", "fb"], RESAMPLES, "contrast")
    long = sums.select("b", F.inline(F.array(
        F.struct(F.lit("A").alias("model"), (F.col("fa") / F.col("labels")).alias("recall")),
        F.struct(F.lit("B").alias("model"), (F.col("fb") / F.col("labels")).alias("recall")))))
    # two planned contrasts share the error rate
    return st.contrasts(long, "model", "recall", "A", family=2).select("model", r6("mean_delta"), r6("lo"), r6("hi"), "excludes_zero")


# ---------------------------------------------------------------- clean patches

PATCH_SQL = cte("tiles", "det") + """, patches AS (SELECT tile_id AS patch_id, source_id, ([60,80,100,120])[(tile_id // 4) % 4 + 1] AS size,
  CAST(source_id % 6 AS INT) AS source_class, max_conf FROM tiles WHERE label = 0)"""


def patches(spark, d):
    """Clean patches: certified clean frames, four crop scales, filed under the class of their coil."""
    sizes = F.array(*[F.lit(v) for v in (60, 80, 100, 120)])
    return tiles(spark, d).where("label = 0").select(
        F.col("tile_id").alias("patch_id"), "source_id", F.get(sizes, (F.floor(F.col("tile_id") / 4) % 4).cast("int")).alias("size"),
        (F.col("source_id") % 6).cast("int").alias("source_class"), "max_conf",
    )


def patch_boxes(spark, d):
    return det(spark, d).where("frame_id % 4 = 0").select(F.col("frame_id").alias("patch_id"), "class_id", "conf")


def wilson_sql(k, n):
    z = "1.959963985::DOUBLE"
    c = f"({k}/{n} + {z}*{z}/(2*{n}))"
    h = f"({z}*sqrt(({k}/{n})*(1-{k}/{n})/{n} + {z}*{z}/(4*{n}*{n})))"
    den = f"(1+{z}*{z}/{n})"
    return f"greatest(0, ({c}-{h})/{den})", f"least(1, ({c}+{h})/{den})"


_LO, _HI = wilson_sql("alarmed::DOUBLE", "n_patches::DOUBLE")


@query("clean_patch_sweep", "E15 F1", PATCH_SQL + f""", long AS (
 SELECT 'all' AS grouping, -1 AS value, * FROM patches UNION ALL SELECT 'scale', size, * FROM patches UNION ALL SELECT 'source_class', source_class, * FROM patches),
p AS (SELECT grouping, value, threshold, count(*) AS n_patches, sum((max_conf >= threshold)::INT) AS alarmed FROM long, {FINE} GROUP BY ALL),
b AS (SELECT grouping, value, threshold, count(*) AS boxes, sum((class_id = source_class)::INT) AS same FROM long JOIN det ON det.frame_id = long.patch_id JOIN {FINE} g ON conf >= g.threshold GROUP BY ALL)
SELECT grouping, value, threshold, n_patches, CAST(alarmed AS BIGINT) AS alarmed, round(alarmed/n_patches, 6) AS rate, round({_LO}, 6) AS rate_lo, round({_HI}, 6) AS rate_hi,
 coalesce(boxes, 0) AS boxes, round(coalesce(boxes, 0)/n_patches, 6) AS boxes_per_patch, round(coalesce(same/boxes, 0), 6) AS same_class_share
FROM p LEFT JOIN b USING (grouping, value, threshold)""")
def clean_patch_sweep(spark, d):
    out = dm.clean_patch_sweep(patches(spark, d), patch_boxes(spark, d))
    return out.select("grouping", "value", "threshold", big("n_patches"), big("alarmed"), r6("rate"), r6("rate_lo"), r6("rate_hi"),
                      big("boxes"), r6("boxes_per_patch"), r6("same_class_share"))


@query("clean_patch_classes", "E15", PATCH_SQL + f"""
SELECT class_id, threshold, count(*) AS boxes FROM patches JOIN det ON det.frame_id = patches.patch_id JOIN {FINE} g ON conf >= g.threshold GROUP BY ALL""")
def clean_patch_classes(spark, d):
    return dm.boxes_at(patch_boxes(spark, d), ["class_id"]).where("boxes > 0")


@query("independence_prediction", "F11", PATCH_SQL + f""", g AS (SELECT threshold, source_id, count(*) AS size, sum((max_conf >= threshold)::INT) AS hits FROM patches, {FINE} GROUP BY 1, 2),
p AS (SELECT threshold, sum(hits)/sum(size) AS pooled FROM g GROUP BY 1)
SELECT threshold, count(*) AS n_images, round(avg((hits > 0)::INT), 6) AS image_rate, round(avg(1 - pow(1 - pooled, size)), 6) AS independent_rate
FROM g JOIN p USING (threshold) GROUP BY 1""")
def independence_prediction(spark, d):
    g = dm.source_rates(patches(spark, d))
    return st.independence_prediction(g, "hits", "size", ["threshold"]).select("threshold", "n_images", r6("image_rate"), r6("independent_rate"))


def _cells(spark, d):
    p = patches(spark, d)
    return dm.alarm_rates(p, ["size"]).select(
        "threshold", (F.col("size") * F.col("size")).cast("double").alias("area"), F.col("alarmed").alias("hits"), F.col("n_patches").alias("trials"))


SLOPE = "list_sum(list_transform(cells, lambda c: c.n*c.area*((1 - exp(-exp((lo+hi)/2)*c.area)) - c.rate)*((1 - exp(-exp((lo+hi)/2)*c.area)) + c.rate - 2*(1 - exp(-exp((lo+hi)/2)*c.area))*c.rate)/((1 - exp(-exp((lo+hi)/2)*c.area))*(1 - exp(-exp((lo+hi)/2)*c.area))*exp(-exp((lo+hi)/2)*c.area))))"
AREA_SQL = PATCH_SQL + f""", cl AS MATERIALIZED (SELECT threshold, size, CAST(size*size AS DOUBLE) AS area, sum((max_conf >= threshold)::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM patches, {FINE} GROUP BY 1, 2),
st AS MATERIALIZED (SELECT threshold, list({{'area': area, 'rate': k/n, 'n': n}} ORDER BY area) AS cells, ln(min(-ln(1 - (k+0.5::DOUBLE)/(n+1))/area)/2) AS lo, ln(max(-ln(1 - (k+0.5::DOUBLE)/(n+1))/area)*2) AS hi, sum(k) AS hits, max(k/n) AS observed_max FROM cl GROUP BY 1),
bs AS (SELECT threshold, cells, lo, hi, 0 AS i FROM st UNION ALL SELECT threshold, cells, CASE WHEN {SLOPE} > 0 THEN lo ELSE (lo+hi)/2 END, CASE WHEN {SLOPE} > 0 THEN (lo+hi)/2 ELSE hi END, i + 1 FROM bs WHERE i < {st.HALVINGS}),
ft AS MATERIALIZED (SELECT threshold, CASE WHEN hits > 0 THEN exp((b.lo+b.hi)/2) ELSE 0 END AS lam, observed_max FROM bs b JOIN st USING (threshold) WHERE i = {st.HALVINGS}),
qu AS (SELECT threshold, count(*) AS m, sum(y*y) - sum(y)*sum(y)/count(*) AS sst, sum((y - lam*area)*(y - lam*area)) AS sse FROM (SELECT threshold, area, lam, -ln(1 - k/n) AS y FROM cl JOIN ft USING (threshold) WHERE k < n) GROUP BY 1)"""


@query("poisson_area_fit", "F8 F10", AREA_SQL + """SELECT threshold, round(lam, 10) AS lam, round(CASE WHEN m >= 2 AND sst > 1e-15 THEN 1 - sse/sst END, 5) AS r2, CAST(coalesce(m, 0) AS INT) AS n_unsaturated,
 round(CASE WHEN m IS NULL THEN observed_max ELSE greatest(1 - exp(-lam*40000), observed_max) END, 6) AS frame_rate, round(CASE WHEN m IS NOT NULL THEN lam*10000 END, 6) AS intensity_per_10k_px,
 CASE WHEN m IS NULL THEN 'saturated' WHEN 1 - exp(-lam*40000) >= observed_max THEN 'fit' ELSE 'floored' END AS note FROM ft LEFT JOIN qu USING (threshold)""")
def poisson_area_fit(spark, d):
    fit = st.extrapolate_to_frame(st.poisson_area_fit(_cells(spark, d), ["threshold"]), 40000.0)
    return fit.select("threshold", r6("lam", digits=10), r6("r2", digits=5), "n_unsaturated", r6("frame_rate"), r6("intensity_per_10k_px"), "note")


def _tail(x):
    """Upper tail of chi-square with dof degrees of freedom: one minus the series of the lower gamma function."""
    return f"greatest(0, 1 - list_sum(list_transform(range(3000), lambda i: exp((dof/2 + i)*ln({x}/2) - {x}/2 - lgamma(dof/2 + 1 + i)))))"


FIT_TEST_SQL = AREA_SQL + f""", de AS (SELECT threshold, avg(deff) AS mean_deff FROM (SELECT size, threshold, CASE WHEN g < 2 OR h/n*(1-h/n)/n <= 0 THEN 1 ELSE (hh - 2*h/n*hs + h/n*h/n*ss)*g/((g-1)*n*n)/(h/n*(1-h/n)/n) END AS deff FROM (
  SELECT size, threshold, count(*) AS g, sum(s)::DOUBLE AS n, sum(h)::DOUBLE AS h, sum(h*h) AS hh, sum(h*s) AS hs, sum(s*s) AS ss FROM (SELECT size, threshold, source_id, count(*) AS s, sum((max_conf >= threshold)::INT) AS h FROM patches, {FINE} GROUP BY 1, 2, 3) GROUP BY 1, 2)) GROUP BY 1),
pc AS (SELECT c.*, least(greatest(1 - exp(-lam*area), 1e-12), 1 - 1e-12) AS pp, least(greatest(sum(k) OVER w / sum(n) OVER w, 1e-12), 1 - 1e-12) AS p0 FROM cl c JOIN ft USING (threshold) WINDOW w AS (PARTITION BY threshold)),
ch AS (SELECT threshold, count(*) - 1 AS dof, sum((k-n*p0)*(k-n*p0)/(n*p0*(1-p0))) AS c0, sum((k-n*pp)*(k-n*pp)/(n*pp*(1-pp))) AS cp, min(least(n*p0, n*(1-p0))) >= 5 AS ok0, min(least(n*pp, n*(1-pp))) >= 5 AS okp FROM pc GROUP BY 1),
co AS (SELECT *, c0/greatest(mean_deff, 1e-9) AS x0, cp/greatest(mean_deff, 1e-9) AS xp, ok0 AND dof > 0 AS v0, okp AND dof > 0 AS vp FROM ch JOIN de USING (threshold)),
pv AS (SELECT *, CASE WHEN v0 THEN {_tail('x0')} END AS p0, CASE WHEN vp THEN {_tail('xp')} END AS pp FROM co)
SELECT threshold, dof, v0 AS valid_constant, vp AS valid_poisson, CASE WHEN v0 THEN round(x0, 4) END AS chi2_constant_corrected, CASE WHEN vp THEN round(xp, 4) END AS chi2_poisson_corrected,
 round(p0, 5) AS p_constant, round(pp, 5) AS p_poisson, coalesce(CAST(CASE WHEN vp THEN pp >= 0.05 AND cp <= c0 END AS VARCHAR), 'not valid') AS poisson_supported, round(mean_deff, 6) AS mean_deff FROM pv"""


@query("area_model_test", "F9", FIT_TEST_SQL)
def area_model_test(spark, d):
    cells = reuse(_cells(spark, d))
    fit = st.poisson_area_fit(cells, ["threshold"])
    deff = st.design_effect(_sized(spark, d), "hits", "trials", ["scale", "threshold"])
    mean = deff.groupBy("threshold").agg(F.avg("design_effect").alias("mean_deff"))
    out = st.goodness_of_fit(cells, fit, mean, ["threshold"])
    held = lambda kind: F.when(F.col(f"valid_{kind}"), F.round(f"chi2_{kind}_corrected", 4)).alias(f"chi2_{kind}_corrected")
    return out.select("threshold", big("dof"), "valid_constant", "valid_poisson", held("constant"), held("poisson"), r6("p_constant", digits=5), r6("p_poisson", digits=5), F.coalesce(F.col("poisson_supported").cast("string"), F.lit("not valid")).alias("poisson_supported"), r6("mean_deff"))


def _sized(spark, d):
    p = patches(spark, d).withColumnRenamed("size", "scale")
    return dm.source_rates(p, keys=["scale"]).withColumnRenamed("size", "trials")


CLEAN_COST_SQL = """, c AS (SELECT p.threshold, detection_rate, a.rate AS clean_fa, r.ratio, 0.05::DOUBLE*r.ratio*(1-detection_rate) + (1-0.05::DOUBLE)*a.rate AS cost,
  CASE WHEN detection_rate >= 0.6 THEN 0 ELSE 1 END AS bad FROM points p JOIN clean a USING (threshold), (SELECT unnest([3,10,12,30]::DOUBLE[]) AS ratio) r)
SELECT ratio AS miss_ratio, arg_min(threshold, (cost, -threshold)) AS free_threshold, round(min(cost), 6) AS free_cost,
 arg_min(threshold, (bad, cost, -threshold)) AS held_threshold, round(arg_min(cost, (bad, cost, -threshold)), 6) AS held_cost, min(bad) = 0 AS floor_reachable,
 round(0.05::DOUBLE*ratio/(1-0.05::DOUBLE), 6) AS effective_weight FROM c GROUP BY ratio"""


def _sweep_fine():
    from .evaluation import sweep_sql

    return sweep_sql(e.FINE_SWEEP, extra=("tiles",))


@query("clean_cost_sensitivity", "E6 B16 E5", _sweep_fine() + f""", clean AS (SELECT threshold, avg((max_conf >= threshold)::INT) AS rate FROM tiles, {FINE} WHERE label = 0 GROUP BY 1)""" + CLEAN_COST_SQL)
def clean_cost_sensitivity(spark, d):
    flag, gts, _ = flagged(spark, d)
    pts = e.sweep(t.frames(spark, d), gts, flag, e.FINE_SWEEP).select("threshold", "detection_rate")
    clean = dm.alarm_rates(patches(spark, d)).select("threshold", F.col("rate").alias("clean_fa"))
    out = e.cost_sensitivity(pts.join(clean, "threshold"), ratios=e.CLEAN_RATIOS, floor=0.6, prevalence=e.PREVALENCE, false_alarm="clean_fa")
    return out.select("miss_ratio", "free_threshold", r6("free_cost"), "held_threshold", r6("held_cost"), "floor_reachable", r6("effective_weight"))


@query("control_sweep", "E16", cte("tiles", "det", "gt", "matches") + f""", x AS (SELECT d.frame_id, d.conf, m.det_id IS NOT NULL AS tp FROM det d LEFT JOIN matches m USING (frame_id, class_id, det_id)),
p AS (SELECT tile_id, threshold, bool_or(x.conf >= threshold) AS fl, bool_or(x.conf >= threshold AND tp) AS loc FROM tiles LEFT JOIN x ON x.frame_id = tile_id, {FINE} WHERE label = 1 GROUP BY 1, 2)
SELECT threshold, count(*) AS n_patches, count(*) FILTER (fl) AS flagged, count(*) FILTER (loc) AS localised,
 round(count(*) FILTER (fl)/count(*), 6) AS flag_rate, round(count(*) FILTER (loc)/count(*), 6) AS localised_rate FROM p GROUP BY 1""")
def control_sweep(spark, d):
    flag, _, _ = flagged(spark, d)
    p = tiles(spark, d).where("label = 1").select(F.col("tile_id").alias("patch_id"))
    out = dm.control_sweep(p, flag.withColumnRenamed("frame_id", "patch_id"), e.FINE_SWEEP)
    return out.select("threshold", "n_patches", big("flagged"), big("localised"), r6("flag_rate"), r6("localised_rate"))


@query("cross_domain_sweep", "E17", cte("tiles", "det") + f""", x AS (SELECT label, source_id, tile_id, threshold, max_conf >= threshold AS h FROM tiles, {FINE}),
f AS (SELECT label, source_id, threshold, bool_or(h) AS h FROM x GROUP BY ALL),
a AS (SELECT threshold, count(*) FILTER (label=0) AS clean_tiles, count(*) FILTER (label=0 AND h) AS ctf, count(*) FILTER (label=1) AS dt, count(*) FILTER (label=1 AND h) AS dth,
   count(*) FILTER (label=-1) AS ut, count(*) FILTER (label=-1 AND h) AS uth FROM x GROUP BY 1),
b AS (SELECT threshold, count(*) FILTER (label=0) AS clean_frames, count(*) FILTER (label=0 AND h) AS cff, count(*) FILTER (label=1) AS df, count(*) FILTER (label=1 AND h) AS dfh FROM f GROUP BY 1),
bx AS (SELECT threshold, count(*) AS boxes FROM det JOIN {FINE} g ON conf >= g.threshold WHERE frame_id % 4 = 0 GROUP BY 1)
SELECT threshold, ctf AS clean_tiles_flagged, clean_tiles, round(ctf/clean_tiles, 6) AS clean_tile_fa, cff AS clean_frames_flagged, clean_frames, round(cff/clean_frames, 6) AS clean_frame_fa,
 round(coalesce(boxes, 0)/clean_tiles, 6) AS boxes_per_clean_tile, round(dth/dt, 6) AS defect_tile_recall, round(dfh/df, 6) AS defect_frame_recall, round(uth/ut, 6) AS unlabelled_flag_rate
FROM a JOIN b USING (threshold) LEFT JOIN bx USING (threshold)""")
def cross_domain_sweep(spark, d):
    boxes = det(spark, d).select(F.col("frame_id").alias("tile_id"), "class_id", "conf")
    out = dm.cross_domain_sweep(tiles(spark, d), boxes)
    return out.select("threshold", big("clean_tiles_flagged"), big("clean_tiles"), r6("clean_tile_fa"), big("clean_frames_flagged"), big("clean_frames"),
                      r6("clean_frame_fa"), r6("boxes_per_clean_tile"), r6("defect_tile_recall"), r6("defect_frame_recall"), r6("unlabelled_flag_rate"))


@query("false_positive_classes", "E17", cte("det") + f"""SELECT class_id, threshold, count(*) AS boxes, round(count(*) / sum(count(*)) OVER (PARTITION BY threshold), 6) AS share
FROM det JOIN {FINE} g ON conf >= g.threshold WHERE frame_id % 4 = 0 GROUP BY class_id, threshold""")
def false_positive_classes(spark, d):
    boxes = det(spark, d).select(F.col("frame_id").alias("tile_id"), "class_id", "conf")
    return dm.false_positive_classes(tiles(spark, d), boxes).select("class_id", "threshold", big("boxes"), r6("share"))


DOMAIN_SQL = cte("tiles", "det", "gt", "matches") + f""", x AS (SELECT d.frame_id, d.conf, m.det_id IS NOT NULL AS tp FROM det d LEFT JOIN matches m USING (frame_id, class_id, det_id)),
p AS (SELECT tile_id, label, domain, threshold, coalesce(bool_or(x.conf >= threshold), false) AS fl, coalesce(bool_or(x.conf >= threshold AND tp), false) AS hit,
   count(*) FILTER (x.conf >= threshold) AS nb FROM tiles LEFT JOIN x ON x.frame_id = tile_id, {FINE} WHERE label >= 0 GROUP BY ALL),
lab AS (SELECT 'all' AS domain, threshold, count(*) AS n_labelled, count(*) FILTER (hit) AS det_n, count(*) FILTER (fl) AS fl_n FROM p WHERE label = 1 GROUP BY 2
  UNION ALL SELECT domain, threshold, count(*), count(*) FILTER (hit), count(*) FILTER (fl) FROM p WHERE label = 1 GROUP BY 1, 2),
cl AS (SELECT threshold, count(*) AS n_clean, count(*) FILTER (fl) AS cf, sum(nb) AS nb FROM p WHERE label = 0 GROUP BY 1),
sw AS (SELECT domain, threshold, n_labelled, n_clean, det_n/n_labelled AS detection_rate, fl_n/n_labelled AS flag_rate, cf/n_clean AS clean_false_alarm, nb/n_clean AS boxes_per_clean_frame FROM lab JOIN cl USING (threshold))"""


def _domain_sweep(spark, d):
    flag, _, _ = flagged(spark, d)
    f = tiles(spark, d).where("label >= 0").select(F.col("tile_id").alias("frame_id"), "domain", (F.col("label") == 1).alias("labelled"))
    return dm.domain_sweep(f, flag)


@query("domain_sweep", "E18", DOMAIN_SQL + """
SELECT domain, threshold, n_labelled, n_clean, round(detection_rate, 6) AS detection_rate, round(flag_rate, 6) AS flag_rate, round(clean_false_alarm, 6) AS clean_false_alarm,
 round(boxes_per_clean_frame, 6) AS boxes_per_clean_frame FROM sw""")
def domain_sweep(spark, d):
    return _domain_sweep(spark, d).select("domain", "threshold", big("n_labelled"), big("n_clean"), r6("detection_rate"), r6("flag_rate"),
                                          r6("clean_false_alarm"), r6("boxes_per_clean_frame"))


@query("domain_operating_points", "E18 E5", DOMAIN_SQL + """, l AS (SELECT domain, threshold, clean_false_alarm AS fa, unnest(['detection_rate','flag_rate']) AS basis, unnest([detection_rate, flag_rate]) AS dr FROM sw),
c AS (SELECT *, 0.05::DOUBLE*12*(1-dr) + (1-0.05::DOUBLE)*fa AS cost, CASE WHEN dr >= 0.9 THEN 0 ELSE 1 END AS bad FROM l)
SELECT domain, basis, arg_min(threshold, (bad, cost, -threshold)) AS threshold, round(arg_min(cost, (bad, cost, -threshold)), 6) AS cost,
 round(arg_min(dr, (bad, cost, -threshold)), 6) AS detection, min(bad) = 0 AS floor_met FROM c GROUP BY 1, 2""")
def domain_operating_points(spark, d):
    return dm.domain_operating_points(_domain_sweep(spark, d)).select("domain", "basis", "threshold", r6("cost"), r6("detection"), "floor_met")


@query("clean_coil_disposition", "E20", cte("dim", "tiles", "det", "frames") + """,
cl AS (SELECT f.*, f.domain AS line FROM frames f WHERE frame_id % 4 = 0)""" + """, sc AS (
 SELECT d.frame_id, m.class_name, d.conf, d.det_id, least(greatest(CASE m.tier WHEN 'low' THEN 22 WHEN 'medium' THEN 42 WHEN 'high' THEN 64 ELSE 84 END
   * (0.5::DOUBLE + 0.5::DOUBLE*conf) * (1 + 0.55::DOUBLE * least(1, (least(d.x2,200)-least(d.x1,200))*(least(d.y2,200)-least(d.y1,200))/40000/0.25::DOUBLE)), 0), 100) AS score
 FROM det d JOIN cl USING (frame_id) JOIN dim m USING (class_id) WHERE d.conf >= 0.96),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC, det_id) AS r FROM sc),
a AS (SELECT frame_id, count(*) AS n, max((class_name='inclusion')::INT) AS flag, 100*(1-product(1-score/100*pow(0.6::DOUBLE, r-1))) AS sev FROM rk GROUP BY 1),
fr AS (SELECT cl.*, coalesce(n,0) AS n, coalesce(flag,0) AS flag, coalesce(sev,0) AS sev FROM cl LEFT JOIN a USING (frame_id)),
wh AS (SELECT coil_id, line, max(n) AS n, max(flag) AS flag, max(sev) AS sev FROM fr GROUP BY 1, 2),
u AS (SELECT 'tiles' AS grain, line, n, flag, sev FROM fr UNION ALL SELECT 'whole_frames', line, n, flag, sev FROM wh),
stats AS (SELECT grain || ':' || line AS coil_id, avg((n > 0)::INT) AS defect_rate, quantile_cont(sev, 0.95) AS p95_severity, sum((sev >= 80)::INT) AS frames_critical,
  sum((sev >= 55 AND sev < 80)::INT) AS frames_high, sum(flag) AS flag_class_frames FROM u GROUP BY ALL)""" + DISPOSE_SQL.replace("coil_id,", "coil_id AS grain_and_line,"))
def clean_coil_disposition(spark, d):
    """Every detection here is a false alarm: one clean coil per line, judged at two grains."""
    clean = t.frames(spark, d).where("frame_id % 4 = 0")
    per_tile = reuse(c.frame_results(clean, det(spark, d).where("conf >= 0.96 and frame_id % 4 = 0")))
    whole = per_tile.groupBy("coil_id", "domain").agg(
        F.max("defect_count").alias("defect_count"), F.max("has_flag_class").alias("has_flag_class"),
        F.max("severity_score").alias("severity_score"), F.max("total_ms").alias("total_ms"),
    ).withColumn("verdict", F.when(F.col("defect_count") > 0, "DEFECT").otherwise("PASS"))
    from ..functions.severity import severity_band

    cols = ["domain", "verdict", "defect_count", "has_flag_class", "severity_score", "severity_band", "total_ms"]
    both = per_tile.select(F.lit("tiles").alias("grain"), *cols).unionByName(
        whole.withColumn("severity_band", severity_band("severity_score", "defect_count")).select(F.lit("whole_frames").alias("grain"), *cols))
    both = both.withColumn("grain_and_line", F.concat_ws(":", "grain", "domain"))
    out = c.disposition(c.coil_stats(both, ["grain_and_line"]))
    return out.select("grain_and_line", "disposition", F.array_join("reasons", "; ").alias("reasons"), r6("defect_rate"), r6("p95_severity"))


@query("spearman_difficulty", "F12", cte("gt", "det", "matches") + """, k AS (SELECT g.frame_id, count(*) AS n, count(m.box_id)/count(*) AS rec, avg((x2-x1)*(y2-y1)) AS area FROM gt g LEFT JOIN matches m USING (frame_id, class_id, box_id) GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY area) + (count(*) OVER (PARTITION BY area) - 1)/2 AS ra, rank() OVER (ORDER BY rec) + (count(*) OVER (PARTITION BY rec) - 1)/2 AS rr FROM k)
SELECT count(*) AS n, round(corr(ra, rr), 6) AS rho FROM r""")
def spearman_difficulty(spark, d):
    _, gts, hits = matched(spark, d)
    f = m.flag_found(gts, hits)
    per = reuse(f.groupBy("frame_id").agg((F.sum(F.col("found").cast("int")) / F.count(F.lit(1))).alias("rec"),
                                          F.avg((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area")).withColumn("k", F.lit(0)))
    return st.spearman(per, ["k"], "area", "rec").select("n", r6("rho"))


@query("ordering_vs_published", "F12", cte("dim", "gt", "det", "matches") + """, k AS (SELECT class_id, count(m.box_id)/count(*) AS rec FROM gt g LEFT JOIN matches m USING (frame_id, class_id, box_id) GROUP BY 1)
SELECT class_name, round(rec, 6) AS recall, row_number() OVER (ORDER BY rec, class_name) - 1 AS our_rank,
 list_position(['crazing','rolled-in_scale','scratches','pitted_surface','inclusion','patches'], class_name) - 1 AS published_rank,
 row_number() OVER (ORDER BY rec, class_name) - list_position(['crazing','rolled-in_scale','scratches','pitted_surface','inclusion','patches'], class_name) AS shift
FROM k JOIN dim USING (class_id)""")
def ordering_vs_published(spark, d):
    _, gts, hits = matched(spark, d)
    f = m.flag_found(gts, hits).groupBy("class_id").agg((F.sum(F.col("found").cast("int")) / F.count(F.lit(1))).alias("recall"))
    f = f.join(F.broadcast(vocab.dim_class(spark).select("class_id", "class_name")), "class_id")  # one row per class
    pub = ["crazing", "rolled-in_scale", "scratches", "pitted_surface", "inclusion", "patches"]
    out = st.ordering_shift(f, "class_name", "recall", pub)
    return out.select("class_name", r6("recall"), big("our_rank"), big("published_rank"), big("shift"))
