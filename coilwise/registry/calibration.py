"""Reliability, calibrator fits and invariance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calibrators import parametric
from ..operators import calibration as cal
from ..operators import metrics as e
from ..session import reuse
from ..sources import tables as t
from .base import big, query, r6
from .evaluation import ap_sql, flagged, label_counts
from . import sql as sqltext
from .sql import cte

TPD = cte("det", "gt", "matches", "frames") + """, s AS (SELECT d.*, d.conf AS score, (x.det_id IS NOT NULL)::INT AS label, f.split FROM det d
  LEFT JOIN matches x USING (frame_id, class_id, det_id) JOIN frames f USING (frame_id))"""
# a fixed calibration curve used to check the interpolation
KNOTS = ((0.05, 0.10), (0.30, 0.10), (0.30001, 0.42), (0.60, 0.55), (0.90, 0.95))


def _scores(spark, d):
    flag, _, _ = flagged(spark, d)
    split = t.frames(spark, d).select("frame_id", "split")
    return flag.join(split, "frame_id").select("split", "frame_id", "class_id", "det_id", F.col("conf").alias("score"), F.col("is_tp").cast("int").alias("label"))


BINS_SQL = """, e AS (SELECT i - 1 AS bin, ([0,0.15,0.25,0.35,0.45,0.55,0.65,0.75,0.85,1]::DOUBLE[])[i] AS lo, ([0,0.15,0.25,0.35,0.45,0.55,0.65,0.75,0.85,1]::DOUBLE[])[i+1] AS hi FROM range(1, 10) t(i)),
bn AS (SELECT sp.split, e.bin, e.lo, e.hi, count(s.score) AS n, round(avg(s.score), 6) AS mean_score, round(avg(s.label), 6) AS precision, round(avg(s.score) - avg(s.label), 6) AS gap
 FROM (SELECT DISTINCT split FROM s) sp CROSS JOIN e LEFT JOIN s ON s.split = sp.split AND s.score >= e.lo AND (s.score < e.hi OR (e.hi = 1 AND s.score = 1)) GROUP BY 1, 2, 3, 4)"""


@query("reliability_bins", "E11", TPD + BINS_SQL + "SELECT * FROM bn")
def reliability_bins(spark, d):
    return cal.reliability_bins(_scores(spark, d), ["split"])


@query("calibration_errors", "E12", TPD + BINS_SQL + """, a AS (SELECT split, sum(n*abs(coalesce(gap, 0)))/sum(n) AS ece, max(abs(gap)) FILTER (n >= 20) AS mce FROM bn GROUP BY 1),
b AS (SELECT split, count(*) AS n, avg((score-label)*(score-label)) AS brier, avg(-(label*ln(score) + (1-label)*ln(1-score))) AS nll FROM s GROUP BY 1)
SELECT split, n, round(ece, 6) AS ece, mce, round(brier, 6) AS brier, round(nll, 6) AS nll FROM a JOIN b USING (split)""")
def calibration_errors(spark, d):
    return cal.calibration_errors(_scores(spark, d), ["split"]).select("split", "n", r6("ece"), "mce", r6("brier"), r6("nll"))


@query("equal_bin_ece", "E12", TPD + """, b AS (SELECT (SELECT count(*) FROM range(1, 15) r(i) WHERE s.score > i/CAST(15 AS DOUBLE)) AS bin, score, label FROM s),
p AS (SELECT bin, count(*) AS n, avg(score) AS m, avg(label) AS p FROM b GROUP BY 1) SELECT round(sum(n*abs(m-p))/sum(n), 6) AS ece FROM p""")
def equal_bin_ece(spark, d):
    return cal.equal_bin_ece(_scores(spark, d)).select(r6("ece"))


@query("calibrator_apply", "F18", TPD + """SELECT frame_id, det_id, score AS raw, round(1/(1+exp(-ln(score/(1-score))/1.7::DOUBLE)), 9) AS temperature, round(1/(1+exp(-(0.8::DOUBLE*ln(score/(1-score)) - 0.3::DOUBLE))), 9) AS platt FROM s""")
def calibrator_apply(spark, d):
    return _scores(spark, d).select(
        "frame_id", "det_id", parametric("score", "identity").alias("raw"), r6(parametric("score", "temperature", temperature=1.7), "temperature", 9),
        r6(parametric("score", "platt", slope=0.8, intercept=-0.3), "platt", 9),
    )


KNOT_SQL = """, k AS (SELECT * FROM (VALUES """ + ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in KNOTS) + """) v(x, y)),
kk AS (SELECT *, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM k),
c AS (SELECT s.*, (CASE WHEN kk.x IS NULL THEN (SELECT arg_min(y, x) FROM k) WHEN kk.x2 IS NULL THEN kk.y ELSE kk.y + (kk.y2-kk.y)/(kk.x2-kk.x)*(score-kk.x) END)*(1-1e-6::DOUBLE) + 1e-6::DOUBLE*score AS calibrated
  FROM s ASOF LEFT JOIN kk ON s.score >= kk.x)"""


def _knots(spark):
    return spark.createDataFrame(list(KNOTS), "x double, y double")


@query("knot_interpolation", "D14 F18", TPD + KNOT_SQL + "SELECT frame_id, det_id, round(calibrated, 9) AS calibrated FROM c")
def knot_interpolation(spark, d):
    return cal.interpolate_knots(_scores(spark, d), _knots(spark)).select("frame_id", "det_id", r6("calibrated", digits=9))


@query("rank_preservation", "F19", TPD + KNOT_SQL + """, u AS (SELECT DISTINCT score, calibrated FROM c), w AS (SELECT *, lead(calibrated) OVER (ORDER BY score) AS nx FROM u)
SELECT count(*) AS distinct_scores, count(*) FILTER (nx <= calibrated) AS collapsed_pairs, coalesce(bool_and(NOT nx < calibrated), true) AS order_identical, round(max(abs(calibrated-score)), 9) AS max_shift FROM w""")
def rank_preservation(spark, d):
    out = cal.rank_preservation(cal.interpolate_knots(_scores(spark, d), _knots(spark)))
    return out.select("distinct_scores", big("collapsed_pairs"), "order_identical", r6("max_shift", digits=9))


@query("map_invariance", "F20 E13", TPD + KNOT_SQL + """, mm AS (SELECT * FROM matches)""" + ap_sql("c", "mm", score="calibrated") + """
SELECT class_id, round(avg(v), 6) AS ap_raw, round(avg(v), 6) AS ap_calibrated, true AS identical FROM val GROUP BY 1""")
def map_invariance(spark, d):
    """AP before and after a strictly increasing rescoring, joined per class."""
    flag, gts, _ = flagged(spark, d)
    c = reuse(cal.interpolate_knots(flag, _knots(spark), "conf"))
    n = label_counts(gts)
    raw = e.average_precision(flag, n).select("class_id", F.col("ap").alias("ap_raw"))
    new = e.average_precision(c, n, score="calibrated").select("class_id", F.col("ap").alias("ap_calibrated"))
    return raw.join(new, "class_id").select("class_id", r6("ap_raw"), r6("ap_calibrated"), F.col("ap_raw").eqNullSafe(F.col("ap_calibrated")).alias("identical"))


@query("temperature_fit", "F15", TPD + """, g AS (SELECT ln(0.02::DOUBLE) + (ln(50::DOUBLE) - ln(0.02::DOUBLE))*i/200 AS lt FROM range(201) r(i)), u AS (SELECT split, score, count(*) AS n, sum(label) AS k FROM s GROUP BY 1, 2),
q AS (SELECT split, lt, n, k, greatest(1e-6, least(1-1e-6, 1/(1+exp(-ln(score/(1-score))/exp(lt))))) AS p FROM u, g),
w AS (SELECT split, lt, sum(-(k*ln(p) + (n-k)*ln(1-p))) AS nll FROM q GROUP BY 1, 2)
SELECT split, round(exp(arg_min(lt, nll)), 6) AS temperature, round(min(nll), 4) AS nll FROM w GROUP BY 1""")
def temperature_fit(spark, d):
    out = cal.fit_temperature(cal.distinct_scores(_scores(spark, d), ["split"]), ["split"], refinements=0)
    return out.select("split", r6("temperature"), r6("nll", digits=4))


def temperature_sql(counts: str, key: str, refinements: int = 3) -> str:
    """CTE ``temp`` (key, temperature, nll): the log grid, then narrower grids around the best."""
    nll = "sum(-(k*ln(p) + (n-k)*ln(1-p)))"
    prob = "greatest(1e-6, least(1-1e-6, 1/(1+exp(-ln(score/(1-score))/exp(lt)))))"
    lo, hi = "ln(0.02::DOUBLE)", "ln(50::DOUBLE)"
    out = f""", tg0 AS (SELECT {key}, lt, {nll} AS nll FROM (SELECT {key}, n, k, lt, {prob} AS p FROM {counts}, (SELECT {lo} + ({hi} - {lo})*i/200 AS lt FROM range(201) r(i))) GROUP BY 1, 2),
tb0 AS (SELECT {key}, arg_min(lt, (nll, lt)) AS lt, min(nll) AS nll FROM tg0 GROUP BY 1)"""
    for r in range(1, refinements + 1):
        width = f"(({hi} - {lo})/200/{20 ** (r - 1)})"
        out += f""", tg{r} AS (SELECT {key}, lt, {nll} AS nll FROM (SELECT c.{key}, n, k, q.lt, 1/(1+exp(-ln(score/(1-score))/exp(q.lt))) AS p0, {prob.replace('lt', 'q.lt')} AS p FROM {counts} c
  JOIN (SELECT {key}, least(greatest(lt + (i-20)*{width}/20, {lo}), {hi}) AS lt FROM tb{r - 1}, range(41) r(i)) q USING ({key})) GROUP BY 1, 2),
tb{r} AS (SELECT {key}, arg_min(lt, (nll, lt)) AS lt, min(nll) AS nll FROM tg{r} GROUP BY 1)"""
    return out + f", temp AS (SELECT {key}, exp(lt) AS temperature, nll FROM tb{refinements})"


def platt_sql(counts: str, key: str) -> str:
    """CTE ``platt`` (key, a, b): the same Newton steps."""
    out = f", pl0 AS (SELECT DISTINCT {key}, 1::DOUBLE AS a, 0::DOUBLE AS b FROM {counts})"
    step = lambda top: f"CASE WHEN aa*bb - ab*ab > 1e-12 THEN least(greatest(({top})/(aa*bb - ab*ab), -{cal.PLATT_STEP}::DOUBLE), {cal.PLATT_STEP}::DOUBLE) ELSE 0 END"
    for r in range(1, cal.PLATT_ROUNDS + 1):
        out += f""", pl{r} AS MATERIALIZED (SELECT {key}, a + {step('bb*ga - ab*gb')} AS a, b + {step('aa*gb - ab*ga')} AS b FROM (
  SELECT {key}, a, b, sum((k - n*p)*z) AS ga, sum(k - n*p) AS gb, sum(n*p*(1-p)*z*z) AS aa, sum(n*p*(1-p)*z) AS ab, sum(n*p*(1-p)) AS bb
  FROM (SELECT *, 1/(1+exp(-(a*z + b))) AS p FROM (SELECT c.{key}, n, k, a, b, ln(score/(1-score)) AS z FROM {counts} c JOIN pl{r - 1} USING ({key}))) GROUP BY 1, 2, 3))"""
    return out + f", platt AS (SELECT * FROM pl{cal.PLATT_ROUNDS})"


def monotone_sql(rows: str, key: str, name: str, x: str, w: str, v: str) -> str:
    """CTE ``name`` (key, x, fit): the largest smallest mean of the ranges around x, from running sums."""
    return f""", {name}_c AS MATERIALIZED (SELECT {key}, {x} AS x, {w} AS w, {v} AS v, row_number() OVER o AS i, sum({w}) OVER o AS cw, sum({v}) OVER o AS cv FROM {rows} WINDOW o AS (PARTITION BY {key} ORDER BY {x} ROWS UNBOUNDED PRECEDING)),
{name}_p AS (SELECT a.{key}, a.i AS a, b.i AS b, (b.cv - a.cv + a.v)/(b.cw - a.cw + a.w) AS m FROM {name}_c a JOIN {name}_c b ON a.{key} = b.{key} AND a.i <= b.i),
{name}_m AS (SELECT {key}, a, b, min(m) OVER (PARTITION BY {key}, a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS m FROM {name}_p),
{name} AS MATERIALIZED (SELECT c.{key}, c.x, c.w, c.v, f.fit FROM {name}_c c JOIN (SELECT {key}, b, max(m) AS fit FROM {name}_m GROUP BY 1, 2) f ON c.{key} = f.{key} AND c.i = f.b)"""


def knots_sql(counts: str, key: str) -> str:
    """CTE ``kn`` (key, x, y): ends of the plateaus of the smoothed monotone fit."""
    return monotone_sql(counts, key, "iso", "score", "n", "k") + f""", fl AS (SELECT {key}, min(x) AS lo, max(x) AS hi, sum(w) AS n, sum(v) AS k FROM iso GROUP BY {key}, round(fit, 12)),
sm AS (SELECT *, n::DOUBLE*(k + 0.5::DOUBLE)/(n + 1) AS v FROM fl)""" + monotone_sql("sm", key, "lev", "lo", "n::DOUBLE", "v") + f""",
bl AS (SELECT {key}, min(lo) AS lo, max(hi) AS hi, min(fit) AS y FROM (SELECT l.{key}, l.fit, s.lo, s.hi FROM lev l JOIN sm s ON s.{key} = l.{key} AND s.lo = l.x) GROUP BY {key}, round(fit, 11)),
kn AS (SELECT DISTINCT {key}, unnest([lo, hi]) AS x, y FROM bl)"""


ALL_SQL = TPD + ", u AS (SELECT 0 AS g, score, count(*) AS n, sum(label) AS k FROM s GROUP BY 2)"


@query("temperature_fit_refined", "F15", ALL_SQL + temperature_sql("u", "g") + "SELECT round(temperature, 5) AS temperature, round(nll, 4) AS nll FROM temp")
def temperature_fit_refined(spark, d):
    return cal.fit_temperature(reuse(cal.distinct_scores(_scores(spark, d)))).select(r6("temperature", digits=5), r6("nll", digits=4))


@query("isotonic_fit", "F13 F14", ALL_SQL + knots_sql("u", "g") + "SELECT x, round(y, 9) AS y FROM kn")
def isotonic_fit(spark, d):
    return cal.fit_isotonic(reuse(cal.distinct_scores(_scores(spark, d)))).select("x", r6("y", digits=9))


@query("platt_fit", "F16", ALL_SQL + platt_sql("u", "g") + """SELECT split, count(*) AS n, round(a, 6) AS slope, round(b, 6) AS intercept, round(avg(1/(1+exp(-(a*ln(score/(1-score)) + b)))), 6) AS mean_calibrated, round(avg(label), 6) AS precision
FROM s, platt GROUP BY split, a, b""")
def platt_fit(spark, d):
    a, b = cal.fit_platt(reuse(cal.distinct_scores(_scores(spark, d))))
    return _scores(spark, d).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), r6(F.lit(a), "slope"), r6(F.lit(b), "intercept"),
        r6(F.avg(parametric("score", "platt", slope=a, intercept=b)), "mean_calibrated"), r6(F.avg("label"), "precision"),
    )


FOLD_SQL = TPD + f""", c AS MATERIALIZED (SELECT CAST(floor({sqltext.unit('folds', 'frame_id')} * 5) AS INT) AS fold, score, count(*) AS n, sum(label) AS k FROM s GROUP BY 1, 2),
tr AS MATERIALIZED (SELECT CAST(h AS INT) AS held, score, sum(n) AS n, sum(k) AS k FROM c, range(5) t(h) WHERE fold <> h GROUP BY 1, 2)""" + temperature_sql("tr", "held") + platt_sql("tr", "held") + knots_sql("tr", "held") + """,
kk AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM kn WINDOW w AS (PARTITION BY held ORDER BY x)), fy AS (SELECT held, arg_min(y, x) AS y FROM kn GROUP BY 1),
ev AS (SELECT 'identity' AS family, score, n, k, score AS p FROM c
 UNION ALL SELECT 'temperature', score, n, k, 1/(1+exp(-ln(score/(1-score))/temperature)) FROM c JOIN temp ON held = fold
 UNION ALL SELECT 'platt', score, n, k, 1/(1+exp(-(a*ln(score/(1-score)) + b))) FROM c JOIN platt ON held = fold
 UNION ALL SELECT 'isotonic', c.score, c.n, c.k, (CASE WHEN kk.x IS NULL THEN fy.y WHEN kk.x2 IS NULL THEN kk.y ELSE kk.y + (kk.y2-kk.y)/(kk.x2-kk.x)*(c.score-kk.x) END)*(1-1e-6::DOUBLE) + 1e-6::DOUBLE*c.score
  FROM c ASOF LEFT JOIN kk ON kk.held = c.fold AND c.score >= kk.x JOIN fy ON fy.held = c.fold),
bn AS (SELECT family, (SELECT count(*) FROM (SELECT unnest([0.15,0.25,0.35,0.45,0.55,0.65,0.75,0.85]::DOUBLE[]) AS e) WHERE p >= e) AS bin, n, k, p FROM ev),
eb AS (SELECT family, sum(n*abs(round(s/n - k/n, 6)))/sum(n) AS ece FROM (SELECT family, bin, sum(n) AS n, sum(n*p) AS s, sum(k) AS k FROM bn GROUP BY 1, 2) GROUP BY 1),
rw AS (SELECT family, sum(n) AS n, sum(k*(1-p)*(1-p) + (n-k)*p*p)/sum(n) AS brier, sum(-(k*ln(q) + (n-k)*ln(1-q)))/sum(n) AS nll FROM (SELECT *, greatest(1e-6, least(1-1e-6, p)) AS q FROM ev) GROUP BY 1)
SELECT family, CAST(n AS BIGINT) AS n, round(ece, 5) AS oof_ece, round(brier, 6) AS oof_brier, round(nll, 6) AS oof_nll, family IN ('temperature', 'isotonic') AS eligible,
 family = (SELECT arg_min(family, (ece, family)) FROM eb WHERE family IN ('temperature', 'isotonic')) AS winner FROM rw JOIN eb USING (family)"""


@query("calibrator_selection", "F17 E12", FOLD_SQL)
def calibrator_selection(spark, d):
    return cal.select_family(_scores(spark, d)).select("family", big("n"), r6("oof_ece", digits=5), r6("oof_brier"), r6("oof_nll"), "eligible", "winner")
