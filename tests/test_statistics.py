import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from coilwise.operators import calibration as cal
from coilwise.operators import metrics as e
from coilwise.operators import scale as sc
from coilwise.operators import statistics as st


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1337)
    s = np.round(0.05 + 0.9 * rng.random(4000), 3)
    y = (rng.random(4000) < np.sqrt(s)).astype(int)
    return spark.createDataFrame(pd.DataFrame({"frame_id": np.arange(4000) // 3, "det_id": np.arange(4000), "score": s, "label": y})).cache()


def test_running_and_quantiles_with_a_hot_key(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": np.where(rng.random(5000) < 0.8, 1, rng.integers(2, 9, 5000)), "v": np.round(rng.normal(0, 50, 5000), 1), "i": np.arange(5000)})
    df = spark.createDataFrame(pdf)
    out = sc.running(df.withColumn("one", F.lit(1)), ["k"], ["v", "i"], {"c": ("one", "sum"), "m": ("i", "max")}).toPandas().sort_values(["k", "v", "i"])
    assert (out["c"] == out.groupby("k").cumcount() + 1).all()
    assert (out["m"] == out.groupby("k")["i"].cummax()).all()
    q = sc.exact_quantiles(df, ["k"], "v", {"a": 0.025, "b": 0.5, "c": 0.95}).toPandas().set_index("k").sort_index()
    for name, p in (("a", 0.025), ("b", 0.5), ("c", 0.95)):
        assert np.allclose(q[name], pdf.groupby("k")["v"].quantile(p))


def test_positions_with_one_score_for_most_rows(spark):
    pdf = pd.DataFrame({"k": 0, "s": [0.5] * 700 + [0.9] * 5 + [0.1] * 5, "i": np.random.default_rng(2).permutation(710), "one": 1})
    out = sc.ordered_positions(spark.createDataFrame(pdf), ["k"], "s", ["i"], {"rank": "one"}).toPandas()
    want = pdf.sort_values(["s", "i"], ascending=[False, True])["i"].tolist()
    assert out.sort_values("rank")["i"].tolist() == want and sorted(out["rank"]) == list(range(1, 711))


def numpy_ap(scores, tp, n):
    order = np.argsort(-scores, kind="stable")
    t, f = np.cumsum(tp[order]), np.cumsum(1 - tp[order])
    prec = np.maximum.accumulate((t / (t + f))[::-1])[::-1]
    return np.interp(np.linspace(0, 1, 101), t / n, prec, left=prec[0], right=0).mean()


@pytest.mark.parametrize("n_labels", [100, 2000, 2600, 4000])
def test_average_precision_equals_numpy(spark, scored, n_labels):
    pdf = scored.toPandas().sort_values("det_id")
    flag = scored.select(F.lit(0).alias("class_id"), "frame_id", "det_id", F.col("score").alias("conf"), (F.col("label") == 1).alias("is_tp"))
    n = max(n_labels, int(pdf["label"].sum()))
    got = e.average_precision(flag, spark.createDataFrame([(0, n)], "class_id int, n_labels bigint")).first()["ap"]
    assert got == pytest.approx(numpy_ap(pdf["score"].to_numpy(), pdf["label"].to_numpy(), n), abs=1e-9)


def test_weighted_ap_equals_replication(spark, scored):
    pdf = scored.limit(300).toPandas()
    pdf["w"] = np.arange(300) % 4
    rep = pdf.loc[pdf.index.repeat(pdf["w"])]
    rep = rep.sort_values(["score", "frame_id", "det_id"], ascending=[False, True, True])
    n = int(rep["label"].sum()) + 5
    df = spark.createDataFrame(pdf[pdf.w > 0]).select(F.lit(0).alias("class_id"), "frame_id", "det_id", F.col("score").alias("conf"), (F.col("label") == 1).alias("is_tp"), "w")
    got = e.average_precision(df, spark.createDataFrame([(0, n)], "class_id int, n_labels bigint"), weight="w").first()["ap"]
    assert got == pytest.approx(numpy_ap(rep["score"].to_numpy(), rep["label"].to_numpy(), n), abs=1e-9)


def test_ap_without_detections_or_labels(spark):
    none = spark.createDataFrame([], "class_id int, frame_id bigint, det_id bigint, conf double, is_tp boolean")
    out = {r.class_id: r.ap for r in e.average_precision(none, spark.createDataFrame([(0, 3), (1, 0)], "class_id int, n_labels bigint")).collect()}
    assert out == {0: 0.0, 1: None}


def test_auc_ties_and_missing_arm(spark):
    df = spark.createDataFrame([(0.0, 0), (0.0, 1), (0.5, 1), (0.5, 0)], "score double, label int")
    assert st.roc_auc(df).first()["auc"] == pytest.approx(0.5)
    assert st.roc_auc(df.where("label = 1")).first()["auc"] is None


def test_design_effect_and_interval(spark):
    flat = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0, 1) for i in range(300)], "c bigint, h int, s int")
    r = st.design_effect(flat, "h", "s").first()
    assert r["design_effect"] == pytest.approx(300 / 299, rel=1e-6)
    lumpy = spark.createDataFrame([(i, 6 if i % 3 == 0 else 0, 6) for i in range(120)], "c bigint, h int, s int").cache()
    r = st.cluster_rate_interval(lumpy, "c", "h", "s", 200).first()
    assert r["lo"] < r["rate"] < r["hi"] and r["design_effect"] > 5
    p = st.profile_bootstrap(lumpy, "h", "s", 400).toPandas()["rate"]
    wide = spark.createDataFrame([(i, i % 400, 400 + i % 700) for i in range(3000)], "c bigint, h int, s int")
    one, many = (st.profile_bootstrap(wide.repartition(k), "h", "s", 50).orderBy("b").collect() for k in (1, 7))
    assert one == many and len({x.rate for x in one}) > 40
    assert {x.rate for x in st.profile_bootstrap(wide.limit(0), "h", "s", 5).collect()} == {0.0}
    assert abs(p.mean() - r["rate"]) < 0.02 and abs((p.quantile(0.975) - p.quantile(0.025)) - (r["hi"] - r["lo"])) < 0.05


def test_poisson_fit_recovers_the_intensity(spark):
    lam = 4e-5
    cells = spark.createDataFrame([(0, float(s * s), int(round(5000 * (1 - np.exp(-lam * s * s)))), 5000) for s in (60, 80, 100, 120)], "k int, area double, hits bigint, trials bigint")
    fit = st.poisson_area_fit(cells, ["k"])
    assert fit.first()["lam"] == pytest.approx(lam, rel=2e-3)
    deff = spark.createDataFrame([(0, 1.0)], "k int, mean_deff double")
    g = st.goodness_of_fit(cells, fit, deff, ["k"]).first()
    assert g["poisson_supported"] is True and g["p_constant"] < 1e-6 and g["dof"] == 3
    flat = cells.withColumn("hits", F.lit(1000).cast("bigint"))
    assert st.goodness_of_fit(flat, st.poisson_area_fit(flat, ["k"]), deff, ["k"]).first()["poisson_supported"] is False


@pytest.mark.parametrize("x,dof,p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (9.487729, 4, 0.05), (15.086272, 5, 0.01)])
def test_chi_square_tail(x, dof, p):
    assert st._upper_tail(x, dof) == pytest.approx(p, rel=1e-5)


def test_paired_bootstrap_of_a_model_with_itself(spark, scored):
    rows = scored.where("frame_id < 60").select("frame_id", F.lit(0).alias("class_id"), "det_id", F.col("score").alias("conf"), (F.col("label") == 1).alias("is_tp"))
    both = rows.withColumn("model", F.lit("A")).unionByName(rows.withColumn("model", F.lit("B")))
    gts = rows.where("is_tp").select("frame_id", "class_id")
    draws = st.paired_map_draws(both, gts, rows.select("frame_id").distinct(), 4).cache()
    assert draws.count() == 8
    s = st.paired_summary(draws, "A", "B").first()
    assert abs(s["mean_difference"]) < 1e-12 and abs(s["lo"]) < 1e-12 and abs(s["hi"]) < 1e-12


def test_calibrators(spark, scored):
    counts = cal.distinct_scores(scored).cache()
    raw = cal.calibration_errors(scored).first()
    knots = cal.fit_isotonic(counts).orderBy("x").toPandas()
    assert (knots["y"].diff().dropna() >= -1e-12).all() and knots["y"].between(0.001, 0.999).all()
    iso = cal.interpolate_knots(scored, spark.createDataFrame(knots)).cache()
    assert cal.calibration_errors(iso, score="calibrated").first()["ece"] < raw["ece"] / 2
    rank = cal.rank_preservation(iso).first()
    assert rank["collapsed_pairs"] == 0 and rank["order_identical"]
    xs = scored.toPandas().sort_values("det_id")["score"]
    want = np.interp(xs.clip(knots.x.iloc[0], knots.x.iloc[-1]), knots.x, knots.y) * (1 - 1e-6) + 1e-6 * xs
    assert np.allclose(iso.toPandas().sort_values("det_id")["calibrated"], want, atol=1e-12)
    slope, _ = cal.fit_platt(counts)
    assert slope > 0
    t = cal.fit_temperature(counts).first()["temperature"]
    nll = lambda temp: float(np.mean([-(np.log(q) if y else np.log(1 - q)) for q, y in zip(1 / (1 + np.exp(-np.log(xs / (1 - xs)) / temp)), scored.toPandas().sort_values("det_id")["label"])]))
    assert nll(t) <= min(nll(t * 1.02), nll(t / 1.02))


def test_selection_prefers_isotonic(scored):
    out = {r.family: r for r in cal.select_family(scored).collect()}
    assert set(out) == {"identity", "temperature", "platt", "isotonic"}
    assert out["isotonic"].oof_ece < out["identity"].oof_ece and [f for f, r in out.items() if r.winner] == ["isotonic"]


def test_recommendation_rules(spark):
    pts = spark.createDataFrame([(0.1, 0.95, 0.5, 0.4), (0.2, 0.92, 0.15, 0.6), (0.3, 0.7, 0.05, 0.7)], "threshold double, detection_rate double, false_alarm_rate double, f1 double")
    r = e.recommend_threshold(pts).first()
    assert r["threshold"] == 0.1 and r["floor_met"] and r["at_edge"] and r["f1_threshold"] == 0.3
    low = e.recommend_threshold(pts, floor=0.99).first()
    assert not low["floor_met"] and low["threshold"] == 0.1
    assert e.recommend_threshold(pts, ratio_=3.0).first()["floor_binding"]


def test_lanes_of_one_ranking_equal_single_ones(spark):
    """Hits of several lanes, ranked together, give the AP that each has by itself; equal scores included."""
    rng = np.random.default_rng(12)
    rows = [(int(rng.integers(2)), i, 7 * i, float(np.round(rng.random(), 1)), int(rng.integers(8))) for i in range(300)]
    df = spark.createDataFrame(rows, "class_id int, frame_id bigint, det_id bigint, conf double, bits int").repartition(5)
    n = spark.createDataFrame([(0, 200), (1, 170)], "class_id int, n_labels bigint")
    got = {(r.class_id, r.lane): r.ap for r in e.lane_precision(df, n, ("class_id",), "conf", ("frame_id", "det_id"), "bits", 3).collect()}
    for lane in range(3):
        single = e.average_precision(df.withColumn("is_tp", F.col("bits").bitwiseAND(1 << lane) > 0), n)
        assert {(r.class_id, lane): pytest.approx(r.ap) for r in single.collect()} == {k: v for k, v in got.items() if k[1] == lane}


def test_contrasts_read_their_resamples_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(b, c, b / 10 + (c == "B")) for b in range(40) for c in "AB"], "b int, c string, v double").coalesce(1)
    got = st.contrasts(rows.mapInArrow(count, "b int, c string, v double"), "c", "v", "A").first()
    assert got["mean_delta"] == pytest.approx(1) and got["excludes_zero"] and seen.value == 80
