"""Weights of clusters in resamples: their law, and sums and AUC against plain replication."""

import numpy as np
import pytest

from coilwise.operators import resampling as rs
from coilwise.operators import statistics as st


def test_weights_are_poisson_and_independent():
    w = np.array([rs.weights(c, 400, "x") for c in range(400)]).astype(float)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    assert abs((w == 0).mean() - np.exp(-1)) < 0.005 and abs((w == 3).mean() - np.exp(-1) / 6) < 0.003
    off = np.corrcoef(w)[np.triu_indices(400, 1)]
    assert abs(off.mean()) < 0.002 and off.std() < 0.055
    assert (rs.weights(7, 400, "x")[:123] == rs.weights(7, 123, "x")).all() and (rs.weights(7, 400, "y") != rs.weights(7, 400, "x")).any()


@pytest.mark.parametrize("parts", [1, 5])
def test_sums_and_auc_equal_replication(spark, monkeypatch, parts):
    monkeypatch.setattr(rs, "KNOWN", 3)
    rng = np.random.default_rng(5)
    rows = [(int(c), round(float(s), 1), int(rng.random() < s)) for c, s in zip(rng.integers(0, 12, 300), rng.random(300), strict=True)] + [(3, None, 1)]
    df = spark.createDataFrame(rows, "c bigint, score double, label int").repartition(parts)
    got = {r.b: r for r in rs.weighted_auc(df, "c", 30, "auc").collect()}
    for b in range(30):
        one, none = ([rs.weights(c, 30, f"auc{arm}")[b] for c in range(12)] for arm in (1, 0))
        pos = [s for c, s, y in rows if y == 1 and s is not None for _ in range(one[c])]
        neg = [s for c, s, y in rows if y == 0 for _ in range(none[c])]
        won = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
        assert (got[b].n_pos, got[b].n_neg) == (len(pos), len(neg))
        assert got[b].auc == (pytest.approx(won / len(pos) / len(neg)) if pos and neg else None)
    sums = {r.b: (r.label, r.c) for r in rs.weighted_sums(df, "c", ["label", "c"], 30, "s").collect()}
    assert sums == {b: (sum(y * int(rs.weights(c, 30, "s")[b]) for c, _, y in rows), sum(c * int(rs.weights(c, 30, "s")[b]) for c, _, _ in rows)) for b in range(30)}


def test_empty_tables_and_single_arms(spark):
    df = spark.createDataFrame([(1, 0.5, 1)], "c bigint, score double, label int")
    assert {r.auc for r in rs.weighted_auc(df, "c", 4, "x").collect()} == {None}
    assert rs.weighted_auc(df.limit(0), "c", 4, "x").count() == 0


def test_interval_covers_what_draws_with_replacement_cover(spark):
    rng = np.random.default_rng(2)
    data = [(i, int(rng.integers(0, 4)), 4) for i in range(200)]
    r = st.cluster_rate_interval(spark.createDataFrame(data, "c bigint, h bigint, s bigint"), "c", "h", "s").first()
    h = np.array([x[1] for x in data])
    plain = [h[rng.integers(0, 200, 200)].sum() / 800 for _ in range(4000)]
    assert r.lo == pytest.approx(np.quantile(plain, 0.025), abs=0.012) and r.hi == pytest.approx(np.quantile(plain, 0.975), abs=0.012)


def test_auc_draws_a_cluster_once_and_is_the_same_by_cells(spark, monkeypatch):
    """Sums by score give what cells in ranges give, with scores that fall on both sides of the limit."""
    rng = np.random.default_rng(5)
    rows = [(int(c), float(np.round(rng.random(), 2)), int(rng.random() < 0.4)) for c in range(60) for _ in range(4)]
    df = spark.createDataFrame(rows, "c bigint, score double, label int")
    by_score = sorted(rs.weighted_auc(df, "c", 30, "t").collect())
    monkeypatch.setattr(rs, "SCORES", 3)
    assert by_score == sorted(rs.weighted_auc(df, "c", 30, "t").collect()) and len(by_score) == 30


def test_lanes_are_poisson_and_independent():
    lanes = rs.Lanes(401)
    w = np.vstack([lanes.weights(np.arange(a, a + 20)).copy() for a in range(0, 400, 20)]).astype(float)
    assert w.shape == (400, 401) and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    for x in (w, w.T):
        off = np.corrcoef(x)[np.triu_indices(400, 1)]
        assert abs(off.mean()) < 0.002 and off.std() < 0.055
    assert (65536 - rs.LIMITS_16.astype(int)).sum() == 65536 and rs.BLOCK * len(rs.LIMITS_16) < 256
    assert (rs.Lanes(50).weights(np.array([-7])) == lanes.weights(np.array([-7]))[:, :50]).all()


@pytest.mark.parametrize("parts", [1, 7])
def test_weighted_precision_equals_lanes_with_the_weights_as_an_array(spark, parts):
    from pyspark.sql import functions as F

    from coilwise.operators.metrics import lane_precision

    rng = np.random.default_rng(3)
    n, lanes = 900, 23
    rows = [("AB"[i % 2], int(c), int(f), i, round(float(s), 2), bool(rng.random() < s)) for i, (c, f, s) in enumerate(zip(rng.integers(0, 3, n), rng.integers(0, 40, n), rng.random(n), strict=True))]
    rows += [("A", 4, 1, n + 1, 0.5, False), ("A", None, 1, n + 2, 0.5, True), ("B", 7, 1, n + 3, 0.5, True)]
    df = spark.createDataFrame(rows, "model string, class_id int, frame_id bigint, det_id bigint, conf double, is_tp boolean")
    labels = {0: 900, 1: 150, 2: 3, 4: 5, 5: 2}  # 2: more hits than labels, 5: no rows at all
    counts = {(m, c): rng.integers(0, 2 * g, lanes) for c, g in labels.items() for m in "AB"}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {tuple(r)[:3]: r.ap for r in rs.weighted_precision(df, counts, ("model", "class_id"), "conf", ("frame_id", "det_id"), "frame_id", "is_tp", lanes, "m").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    hashes = {r.id: r.h for r in spark.range(40).select("id", F.xxhash64(F.lit("m"), F.col("id").cast("string")).alias("h")).collect()}
    w = spark.createDataFrame([(f, rs.Lanes(lanes).weights(np.array([h]))[0].astype(int).tolist()) for f, h in hashes.items()], "frame_id bigint, w array<int>")
    base = spark.createDataFrame([(*key, b, int(v)) for key, vs in counts.items() for b, v in enumerate(vs)], "model string, class_id int, lane int, n_labels bigint")
    rows = df.join(w, "frame_id").withColumn("hit", F.col("is_tp").cast("int"))
    want = {(r.model, r.class_id, r.lane): r.ap for r in lane_precision(rows, base, ("model", "class_id"), "conf", ("frame_id", "det_id"), "hit", lanes, "w").collect()}
    assert set(got) == set(want) and len(got) == 10 * lanes
    assert all((got[k] is None) == (want[k] is None) for k in want) and any(v is None for v in want.values())
    assert max(abs(got[k] - want[k]) for k in want if want[k] is not None) < 1e-12


def test_weighted_counts(spark):
    df = spark.createDataFrame([(c, f, c + f % 2) for c in range(3) for f in range(70)], "c int, f bigint, n bigint").repartition(3)
    got = {(r.c, r.b): r.n for r in rs.weighted_counts(df, ["c"], "f", "n", 9, "m").collect()}
    from pyspark.sql import functions as F
    w = np.vstack([rs.Lanes(9).weights(np.array([r.h])) for r in spark.range(70).select(F.xxhash64(F.lit("m"), F.col("id").cast("string")).alias("h")).collect()]).astype(int)
    assert got == {(c, b): sum(int(w[f, b]) * (c + f % 2) for f in range(70)) for c in range(3) for b in range(9)}


def test_paired_bootstrap_is_registered_with_all_resamples(spark, sf, monkeypatch):
    from coilwise.registry import statistics as q

    asked, draws = [], st.paired_map_draws
    monkeypatch.setattr(st, "paired_map_draws", lambda flagged, gts, frames, resamples=2000: asked.append(resamples) or draws(flagged, gts, frames, 8))
    assert q.paired_map_bootstrap(spark, sf).count() == 1 and asked == [2000]
