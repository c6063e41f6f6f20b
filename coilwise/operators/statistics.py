"""ROC AUC, cluster bootstraps, contrasts, area fits and goodness of fit."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import dbl
from ..functions.hashing import unit_hash
from ..functions.stats import ratio
from .resampling import weighted_auc, weighted_counts, weighted_precision, weighted_sums
from ..session import reuse
from .scale import exact_quantiles, running

# ---------------------------------------------------------------- AUC


def roc_auc(scores: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """Tie-corrected AUC per key: P(pos > neg) + P(equal) / 2; NULL when an arm is empty.

    Rows are first combined to distinct scores (map-side), so ties, which dominate tile scores, cost
    one row; the rest is a bucketed running sum of negatives.
    """
    keys = list(keys)
    w = F.col(weight) if weight else F.lit(1)
    by = scores.groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("neg")
    )
    cum = running(by, keys, [score], {"below": ("neg", "sum"), "p": ("pos", "sum")})
    won = F.sum(dbl("pos") * (F.col("below") - F.col("neg") / 2))
    n_p, n_n = F.max("p_total"), F.max("below_total")
    return cum.groupBy(*keys).agg(
        n_p.alias("n_pos"), n_n.alias("n_neg"), ratio(won, dbl(n_p) * dbl(n_n), empty=None).alias("auc")
    )


def stratified_auc(scores: DataFrame, stratum: str, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Per-stratum AUC recombined with n_pos * n_neg weights."""
    per = roc_auc(scores, [*keys, stratum], score, label)
    w = dbl("n_pos") * dbl("n_neg")
    return per.groupBy(*keys).agg(
        ratio(F.sum(F.when(F.col("auc").isNotNull(), F.col("auc") * w)), F.sum(F.when(F.col("auc").isNotNull(), w)), empty=None).alias("auc_stratified")
    )


# ---------------------------------------------------------------- cluster bootstrap

def cluster_index(clusters: DataFrame, cluster: str, keys: Sequence[str] = ()) -> DataFrame:
    """Number the clusters 0..n-1 in the order of their id (bucketed, no single-task window)."""
    src = clusters.withColumn("__one", F.lit(1))
    return running(src, list(keys), [cluster], {"__pos": ("__one", "sum")}).withColumn("idx", F.col("__pos") - 1).drop("__one", "__pos", "__pos_total")


def draws(spark, n: int, resamples: int, seed: str) -> DataFrame:
    """(b, idx): n draws with replacement from 0..n-1 for each resample.

    A draw is a hash of (seed, b, slot). The rows are generated on the executors.
    """
    ids = spark.range(int(n) * int(resamples))
    return ids.select(F.floor(F.col("id") / n).alias("b"), (F.col("id") % n).alias("slot")).select(
        "b", F.floor(unit_hash(seed, "b", "slot") * n).alias("idx")
    )


def draw_weights(spark, n: int, resamples: int, seed: str) -> DataFrame:
    """(b, idx, w): how often each cluster is drawn; combined map-side before any join."""
    return draws(spark, n, resamples, seed).groupBy("b", "idx").agg(F.count(F.lit(1)).alias("w"))


def bootstrap_sums(clusters: DataFrame, cluster: str, sums: Sequence[str], resamples: int, seed: str) -> DataFrame:
    """Resampled sums of cluster aggregates, by Poisson weights of the clusters (``resampling``)."""
    return weighted_sums(clusters, cluster, sums, resamples, seed)


def cluster_rate_interval(clusters: DataFrame, cluster: str, hits: str, size: str, resamples: int = 2000, seed: str = "boot") -> DataFrame:
    """Pooled rate with a cluster-bootstrap 95 % interval, design effect and effective size."""
    sums = bootstrap_sums(clusters, cluster, [hits, size], resamples, seed)
    rates = sums.withColumn("rate", F.col(hits) / F.greatest(dbl(size), dbl(1)))
    ci = exact_quantiles(rates.withColumn("__k", F.lit(0)), ["__k"], "rate", {"lo": 0.025, "hi": 0.975}).drop("__k")
    return design_effect(clusters, hits, size).join(F.broadcast(ci))  # one row each


def design_effect(clusters: DataFrame, hits: str, size: str, keys: Sequence[str] = ()) -> DataFrame:
    """Ratio of clustered to binomial variance from plain sums; 1 when undefined."""
    h, s = dbl(hits), dbl(size)
    a = clusters.where(F.col(size) > 0).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_clusters"), F.sum(size).alias("n"), F.sum(hits).alias("hits"),
        F.sum(h * h).alias("__hh"), F.sum(h * s).alias("__hs"), F.sum(s * s).alias("__ss"),
    )
    g, n = dbl("n_clusters"), dbl("n")
    p = F.col("hits") / n
    srs = p * (1 - p) / n
    between = (F.col("__hh") - 2 * p * F.col("__hs") + p * p * F.col("__ss")) * g / ((g - 1) * n * n)
    deff = F.when((g < 2) | (srs <= 0), dbl(1)).otherwise(between / srs)
    return a.withColumns({"rate": p, "design_effect": deff}).withColumn("effective_n", F.col("n") / F.col("design_effect")).drop("__hh", "__hs", "__ss")


def profile_bootstrap(clusters: DataFrame, hits: str, size: str, resamples: int = 2000, seed: int = 1) -> DataFrame:
    """Resampled rates for very many clusters, from the distinct (hits, size) profiles.

    Every cluster weighs Poisson(1) in a resample, so the m clusters of one profile weigh Poisson(m)
    together. Weights are drawn beside the profile from (seed, hits, size) and summed per task before
    they are shuffled: no draw table, and the result does not depend on the partitioning. Null hits or
    sizes count as 0; hits and sizes are whole numbers of at least 0. An empty table gives rates of 0.
    """
    prof = clusters.groupBy(F.coalesce(F.col(hits).cast("bigint"), F.lit(0)).alias("h"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("s")).agg(F.count(F.lit(1)).alias("m"))

    def weigh(batches):
        h_sum, s_sum = np.zeros(resamples, np.int64), np.zeros(resamples, np.int64)
        for pdf in batches:
            for h, s, m in pdf.itertuples(index=False):
                w = np.random.default_rng([seed, h, s]).poisson(m, resamples)
                h_sum += w * h
                s_sum += w * s
        yield pd.DataFrame({"b": np.arange(resamples), "h": h_sum, "s": s_sum})

    sums = prof.mapInPandas(weigh, "b bigint, h bigint, s bigint").groupBy("b").agg(F.sum("h").alias("h"), F.sum("s").alias("s"))
    rate = F.coalesce(F.col("h") / F.greatest(dbl("s"), dbl(1)), F.lit(0.0))
    return clusters.sparkSession.range(resamples).withColumnRenamed("id", "b").join(sums, "b", "left").select("b", rate.alias("rate"))


def cluster_auc_draws(scores: DataFrame, cluster: str, resamples: int = 2000, seed: str = "auc", score: str = "score", label: str = "label") -> DataFrame:
    """AUC of each resample, both arms weighed by cluster independently."""
    return weighted_auc(scores, cluster, resamples, seed, score, label)


def cluster_auc_interval(scores: DataFrame, cluster: str, resamples: int = 2000, seed: str = "auc") -> DataFrame:
    d = cluster_auc_draws(scores, cluster, resamples, seed).withColumn("__k", F.lit(0))
    return exact_quantiles(d, ["__k"], "auc", {"lo": 0.025, "hi": 0.975}).drop("__k")


# ---------------------------------------------------------------- paired comparison of models

def paired_map_draws(flagged: DataFrame, gts: DataFrame, frames: DataFrame, resamples: int = 2000, seed: str = "map") -> DataFrame:
    """mAP of every model on the same resamples of frames: (b, model, mean_ap).

    ``flagged`` holds model, frame_id, class_id, det_id, conf, is_tp for all models together. A frame weighs Poisson(1)
    in a resample, whichever model or label is counted, and its weights are drawn where its rows lie (``resampling``).
    """
    on = frames.select("frame_id").distinct()
    labels = gts.groupBy("frame_id", "class_id").agg(F.count(F.lit(1)).alias("g")).join(on, "frame_id", "left_semi")
    counts: dict[tuple, np.ndarray] = {}
    for row in weighted_counts(labels, ["class_id"], "frame_id", "g", resamples, seed).toLocalIterator():
        counts.setdefault(row["class_id"], np.zeros(resamples, np.int64))[row["b"]] = row["n"]
    models = [r[0] for r in flagged.select("model").distinct().collect()]  # a handful of model names
    rows = flagged.join(on, "frame_id", "left_semi")
    ap = weighted_precision(rows, {(m, c): n for m in models for c, n in counts.items()}, ("model", "class_id"), "conf", ("frame_id", "det_id"), "frame_id", "is_tp", resamples, seed)
    return ap.groupBy("b", "model").agg(F.avg("ap").alias("mean_ap"))


def paired_summary(samples: DataFrame, a: str, b: str, value: str = "mean_ap") -> DataFrame:
    """Difference a - b over shared resamples: interval, win shares, gain from pairing."""
    wide = samples.groupBy("b").agg(
        F.max(F.when(F.col("model") == a, F.col(value))).alias("va"), F.max(F.when(F.col("model") == b, F.col(value))).alias("vb")
    ).withColumn("delta", F.col("va") - F.col("vb"))
    unpaired = F.sqrt(F.pow(F.stddev_samp("va"), 2) + F.pow(F.stddev_samp("vb"), 2))
    base = wide.agg(
        F.avg("delta").alias("mean_difference"), F.stddev_samp("delta").alias("std_difference"),
        F.avg((F.col("delta") > 0).cast("double")).alias("share_a_wins"), F.avg((F.col("delta") < 0).cast("double")).alias("share_b_wins"),
        unpaired.alias("unpaired_std"), (unpaired / F.greatest(F.stddev_samp("delta"), dbl(1e-12))).alias("variance_reduction"),
    )
    ci = exact_quantiles(wide.withColumn("__k", F.lit(0)), ["__k"], "delta", {"lo": 0.025, "hi": 0.975}).drop("__k")
    out = base.join(F.broadcast(ci))  # one row each
    return out.withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


def contrasts(samples: DataFrame, config: str, value: str, reference: str, alpha: float = 0.05, family: int = 1) -> DataFrame:
    """Interval of each configuration minus the reference over shared resamples.

    ``alpha`` is divided by the number of contrasts in the family.
    """
    samples = reuse(samples)  # both sides of the join, the mean and the quantiles read them
    ref = samples.where(F.col(config) == reference).select("b", F.col(value).alias("__ref"))
    d = samples.where(F.col(config) != reference).join(ref, "b").withColumn("delta", F.col(value) - F.col("__ref"))
    a = alpha / family
    q = exact_quantiles(d, [config], "delta", {"lo": a / 2, "hi": 1 - a / 2})
    mean = d.groupBy(config).agg(F.avg("delta").alias("mean_delta"))
    return mean.join(q, config).withColumn("excludes_zero", (F.col("lo") > 0) | (F.col("hi") < 0))


# ---------------------------------------------------------------- area models

HALVINGS = 60


def _slope(cells: Column, lam: Column) -> Column:
    """Sign-giving slope of Pearson's statistic in the intensity.

    A cell of rate r has the statistic n (r - p)^2 / (p q) with q = exp(-lam area) and p = 1 - q, and the
    slope n area (p - r) (p + r - 2 p r) / (p^2 q): it falls while p is under r and rises beyond.
    """
    def term(c: Column) -> Column:
        q = F.exp(-lam * c["area"])
        p, r = 1 - q, c["rate"]
        return c["n"] * c["area"] * (p - r) * (p + r - 2 * p * r) / (p * p * q)
    return F.aggregate(cells, dbl(0), lambda acc, c: acc + term(c))


def poisson_area_fit(cells: DataFrame, keys: Sequence[str], area: str = "area", hits: str = "hits", trials: str = "trials") -> DataFrame:
    """Fit rate = 1 - exp(-lambda * area) by minimum chi-square: where the slope of the statistic changes its sign.

    Every cell by itself wants an intensity of its own, and the slope is negative below all of them and
    positive above, so the logarithm of the bracket is halved between the smallest and the largest (with half a
    hit and half a miss added, so that both are finite). A key has one cell per crop scale, a short
    configured list. No hits at all give the intensity 0; ``r2`` and ``n_unsaturated`` are of the cells with misses.
    """
    keys = list(keys)
    k, n = dbl(hits), dbl(trials)
    own = -F.log1p(-(k + 0.5) / (n + 1)) / dbl(area)
    rows = cells.where((F.col(trials) > 0) & (F.col(area) > 0)).select(*keys, F.struct(dbl(area).alias("area"), (k / n).alias("rate"), n.alias("n")).alias("cell"), own.alias("own"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("cell")).alias("cells"), F.log(F.min("own") / 2).alias("__lo"), F.log(F.max("own") * 2).alias("__hi"))

    def halved(bracket: Column, _: Column) -> Column:
        middle = (bracket["lo"] + bracket["hi"]) / 2
        rising = _slope(F.col("cells"), F.exp(middle)) > 0
        return F.struct(F.when(rising, bracket["lo"]).otherwise(middle).alias("lo"), F.when(rising, middle).otherwise(bracket["hi"]).alias("hi"))

    at = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(F.col("__lo").alias("lo"), F.col("__hi").alias("hi")), halved)
    none = ~F.exists("cells", lambda c: c["rate"] > 0)
    g = g.select(*keys, "cells", F.when(none, dbl(0)).otherwise(F.exp((at["lo"] + at["hi"]) / 2)).alias("lam"), F.array_max(F.transform("cells", lambda c: c["rate"])).alias("observed_max"))
    y = -F.log1p(-F.col("c.rate"))
    off = y - F.col("lam") * F.col("c.area")
    m, spread = F.count("y"), F.sum(F.col("y") * F.col("y")) - F.sum("y") * F.sum("y") / F.count("y")
    quality = g.select(*keys, "lam", F.explode("cells").alias("c")).where("c.rate < 1").select(*keys, y.alias("y"), off.alias("off")).groupBy(*keys).agg(
        m.cast("int").alias("n_unsaturated"), F.when((m >= 2) & (spread > 1e-15), 1 - F.sum(F.col("off") * F.col("off")) / spread).alias("r2"))
    return g.join(quality, keys, "left").withColumn("n_unsaturated", F.coalesce("n_unsaturated", F.lit(0)))


def extrapolate_to_frame(fit: DataFrame, frame_area: float) -> DataFrame:
    """Frame-level alarm rate from the area fit, never below the largest observed rate."""
    fitted = 1 - F.exp(-F.col("lam") * dbl(frame_area))
    spent = F.col("n_unsaturated") == 0
    return fit.withColumns({
        "frame_rate": F.when(spent, F.col("observed_max")).otherwise(F.greatest(fitted, F.col("observed_max"))),
        "intensity_per_10k_px": F.when(~spent, F.col("lam") * 10000),
        "note": F.when(spent, "saturated").when(fitted >= F.col("observed_max"), "fit").otherwise("floored"),
    })


def _upper_tail(x: float, dof: int) -> float:
    """Chi-square survival function for whole degrees of freedom (closed-form series)."""
    half = x / 2
    if dof % 2 == 0:
        term, total = 1.0, 1.0
        for i in range(1, dof // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total, term = 0.0, math.sqrt(half) / math.gamma(1.5)
    for i in range((dof - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return math.erfc(math.sqrt(half)) + math.exp(-half) * total


def chi_square_p_value(stat: Column, dof: Column) -> Column:
    """p-value column; Spark has no error function, so this one scalar is computed in pandas."""
    @F.pandas_udf(T.DoubleType())
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else _upper_tail(float(a), int(b)) for a, b in zip(x, k)], dtype="float64")
    return tail(stat, dof)


def goodness_of_fit(cells: DataFrame, fit: DataFrame, deff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Constant-rate against Poisson-in-area: chi-squares, design-corrected p-values and a verdict.

    ``cells``: keys, area, hits, trials; ``fit`` from ``poisson_area_fit``; ``deff``: keys, mean_deff.
    """
    keys = list(keys)
    k, n = dbl("hits"), dbl("trials")
    pooled = cells.groupBy(*keys).agg((F.sum("hits") / F.sum("trials")).alias("pooled"))
    c = cells.join(pooled, keys).join(fit.select(*keys, "lam"), keys)

    def stat(p: Column):
        p = F.least(F.greatest(p, dbl(1e-12)), dbl(1 - 1e-12))
        hit, miss = n * p, n * (1 - p)
        return F.sum(F.pow(k - hit, 2) / hit + F.pow((n - k) - miss, 2) / miss), F.min(F.least(hit, miss)) >= 5

    chi_c, ok_c = stat(F.col("pooled"))
    chi_p, ok_p = stat(1 - F.exp(-F.col("lam") * dbl("area")))
    out = c.groupBy(*keys).agg(
        chi_c.alias("chi2_constant"), chi_p.alias("chi2_poisson"), ok_c.alias("__oc"), ok_p.alias("__op"), (F.count(F.lit(1)) - 1).alias("dof")
    ).join(deff, keys)
    for kind, ok in (("constant", "__oc"), ("poisson", "__op")):
        fixed = F.col(f"chi2_{kind}") / F.greatest(F.col("mean_deff"), dbl(1e-9))
        valid = F.col(ok) & (F.col("dof") > 0)
        out = out.withColumns({f"chi2_{kind}_corrected": fixed, f"valid_{kind}": valid})
        out = out.withColumn(f"p_{kind}", F.when(valid, chi_square_p_value(fixed, F.col("dof"))))
    support = (F.col("p_poisson") >= 0.05) & (F.col("chi2_poisson") <= F.col("chi2_constant"))
    return out.withColumn("poisson_supported", F.when(F.col("valid_poisson"), support)).drop("__oc", "__op")


def independence_prediction(groups: DataFrame, hits: str, size: str, keys: Sequence[str] = ()) -> DataFrame:
    """Image-level alarm rate, measured and as predicted if patches alarmed independently."""
    keys = list(keys)
    pooled = groups.groupBy(*keys).agg((F.sum(hits) / F.sum(size)).alias("pooled"))
    g = groups.join(pooled, keys) if keys else groups.join(F.broadcast(pooled))  # one row
    return g.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_images"), F.avg((F.col(hits) > 0).cast("double")).alias("image_rate"),
        F.avg(1 - F.pow(1 - F.col("pooled"), dbl(size))).alias("independent_rate"),
    )


# ---------------------------------------------------------------- rank correlation

def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Ranks with ties averaged, by distinct value."""
    keys = list(keys)
    cnt = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cum = running(cnt, keys, [value], {"__c": ("__n", "sum")})
    r = cum.select(*keys, value, (F.col("__c") - (F.col("__n") - 1) / 2).alias(name))
    return df.join(r, [*keys, value])


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    ranked = average_ranks(average_ranks(df, keys, x, "__rx"), keys, y, "__ry")
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("__rx", "__ry").alias("rho"))


def ordering_shift(values: DataFrame, item: str, value: str, published: Sequence[str]) -> DataFrame:
    """Rank of each class (smallest value first) beside its published rank."""
    ours = values.select(item, value)
    cum = running(ours.withColumn("__one", F.lit(1)).withColumn("__k", F.lit(0)), ["__k"], [value, item], {"__r": ("__one", "sum")})
    pub = values.sparkSession.createDataFrame([(n, i) for i, n in enumerate(published)], f"{item} string, published_rank int")
    out = cum.select(item, value, (F.col("__r") - 1).alias("our_rank")).join(F.broadcast(pub), item)  # a handful of classes
    return out.withColumn("shift", F.col("our_rank") - F.col("published_rank"))
