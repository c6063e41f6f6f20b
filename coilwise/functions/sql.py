"""The scalar functions as Spark SQL functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import vocab
from .stats import Z95

_IW = "greatest(0D, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0D, least(ay2, by2) - greatest(ay1, by1))"
_UNION = f"(greatest(0D, ax2-ax1)*greatest(0D, ay2-ay1) + greatest(0D, bx2-bx1)*greatest(0D, by2-by1) - {_IW})"


def definitions() -> dict[str, str]:
    """Name -> CREATE statement; every body is an expression the optimiser inlines."""
    anchors = " ".join(f"WHEN '{c}' THEN {vocab.TIER_SCORE[t]}D" for c, t in vocab.TIERS.items())
    bands = " ".join(f"WHEN score < {cut}D THEN '{band}'" for cut, band in zip(vocab.BAND_CUTS, vocab.BANDS))
    head = "CREATE OR REPLACE TEMPORARY FUNCTION "
    wil = "((k/n) + {z}*{z}/(2*n) {s} {z}*sqrt((k/n)*(1-k/n)/n + {z}*{z}/(4*n*n))) / (1 + {z}*{z}/n)"
    z = f"{Z95}D"
    return {
        "severity_score": f"{head}severity_score(class_name STRING, conf DOUBLE, area_frac DOUBLE) RETURNS DOUBLE RETURN "
                          f"least(greatest(CASE class_name {anchors} ELSE {vocab.TIER_SCORE[vocab.UNKNOWN_TIER]}D END * (0.5D + 0.5D*least(greatest(conf, 0D), 1D)) "
                          f"* (1D + {vocab.AREA_GAIN}D*least(1D, greatest(0D, area_frac)/{vocab.AREA_SATURATION}D)), 0D), 100D)",
        "severity_band": f"{head}severity_band(score DOUBLE) RETURNS STRING RETURN CASE {bands} ELSE '{vocab.BANDS[-1]}' END",
        "box_iou": f"{head}box_iou(ax1 DOUBLE, ay1 DOUBLE, ax2 DOUBLE, ay2 DOUBLE, bx1 DOUBLE, by1 DOUBLE, bx2 DOUBLE, by2 DOUBLE) RETURNS DOUBLE RETURN "
                   f"CASE WHEN {_UNION} > 0 THEN {_IW} / {_UNION} ELSE 0D END",
        "wilson_lo": f"{head}wilson_lo(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN greatest(0D, {wil.format(z=z, s='-')}) ELSE 0D END",
        "wilson_hi": f"{head}wilson_hi(k DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN CASE WHEN n > 0 THEN least(1D, {wil.format(z=z, s='+')}) ELSE 0D END",
        "unit_hash": f"{head}unit_hash(seed STRING, id STRING) RETURNS DOUBLE RETURN cast(conv(substr(md5(concat(seed, ':', id)), 1, 15), 16, 10) as bigint) / {float(1 << 60)!r}D",
        "calibrate_temperature": f"{head}calibrate_temperature(s DOUBLE, t DOUBLE) RETURNS DOUBLE RETURN "
                                 "1D/(1D + exp(-ln(least(greatest(s, 1e-6D), 0.999999D)/(1D - least(greatest(s, 1e-6D), 0.999999D)))/t))",
    }


def register(spark: SparkSession) -> list[str]:
    defs = definitions()
    for text in defs.values():
        spark.sql(text)
    return list(defs)
