"""Severity scoring as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .geometry import dbl


def class_name(class_id="class_id", names=vocab.CLASSES) -> Column:
    """Name of a class id; ids outside the vocabulary keep a visible fallback name."""
    cid = F.col(class_id) if isinstance(class_id, str) else class_id
    table = F.array(*[F.lit(n) for n in names])
    return (
        F.when(cid == -1, vocab.NO_LABEL_NAME)
        .when((cid >= 0) & (cid < len(names)), F.get(table, cid.cast("int")))
        .when(cid.isNotNull(), F.concat(F.lit("class_"), cid.cast("string")))
    )


def tier_anchor(name="class_name") -> Column:
    """Score anchor of a class through its tier."""
    name = F.col(name) if isinstance(name, str) else name
    expr = None
    for tier in vocab.BANDS:
        members = [c for c, t in vocab.TIERS.items() if t == tier]
        if members and tier != vocab.UNKNOWN_TIER:
            cond = name.isin(members)
            score = dbl(vocab.TIER_SCORE[tier])
            expr = F.when(cond, score) if expr is None else expr.when(cond, score)
    return expr.otherwise(dbl(vocab.TIER_SCORE[vocab.UNKNOWN_TIER]))


def detection_score(name="class_name", conf="conf", area_frac="area_frac") -> Column:
    """0-100 score: tier anchor, halved for marginal hits, raised for large areas."""
    conf, frac = dbl(conf), dbl(area_frac)
    sure = F.least(F.greatest(conf, dbl(0)), dbl(1))
    grown = F.least(dbl(1), F.greatest(dbl(0), frac) / dbl(vocab.AREA_SATURATION))
    raw = tier_anchor(name) * (dbl(0.5) + dbl(0.5) * sure) * (dbl(1) + dbl(vocab.AREA_GAIN) * grown)
    return F.least(F.greatest(raw, dbl(0)), dbl(100))


def severity_band(score="score", n_boxes=None) -> Column:
    """Reporting band; with a box count, frames without boxes are ``clean``."""
    s = F.col(score) if isinstance(score, str) else score
    expr = F.when(F.lit(False), "")
    if n_boxes is not None:
        n = F.col(n_boxes) if isinstance(n_boxes, str) else n_boxes
        expr = expr.when(n == 0, "clean")
    for cut, band in zip(vocab.BAND_CUTS, vocab.BANDS):
        expr = expr.when(s < dbl(cut), band)
    return expr.otherwise(vocab.BANDS[-1])


def band_order(band="band") -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in vocab.BANDS]), F.col(band) if isinstance(band, str) else band)


def fps(ms="total_ms") -> Column:
    ms = dbl(ms)
    return F.when(ms > 0, dbl(1000) / ms).otherwise(dbl(0))


def physical_size(mm_per_px=0.5) -> dict[str, Column]:
    """Box size and place in millimetres; the scale is the caller's assumption."""
    s = dbl(mm_per_px)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return {
        "length_mm": F.greatest(w, h) * s,
        "width_mm": F.least(w, h) * s,
        "across_strip_mm": (F.col("x1") + F.col("x2")) / 2 * s,
    }


def network_input_size(size, magnification, stride: int = 32) -> Column:
    """Input size showing a crop at deployment scale, a multiple of the stride (half-even)."""
    steps = F.bround(dbl(size) * dbl(magnification) / dbl(stride), 0)
    return (F.greatest(dbl(1), steps) * stride).cast("int")


def padded_input_size(imgsz, stride: int = 32) -> Column:
    """Size actually fed to the network when the letterbox adds half a stride."""
    return (F.ceil(dbl(imgsz) / stride + dbl(0.5)) * stride).cast("int")
