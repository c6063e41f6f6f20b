"""Box geometry as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def dbl(x) -> Column:
    """Literal or column as DOUBLE (plain decimal literals would become DECIMAL in SQL text)."""
    return F.lit(x).cast("double") if not isinstance(x, (Column, str)) else (
        F.col(x) if isinstance(x, str) else x).cast("double")


def _c(prefix: str, side: str) -> Column:
    return F.col(f"{prefix}{side}")


def area(prefix: str = "") -> Column:
    w = F.greatest(dbl(0), _c(prefix, "x2") - _c(prefix, "x1"))
    h = F.greatest(dbl(0), _c(prefix, "y2") - _c(prefix, "y1"))
    return w * h


def overlap_area(a: str, b: str) -> Column:
    w = F.least(_c(a, "x2"), _c(b, "x2")) - F.greatest(_c(a, "x1"), _c(b, "x1"))
    h = F.least(_c(a, "y2"), _c(b, "y2")) - F.greatest(_c(a, "y1"), _c(b, "y1"))
    return F.greatest(dbl(0), w) * F.greatest(dbl(0), h)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two prefixed boxes; 0 when the union is empty."""
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(dbl(0))


def overlaps(a: str, b: str) -> Column:
    """Strictly positive intersection, in a form the optimiser can evaluate cheaply."""
    return (
        (_c(a, "x1") < _c(b, "x2")) & (_c(b, "x1") < _c(a, "x2"))
        & (_c(a, "y1") < _c(b, "y2")) & (_c(b, "y1") < _c(a, "y2"))
        & (_c(a, "x1") < _c(a, "x2")) & (_c(a, "y1") < _c(a, "y2"))
        & (_c(b, "x1") < _c(b, "x2")) & (_c(b, "y1") < _c(b, "y2"))
    )


def contains(outer: str, inner: str) -> Column:
    return (
        (_c(inner, "x1") >= _c(outer, "x1")) & (_c(inner, "y1") >= _c(outer, "y1"))
        & (_c(inner, "x2") <= _c(outer, "x2")) & (_c(inner, "y2") <= _c(outer, "y2"))
    )


def clamp_box(width="width", height="height") -> dict[str, Column]:
    """Near corner clamped into the frame, far corner never ahead of the near one."""
    w, h = dbl(width), dbl(height)
    x1 = F.least(F.greatest(dbl(0), F.col("x1")), w)
    y1 = F.least(F.greatest(dbl(0), F.col("y1")), h)
    return {
        "x1": x1,
        "y1": y1,
        "x2": F.least(F.greatest(x1, F.col("x2")), w),
        "y2": F.least(F.greatest(y1, F.col("y2")), h),
    }


def corner_box_to_centre(x, y, bw, bh, width, height, min_side_px: float = 1.0) -> Column:
    """(x, y, w, h) pixels -> normalised centre box, clipped first; NULL when a side is too thin."""
    x, y, bw, bh, w, h = (dbl(v) for v in (x, y, bw, bh, width, height))
    left, top = F.greatest(dbl(0), x), F.greatest(dbl(0), y)
    right, bottom = F.least(w, x + bw), F.least(h, y + bh)
    cw, ch = right - left, bottom - top
    box = F.struct(
        ((left + right) / 2 / w).alias("cx"), ((top + bottom) / 2 / h).alias("cy"),
        (cw / w).alias("w"), (ch / h).alias("h"),
    )
    return F.when((cw >= min_side_px) & (ch >= min_side_px), box)


def centre_to_corner(cx, cy, bw, bh, width, height) -> dict[str, Column]:
    """Normalised centre box -> pixel corners."""
    cx, cy, bw, bh, w, h = (dbl(v) for v in (cx, cy, bw, bh, width, height))
    x1, y1 = (cx - bw / 2) * w, (cy - bh / 2) * h
    return {"x1": x1, "y1": y1, "x2": x1 + bw * w, "y2": y1 + bh * h}


def tiling_choice(width, height, imgsz, mode="auto", aspect: float = 3.0, downscale: float = 3.0) -> Column:
    """Whether a frame is inspected in tiles, and which rule decided it."""
    w, h, mode = dbl(width), dbl(height), mode if isinstance(mode, Column) else F.lit(mode)
    ratio = F.greatest(w, h) / F.greatest(dbl(1), F.least(w, h))
    shrink = F.greatest(w, h) / F.greatest(dbl(1), dbl(imgsz))
    wide, large = ratio >= aspect, shrink >= downscale
    trigger = (
        F.when(mode == "always", "manual")
        .when(mode == "never", F.when(wide | large, "manual").otherwise("none"))
        .when(wide, "aspect").when(large, "downscale").otherwise("none")
    )
    tiled = (mode == "always") | ((mode != "never") & (wide | large))
    return F.struct(tiled.alias("tiled"), trigger.alias("trigger"), ratio.alias("aspect"), shrink.alias("downscale"))
