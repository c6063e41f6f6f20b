"""Parsing of file names written by the existing exporters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

# Name formats of existing data sets.
EXPORT_MARK = "_jpg.rf."
CAMERA_STEM = r"^img_(\d+)_([A-Za-z0-9]+)_(\d+)$"
CROP_STEM = r"^sev_([0-9a-fA-F]+)_x(\d+)$"
FINISHES = ("2b", "ba", "hl", "mirror")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def class_of(stem, names=vocab.CLASSES) -> Column:
    """Class whose name, followed by an underscore, starts the stem; the longest one wins."""
    stem = _c(stem)
    expr = None
    for n in sorted(names, key=len, reverse=True):
        cond = stem.startswith(n + "_")
        expr = F.when(cond, n) if expr is None else expr.when(cond, n)
    return expr


def original_stem(name) -> Column:
    return F.substring_index(_c(name), EXPORT_MARK, 1)


def _match(stem, pattern: str, group: int) -> Column:
    v = F.regexp_extract(_c(stem), pattern, group)
    return F.when(v != "", v)


def sequence_id(stem) -> Column:
    """Line sequence behind a camera stem; the camera is not part of it."""
    return _match(stem, CAMERA_STEM, 2)


def source_frame(stem) -> Column:
    return _match(stem, CROP_STEM, 1)


def crop_offset(stem) -> Column:
    return _match(stem, CROP_STEM, 2).cast("int")


def family(stem) -> Column:
    """Stem without its last underscore-separated part."""
    return F.regexp_replace(_c(stem), r"_[^_]*$", "")


def finish_and_label(stem, finishes=FINISHES) -> dict[str, Column]:
    parts = F.split(_c(stem), "_")
    first = F.get(parts, F.lit(0))
    return {
        "finish": F.when(first.isin(*finishes), first).otherwise("other"),
        "label": F.coalesce(F.lower(F.get(parts, F.lit(1))), F.lit("unknown")),
    }
