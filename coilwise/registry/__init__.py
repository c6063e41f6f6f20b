"""Named queries over the test tables, each with the SQL that has to give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("coil", "evaluation", "statistics", "calibration", "tiling", "data", "io_and_streams", "files")


def load():
    """Import every query module once and return (queries, sql, inventory ids)."""
    from . import base

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return base.QUERIES, base.SQL, base.COVERS
