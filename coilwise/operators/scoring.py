"""Plugging in a batch scoring function, and the tiled inspection job around it."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import tiling_choice
from ..session import by_frame, reuse
from .coil import frame_results
from .matching import nms
from .tiling import sliding_tiles

# what a scorer returns per input row; row_ix points into the chunk it was given
BOXES = "class_id int, conf double, x1 double, y1 double, x2 double, y2 double"
Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_batches(items: DataFrame, scorer: Scorer, id_cols: Sequence[str], size_cols: Sequence[str] = ("tile_w", "tile_h"), chunk: int = 8) -> DataFrame:
    """Run a user model over items of equal size, in chunks, with the mean time per item.

    Items are scored where they are, without a shuffle. A task sorts them by size, so chunks are full, and
    each Arrow batch is grouped by size, so an answer never depends on neighbours of another size.
    """
    ids, sizes = list(id_cols), list(size_cols)
    fields = ", ".join(f"{c} {dict(items.dtypes)[c]}" for c in ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, rows, times = [], [], []
            for _, at in pdf.groupby(sizes, sort=True).indices.items():
                same = pdf.take(at)
                for a in range(0, len(at), chunk):
                    part = same.iloc[a:a + chunk].copy()
                    part.index = pd.RangeIndex(len(part))
                    t0 = time.perf_counter()
                    boxes = scorer(part)
                    ms = (time.perf_counter() - t0) * 1000 / len(part)
                    if len(boxes):
                        found.append(boxes)
                        rows.append(at[a:a + chunk][boxes["row_ix"].to_numpy()])
                        times.append(np.full(len(boxes), ms))
            if found:  # one Arrow batch out per batch in
                out = pdf[ids].take(np.concatenate(rows)).reset_index(drop=True)
                yield pd.concat([out, pd.concat(found, ignore_index=True).drop(columns="row_ix")], axis=1).assign(ms_per_item=np.concatenate(times))

    return items.sortWithinPartitions(*sizes).mapInPandas(run, f"{fields}, {BOXES}, ms_per_item double")


def tiled_inspection(frames: DataFrame, scorer: Scorer, tile: int = 256, overlap: float = 0.2, max_iou: float = 0.45, mode: str = "auto") -> DataFrame:
    """Frames to verdicts: tiling decision, tiles, scoring, lifting, suppression across tiles, roll-up.

    Frames are small rows that take much work, so they are dealt to tasks by number (``by_frame``), not by their size.
    """
    choice = tiling_choice("width", "height", tile, mode)
    f = by_frame(frames).withColumn("tiled", choice["tiled"])
    cut = sliding_tiles(f.where("tiled"), tile, overlap).select("frame_id", "x0", "y0", "tile_w", "tile_h")
    whole = f.where("not tiled").select("frame_id", F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.col("width").alias("tile_w"), F.col("height").alias("tile_h"))
    tiles = cut.unionByName(whole).withColumn("tile_id", F.xxhash64("frame_id", "x0", "y0"))
    # scoring is the costly step and its boxes are read by several branches below
    raw = reuse(score_batches(tiles, scorer, ["frame_id", "tile_id", "x0", "y0"]))
    lifted = raw.withColumns({  # tile-local to frame coordinates
        "x1": F.col("x1") + F.col("x0"), "x2": F.col("x2") + F.col("x0"), "y1": F.col("y1") + F.col("y0"), "y2": F.col("y2") + F.col("y0")})
    lifted = lifted.withColumn("det_id", F.xxhash64("tile_id", "class_id", "conf", "x1", "y1", "x2", "y2"))
    kept = reuse(nms(lifted.select("frame_id", "class_id", "det_id", "conf", "x1", "y1", "x2", "y2"), max_iou=max_iou))
    return frame_results(f, kept)
