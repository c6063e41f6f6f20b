"""Image inventory, pixel decoding and mask payloads."""

from __future__ import annotations

import base64
import io
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values
SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
NOISE_LAPLACIAN = 32
FOCUS_SIDE = 256
MIN_REST = 32
FLAT = 1e-6


def image_inventory(spark: SparkSession, sources: Sequence[str]) -> DataFrame:
    """Path, size and time of image files under folders, globs or single files; content is not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(sources))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = df.select("path", "length", "modificationTime").where(ext.isin(*SUFFIXES)).orderBy("path")
    if not out.take(1):
        raise FileNotFoundError(f"no images found in {list(sources)}")
    return out


def _all_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")


def read_images(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """origin, height, width, nChannels, mode, data (decoded by Spark) of the files that decode.

    The others are listed by ``rejected_images``; with ``strict`` the first of them fails the job.
    """
    decoded = F.col("height") > 0
    if strict:
        decoded = F.when(decoded, True).otherwise(F.raise_error(F.concat(F.lit("undecodable image "), "origin")).cast("boolean"))
    return _all_images(spark, path).where(decoded)


def rejected_images(spark: SparkSession, path: str) -> DataFrame:
    """origin of the files under ``path`` that don't decode as an image."""
    return _all_images(spark, path).where("height <= 0").select("origin")


def _planes(row) -> tuple[np.ndarray, np.ndarray]:
    """Grey plane (BT.601 in 14-bit fixed point) and mean-saturation plane of one decoded image."""
    a = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.nChannels)
    if row.nChannels == 1:
        g = a[..., 0]
        return g, np.zeros(g.shape)
    b, g, r = (a[..., i].astype(np.int64) for i in range(3))
    grey = ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.uint8)
    top, low = a[..., :3].max(axis=2).astype(float), a[..., :3].min(axis=2).astype(float)
    return grey, np.rint(np.where(top > 0, (top - low) / np.maximum(top, 1) * 255, 0))


def _laplacian(p: np.ndarray) -> np.ndarray:
    q = np.pad(p.astype(float), 1, mode="reflect") if min(p.shape) > 1 else np.pad(p.astype(float), 1, mode="edge")
    return q[:-2, 1:-1] + q[2:, 1:-1] + q[1:-1, :-2] + q[1:-1, 2:] - 4 * q[1:-1, 1:-1]


def _sobel(p: np.ndarray) -> np.ndarray:
    """Gradient magnitude of the 3x3 Sobel operator."""
    q = np.pad(p, 1, mode="reflect") if min(p.shape) > 1 else np.pad(p, 1, mode="edge")
    col = q[:-2] + 2 * q[1:-1] + q[2:]
    row = q[:, :-2] + 2 * q[:, 1:-1] + q[:, 2:]
    return np.hypot(col[:, 2:] - col[:, :-2], row[2:] - row[:-2])


def _area_resize(p: np.ndarray, side: int) -> np.ndarray:
    """Shrink by area so that the long side is at most ``side``; never enlarge."""
    long = max(p.shape)
    if long <= side:
        return p
    h, w = max(1, round(p.shape[0] * side / long)), max(1, round(p.shape[1] * side / long))

    def weights(n_in: int, n_out: int) -> np.ndarray:
        edges = np.arange(n_out + 1) * n_in / n_out
        lo, hi = edges[:-1, None], edges[1:, None]
        cover = np.clip(np.minimum(hi, np.arange(1, n_in + 1)) - np.maximum(lo, np.arange(n_in)), 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return np.rint(weights(p.shape[0], h) @ p @ weights(p.shape[1], w).T)


def pixel_histograms(images: DataFrame) -> DataFrame:
    """Grey histogram rows (origin, level, n) from decoded images."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n = np.bincount(_planes(row)[0].ravel(), minlength=256)
                lv = np.flatnonzero(n)
                yield pd.DataFrame({"origin": row.origin, "level": lv.astype("int32"), "n": n[lv]})
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, "origin string, level int, n bigint")


def pixel_signals(images: DataFrame) -> DataFrame:
    """Size, saturation, edge density and focus of each image in one pass over its pixels."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                grey, sat = _planes(row)
                small = _area_resize(grey, FOCUS_SIDE)
                out.append((row.origin, row.width, row.height, min(row.width, row.height), max(row.width, row.height) / max(1, min(row.width, row.height)),
                            float(sat.mean()), float((np.abs(_laplacian(grey)) > NOISE_LAPLACIAN).mean()), float(_laplacian(small).var()), float(grey.mean()), float(grey.std())))
            yield pd.DataFrame(out, columns=["origin", "width", "height", "min_side", "aspect", "saturation", "edge_density", "focus", "grey_mean", "grey_std"])
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(
        run, "origin string, width int, height int, min_side int, aspect double, saturation double, edge_density double, focus double, grey_mean double, grey_std double")


def _table(p: np.ndarray) -> np.ndarray:
    """Summed-area table with a leading row and column of zeros."""
    return np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))


BOX_SUMS = ("in_n", "in_g", "in_gg", "in_edge", "rest_n", "rest_g", "rest_gg", "all_n", "all_edge")


def box_sums(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixel count and sums of grey, squared grey and gradient: of each box, outside all boxes, and of the image.

    Boxes reach the pixels as one bounded list per image (labels of a single picture). Boxes without a
    pixel inside the image give no row.
    """
    lists = boxes.groupBy("origin").agg(F.collect_list(F.struct("box_id", "class_id", "x1", "y1", "x2", "y2")).alias("boxes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for image in (r for pdf in batches for r in pdf.itertuples(index=False)):
            b = pd.DataFrame([x if isinstance(x, dict) else x.asDict() for x in image.boxes])
            grey = _planes(image)[0].astype(np.int64)
            edge = _sobel(grey.astype(float))
            x = b[["x1", "x2"]].round().clip([0, 1], [image.width - 1, image.width]).to_numpy(int).T
            y = b[["y1", "y2"]].round().clip([0, 1], [image.height - 1, image.height]).to_numpy(int).T
            some = (x[0] < x[1]) & (y[0] < y[1])
            b, x, y = b[some], x[:, some], y[:, some]
            corner = np.zeros((image.height + 1, image.width + 1), int)
            for i, j, sign in ((0, 0, 1), (1, 1, 1), (0, 1, -1), (1, 0, -1)):
                np.add.at(corner, (y[i], x[j]), sign)
            free = corner.cumsum(0).cumsum(1)[:-1, :-1] == 0  # pixels that no box covers
            sums = {"in_n": (x[1] - x[0]) * (y[1] - y[0])}
            for name, plane in (("g", grey), ("gg", grey * grey), ("edge", edge)):
                t = _table(plane)
                sums[f"in_{name}"] = t[y[1], x[1]] - t[y[0], x[1]] - t[y[1], x[0]] + t[y[0], x[0]]
            sums |= {"rest_n": free.sum(), "rest_g": grey[free].sum(), "rest_gg": (grey[free] ** 2).sum(), "all_n": grey.size, "all_edge": edge.sum()}
            yield b[["box_id", "class_id"]].assign(origin=image.origin, **sums)[["origin", "box_id", "class_id", *BOX_SUMS]]

    pixels = images.select("origin", "height", "width", "nChannels", "data").join(lists, "origin")
    return pixels.mapInPandas(run, "origin string, box_id bigint, class_id int, " + ", ".join(f"{c} double" for c in BOX_SUMS))


def _deviation(part: str):
    n = F.nullif(F.col(f"{part}_n"), F.lit(0.0))
    mean = F.col(f"{part}_g") / n
    return F.sqrt(F.greatest(F.col(f"{part}_gg") / n - mean * mean, F.lit(0.0)))


def box_pixel_stats(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Separability, edge ratio and in-box deviation per labelled box, as columns over ``box_sums``."""
    gap = F.abs(F.expr("in_g / in_n - rest_g / nullif(rest_n, 0)"))
    contrast = F.when((F.col("rest_n") > MIN_REST) & (_deviation("rest") > FLAT), gap / _deviation("rest"))
    edges = F.expr("(in_edge / in_n) / coalesce(nullif(all_edge / all_n, 0), 1)")
    return box_sums(images, boxes).select("origin", "box_id", "class_id", contrast.alias("separability"), edges.alias("edge_ratio"), _deviation("in").alias("in_box_std"))


def apply_lut_to_pixels(images: DataFrame, luts: DataFrame) -> DataFrame:
    """Decoded images with a 256-entry table (``lut`` array per origin) applied to every channel."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["data"] = [np.asarray(lut, dtype=np.uint8)[np.frombuffer(d, dtype=np.uint8)].tobytes() for d, lut in zip(pdf["data"], pdf["lut"])]
            yield pdf.drop(columns="lut")
    cols = images.select("origin", "height", "width", "nChannels", "mode", "data").join(luts.select("origin", "lut"), "origin")
    return cols.mapInPandas(run, "origin string, height int, width int, nChannels int, mode int, data binary")


def decode_masks(samples: DataFrame, height: int, width: int) -> DataFrame:
    """Mask payloads (base64, zlib, npy) to run-length rows; no payload means an empty mask.

    ``samples``: frame_id, payload. A wrong shape fails the job.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fid, payload in zip(pdf["frame_id"], pdf["payload"]):
                if not payload:
                    continue
                m = np.load(io.BytesIO(zlib.decompress(base64.b64decode(payload))))
                if m.shape != (height, width):
                    raise ValueError(f"frame {fid}: mask shape {m.shape}, expected {(height, width)}")
                edge = np.diff(np.pad(m.astype(np.int16), ((0, 0), (1, 1))), axis=1) != 0
                for y in np.flatnonzero(m.any(axis=1)):
                    cut = np.flatnonzero(edge[y])
                    for a, b in zip(cut[:-1], cut[1:]):
                        if m[y, a]:
                            out.append((fid, int(m[y, a]), y, a, b - 1))
            yield pd.DataFrame(out, columns=["frame_id", "class_id", "y", "x_start", "x_end"])
    return samples.select("frame_id", "payload").mapInPandas(run, "frame_id bigint, class_id int, y int, x_start int, x_end int")
