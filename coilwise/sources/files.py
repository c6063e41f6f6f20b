"""Files of any format written from rows, and payloads that can't be read set aside instead of failing the job."""

from __future__ import annotations

import base64
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK_SAMPLE = "frame_id bigint, payload string"
RUN = "frame_id bigint, class_id int, y int, x_start int, x_end int, error string"


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files under ``folder`` where the rows are; returns (name, length).

    Folders in names are made. The store is any that Arrow's file systems reach from the executors. A file
    is written under its final name at once, so a task that runs again writes the same file.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        made: set[str] = set()
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, content in zip(names, b.column(1), strict=True):
                path = f"{base.rstrip('/')}/{name}"
                parent = path.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent)
                    made.add(parent)
                data = content.as_buffer() or b""
                with store.open_output_stream(path) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["name", "length"])

    return files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, length bigint")


# ---------------------------------------------------------------- pictures

def bitmap(pixels: np.ndarray) -> bytes:
    """A 24-bit BMP of (height, width, 3) red, green, blue bytes."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, ::-1].reshape(h, 3 * w)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


# ---------------------------------------------------------------- mask payloads

def mask_payload(mask: np.ndarray) -> str:
    """A mask as base64 of zlib of npy."""
    out = io.BytesIO()
    np.save(out, mask)
    return base64.b64encode(zlib.compress(out.getvalue())).decode()


def encode_masks(runs: DataFrame, height: int, width: int) -> DataFrame:
    """(frame_id, payload) of every frame with runs; where classes overlap the largest one stays.

    A task holds one mask at a time: runs are sorted by frame and class.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame, mask = None, np.zeros((0, 0), np.uint8)
        for pdf in batches:
            out = []
            for fid, c, y, a, z in pdf.itertuples(index=False):
                if fid != frame:
                    if frame is not None:
                        out.append((frame, mask_payload(mask)))
                    frame, mask = fid, np.zeros((height, width), np.uint8)
                mask[y, a : z + 1] = c
            yield pd.DataFrame(out, columns=["frame_id", "payload"])
        if frame is not None:
            yield pd.DataFrame([(frame, mask_payload(mask))], columns=["frame_id", "payload"])

    dealt = runs.select("frame_id", "class_id", "y", "x_start", "x_end").repartition("frame_id").sortWithinPartitions("frame_id", "class_id")
    return dealt.mapInPandas(run, MASK_SAMPLE)


def _runs_of(payload: str, height: int, width: int) -> np.ndarray:
    """(class, y, first x, last x) of every run, row by row."""
    m = np.load(io.BytesIO(zlib.decompress(base64.b64decode(payload, validate=True))))
    if m.shape != (height, width):
        raise ValueError(f"mask shape {m.shape}, expected {(height, width)}")
    edge = np.ones((height, width + 1), bool)
    edge[:, 1:width] = m[:, 1:] != m[:, :-1]
    y, x = np.nonzero(edge)
    first = np.flatnonzero(x < width)
    y0, a, z = y[first], x[first], x[first + 1]
    some = m[y0, a] > 0
    return np.column_stack([m[y0, a], y0, a, z - 1])[some].astype(np.int64)


def read_masks(samples: DataFrame, height: int, width: int) -> DataFrame:
    """Runs of all payloads of (frame_id, payload); a payload that can't be read is one row with ``error`` set.

    No payload means an empty mask, which has no rows. ``mask_runs_of`` and ``quarantined`` part the two kinds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fid, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not payload:
                    continue
                try:
                    rows, error = _runs_of(payload, height, width), None
                except (ValueError, zlib.error, EOFError, OSError) as e:
                    rows, error = np.zeros((1, 4), np.int64), f"{type(e).__name__}: {e}"[:200]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([fid] * n, pa.int64()), *(pa.array(c, pa.int32(), mask=np.full(n, error is not None)) for c in rows.T), pa.array([error] * n, pa.string())], ["frame_id", "class_id", "y", "x_start", "x_end", "error"])

    return samples.select("frame_id", "payload").mapInArrow(run, RUN)


def mask_runs_of(read: DataFrame) -> DataFrame:
    return read.where("error is null").drop("error")


def quarantined(read: DataFrame) -> DataFrame:
    """(frame_id, error) of the payloads that can't be read."""
    return read.where("error is not null").select("frame_id", "error")


def read_mask_samples(spark: SparkSession, path: str) -> DataFrame:
    """(frame_id, payload) of JSON-lines files; the file source splits them and reads no other field."""
    return spark.read.schema(MASK_SAMPLE).json(path)


# ---------------------------------------------------------------- label text

def label_line_faults(lines: DataFrame, n_classes: int) -> DataFrame:
    """The lines with ``fault``: null, 'short', 'class' or 'number'."""
    p = F.split(F.trim("line"), r"\s+")
    numbers = F.forall(F.slice(p, 2, 4), lambda x: x.try_cast("double").isNotNull())
    cid = F.get(p, F.lit(0)).try_cast("int")
    return lines.withColumn("fault", F.when(F.size(p) < 5, "short").when(cid.isNull() | (cid < 0) | (cid >= n_classes), "class").when(~numbers, "number"))
