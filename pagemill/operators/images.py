"""Image operators over pixel arrays (rows of a greyscale or RGB image as binary): crops, table rulings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Ink threshold, kernel and projection shares, distance of merged lines, crop margin.
INK, KERNEL, PROJECTION, NEAR, PADDING = 200, 0.30, 0.30, 3, 4


def crop(image: np.ndarray, box: tuple[float, float, float, float], padding: int = PADDING) -> np.ndarray:
    """The box with a margin, inside the page; a ValueError if nothing is left."""
    if padding < 0:
        raise ValueError("padding must not be negative")
    h, w = image.shape[:2]
    x0, y0, x1, y1 = (int(v) for v in box)
    x0, y0, x1, y1 = max(0, x0 - padding), max(0, y0 - padding), min(w, x1 + padding), min(h, y1 + padding)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("empty crop")
    return image[y0:y1, x0:x1]


def long_runs(ink: np.ndarray, kernel: int) -> np.ndarray:
    """Along the last axis: pixels whose whole neighbourhood of an odd kernel, cut at the edges, is ink."""
    r = kernel // 2
    total = np.concatenate([np.zeros((*ink.shape[:-1], 1), np.int64), np.cumsum(ink, -1)], -1)
    x = np.arange(ink.shape[-1])
    lo, hi = np.maximum(x - r, 0), np.minimum(x + r + 1, ink.shape[-1])
    return total[..., hi] - total[..., lo] == hi - lo


def merged(positions: np.ndarray) -> np.ndarray:
    """Positions at most NEAR from the one before are one line; its middle member stands for it."""
    if not len(positions):
        return positions
    starts = np.flatnonzero(np.concatenate([[True], np.diff(positions) > NEAR]))
    sizes = np.diff(np.append(starts, len(positions)))
    return positions[starts + sizes // 2]


def rulings(ink: np.ndarray) -> np.ndarray:
    """Rows of ruled lines that run along the last axis."""
    width = ink.shape[1]
    k = int(width * KERNEL)
    kept = long_runs(ink, max(3, k if k % 2 else k + 1))
    return merged(np.flatnonzero(kept.sum(1) >= max(1, int(width * PROJECTION))))


def table_cells(image: np.ndarray, box: tuple[float, float, float, float]) -> list[list[tuple[float, float, float, float]]] | None:
    """Boxes of the cells between ruled lines, row by row, or None without two lines each way."""
    if image.ndim == 3:  # fixed values: ITU-R 601 luma
        image = (image.astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16
    h, w = image.shape
    x0, y0, x1, y1 = max(0, int(box[0])), max(0, int(box[1])), min(w, int(box[2])), min(h, int(box[3]))
    if x1 - x0 <= 1 or y1 - y0 <= 1:
        return None
    ink = image[y0:y1, x0:x1] <= INK
    rows, columns = rulings(ink), rulings(ink.T)
    if len(rows) < 2 or len(columns) < 2:
        return None
    return [[(float(x0 + a), float(y0 + t), float(x0 + b), float(y0 + u)) for a, b in zip(columns, columns[1:], strict=False)] for t, u in zip(rows, rows[1:], strict=False)]


def find_table_cells(images: DataFrame) -> DataFrame:
    """(image_id, row, col, x0, y0, x1, y1) from images (image_id, width, height, pixels, x0, y0, x1, y1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                image = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], -1)
                found = table_cells(image[..., 0] if image.shape[2] == 1 else image, (r["x0"], r["y0"], r["x1"], r["y1"]))
                out += [(r["image_id"], i, j, *cell) for i, row in enumerate(found or []) for j, cell in enumerate(row)]
            if out:
                kinds = [pa.int64(), pa.int32(), pa.int32()] + [pa.float64()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["image_id", "row", "col", "x0", "y0", "x1", "y1"])

    return images.mapInArrow(run, "image_id long, row int, col int, x0 double, y0 double, x1 double, y1 double")
