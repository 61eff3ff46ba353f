"""Rasters as rows: filters, resizing and packing over (id, width, height, pixels), pixels being floats row by row.

Spark spreads the images; each is a small numpy step of its own. Filters repeat
the border. A raster whose pixels do not fit its size gives null pixels.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship

RASTER = "id long, width int, height int, pixels array<double>"


def _windows(x: np.ndarray, radius: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = (radius, radius)
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), 2 * radius + 1, axis=axis)


def box_filter(x: np.ndarray, radius: int) -> np.ndarray:
    return _windows(_windows(x, radius, 0).mean(-1), radius, 1).mean(-1)


def min_filter(x: np.ndarray, radius: int) -> np.ndarray:
    return _windows(_windows(x, radius, 0).min(-1), radius, 1).min(-1)


def gaussian_blur(x: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    return _windows(_windows(x, radius, 0) @ kernel, radius, 1) @ kernel


def guided_filter(x: np.ndarray, radius: int, eps: float) -> np.ndarray:
    """Edge-preserving smoothing of an image guided by itself."""
    mean = box_filter(x, radius)
    var = box_filter(x * x, radius) - mean * mean
    a = var / (var + eps)
    return box_filter(a, radius) * x + box_filter(mean * (1 - a), radius)


def resize(x: np.ndarray, width: int, height: int, lobes: int = 3) -> np.ndarray:
    """Windowed-sinc resampling with a support that widens when the image shrinks."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = old / new
        wide = max(1.0, scale)
        at = (np.arange(new) + 0.5) * scale - 0.5
        d = (np.arange(old)[None, :] - at[:, None]) / wide
        w = np.where(np.abs(d) < lobes, np.sinc(d) * np.sinc(d / lobes), 0.0)
        return w / w.sum(1, keepdims=True)

    return weights(x.shape[0], height) @ x @ weights(x.shape[1], width).T


def quarter_turns(x: np.ndarray, turns: int) -> np.ndarray:
    return np.rot90(x, -turns)


def map_rasters(rows: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """rows (id, width, height, pixels) with work done on each image as an array of height x width."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                p, w, h = row["pixels"], row["width"], row["height"]
                out = None
                if p and w and h and len(p) == w * h:
                    out = work(np.array(p, np.float64).reshape(h, w))
                    h, w = out.shape
                values = [[row["id"]], [w], [h], [None if out is None else out.ravel().tolist()]]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["id", "width", "height", "pixels"])

    return rows.select("id", "width", "height", "pixels").mapInArrow(run, RASTER)


def pack(values: np.ndarray) -> str:
    """8-bit raster as base64 of its deflated bytes."""
    return base64.b64encode(zlib.compress(np.asarray(values, np.uint8).tobytes())).decode()


def unpack(text: str) -> np.ndarray | None:
    """The raster again; null for what is no such text."""
    try:
        return np.frombuffer(zlib.decompress(base64.b64decode(text, validate=True)), np.uint8)
    except (ValueError, zlib.error):
        return None
