"""Elevation models from GeoTIFF files: pixels as rows (TIFF 6.0, GeoTIFF 1.1; strips or tiles, raw or deflated)."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def tags(b: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the numeric tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    if order is None or struct.unpack(order + "H", b[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", b[4:8])[0]
    out = {}
    for i in range(struct.unpack(order + "H", b[at : at + 2])[0]):
        o = at + 2 + 12 * i
        tag, kind, n = struct.unpack(order + "HHI", b[o : o + 8])
        if kind not in _CODES:
            continue
        size = n * _SIZES[kind]
        p = o + 8 if size <= 4 else struct.unpack(order + "I", b[o + 8 : o + 12])[0]
        out[tag] = struct.unpack(f"{order}{n}{_CODES[kind]}", b[p : p + size])
    return order, out


def blocks(b: bytes):
    """(first row, first column, array) of the first band's strips or tiles, and the affine transform (x0, dx, y0, dy)."""
    order, t = tags(b)
    width, height = t[256][0], t[257][0]
    bands, packing, predictor = t.get(277, (1,))[0], t.get(259, (1,))[0], t.get(317, (1,))[0]
    if packing not in (1, 8, 32946) or predictor not in (1, 2):
        raise ValueError(f"compression {packing} with predictor {predictor} is not read")
    kind = np.dtype({1: "u", 2: "i", 3: "f"}[t.get(339, (1,))[0]] + str(t[258][0] // 8)).newbyteorder(order)
    sx, sy = t.get(33550, (1.0, 1.0, 0.0))[:2]
    tie = t.get(33922, (0.0, 0.0, 0.0, 0.0, 0.0, 0.0))
    place = (tie[3] - tie[0] * sx, sx, tie[4] + tie[1] * sy, -sy)
    tiled = 322 in t
    bw, bh = (t[322][0], t[323][0]) if tiled else (width, t.get(278, (height,))[0])
    across = -(-width // bw)
    for i, (o, n) in enumerate(zip(t[324 if tiled else 273], t[325 if tiled else 279])):
        raw = b[o : o + n] if packing == 1 else zlib.decompress(b[o : o + n])
        r, c = i // across * bh, i % across * bw
        rows = bh if tiled else min(bh, height - r)
        a = np.frombuffer(raw, kind, rows * bw * bands).reshape(rows, bw, bands)
        if predictor == 2:
            a = np.cumsum(a, axis=1, dtype=kind)
        yield r, c, a[: min(rows, height - r), : min(bw, width - c), 0], place


def read_dem(spark: SparkSession, path: str) -> DataFrame:
    """``file, row, col, x, y, z`` of every pixel (x, y: its centre); one file is one task's work, a block at a time.

    A missing path raises FileNotFoundError; a file of another kind or compression fails the query.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(path)

    def pixels(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                for r, c, a, (x0, dx, y0, dy) in blocks(content):
                    rows, cols = (m.ravel() for m in np.mgrid[r : r + a.shape[0], c : c + a.shape[1]])
                    z = a.astype(np.float64).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(z)), pa.array(rows), pa.array(cols), pa.array(x0 + (cols + 0.5) * dx), pa.array(y0 + (rows + 0.5) * dy), pa.array(z)], ["file", "row", "col", "x", "y", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(pixels, "file string, row long, col long, x double, y double, z double")
