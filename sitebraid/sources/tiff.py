"""Rasters in TIFF files, read from binaryFile tables: headers with georeference, and cells of single-band elevation.

Uncompressed and deflated strips are read; tiles and other compressions are refused by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8, 16: 8}
_FORMS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
HEADER = "path string, length long, width int, height int, epsg int, pixel_scale array<double>, tiepoint array<double>, affine array<double>, nodata double"
CELLS = "path string, width int, height int, nodata double, row int, col int, z float"


def tags(content: bytes) -> tuple[str, dict[int, list]]:
    """The byte order and the first directory's tags."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8 or struct.unpack_from(order + "H", content, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", content, 4)[0]
    found: dict[int, list] = {}
    for i in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, count, _ = struct.unpack_from(order + "HHII", content, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * count
        start = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", content, at + 10 + 12 * i)[0]
        if kind == 2:
            found[tag] = [content[start : start + count].split(b"\0")[0].decode("latin-1")]
        elif kind in _FORMS:
            found[tag] = list(struct.unpack_from(f"{order}{count}{_FORMS[kind]}", content, start))
    return order, found


def _nodata(t: dict[int, list]) -> float | None:
    try:
        return float(t[42113][0])
    except (KeyError, ValueError):
        return None


def _epsg(t: dict[int, list]) -> int | None:
    keys = t.get(34735, [])
    for i in range(4, len(keys) - 3, 4):
        if keys[i] in (3072, 2048) and keys[i + 1] == 0:
            return keys[i + 3]
    return None


def headers(files: DataFrame) -> DataFrame:
    """Size, system and georeference of files (path, length, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, length, content in zip(b["path"], b["length"], b["content"], strict=True):
                _, t = tags(bytes(content))
                out.append((path, length, t[256][0], t[257][0], _epsg(t), t.get(33550), t.get(33922), t.get(34264), _nodata(t)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEADER.split(", ")])

    return files.select("path", "length", "content").mapInPandas(run, HEADER)


def grid(content: bytes) -> tuple[np.ndarray, float | None]:
    """Elevations (float32, rows from the north) and nodata of a single-band file of 32-bit floats or signed 16-bit numbers."""
    order, t = tags(content)
    width, height, bits, form = t[256][0], t[257][0], t.get(258, [1])[0], t.get(339, [1])[0]
    if t.get(277, [1])[0] != 1:
        raise ValueError("the raster has more than one band")
    if (bits, form) not in ((32, 3), (16, 1), (16, 2)):
        raise ValueError(f"samples of {bits} bits of form {form} can't be read as elevations")
    packing = t.get(259, [1])[0]
    if packing not in (1, 8, 32946) or 273 not in t or t.get(317, [1])[0] != 1:
        raise ValueError("tiles, predictors and this compression can't be read")
    strips = [content[a : a + n] for a, n in zip(t[273], t[279], strict=True)]
    data = b"".join(zlib.decompress(s) if packing != 1 else s for s in strips)
    kind = np.dtype(order + ("f4" if bits == 32 else "i2"))
    return np.frombuffer(data, kind, width * height).reshape(height, width).astype("f4"), _nodata(t)


def cells(files: DataFrame) -> DataFrame:
    """A row a cell of elevation files (path, content); rows of a file are handed on in blocks, not whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                z, nodata = grid(bytes(content))
                height, width = z.shape
                step = max(1, 200_000 // max(1, width))
                for at in range(0, height, step):
                    part = z[at : at + step]
                    rows, cols = np.divmod(np.arange(part.size), width)
                    yield pd.DataFrame({"path": path, "width": width, "height": height, "nodata": nodata, "row": rows + at, "col": cols, "z": part.ravel()})

    return files.select("path", "content").mapInPandas(run, CELLS)
