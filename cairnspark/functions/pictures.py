"""Prints of pictures: grey pixels averaged over 16 x 16 areas, a bit for each area that isn't darker than their mean."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnspark.functions.bits import LANES, to_hex

SIDE = 16
#: The tag of these prints in a cache.
ALGO = "area16-v1"


def _luma(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[..., k].astype(np.int64) for k in range(3))
    return ((299 * r + 587 * g + 114 * b + 500) // 1000).astype(np.uint8)


def _netpbm(data: bytes) -> np.ndarray | None:
    """Binary grey (P5) or colour (P6) pictures of up to 8 bits a sample."""
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at) + 1 or len(data)
            continue
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        fields.append(int(data[at:end]))
        at = end
    (width, height, most), depth = fields, 3 if data[:2] == b"P6" else 1
    size = width * height * depth
    if not size or not 0 < most < 256 or len(data) < at + 1 + size:
        return None
    px = np.frombuffer(data, np.uint8, size, at + 1).reshape(height, width, depth)
    px = px if most == 255 else np.minimum((px.astype(np.int64) * 255 + most // 2) // most, 255).astype(np.uint8)
    return px[..., 0] if depth == 1 else _luma(px)


def _bmp(data: bytes) -> np.ndarray | None:
    """Uncompressed bitmaps of 8 bits with a palette, 24 or 32 bits."""
    if len(data) < 54:
        return None
    (start, head, width, height, _, depth, packed) = struct.unpack_from("<I4xI", data, 10)[:1] + struct.unpack_from("<IiiHHI", data, 14)
    rows, line = abs(height), (abs(width) * depth + 31) // 32 * 4
    if packed or depth not in (8, 24, 32) or width <= 0 or not rows or len(data) < start + rows * line:
        return None
    px = np.frombuffer(data, np.uint8, rows * line, start).reshape(rows, line)[:, : width * depth // 8]
    if depth == 8:
        table = np.frombuffer(data, np.uint8, (start - 14 - head) // 4 * 4, 14 + head).reshape(-1, 4)
        if not len(table) or px.max() >= len(table):
            return None
        grey = _luma(table[:, 2::-1])[px]
    else:
        grey = _luma(px.reshape(rows, width, depth // 8)[..., 2::-1])
    return grey if height < 0 else grey[::-1]


def grey_pixels(data: bytes | None) -> np.ndarray | None:
    """Rows of grey values of a picture (PGM, PPM or BMP); null for anything else."""
    if not data:
        return None
    return _netpbm(data) if data[:2] in (b"P5", b"P6") else _bmp(data) if data[:2] == b"BM" else None


def _areas(x: np.ndarray, side: int) -> np.ndarray:
    """Sums over side areas of equal height of the rows of x, in parts of a row: each row counts side in all."""
    n = len(x)
    sums = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x, axis=0, dtype=np.int64)])
    whole, part = np.divmod(np.arange(side + 1) * n, side)
    edges = sums[whole] * side + part[:, None] * x[np.minimum(whole, n - 1)]
    return np.diff(edges, axis=0)


def area_sums(grey: np.ndarray, side: int = SIDE) -> np.ndarray:
    """side x side sums of areas of equal size, exact where areas cut through pixels."""
    return _areas(_areas(grey.astype(np.int64), side).T, side).T


def print_lanes(grey: np.ndarray) -> np.ndarray:
    """The print as four 64-bit lanes: bit i is that of area i, row by row, the lowest first."""
    cells = area_sums(grey).ravel()
    bits = cells * len(cells) >= cells.sum()
    return np.packbits(bits, bitorder="little").view("<i8")


_KIND = pa.struct([*((f"fp{k}", pa.int64()) for k in range(LANES)), ("spread", pa.float64())])


def _prints(content: pa.Array) -> pa.Array:
    out: list[dict | None] = []
    for data in content.to_pylist():
        grey = grey_pixels(data)
        out.append(None if grey is None else {f"fp{k}": int(v) for k, v in enumerate(print_lanes(grey))} | {"spread": float(grey.std())})
    return pa.array(out, _KIND)


def picture_print(content: Column) -> Column:
    """fp0 to fp3 and spread (the deviation of the grey values) of a picture's bytes; null for what is no picture."""
    return F.arrow_udf(_prints, ", ".join([*(f"fp{k} bigint" for k in range(LANES)), "spread double"]))(content)


def picture_hex(content: Column) -> Column:
    """The print as 64 hex digits, as a cache holds it."""
    p = picture_print(content)
    return F.when(p.isNotNull(), to_hex([p[f"fp{k}"] for k in range(LANES)]))
