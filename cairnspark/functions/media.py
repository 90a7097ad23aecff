"""What a file is, for people: its size in pixels, its format, its bit rate."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnspark.functions.display import pretty_codec, pretty_type
from cairnspark.functions.estimate import bitrate
from cairnspark.functions.paths import classify, extension, media_kind


def header_size(head: bytes) -> tuple[int, int]:
    """(width, height) from the first bytes of a PNG, GIF, BMP, WebP or JPEG file; (0, 0) where they don't tell."""
    try:
        if head[:8] == b"\x89PNG\r\n\x1a\n" and head[12:16] == b"IHDR":
            return struct.unpack(">II", head[16:24])
        if head[:6] in (b"GIF87a", b"GIF89a"):
            return struct.unpack("<HH", head[6:10])
        if head[:2] == b"BM":
            w, h = struct.unpack("<ii", head[18:26])
            return abs(w), abs(h)
        if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
            return _webp_size(head)
        if head[:2] == b"\xff\xd8":
            return _jpeg_size(head)
    except (struct.error, IndexError):
        pass
    return 0, 0


def _webp_size(head: bytes) -> tuple[int, int]:
    kind = head[12:16]
    if kind == b"VP8X":
        return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
    if kind == b"VP8L":
        bits = int.from_bytes(head[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    w, h = struct.unpack("<HH", head[26:30])
    return w & 0x3FFF, h & 0x3FFF


def _jpeg_size(head: bytes) -> tuple[int, int]:
    """From the first frame header; segments before it are stepped over."""
    at = 2
    while head[at] == 0xFF:
        marker = head[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", head[at + 5 : at + 9])
            return w, h
        at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return 0, 0


#: Bytes of a file that are looked at; a picture's header stands in them.
HEADER_BYTES = 1 << 18


def image_size(content: Column) -> Column:
    """width and height of a picture, 0 and 0 where its header can't be read. Only the beginning of the file goes to Python."""

    def sizes(heads: pa.Array) -> pa.Array:
        found = [(0, 0) if h is None else header_size(h) for h in heads.to_pylist()]
        return pa.array([{"width": w, "height": h} for w, h in found], pa.struct([("width", pa.int64()), ("height", pa.int64())]))

    sizes.__annotations__ = {"heads": pa.Array, "return": pa.Array}
    return F.arrow_udf(sizes, "width bigint, height bigint")(F.substring(content.cast("binary"), 1, HEADER_BYTES))


def describe(path: Column, size: Column, width: Column, height: Column, uti: Column, codec: Column, duration_us: Column) -> dict[str, Column]:
    """The columns of a file's description. Unknown files count as pictures; a picture of unknown type has the extension as
    its format, other media the codec's name, a bit rate and a length."""
    kind = F.coalesce(media_kind(classify(path)), F.lit("image"))
    image, ext = kind == "image", extension(path)
    return {
        "kind": kind, "size_bytes": size, "width": F.coalesce(width, F.lit(0)), "height": F.coalesce(height, F.lit(0)),
        "format": F.when(image, F.coalesce(pretty_type(uti), F.when(ext != "", F.upper(ext)))).otherwise(pretty_codec(codec)),
        "bitrate_bps": F.when(~image, bitrate(size, duration_us)), "duration_us": F.when(~image, duration_us),
    }
