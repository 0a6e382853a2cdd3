"""Image sizes from file headers, and the decision whether a recompression pays."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = "width int, height int"


def _orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        mark, at = struct.unpack_from(order + "HI", tiff, 2)
        for k in range(struct.unpack_from(order + "H", tiff, at)[0] if mark == 42 else 0):
            tag, _, _, value = struct.unpack_from(order + "HHIH", tiff, at + 2 + 12 * k)
            if tag == 0x0112:
                return value or 1
    except (struct.error, TypeError):
        pass
    return 1


def _jpeg(data: bytes) -> tuple[int, int] | None:
    at, turned = 2, False
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if mark == 0xFF:
            at += 1
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return (h, w) if turned else (w, h)
        if mark == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turned = _orientation(data[at + 10 : at + 2 + size]) in (5, 6, 7, 8)
        at += 2 + size
    return None


def image_size(data: bytes | None) -> tuple[int, int] | None:
    """Size as displayed of a PNG, GIF, JPEG or WebP; None for anything else."""
    data = data or b""
    size = None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
            size = struct.unpack_from(">II", data, 16)
        elif data[:6] in (b"GIF87a", b"GIF89a"):
            size = struct.unpack_from("<HH", data, 6)
        elif data[:2] == b"\xff\xd8":
            size = _jpeg(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            kind = data[12:16]
            if kind == b"VP8X":
                size = tuple(int.from_bytes(data[k : k + 3], "little") + 1 for k in (24, 27))
            elif kind == b"VP8L" and data[20] == 0x2F:
                bits = int.from_bytes(data[21:25], "little")
                size = (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
            elif kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
                size = tuple(x & 0x3FFF for x in struct.unpack_from("<HH", data, 26))
    except (struct.error, IndexError):
        return None
    return size if size and all(size) else None


def with_sizes(files: DataFrame, content: str = "content") -> DataFrame:
    """`files` with `size` (width, height), null where none can be read."""

    @F.pandas_udf(SIZE)
    def read(data: pd.Series) -> pd.DataFrame:
        got = [image_size(bytes(d) if d is not None else None) or (None, None) for d in data]
        return pd.DataFrame(got, columns=["width", "height"]).astype("Int32")

    size = read(content)
    return files.withColumn("size", size).withColumn("size", F.when(F.col("size.width").isNotNull(), F.col("size")))


def significant_gain(before: Column, after: Column, lossless: Column) -> Column:
    """Whether a smaller file is worth it: 10 % for lossy formats, 2 % for lossless ones."""
    return (before > 0) & (after <= before * (1 - F.when(lossless, 0.02).otherwise(0.10)))


def savings(files: DataFrame) -> DataFrame:
    """(files, accepted, bytes_before, bytes_after) over (before, after, lossless)."""
    ok = significant_gain(F.col("before"), F.col("after"), F.col("lossless"))
    return files.agg(F.count("*").alias("files"), F.count_if(ok).alias("accepted"), F.sum("before").alias("bytes_before"), F.sum(F.when(ok, F.col("after")).otherwise(F.col("before"))).alias("bytes_after"))
