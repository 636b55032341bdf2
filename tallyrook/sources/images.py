"""Scanned pages as binary files: scan, size from the file's head, budgets, identity. Pixels need an imaging library, which a reader brings."""

from __future__ import annotations

import re
import struct
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forms

# File types that are read, and how a PNG begins.
SUFFIXES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp", "pdf")
PNG = b"\x89PNG\r\n\x1a\n"
#: Points of an inch, in which PDF pages are measured.
POINTS = 72


def _png(data: bytes) -> tuple[int, int, int]:
    if data[:8] != PNG or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return (*struct.unpack(">II", data[16:24]), 1)


def _jpeg(data: bytes) -> tuple[int, int, int]:
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # a frame's head
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height, 1
        at += 2 + length
    raise ValueError("not a JPEG")


def _bmp(data: bytes) -> tuple[int, int, int]:
    if data[:2] != b"BM":
        raise ValueError("not a BMP")
    width, height = struct.unpack("<ii", data[18:26])
    return width, abs(height), 1


def _webp(data: bytes) -> tuple[int, int, int]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP")
    kind = data[12:16]
    if kind == b"VP8X":
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, max(1, data.count(b"ANMF"))
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, 1
    width, height = struct.unpack("<HH", data[26:30])
    return width & 0x3FFF, height & 0x3FFF, 1


def _tiff(data: bytes) -> tuple[int, int, int]:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        raise ValueError("not a TIFF")
    at, frames, size, seen = struct.unpack(order + "I", data[4:8])[0], 0, {}, set()
    while at and at not in seen and at + 2 <= len(data):
        seen.add(at)
        frames += 1
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        for i in range(n):
            tag, kind, _, value = struct.unpack(order + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
            if frames == 1 and tag in (256, 257):
                size[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]
    return size[256], size[257], frames


def _pdf(data: bytes, dpi: int) -> tuple[int, int, int]:
    """Pages, and the first one's pixels at the resolution; of files whose page objects aren't compressed."""
    if not data.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    box = re.search(rb"/MediaBox\s*\[\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", data)
    if box is None:
        raise ValueError("no page size")
    x0, y0, x1, y1 = map(float, box.groups())
    return round(abs(x1 - x0) * dpi / POINTS), round(abs(y1 - y0) * dpi / POINTS), len(re.findall(rb"/Type\s*/Page\b", data))


HEADS = {"png": _png, "jpg": _jpeg, "jpeg": _jpeg, "bmp": _bmp, "webp": _webp, "tif": _tiff, "tiff": _tiff}


def measured(data: bytes, kind: str, dpi: int) -> tuple[int | None, int | None, int | None, str | None]:
    """Width, height, frames, and what is wrong with the file."""
    try:
        found = _pdf(data, dpi) if kind == "pdf" else HEADS[kind](data)
        return (*found, None)
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return None, None, None, f"unreadable: {e or 'truncated'}"


def pages(spark: SparkSession, path: str, recursive: bool = False, dpi: int = 150) -> DataFrame:
    """path, length, kind, width, height, frames, sha256, png_valid, reject_reason, content.

    Files over the budget in bytes are never read; of the others the head says how large their pixels are, before anything decodes them. A
    file of several frames or pages, of too many pixels, or that can't be read has a reject_reason and no content. A PNG's bytes are its
    identity; other kinds get theirs when a reader encodes them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    small = files.where(F.col("length") <= forms.MOST_BYTES).select("path", "length", kind.alias("kind"), "content")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measured(c.as_py(), k, dpi) for c, k in zip(batch.column("content"), batch.column("kind").to_pylist(), strict=True)]
            columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "frames", "fault"])

    good = small.mapInArrow(heads, "path string, length long, kind string, content binary, width long, height long, frames long, fault string")
    reason = F.coalesce("fault", forms.reject_reason(F.col("length"), F.lit(dpi), F.col("width"), F.col("height"), F.col("frames")))
    good = good.withColumn("reject_reason", reason)
    out = good.select(
        "path", "length", "kind", "width", "height", "frames", F.sha2("content", 256).alias("sha256"), ((F.col("kind") != "png") | (F.hex(F.substring("content", 1, 8)) == PNG.hex().upper())).alias("png_valid"),
        "reject_reason", F.when(F.col("reject_reason").isNull(), F.col("content")).alias("content"),
    )
    big = files.where(F.col("length") > forms.MOST_BYTES).select("path", "length", kind.alias("kind"))
    none = {"width": "long", "height": "long", "frames": "long", "sha256": "string", "png_valid": "boolean"}
    return out.unionByName(big.select("*", *(F.lit(None).cast(t).alias(c) for c, t in none.items()), F.lit("too many bytes").alias("reject_reason"), F.lit(None).cast("binary").alias("content")))


class Deadline:
    """Seconds that a sheet may take, by a clock that never goes back."""

    def __init__(self, seconds: float, clock=time.monotonic):
        self.clock, self.until = clock, clock() + seconds

    def remaining(self) -> float:
        """Seconds left; an error when there are none."""
        left = self.until - self.clock()
        if left <= 0:
            raise TimeoutError("processing deadline exceeded")
        return left

    def bounded(self, most: float) -> float:
        """A step's own limit, within what is left."""
        return min(most, self.remaining())
