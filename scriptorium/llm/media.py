"""Media columns: TIFF files held as bytes in a column, one row out per page.

``tiff_pages`` walks each file's image directories, decodes PackBits, LZW, deflate or
plain strips and tiles, undoes predictors, and emits a row per page with its geometry,
digests, features and (on request) its samples.  A file that cannot be read gives one
row with page -1 and the reason in ``error``: a corpus job never fails on one file.
``to_tiff`` stores byte payloads losslessly as 8-bit pages.

Everything is row by row in one pass, so memory is bounded by the largest file.

Defined results: null bytes give one row with ``error`` set; an empty table gives an
empty table; repeated files give equal rows; columns of the input are kept unless a
result has the same name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tiff

#: samples in a row of a stored payload, and the unit to which payloads are filled
ROW = 64

PAGE_FIELDS = [
    ("page", T.LongType(), pa.int64()), ("width", T.LongType(), pa.int64()), ("height", T.LongType(), pa.int64()),
    ("samples", T.LongType(), pa.int64()), ("bits", T.LongType(), pa.int64()), ("compression", T.LongType(), pa.int64()),
    ("predictor", T.LongType(), pa.int64()), ("media_bytes", T.LongType(), pa.int64()), ("media_sha256", T.StringType(), pa.string()),
    ("payload_bytes", T.LongType(), pa.int64()), ("payload_sha256", T.StringType(), pa.string()), ("tail_crc32", T.LongType(), pa.int64()),
    ("feature", T.StringType(), pa.string()), ("error", T.StringType(), pa.string()), ("pixels", T.BinaryType(), pa.binary()),
]


def payload_image(data: bytes) -> np.ndarray:
    """Bytes as rows of 64 samples, filled with zeros to a positive whole number of rows."""
    filled = data.ljust(max(1, -(-len(data) // ROW)) * ROW, b"\0")
    return np.frombuffer(filled, np.uint8).reshape(-1, ROW)


def to_tiff(df: DataFrame, payload: str, into: str = "media", rows_per_strip: int = 1024) -> DataFrame:
    """Adds ``into``: each binary ``payload`` (null: empty) as a one-page deflated TIFF of 8-bit samples."""
    rest = [c for c in df.columns if c != into]
    at = rest.index(payload)
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(into, T.BinaryType())])

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = [tiff.write([payload_image(p or b"")], tiff.DEFLATE, 1, rows_per_strip) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(files, pa.binary())], [*b.schema.names, into])

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(stored, schema)


def page_feature(pixels: np.ndarray) -> str:
    """Size, mean, deviation and a 64-bit average hash of an 8 x 8 grid of a page's samples."""
    if pixels.size == 0:
        return "0x0"
    gray = pixels.reshape(pixels.shape[0], -1)
    rows = np.add.reduceat(gray, np.arange(8) * gray.shape[0] // 8, axis=0, dtype=np.float64) if gray.shape[0] >= 8 else gray.astype(np.float64)
    if gray.shape[1] >= 8:
        rows = np.add.reduceat(rows, np.arange(8) * gray.shape[1] // 8, axis=1)
    bits = int("".join("1" if x else "0" for x in (rows > rows.mean()).ravel()) or "0", 2)
    return f"{pixels.shape[1]}x{pixels.shape[0]}:{gray.mean(dtype=np.float64):.4f}:{gray.std(dtype=np.float64):.4f}:{bits:016x}"


def _page_rows(data: bytes | None, with_pixels: bool) -> Iterator[tuple]:
    if data is None:
        yield -1, *[None] * 12, "no file", None
        return
    digest, n = hashlib.sha256(data).hexdigest(), -1
    try:
        for n, p in enumerate(tiff.pages(data)):  # noqa: B007
            raw = p.pixels.tobytes()
            yield (n, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, len(data), digest, len(raw),
                   hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]), page_feature(p.pixels), None, raw if with_pixels else None)
    except Exception as e:  # whatever damage does to a decoder, it is this file's own row
        yield -1, *[None] * 6, len(data), digest, *[None] * 4, f"after page {n}: {e or type(e).__name__}", None


def tiff_pages(df: DataFrame, media: str, with_pixels: bool = False, drop_media: bool = True) -> DataFrame:
    """One row for each page of each file in ``media``."""
    names = [n for n, *_ in PAGE_FIELDS]
    rest = [c for c in df.columns if c not in names]
    keep = [c for c in rest if not (drop_media and c == media)]
    at = rest.index(media)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(n, t) for n, t, _ in PAGE_FIELDS])
    most = 64 << 20  # bytes of samples in one batch out

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(b: pa.RecordBatch, source: list[int], rows: list[tuple]) -> pa.RecordBatch:
            kept = [b.column(i).take(pa.array(source, pa.int64())) for i, c in enumerate(rest) if c in keep]
            columns = zip(*rows, strict=True)
            made = [pa.array(list(x), t) for x, (_, _, t) in zip(columns, PAGE_FIELDS, strict=True)]
            return pa.RecordBatch.from_arrays([*kept, *made], [*keep, *names])

        for b in batches:
            source, rows, held = [], [], 0
            for i in range(b.num_rows):
                for row in _page_rows(b.column(at)[i].as_py(), with_pixels):
                    source.append(i)
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > most:
                        yield batch(b, source, rows)
                        source, rows, held = [], [], 0
            if rows:
                yield batch(b, source, rows)

    return df.select(*[F.col(f"`{c}`") for c in rest]).mapInArrow(paged, schema)
