"""A small TIFF codec: what the media operator needs to read and write pages.

Reading walks the chain of image directories, gathers strips or tiles, decodes
PackBits, LZW, deflate or plain data, undoes horizontal (2) and floating-point (3)
predictors, and yields one page after the other.  Writing makes baseline files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773  # fixed values of the format
# fixed values of the format: tag numbers
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 266, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
# fixed values of the format: bytes of each field type
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}


class TiffError(ValueError):
    """The bytes are not a TIFF file this codec can read."""


@dataclass
class Page:
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: np.ndarray  # height x width x samples


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 1 < n and data[i + 1] == data[i]):
            i += 1
        out.append(i - start - 1)
        out += data[start:i]
    return bytes(out)


def _lzw_width(table_size: int) -> int:
    """Code width once the table has so many entries; the format switches one entry early."""
    return min(12, max(9, (table_size + 1).bit_length()))


def lzw_decode(data: bytes) -> bytes:
    out, strings, prev = bytearray(), [], None
    bits = have = 0
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    strings = first.copy()
    width = 9
    for byte in data:
        bits = (bits << 8) | byte
        have += 8
        while have >= width:
            code = bits >> (have - width)
            have -= width
            bits &= (1 << have) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                strings, width, prev = first.copy(), 9, None
                continue
            if prev is None:
                if code >= len(strings):
                    raise TiffError("LZW data is damaged")
                entry = strings[code]
            else:
                if code > len(strings):
                    raise TiffError("LZW data is damaged")
                entry = strings[code] if code < len(strings) else prev + prev[:1]
                strings.append(prev + entry[:1])
            out += entry
            prev = entry
            width = _lzw_width(len(strings))
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, bits, have = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, have
        bits = (bits << width) | code
        have += width
        while have >= 8:
            out.append(bits >> (have - 8))
            have -= 8
            bits &= (1 << have) - 1

    codes = {bytes((i,)): i for i in range(256)}
    put(256, 9)
    size, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        # the reader's table is one entry behind the writer's
        put(codes[word], _lzw_width(size - 1))
        codes[longer] = size
        size += 1
        if size >= 4094:
            put(256, 12)
            codes, size = {bytes((j,)): j for j in range(256)}, 258
            # the reader has emptied its table too
        word = data[i : i + 1]
    if word:
        put(codes[word], _lzw_width(size - 1))
        size += 1
    put(257, _lzw_width(size - 1))
    if have:
        put(0, 8 - have)
    return bytes(out)


def _decode(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(data)
        except zlib.error as e:
            raise TiffError(f"deflate data is damaged: {e}") from None
    if compression == PACKBITS:
        return unpack_bits(data)
    if compression == LZW:
        return lzw_decode(data)
    raise TiffError(f"compression {compression} is not supported")


def _encode(data: bytes, compression: int) -> bytes:
    return {NONE: lambda d: d, DEFLATE: lambda d: zlib.compress(d, 1), OLD_DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits, LZW: lzw_encode}[compression](data)


def _block(raw: bytes, rows: int, columns: int, samples: int, bits: int, kind: int, predictor: int, order: str) -> np.ndarray:
    """One strip or tile as rows x columns x samples, its predictor undone."""
    per_row = columns * samples
    row_bytes = -(-per_row * bits // 8)
    raw = raw[: rows * row_bytes].ljust(rows * row_bytes, b"\0")
    if bits < 8:
        if predictor != 1:
            raise TiffError("a predictor needs whole bytes")
        spread = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, row_bytes), axis=1)[:, : per_row * bits]
        weights = 1 << np.arange(bits - 1, -1, -1)
        return (spread.reshape(rows, per_row, bits) @ weights).astype(np.uint8).reshape(rows, columns, samples)
    size = bits // 8
    if predictor == 3:
        planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(rows, row_bytes // samples, samples), axis=1, dtype=np.uint8)
        mixed = planes.reshape(rows, size, per_row).transpose(0, 2, 1)  # most significant byte first
        return np.ascontiguousarray(mixed).view(f">f{size}").reshape(rows, columns, samples).astype(f"f{size}")
    code = {1: "u", 2: "i", 3: "f"}.get(kind, "u")
    values = np.frombuffer(raw, f"{order}{code}{size}").reshape(rows, columns, samples)
    if predictor == 2:
        values = np.cumsum(values, axis=1, dtype=f"{code}{size}")
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} is not supported")
    return values.astype(f"{code}{size}")


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    if at + 2 > len(data):
        raise TiffError("an image directory lies outside the file")
    (n,) = struct.unpack_from(f"{order}H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise TiffError("an image directory lies outside the file")
    tags: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if kind not in TYPE_CODES:
            continue
        size = TYPE_BYTES[kind] * count
        where = at + 2 + 12 * i + 8
        if size > 4:
            (where,) = struct.unpack_from(f"{order}I", data, where)
        if where + size > len(data):
            raise TiffError(f"the values of tag {tag} lie outside the file")
        tags[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", data, where))
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return tags, following


#: no codec here makes more than so many bytes of one: LZW makes 4096 of 12 bits, deflate 258 of 2 bits
MOST_RATIO = 4096


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tags.get(tag) else default
    width, height = one(WIDTH), one(HEIGHT)
    if not width or height is None:
        raise TiffError("a page has no size")
    samples, planar = one(SAMPLES, 1), one(PLANAR, 1)
    bits, compression, predictor, kind = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(SAMPLE_FORMAT, 1)
    if len(set(tags.get(BITS, [bits]))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError("this sample size is not supported")
    if one(FILL_ORDER, 1) != 1:
        raise TiffError("reversed bit order is not supported")
    tiled = TILE_OFFSETS in tags
    block_w = one(TILE_WIDTH) if tiled else width
    block_h = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height) or height, height) or 1
    offsets, sizes = (tags.get(t, []) for t in ((TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)))
    if not block_w or not block_h:
        raise TiffError("a tile has no size")
    across, down = -(-width // block_w), -(-height // block_h)
    planes = samples if planar == 2 else 1
    if min(len(offsets), len(sizes)) < across * down * planes:
        raise TiffError("strips or tiles are missing")
    # checked before anything of that size is made
    stored = sum(sizes[: across * down * planes])
    if max(width * height * samples, across * block_w * block_h * samples) * bits > 8 * (64 + MOST_RATIO * stored):
        raise TiffError("the page is larger than its strips or tiles can hold")
    pixels = None
    per_block = 1 if planar == 2 else samples
    for k in range(across * down * planes):
        plane, place = divmod(k, across * down)
        y, x = place // across * block_h, place % across * block_w
        rows = block_h if tiled else min(block_h, height - y)
        if offsets[k] + sizes[k] > len(data):
            raise TiffError("a strip or tile lies outside the file")
        block = _block(_decode(data[offsets[k] : offsets[k] + sizes[k]], compression), rows, block_w, per_block, bits, kind, predictor, order)
        if pixels is None:
            pixels = np.zeros((height, width, samples), block.dtype)
        keep = block[: height - y, : width - x]
        pixels[y : y + keep.shape[0], x : x + keep.shape[1], plane : plane + per_block] = keep
    return Page(width, height, samples, bits, compression, predictor, np.zeros((height, width, samples), np.uint8) if pixels is None else pixels)


def pages(data: bytes) -> Iterator[Page]:
    """Every page of a file, in the order of its directories; TiffError if it can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the image directories form a circle")
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order)


def write(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A TIFF file of 8- or 16-bit unsigned images (rows x columns, or rows x columns x samples)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for image in images:
        if image.ndim == 2:
            image = image[:, :, None]
        height, width, samples = image.shape
        size = image.dtype.itemsize
        block_h, block_w = tile or (min(rows_per_strip, height), width)
        offsets, sizes = [], []
        for y in range(0, height, block_h):
            for x in range(0, width, block_w):
                block = image[y : y + block_h, x : x + block_w]
                if tile:
                    block = np.pad(block, ((0, block_h - block.shape[0]), (0, block_w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=block.dtype.type(0))
                raw = _encode(block.astype(f"{order}u{size}").tobytes(), compression)
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        layout = {TILE_WIDTH: ("I", [block_w]), TILE_HEIGHT: ("I", [block_h]), TILE_OFFSETS: ("I", offsets), TILE_BYTES: ("I", sizes)} if tile else {STRIP_OFFSETS: ("I", offsets), ROWS_PER_STRIP: ("I", [block_h]), STRIP_BYTES: ("I", sizes)}
        tags = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [8 * size] * samples), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [2 if samples == 3 else 1]), SAMPLES: ("H", [samples]), PLANAR: ("H", [1]), PREDICTOR: ("H", [predictor])} | layout
        entries = bytearray()
        for tag, (code, values) in sorted(tags.items()):
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                where = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(f"{order}I", where)
            entries += struct.pack(f"{order}HHI", tag, 3 if code == "H" else 4, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries + struct.pack(f"{order}I", 0)
        link = len(out) - 4
    return bytes(out)
