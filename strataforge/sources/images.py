"""Images as bytes: format, size, orientation, day and perceptual hash.

JPEG and PNG headers and the EXIF directory are parsed from the bytes; PNG pixels are decoded, resized by
Lanczos in whole-number arithmetic and hashed. Work is by Arrow batch, an image at a time; bytes that are no image, or that cannot be
decoded, become a reason, never a failed task.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from datetime import date
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.operators.extract import grey_phash

#: Bytes of images that a Python worker gets at once, pixels of an image that are decoded at most.
BATCH_ROWS, PIXELS = 64, 100_000_000
PNG, JPEG = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"
# EXIF tags of the orientation, of the place of the EXIF directory and of the time the picture was taken; samples of a pixel by PNG colour type; steps of interlacing.
ORIENTATION, EXIF, TAKEN = 0x0112, 0x8769, 0x9003
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class NotAnImage(ValueError):
    pass


class DecodeError(ValueError):
    pass


def _directory(data: bytes, at: int, order: str) -> dict[int, tuple[int, int, bytes]]:
    """Entries (type, count, value or place) of a directory of tags."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    return {tag: (kind, count, value) for tag, kind, count, value in (struct.unpack_from(f"{order}HHI4s", data, at + 2 + 12 * k) for k in range(n))}


def exif(data: bytes) -> tuple[int, str | None]:
    """(orientation from 1 to 8, day) of an EXIF block; a broken block has neither."""
    turn, day = 1, None
    try:
        order = {b"II": "<", b"MM": ">"}[data[:2]]
        first = _directory(data, struct.unpack_from(f"{order}I", data, 4)[0], order)
        if ORIENTATION in first:
            (turn,) = struct.unpack_from(f"{order}H", first[ORIENTATION][2])
        if EXIF in first:
            own = _directory(data, struct.unpack(f"{order}I", first[EXIF][2])[0], order)
            if TAKEN in own:
                _, count, value = own[TAKEN]
                at = struct.unpack(f"{order}I", value)[0]
                day = exif_day((value[:count] if count <= 4 else data[at : at + count]).decode("latin-1"))
    except (KeyError, struct.error):
        pass
    return (turn if 1 <= turn <= 8 else 1), day


def exif_day(text: str) -> str | None:
    found = re.match(r"(\d{4}):(\d{2}):(\d{2})", text.strip("\0 "))
    try:
        return date(*map(int, found.groups())).isoformat() if found else None
    except ValueError:
        return None


def jpeg_header(data: bytes) -> tuple[int, int, int, str | None]:
    """(width, height, orientation, day) of a JPEG: its segments are walked up to the frame's."""
    at, turn, day = 2, 1, None
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise DecodeError("no marker")
        kind = data[at + 1]
        if kind == 0xFF:  # fill
            at += 1
            continue
        if kind == 1 or 0xD0 <= kind <= 0xD8:  # no length follows
            at += 2
            continue
        (length,) = struct.unpack_from(">H", data, at + 2)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                break
            height, width = struct.unpack_from(">HH", data, at + 5)
            return width, height, turn, day
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            turn, day = exif(data[at + 10 : at + 2 + length])
        at += 2 + length
    raise DecodeError("no frame")


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(body) < n or struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise DecodeError(f"broken chunk {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n
    raise DecodeError("cut off")


def _unfiltered(raw: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    """Lines of bytes from filtered ones: each is a filter's number and ``stride`` bytes."""
    lines = raw.reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride), np.uint8)
    for y in range(rows):
        kind, line, above = int(lines[y, 0]), lines[y, 1:], out[y]
        if kind == 0:
            out[y + 1] = line
        elif kind == 2:
            out[y + 1] = line + above
        elif kind == 1:  # sums of every ``step``-th byte, modulo 256
            for c in range(step):
                out[y + 1, c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind in (3, 4):
            own, up = bytearray(line.tobytes()), above.tobytes()
            for x in range(stride):
                a, b, c = own[x - step] if x >= step else 0, up[x], up[x - step] if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p, q, r = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if p <= q and p <= r else b if q <= r else c
                own[x] = (own[x] + guess) & 255
            out[y + 1] = np.frombuffer(bytes(own), np.uint8)
        else:
            raise DecodeError(f"filter {kind}")
    return out[1:]


def _samples(lines: np.ndarray, width: int, depth: int, samples: int) -> np.ndarray:
    """Lines of bytes as height x width x samples whole numbers."""
    if depth == 16:
        return lines.reshape(len(lines), -1, 2)[:, : width * samples, 0].reshape(len(lines), width, samples)  # the higher byte, as 8-bit conversions take it
    if depth == 8:
        return lines[:, : width * samples].reshape(len(lines), width, samples)
    bits = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)
    return (bits @ (1 << np.arange(depth)[::-1]))[:, :width, None].astype(np.uint8)


def grey(colours: np.ndarray) -> np.ndarray:
    """Luma of red, green and blue, in whole numbers."""
    r, g, b = (colours[..., k].astype(np.int64) for k in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def png_grey(chunks: list[tuple[bytes, bytes]], width: int, height: int, depth: int, colour: int, interlaced: bool) -> np.ndarray:
    """Grey pixels of a PNG; transparency is left out."""
    samples = SAMPLES[colour]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT")), np.uint8)
    except zlib.error as e:
        raise DecodeError(str(e)) from None
    step = max(1, samples * depth // 8)
    out, at = np.zeros((height, width, samples), np.uint8), 0
    for x0, y0, dx, dy in ADAM7 if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = (w * samples * depth + 7) // 8
        if len(raw) < at + h * (stride + 1):
            raise DecodeError("too few pixels")
        lines = _unfiltered(raw[at : at + h * (stride + 1)], h, stride, step)
        out[y0::dy, x0::dx] = _samples(lines, w, depth, samples)
        at += h * (stride + 1)
    if colour == 3:
        palette = next((body for kind, body in chunks if kind == b"PLTE"), b"")
        table = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)
        if out.max(initial=0) >= len(table):
            raise DecodeError("outside the palette")
        return grey(table[out[..., 0]])
    if samples >= 3:
        return grey(out)
    return (out[..., 0].astype(np.int64) * (255 // ((1 << min(depth, 8)) - 1))).astype(np.uint8)


@cache
def _weights(size: int, to: int) -> tuple[list[int], list[np.ndarray]]:
    """First pixels and whole-number weights (22 bits) of Lanczos windows of three lobes."""
    scale = size / to
    wide = max(scale, 1.0)
    first, out = [], []
    for k in range(to):
        middle = (k + 0.5) * scale
        low, high = max(0, int(middle - 3 * wide + 0.5)), min(size, int(middle + 3 * wide + 0.5))
        at = [(x - middle + 0.5) / wide for x in range(low, high)]
        w = [0.0 if abs(t) >= 3 else 1.0 if t == 0 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2 for t in at]
        total = sum(w)
        first.append(low)
        out.append(np.array([int(math.copysign(math.floor(abs(x / total) * (1 << 22) + 0.5), x / total)) for x in w], np.int64))
    return first, out


def _across(pixels: np.ndarray, to: int) -> np.ndarray:
    first, weights = _weights(pixels.shape[1], to)
    wide = pixels.astype(np.int64)
    out = np.stack([wide[:, a : a + len(w)] @ w for a, w in zip(first, weights, strict=True)], axis=1)
    return np.clip((out + (1 << 21)) >> 22, 0, 255).astype(np.uint8)


def resized(pixels: np.ndarray, to: int = 32) -> np.ndarray:
    """``to`` x ``to`` grey pixels: across first, then down, rounded after each."""
    return _across(_across(pixels, to).T, to).T


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Stored pixels as they are to be seen, by their EXIF orientation."""
    if turn >= 5:
        pixels = pixels.T
    if turn in (2, 3, 6, 7):
        pixels = pixels[:, ::-1]
    return pixels[::-1] if turn in (3, 4, 7, 8) else pixels


def png_header(chunks: list[tuple[bytes, bytes]]) -> tuple[int, int, int, int, bool]:
    """(width, height, bits of a sample, colour type, interlaced) of a PNG that can be decoded."""
    width, height, depth, colour, packed, filtered, interlaced = struct.unpack_from(">IIBBBBB", chunks[0][1])
    if colour not in SAMPLES or depth not in (1, 2, 4, 8, 16) or packed or filtered or not width * height or width * height > PIXELS:
        raise DecodeError("header")
    return width, height, depth, colour, bool(interlaced)


def grey_of(data: bytes) -> np.ndarray | None:
    """Stored grey pixels of a PNG; None if the bytes cannot be decoded."""
    try:
        chunks = list(png_chunks(data)) if data.startswith(PNG) else []
        return png_grey(chunks, *png_header(chunks)) if chunks else None
    except (DecodeError, struct.error, IndexError):
        return None


def png_of(pixels: np.ndarray) -> bytes:
    """Grey pixels as a PNG, the same bytes for the same pixels."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def inspect(data: bytes | None) -> dict:
    """Format, size as it is seen, orientation, day, hash and reason of an image's bytes."""
    out = {"sha256": None if data is None else hashlib.sha256(data).hexdigest(), "format": None, "width": None, "height": None, "orientation": None, "exif_day": None, "phash": None, "reason": None}
    try:
        if data is not None and data.startswith(JPEG):
            width, height, turn, day = jpeg_header(data)
            code, kind, why = None, "jpeg", None if width and height else "decode_error"
        elif data is not None and data.startswith(PNG) and data[12:16] == b"IHDR":
            chunks = list(png_chunks(data))
            width, height, depth, colour, interlaced = png_header(chunks)
            turn, day = exif(next((body for kind, body in chunks if kind == b"eXIf"), b""))
            code, kind, why = grey_phash(resized(upright(png_grey(chunks, width, height, depth, colour, interlaced), turn))), "png", None
        else:
            raise NotAnImage
    except NotAnImage:
        return out | {"reason": "not_an_image"}
    except (DecodeError, struct.error, IndexError):
        return out | {"reason": "decode_error"}
    if turn >= 5:
        width, height = height, width
    return out | {"format": kind, "width": width, "height": height, "orientation": turn, "exif_day": day, "phash": code, "reason": why}


SEEN = "sha256 string, format string, width int, height int, orientation int, exif_day string, phash string, reason string"


def inspect_images(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``content`` replaced by what its bytes say of the image.

    Null bytes are ``not_an_image``. JPEG pixels are not decoded: format, size, orientation and day are told, and ``phash`` is null. ``width`` and
    ``height`` are those of the image as it is seen, after its orientation. An image is held whole in a worker, a
    few at a time; what is written back are a few numbers.
    """
    kept = [c for c in files.columns if c != content]

    @F.arrow_udf(f"struct<{', '.join(x.replace(' ', ':') for x in SEEN.split(', '))}>")
    def look(x: pa.Array) -> pa.Array:
        kinds = {"width": pa.int32(), "height": pa.int32(), "orientation": pa.int32()}
        kind = pa.struct([(k, kinds.get(k, pa.string())) for k in (s.split()[0] for s in SEEN.split(", "))])
        return pa.concat_arrays([pa.array([inspect(b.as_py()) for b in x.slice(at, BATCH_ROWS)], kind) for at in range(0, len(x), BATCH_ROWS)]) if len(x) else pa.array([], kind)

    return files.select(*kept, look(F.col(content)).alias("__seen")).select(*kept, "__seen.*")
