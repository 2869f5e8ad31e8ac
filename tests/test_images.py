"""Image bytes made here, against plain versions of what they hold."""

import math
import struct
import zlib

import numpy as np
import pytest

from strataforge.operators.extract import grey_phash
from strataforge.plans.sourcing import _chunk, _tags
from strataforge.sources import images
from strataforge.sources.images import ADAM7, PNG, inspect


def filtered(lines, step, kinds):
    """Lines of bytes with a filter each, by the definition of the filters."""
    out = b""
    for y, line in enumerate(lines):
        kind = kinds[y % len(kinds)]
        coded = []
        for x, value in enumerate(line):
            a = int(line[x - step]) if x >= step else 0
            b = int(lines[y - 1][x]) if y else 0
            c = int(lines[y - 1][x - step]) if y and x >= step else 0
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded.append((int(value) - (0, a, b, (a + b) // 2, nearest)[kind % 5]) & 255)
        out += bytes([kind, *coded])
    return out


def packed(values, depth):
    """Rows of samples as lines of bytes."""
    if depth == 16:
        return [[b for v in row for b in (int(v) >> 8, int(v) & 255)] for row in values]
    if depth == 8:
        return values.tolist()
    out = []
    for row in values:
        bits = "".join(f"{int(v):0{depth}b}" for v in row)
        bits += "0" * (-len(bits) % 8)
        out.append([int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)])
    return out


def png(samples, depth, colour, kinds=(0,), interlaced=False, more=b"", palette=None):
    """``samples``: height x width x n."""
    height, width, n = samples.shape
    data = b""
    for x0, y0, dx, dy in ADAM7 if interlaced else ((0, 0, 1, 1),):
        part = samples[y0::dy, x0::dx]
        if part.size:
            data += filtered(packed(part.reshape(len(part), -1), depth), max(1, n * depth // 8), kinds)
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, int(interlaced))
    table = _chunk(b"PLTE", palette.astype(np.uint8).tobytes()) if palette is not None else b""
    half = len(z := zlib.compress(data)) // 2
    return PNG + _chunk(b"IHDR", head) + table + more + _chunk(b"IDAT", z[:half]) + _chunk(b"IDAT", z[half:]) + _chunk(b"IEND", b"")


def plain_phash(pixels):
    """The hash of 32 x 32 pixels by sums of cosines, term by term."""
    n, low = 32, np.zeros((8, 8))
    for u in range(8):
        for v in range(8):
            s = sum(float(pixels[y][x]) * math.cos(math.pi * (2 * x + 1) * v / 64) * math.cos(math.pi * (2 * y + 1) * u / 64) for y in range(n) for x in range(n))
            low[u, v] = s * (2 / n) * (math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1)
    middle = sorted(low.ravel())
    middle = (middle[31] + middle[32]) / 2
    return f"{int(''.join('1' if c > middle else '0' for c in low.ravel()), 2):016x}"


def plain_resize(pixels):
    """Lanczos of three lobes in floating point, rounded after each direction."""

    def across(p):
        height, width = p.shape
        scale = width / 32
        wide = max(scale, 1)
        out = np.zeros((height, 32))
        for k in range(32):
            middle = (k + 0.5) * scale
            at = range(max(0, int(middle - 3 * wide + 0.5)), min(width, int(middle + 3 * wide + 0.5)))
            w = np.array([np.sinc(t := (x + 0.5 - middle) / wide) * np.sinc(t / 3) * (abs(t) < 3) for x in at])
            out[:, k] = p[:, list(at)] @ (w / w.sum())
        return np.clip(np.floor(out + 0.5), 0, 255)

    return across(across(pixels.astype(float)).T).T


@pytest.mark.parametrize(("depth", "colour", "n"), [(1, 0, 1), (2, 0, 1), (4, 0, 1), (8, 0, 1), (16, 0, 1), (8, 2, 3), (16, 2, 3), (8, 4, 2), (8, 6, 4), (16, 6, 4)])
@pytest.mark.parametrize("interlaced", [False, True])
def test_png_pixels(depth, colour, n, interlaced):
    rng = np.random.default_rng(depth + colour)
    for height, width in ((1, 1), (3, 5), (13, 11)):
        x = rng.integers(0, 1 << depth, (height, width, n))
        data = png(x, depth, colour, (0, 1, 2, 3, 4), interlaced)
        chunks = list(images.png_chunks(data))
        got = images.png_grey(chunks, width, height, depth, colour, interlaced)
        full = x >> 8 if depth == 16 else x * 255 // ((1 << depth) - 1) if depth < 8 else x
        want = (full[..., 0] * 19595 + full[..., 1] * 38470 + full[..., 2] * 7471 + 32768) >> 16 if n >= 3 else full[..., 0]
        assert (got == want).all()


def test_png_palettes():
    rng = np.random.default_rng(1)
    palette = rng.integers(0, 256, (5, 3))
    x = rng.integers(0, 5, (6, 7, 1))
    for depth in (4, 8):
        data = png(x, depth, 3, (1, 4), palette=palette)
        got = images.png_grey(list(images.png_chunks(data)), 7, 6, depth, 3, False)
        assert (got == (palette[x[..., 0]] @ [19595, 38470, 7471] + 32768) >> 16).all()
    assert inspect(png(x, 8, 3, palette=palette[:3]))["reason"] == "decode_error"


@pytest.mark.parametrize("size", [(32, 32), (7, 50), (90, 41), (40, 23), (200, 33)])
def test_resized_and_hashed_as_plainly(size):
    x = np.random.default_rng(size[0]).integers(0, 256, size).astype(np.uint8)
    got = images.resized(x)
    assert np.abs(got.astype(int) - plain_resize(x)).max() <= 1
    seen = inspect(png(x[..., None], 8, 0, (2,)))
    assert (seen["format"], seen["width"], seen["height"], seen["reason"]) == ("png", size[1], size[0], None)
    assert seen["phash"] == plain_phash(got) == grey_phash(got)


def test_orientations():
    x = np.arange(6, dtype=np.uint8).reshape(2, 3)
    want = {1: x, 2: np.fliplr(x), 3: np.rot90(x, 2), 4: np.flipud(x), 5: x.T, 6: np.rot90(x, -1), 7: np.rot90(x, 2).T, 8: np.rot90(x)}
    for turn, y in want.items():
        assert (images.upright(x, turn) == y).all()
        seen = inspect(png(np.tile(x[..., None], (9, 5, 1)), 8, 0, more=_chunk(b"eXIf", _tags(turn, "2024:02:30"))))
        shape = np.tile(x, (9, 5)).shape
        assert (seen["height"], seen["width"]) == (shape if turn < 5 else shape[::-1]) and seen["orientation"] == turn and seen["exif_day"] is None


def jpeg(block, frame=0xC0, width=300, height=200):
    app = b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + app + b"\xff\xff" + bytes([frame]) + struct.pack(">HBHHB", 8, 8, height, width, 1) + b"rest"


def test_jpeg_headers():
    seen = inspect(jpeg(b"Exif\0\0" + _tags(8, "2023:07:09 12:00:00"), 0xC2))
    assert (seen["format"], seen["width"], seen["height"], seen["orientation"], seen["exif_day"], seen["phash"], seen["reason"]) == ("jpeg", 200, 300, 8, "2023-07-09", None, None)
    for block in (b"Exif\0\0II*\0\xff\xff\xff\xff", b"Exif\0\0", b"other", b"Exif\0\0" + _tags(9, "2023:13:09")):
        seen = inspect(jpeg(block))
        assert (seen["width"], seen["orientation"], seen["exif_day"], seen["reason"]) == (300, 1, None, None)
    big = b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x03\0\0"
    assert images.exif(big) == (3, None)
    for cut in (4, 9, 24):
        assert inspect(jpeg(b"other")[:cut])["reason"] == "decode_error"


def test_bytes_that_are_no_image(spark):
    good = png(np.zeros((3, 3, 1), int), 8, 0)
    rows = [(1, None), (2, b""), (3, b"GIF89a"), (4, good[:-30]), (5, good[:60] + b"x" + good[61:]), (6, good), (7, good[:8]), (8, png(np.zeros((3, 3, 1), int), 8, 0, (9,)))]
    table = spark.createDataFrame([(k, None if b is None else bytearray(b), "y") for k, b in rows], "id int, content binary, format2 string").repartition(3)
    got = {r.id: r.reason for r in images.inspect_images(table).collect()}
    assert got == {1: "not_an_image", 2: "not_an_image", 3: "not_an_image", 4: "decode_error", 5: "decode_error", 6: None, 7: "not_an_image", 8: "decode_error"}
    assert images.inspect_images(table.limit(0)).count() == 0
