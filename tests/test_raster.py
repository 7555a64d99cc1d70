"""PNG pixels against a plain reader and writer of this test, resampling against its definition, and the shrink steps on true bytes."""

import struct
import zlib

import numpy as np
import pytest

from quadrille.operators import textures
from quadrille.sources import raster


def guess(kind, a, b, c):
    if kind == 4:
        return min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
    return (0, a, b, (a + b) // 2)[kind]


def filtered(rows, step, kinds):
    """Scanlines (lists of bytes) filtered byte by byte."""
    out, above = b"", [0] * len(rows[0])
    for row, kind in zip(rows, kinds, strict=False):
        line = [(v - guess(kind, row[i - step] if i >= step else 0, above[i], above[i - step] if i >= step else 0)) & 255 for i, v in enumerate(row)]
        out += bytes([kind, *line])
        above = row
    return out


def packed(samples, depth):
    """One scanline of samples as bytes."""
    if depth == 16:
        return [b for v in samples for b in divmod(int(v), 256)]
    bits = "".join(f"{int(v):0{depth}b}" for v in samples)
    bits += "0" * (-len(bits) % 8)
    return [int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)]


def png(samples, colour, depth, interlace, rng, more=()):
    """A PNG of samples (h, w, n) written plainly; rows take random filters."""
    h, w, n = samples.shape
    step = max(1, n * depth // 8)
    data = b""
    for r, c, dr, dc in raster.PASSES if interlace else ((0, 0, 1, 1),):
        part = samples[r::dr, c::dc]
        if part.size:
            rows = [packed(row.ravel(), depth) for row in part]
            data += filtered(rows, step, rng.integers(0, 5, len(rows)).tolist())
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)), *more]
    squeezed = zlib.compress(data)
    parts += [(b"IDAT", squeezed[:7]), (b"IDAT", squeezed[7:]), (b"IEND", b"")]
    return raster.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)


def rgba(samples, colour, depth, table=None, alpha=(), key=None):
    """What the samples mean, pixel by pixel."""
    out = np.zeros((*samples.shape[:2], 4), np.uint8)
    most = (1 << depth) - 1
    eight = lambda v: (int(v) * 255 + most // 2) // most
    for y, x in np.ndindex(*samples.shape[:2]):
        s = samples[y, x]
        if colour == 3:
            out[y, x] = [*table[s[0]], alpha[s[0]] if s[0] < len(alpha) else 255]
        else:
            grey = [eight(s[0])] * 3 if colour in (0, 4) else [eight(v) for v in s[:3]]
            last = eight(s[-1]) if colour in (4, 6) else 0 if key is not None and (s == key).all() else 255
            out[y, x] = [*grey, last]
    return out


@pytest.mark.parametrize("colour,depth", [(c, d) for c, depths in raster.DEPTHS.items() for d in depths])
@pytest.mark.parametrize("interlace", [0, 1])
def test_all_colour_types_are_read(colour, depth, interlace):
    rng = np.random.default_rng(colour * 40 + depth)
    for h, w in ((1, 1), (3, 2), (9, 13), (16, 5)):
        samples = rng.integers(0, 1 << depth, (h, w, raster.SAMPLES[colour]))
        table = rng.integers(0, 256, (1 << min(depth, 8), 3)) if colour == 3 else None
        alpha = rng.integers(0, 256, max(1, (1 << min(depth, 8)) // 2)).tolist() if colour == 3 else ()
        key = samples[0, 0] if colour in (0, 2) else None
        more = [(b"PLTE", bytes(table.ravel().tolist())), (b"tRNS", bytes(alpha))] if colour == 3 else [] if key is None else [(b"tRNS", np.asarray(key, ">u2").tobytes())]
        assert (raster.decoded(png(samples, colour, depth, interlace, rng, more)) == rgba(samples, colour, depth, table, alpha, key)).all()


def test_broken_images_are_told():
    rng = np.random.default_rng(1)
    good = png(rng.integers(0, 256, (4, 4, 3)), 2, 8, 0, rng)
    changed = bytearray(good)
    changed[-20] ^= 1
    wide = png(rng.integers(0, 256, (4, 4, 3)), 2, 8, 0, rng).replace(struct.pack(">II", 4, 4), struct.pack(">II", 1 << 20, 1 << 20))
    for data, word in ((b"GIF", "not a PNG"), (good[:-12], "end"), (bytes(changed), "checksum"), (good[:50], "exceeds"), (wide, "checksum"), (png(np.full((2, 2, 1), 3), 3, 8, 0, rng, [(b"PLTE", b"abc")]), "palette")):
        with pytest.raises(raster.RasterError, match=word):
            raster.decoded(data)


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (40, 64)])
def test_written_images_are_read_again(shape):
    rng = np.random.default_rng(2)
    for solid in (True, False):
        pixels = rng.integers(0, 256, (*shape, 4), dtype=np.uint8)
        pixels[..., 3] = 255 if solid else pixels[..., 3]
        data = raster.encoded(pixels)
        assert (raster.decoded(data) == pixels).all() and data[25] == (2 if solid or (pixels[..., 3] == 255).all() else 6)
    smooth = np.full((*shape, 4), 255, np.uint8)
    smooth[..., 0] = np.add.outer(np.arange(shape[0]), np.arange(shape[1])) % 256
    assert (raster.decoded(raster.encoded(smooth)) == smooth).all()


def triangle(pixels, width, height):
    """The filter as defined: for every pixel all weights of its row and column."""
    def along(line, size):
        ratio, out = len(line) / size, []
        for i in range(size):
            at = (i + 0.5) * ratio - 0.5
            w = [max(0.0, 1 - abs(j - at) / max(1.0, ratio)) for j in range(len(line))]
            out.append(sum(x * y for x, y in zip(w, line, strict=True)) / sum(w))
        return out

    high = np.array([along(list(pixels[:, x].astype(float)), height) for x in range(pixels.shape[1])]).transpose(1, 0, 2)
    return np.array([along(list(row), width) for row in high])


@pytest.mark.parametrize("size", [(3, 2), (5, 11), (8, 8), (1, 1), (20, 9)])
def test_resampling_is_the_triangle_filter(size):
    pixels = np.random.default_rng(3).integers(0, 256, (11, 8, 4), dtype=np.uint8)
    assert np.abs(raster.resampled(pixels, *size) - triangle(pixels, *size)).max() <= 0.51
    flat = np.full((9, 9, 4), 77, np.uint8)
    assert (raster.resampled(flat, *size) == 77).all()


def test_textures_shrink_until_their_true_bytes_fit(spark):
    rng = np.random.default_rng(4)
    noise = [raster.encoded(np.dstack([rng.integers(0, 256, (64, 64, 3), dtype=np.uint8), np.full((64, 64), 255, np.uint8)])) for _ in range(3)]
    jpeg = b"\xff\xd8\xff\xc0\x00\x11\x08\x00\x10\x00\x20" + bytes(50)
    rows = [("a", "h0", "image/png", noise[0]), ("a", "h0", "image/png", noise[0]), ("a", "h1", "image/png", noise[1]), ("a", "j", "image/jpeg", jpeg), ("b", "h2", "image/png", noise[2]), ("c", "j", "image/jpeg", jpeg)]
    images = spark.createDataFrame(rows, "node string, hash string, mime string, data binary")
    found, metrics = textures.processed(images, 48, 7_500)
    got = {(r.node, r.hash): r for r in found.collect()}
    m = {r.node: r for r in metrics.collect()}
    assert len(got) == 5 and bytes(got["a", "j"].data) == jpeg and (got["a", "j"].width, got["a", "j"].height) == (32, 16)
    # 64 -> 48 by size, then steps of 0.7 while two noisy pictures are over the budget; one alone fits.
    assert got["b", "h2"].width == 48 and m["b"].steps == 0 and not m["b"].over_budget
    assert got["a", "h0"].width == got["a", "h1"].width == 34 and m["a"].steps == 1 and m["a"].bytes_after <= 7_500
    assert (m["a"].input_count, m["a"].unique_count, m["a"].dedup_removed) == (4, 3, 1)
    wanted = raster.resampled(raster.resampled(raster.decoded(noise[2]), 48, 48), 34, 34)
    assert np.abs(raster.decoded(bytes(textures.resized(found.filter("node = 'b'"), times=0.7).first().data))[..., :3].astype(int) - wanted[..., :3]).max() <= 1
    _, tight = textures.processed(images, 0, 60)
    t = {r.node: r for r in tight.collect()}
    assert t["a"].steps == textures.STEPS and t["a"].over_budget and t["c"].steps == 0 and t["c"].over_budget
