"""PNG images as arrays of RGBA bytes: reading all colour types, depths and interlacing, resampling, writing. Numpy and zlib, one image at a time."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: signature, samples per pixel by colour type, depths, and the passes (first row, first column, steps) of interlacing.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))
#: Pixels of an image that is decoded at most.
MOST_PIXELS = 1 << 28


class RasterError(ValueError):
    """An image that can't be decoded, with the reason."""


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(kind, body) of each chunk up to the end mark; wrong lengths and checksums are errors."""
    if data[:8] != SIGNATURE:
        raise RasterError("not a PNG")
    out, at = [], 8
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise RasterError("a chunk exceeds the file")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise RasterError(f"checksum of {kind.decode('latin-1')} is wrong")
        out.append((kind, body))
        if kind == b"IEND":
            return out
        at += 12 + size
    raise RasterError("the image has no end")


def unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Bytes (h, n) of filtered rows (h, 1 + n); ``step`` bytes make a pixel.

    Rows that lean on the left or the row above alone are summed at once; with the other filters the image is walked by
    diagonals, whose pixels depend on the two diagonals before.
    """
    kinds, h, n = rows[:, 0], len(rows), rows.shape[1] - 1
    if (kinds > 4).any():
        raise RasterError("unknown filter")
    width = -(-n // step)
    values = np.zeros((h, width * step), np.uint8)
    values[:, :n] = rows[:, 1:]
    values = values.reshape(h, width, step)
    if not h or not width:
        return values.reshape(h, -1)[:, :n]
    if (kinds <= 2).all():
        out, above = np.empty_like(values), np.zeros((width, step), np.uint8)
        for r in range(h):
            line = values[r]
            if kinds[r] == 1:
                line = np.cumsum(line, axis=0, dtype=np.uint8)
            elif kinds[r] == 2:
                line = line + above
            out[r] = above = line
        return out.reshape(h, -1)[:, :n]
    full = np.zeros((h + 1, width + 1, step), np.int16)
    kind = kinds.astype(np.intp)[:, None]
    for d in range(h + width - 1):
        r = np.arange(max(0, d - width + 1), min(h - 1, d) + 1)
        c = d - r
        left, above, corner = full[r + 1, c], full[r, c + 1], full[r, c]
        to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
        nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
        guess = np.choose(kind[r], [np.int16(0), left, above, (left + above) >> 1, nearest])
        full[r + 1, c + 1] = (values[r, c] + guess) & 255
    return full[1:, 1:].astype(np.uint8).reshape(h, -1)[:, :n]


def samples_of(raw: np.ndarray, width: int, n: int, depth: int) -> np.ndarray:
    """(h, width, n) samples of unfiltered rows as whole numbers."""
    if depth == 16:
        return raw.reshape(len(raw), width, n, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    if depth < 8:
        bits = np.unpackbits(raw, axis=1).reshape(len(raw), -1, depth)
        return (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint16)[:, : width * n].reshape(len(raw), width, n)
    return raw.reshape(len(raw), width, n).astype(np.uint16)


def decoded(data: bytes) -> np.ndarray:
    """(h, w, 4) RGBA bytes of a PNG. Samples of 16 bits are rounded; a transparent colour or palette gives alpha."""
    parts = chunks(data)
    head = next((b for k, b in parts if k == b"IHDR" and len(b) == 13), None)
    if head is None:
        raise RasterError("the image has no header")
    width, height, depth, colour, method, filters, interlace = struct.unpack(">IIBBBBB", head)
    if colour not in SAMPLES or depth not in DEPTHS[colour] or method or filters or interlace > 1:
        raise RasterError("unknown colour type, depth or method")
    if not width or not height or width * height > MOST_PIXELS:
        raise RasterError("size is out of bounds")
    n, bits = SAMPLES[colour], SAMPLES[colour] * depth
    step = max(1, bits // 8)
    passes = PASSES if interlace else ((0, 0, 1, 1),)
    sizes = [(-(-(height - r) // dr) if height > r else 0, -(-(width - c) // dc) if width > c else 0) for r, c, dr, dc in passes]
    lengths = [h * (1 + -(-w * bits // 8)) if w else 0 for h, w in sizes]
    box = zlib.decompressobj()
    try:
        raw = box.decompress(b"".join(b for k, b in parts if k == b"IDAT"), sum(lengths))
    except zlib.error as e:
        raise RasterError(f"pixels: {e}") from e
    if len(raw) < sum(lengths):
        raise RasterError("pixels are missing")
    pixels, at = np.zeros((height, width, n), np.uint16), 0
    for (r, c, dr, dc), (h, w), length in zip(passes, sizes, lengths, strict=True):
        if length:
            rows = np.frombuffer(raw, np.uint8, length, at).reshape(h, -1)
            pixels[r::dr, c::dc] = samples_of(unfiltered(rows, step), w, n, depth)
            at += length
    rest = dict(parts)
    out = np.full((height, width, 4), 255, np.uint8)
    key = rest.get(b"tRNS")
    if colour == 3:
        table = np.frombuffer(rest.get(b"PLTE", b""), np.uint8)
        if not len(table) or len(table) % 3 or pixels.max() >= len(table) // 3:
            raise RasterError("the palette is missing or too short")
        alpha = np.full(256, 255, np.uint8)
        alpha[: len(key or b"")] = np.frombuffer(key or b"", np.uint8)[:256]
        out[..., :3], out[..., 3] = table.reshape(-1, 3)[pixels[..., 0]], alpha[pixels[..., 0]]
        return out
    most = (1 << depth) - 1
    scaled = ((pixels.astype(np.uint32) * 255 + most // 2) // most).astype(np.uint8)
    out[..., :3] = scaled[..., :3] if n >= 3 else scaled[..., :1]
    if n in (2, 4):
        out[..., 3] = scaled[..., -1]
    elif key is not None and len(key) >= 2 * n:
        out[..., 3] = np.where((pixels == np.frombuffer(key[: 2 * n], ">u2")).all(-1), 0, 255)
    return out


def resampled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size by a triangle filter, which is widened by the ratio where the image shrinks; one axis after the other."""
    out = pixels.astype(np.float32)
    for axis, size in ((0, height), (1, width)):
        have = out.shape[axis]
        if have == size:
            continue
        ratio = have / size
        reach = max(1.0, ratio)
        centre = (np.arange(size) + 0.5) * ratio - 0.5
        window = np.floor(centre - reach).astype(int)[:, None] + np.arange(int(np.ceil(2 * reach)) + 2)
        weights = np.maximum(0.0, 1 - np.abs(window - centre[:, None]) / reach) * ((window >= 0) & (window < have))
        weights = (weights / weights.sum(1, keepdims=True)).astype(np.float32)
        window = window.clip(0, have - 1)
        lines = np.moveaxis(out, axis, 0)
        lines = sum(weights[:, k, None, None] * lines[window[:, k]] for k in range(window.shape[1]))
        out = np.moveaxis(lines, 0, axis)
    return np.rint(out).clip(0, 255).astype(np.uint8)


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    """The size with its longer edge at ``most``, where it is longer; 0 keeps the size."""
    if not most or max(width, height) <= most:
        return width, height
    scale = most / max(width, height)
    return max(1, int(width * scale + 0.5)), max(1, int(height * scale + 0.5))


def encoded(pixels: np.ndarray) -> bytes:
    """A PNG of RGBA bytes, without alpha where all is opaque. Each row takes the filter with the least sum of differences."""
    height, width = pixels.shape[:2]
    opaque = bool((pixels[..., 3] == 255).all())
    values = np.ascontiguousarray(pixels[..., :3] if opaque else pixels).astype(np.int16)
    left, above, corner = (np.zeros_like(values) for _ in range(3))
    left[:, 1:], above[1:], corner[1:, 1:] = values[:, :-1], values[:-1], values[:-1, :-1]
    to_left, to_above, to_corner = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
    nearest = np.where((to_left <= to_above) & (to_left <= to_corner), left, np.where(to_above <= to_corner, above, corner))
    tries = np.stack([(values - guess).astype(np.uint8).reshape(height, -1) for guess in (0, left, above, (left + above) >> 1, nearest)])
    kinds = np.abs(tries.astype(np.int8).astype(np.int32)).sum(2).argmin(0)
    rows = np.column_stack([kinds.astype(np.uint8), tries[kinds, np.arange(height)]])
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if opaque else 6, 0, 0, 0)
    parts = ((b"IHDR", head), (b"IDAT", zlib.compress(rows.tobytes(), 6)), (b"IEND", b""))
    return SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)
