"""Clipping and flattening of triangles, in batches of numpy arrays.

Polygons of a batch are padded arrays: values (n, k, d) and counts (n). A vertex is its attributes; columns ``xy`` hold its
place in the region's plane. One half-plane cuts all polygons at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrille.operators.region import Region

WALL, EDGE_NEAR = 1e-5, 1e-5


def edge_distances(part: np.ndarray, edge: int, xy: np.ndarray) -> np.ndarray:
    a, b = part[edge], part[(edge + 1) % len(part)]
    d = b - a
    return (d[0] * (xy[..., 1] - a[1]) - d[1] * (xy[..., 0] - a[0])) / np.hypot(*d)


def packed(values: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move the kept slots of each row to its front."""
    counts = keep.sum(1)
    order = np.argsort(~keep, axis=1, kind="stable")[:, : max(1, int(counts.max(initial=0)))]
    return np.take_along_axis(values, order[..., None], 1), counts


def halved(values: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Cut polygons by the line where ``d`` is 0: (inside, outside), each with values and counts. Points on the line are inside."""
    n, k, _ = values.shape
    slot = np.arange(k)[None, :]
    there = slot < counts[:, None]
    before = np.where(slot == 0, np.maximum(counts - 1, 0)[:, None], slot - 1)
    d_before = np.take_along_axis(d, before, 1)
    v_before = np.take_along_axis(values, before[..., None], 1)
    crosses = there & ((d_before >= 0) != (d >= 0))
    gap = np.where(crosses, d_before - d, 1.0)
    t = np.clip(np.where(crosses, d_before, 0.0) / gap, 0, 1)
    cut = v_before + (values - v_before) * t[..., None]
    both = np.stack([cut, values], 2).reshape(n, 2 * k, -1)
    inside = np.stack([crosses, there & (d >= 0)], 2).reshape(n, 2 * k)
    outside = np.stack([crosses, there & (d < 0)], 2).reshape(n, 2 * k)
    return packed(both, inside), packed(both, outside)


def padded(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join (values, counts, source) lists into one batch."""
    pieces = [p for p in pieces if len(p[1])]
    if not pieces:
        return np.empty((0, 3, width)), np.empty(0, int), np.empty(0, int)
    k = max(p[0].shape[1] for p in pieces)
    return np.concatenate([np.pad(v, ((0, 0), (0, k - v.shape[1]), (0, 0))) for v, _, _ in pieces]), np.concatenate([c for _, c, _ in pieces]), np.concatenate([s for _, _, s in pieces])


Batch = tuple[np.ndarray, np.ndarray, np.ndarray]


def partition(region: Region, triangles: np.ndarray, xy: slice) -> tuple[Batch, Batch]:
    """Split triangles (n, 3, d) into disjoint polygons inside and outside the region, each with the triangle it came from. Areas add up."""
    width = triangles.shape[2]
    rest = (triangles, np.full(len(triangles), 3), np.arange(len(triangles)))
    inside: list[Batch] = []
    for part in region.parts:
        values, counts, source = rest
        there = np.arange(values.shape[1])[None, :] < counts[:, None]
        apart = np.zeros(len(counts), bool)
        for e in range(len(part)):
            apart |= ((edge_distances(part, e, values[..., xy]) < 0) | ~there).all(1)
        after: list[Batch] = [(values[apart], counts[apart], source[apart])]
        live = (values[~apart], counts[~apart], source[~apart])
        for e in range(len(part)):
            values, counts, source = live
            if not len(counts):
                break
            (iv, ic), (ov, oc) = halved(values, counts, edge_distances(part, e, values[..., xy]))
            after.append((ov[oc >= 3], oc[oc >= 3], source[oc >= 3]))
            live = (iv[ic >= 3], ic[ic >= 3], source[ic >= 3])
        inside.append(live)
        rest = padded(after, width)
    return padded(inside, width), rest


def clipped(region: Region, triangles: np.ndarray, xy: slice) -> Batch:
    """The polygons of triangles within the region."""
    return partition(region, triangles, xy)[0]


def fans(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """Triangles (m, 3, d) of convex polygons, from their first vertex, and their sources."""
    values, counts, source = batch
    if not len(counts):
        return np.empty((0, 3, values.shape[2])), np.empty(0, int)
    k = np.arange(1, values.shape[1] - 1)
    poly, at = np.nonzero(k[None, :] + 1 < counts[:, None])
    return np.stack([values[poly, 0], values[poly, at + 1], values[poly, at + 2]], 1), source[poly]


def polygon_area(batch: Batch, xy: slice) -> np.ndarray:
    """Unsigned area of each polygon in the plane."""
    tri, source = fans((batch[0], batch[1], np.arange(len(batch[1]))))
    p = tri[..., xy]
    each = np.abs((p[:, 1, 0] - p[:, 0, 0]) * (p[:, 2, 1] - p[:, 0, 1]) - (p[:, 1, 1] - p[:, 0, 1]) * (p[:, 2, 0] - p[:, 0, 0])) / 2
    return np.bincount(source, each, len(batch[1]))


def solid(tri: np.ndarray, at: slice, least: float = 1e-20) -> np.ndarray:
    """Which triangles have an area: the square of the edges' cross product is at least ``least``."""
    p = tri[..., at]
    return (np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]) ** 2).sum(1) >= least


def face_frames(tri: np.ndarray, at: slice, uv: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals (m, 3) and tangents with handedness (m, 4) of triangles, from positions and texture coordinates where these span an area."""
    p = tri[..., at]
    ab, ac = p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    normal = unit(np.cross(ab, ac))
    tangent, sign = unit(ab), np.ones(len(tri))
    if uv is not None:
        d1, d2 = tri[:, 1, uv] - tri[:, 0, uv], tri[:, 2, uv] - tri[:, 0, uv]
        det = d1[:, 0] * d2[:, 1] - d2[:, 0] * d1[:, 1]
        ok = np.abs(det) > 1e-12
        safe = np.where(ok, det, 1.0)[:, None]
        t = (ab * d2[:, 1:2] - ac * d1[:, 1:2]) / safe
        b = (ac * d1[:, 0:1] - ab * d2[:, 0:1]) / safe
        ok &= np.linalg.norm(t, axis=1) > 1e-12
        tangent = np.where(ok[:, None], unit(np.where(ok[:, None], t, 1.0)), tangent)
        sign = np.where(ok & ((np.cross(normal, tangent) * b).sum(1) < 0), -1.0, 1.0)
    return normal, np.column_stack([tangent, sign])


def flattened(region: Region, triangles: np.ndarray, height: float) -> dict[str, np.ndarray]:
    """Flatten what lies in the region to a height, with walls at the region's edges.

    triangles: (n, 3, d), positions in the region's frame first, then any attributes. Gives kept (outside), flat and wall triangles. A wall stands where an edge of an
    inside polygon lies on an edge of the region and is off the height; where it crosses the height it is two walls.
    """
    xy = slice(0, 2)
    inside, outside = partition(region, triangles, xy)
    low = (inside[0].copy(), inside[1], inside[2])
    low[0][..., 2] = height
    flat, flat_source = fans((low[0], low[1], np.arange(len(low[1]))))
    good = solid(flat, slice(0, 3)) if len(flat) else np.empty(0, bool)
    has_flat = np.isin(np.arange(len(inside[1])), flat_source[good])
    values, counts, _ = inside
    walls = []
    if len(counts):
        slot = np.arange(values.shape[1])[None, :]
        poly, at = np.nonzero((slot < counts[:, None]) & has_flat[:, None])
        a, b = values[poly, at], values[poly, np.where(at + 1 < counts[poly], at + 1, 0)]
        taken = np.zeros(len(a), bool)
        for e in range(len(region.polygon)):
            start, end = region.polygon[e], region.polygon[(e + 1) % len(region.polygon)]
            d = end - start
            along = lambda p, s=start, d=d: (p[:, :2] - s) @ d
            on = ~taken
            for p in (a, b):
                on &= (np.abs(edge_distances(region.polygon, e, p[:, :2])) < EDGE_NEAR) & (along(p) >= -1e-6) & (along(p) <= d @ d + 1e-6)
            taken |= on
            p, q = a[on], b[on]
            turned = ((q - p)[:, :2] @ d) < 0
            p, q = np.where(turned[:, None], q, p), np.where(turned[:, None], p, q)
            da, db = p[:, 2] - height, q[:, 2] - height
            split = da * db < 0
            t = np.where(split, da / np.where(split, da - db, 1.0), 0.0)
            mid = p + (q - p) * t[:, None]
            walls += [(p[~split], q[~split]), (p[split], mid[split]), (mid[split], q[split])]
    made = []
    for p, q in walls:
        off = np.maximum(np.abs(p[:, 2] - height), np.abs(q[:, 2] - height)) >= WALL
        p, q = p[off], q[off]
        fp, fq = p.copy(), q.copy()
        fp[:, 2] = fq[:, 2] = height
        below = p[:, 2] + q[:, 2] < 2 * height
        for tri in (np.stack([p, fp, fq], 1), np.stack([p, fq, q], 1)):
            made.append(np.where(below[:, None, None], tri[:, [0, 2, 1]], tri))
    wall = np.concatenate(made) if made else np.empty((0, 3, triangles.shape[2]))
    wall = wall[solid(wall, slice(0, 3))] if len(wall) else wall
    kept, _ = fans(outside)
    return {"kept": kept, "flat": flat[good], "wall": wall}


def clip_triangles(df: DataFrame, region: Region, key: str = "id") -> DataFrame:
    """Cut triangles by a region: (key, side, area, xs, ys, zs) of the fragments' triangles, in and out.

    df: key long and x0 .. z2. Run it after boxes that the region excludes were filtered out in SQL. No shuffle.
    """
    names = [f"{a}{i}" for i in range(3) for a in "xyz"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tri = batch[names].to_numpy(float).reshape(-1, 3, 3)
            out = []
            for side, polygons in zip(("in", "out"), partition(region, tri, slice(0, 2)), strict=True):
                frag, source = fans(polygons)
                p = frag[..., :2]
                area = np.abs((p[:, 1, 0] - p[:, 0, 0]) * (p[:, 2, 1] - p[:, 0, 1]) - (p[:, 1, 1] - p[:, 0, 1]) * (p[:, 2, 0] - p[:, 0, 0])) / 2
                out.append(pd.DataFrame({key: batch[key].to_numpy()[source], "side": side, "area": area, "xs": list(frag[..., 0]), "ys": list(frag[..., 1]), "zs": list(frag[..., 2])}))
            yield pd.concat(out, ignore_index=True)

    return df.select(key, *names).mapInPandas(run, f"{key} long, side string, area double, xs array<double>, ys array<double>, zs array<double>")


def flatten_triangles(df: DataFrame, region: Region, height: float) -> DataFrame:
    """Flatten triangles within a region: (kind, xs, ys, zs) with kind kept, flat or wall. No shuffle."""
    names = [f"{a}{i}" for i in range(3) for a in "xyz"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for kind, tri in flattened(region, batch[names].to_numpy(float).reshape(-1, 3, 3), height).items():
                yield pd.DataFrame({"kind": kind, "xs": list(tri[..., 0]), "ys": list(tri[..., 1]), "zs": list(tri[..., 2])})

    return df.select(*names).mapInPandas(run, "kind string, xs array<double>, ys array<double>, zs array<double>")
