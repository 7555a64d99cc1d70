"""Geographic regions: parsing, limits, convex parts, and tests of points and boxes against them.

A region is a small constant (3 to 256 vertices), made once on the driver and put into expressions as literals.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geodesy import A, E2

#: Limits of a region.
LEAST_VERTICES, MOST_VERTICES, MOST_LON, MOST_LAT, MOST_SPAN, MOST_RADIUS, LEAST_AREA = 3, 256, 180.0, 80.0, 1.0, 10_000.0, 1e-4
TOUCH = 1e-6


class RegionError(ValueError):
    """A region that is not supported, with the reason."""


def turn(a, b, p):
    """Twice the signed area of a, b, p; arrays broadcast."""
    return (b[..., 0] - a[..., 0]) * (p[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (p[..., 0] - a[..., 0])


def check_ring(ring: np.ndarray) -> None:
    """Reject repeated vertices and edges that cross or touch others than their neighbours; all pairs of a bounded ring at once."""
    n = len(ring)
    i, j = np.triu_indices(n, 1)
    if (np.hypot(*(ring[i] - ring[j]).T) < TOUCH).any():
        raise RegionError("clip polygon has repeated vertices")
    apart = (j > i + 1) & ~((i == 0) & (j == n - 1))
    a, b, c, d = ring[i[apart]], ring[(i[apart] + 1) % n], ring[j[apart]], ring[(j[apart] + 1) % n]
    cross = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    on = lambda p, q, r: (np.abs(turn(p, q, r)) <= TOUCH) & (r >= np.minimum(p, q) - TOUCH).all(-1) & (r <= np.maximum(p, q) + TOUCH).all(-1)
    if (cross | on(a, b, c) | on(a, b, d) | on(c, d, a) | on(c, d, b)).any():
        raise RegionError("clip polygon must not self-intersect or touch itself")


def convex_parts(ring: np.ndarray) -> list[np.ndarray]:
    """A counter-clockwise simple ring as convex parts: itself if convex, else triangles cut off ear by ear."""
    if (turn(ring, np.roll(ring, -1, 0), np.roll(ring, -2, 0)) >= 0).all():
        return [ring]
    left, parts = np.arange(len(ring)), []
    while len(left) > 3:
        a, b, c = ring[np.roll(left, 1)], ring[left], ring[np.roll(left, -1)]
        for k in np.flatnonzero(turn(a, b, c) > 1e-10):
            others = ring[np.setdiff1d(left, left[[k - 1, k, (k + 1) % len(left)]])]
            inside = (turn(a[k], b[k], others) >= -1e-10) & (turn(b[k], c[k], others) >= -1e-10) & (turn(c[k], a[k], others) >= -1e-10)
            if not inside.any():
                parts.append(np.stack([a[k], b[k], c[k]]))
                left = np.delete(left, k)
                break
        else:
            raise RegionError("clip polygon cannot be decomposed reliably; adjust nearly collinear vertices")
    return [*parts, ring[left]]


@dataclass(frozen=True)
class Region:
    """frame: column-major matrix from earth-centred to east, north, up at the centre; polygon and parts in that plane, counter-clockwise."""

    frame: tuple[float, ...]
    polygon: np.ndarray
    parts: tuple[np.ndarray, ...]

    @staticmethod
    def planar(ring) -> Region:
        """A region given in its own plane, for data without a place on earth."""
        polygon = np.asarray(ring, float)
        area = float(np.sum(polygon[:, 0] * np.roll(polygon[:, 1], -1) - polygon[:, 1] * np.roll(polygon[:, 0], -1)))
        if abs(area) < LEAST_AREA:
            raise RegionError("clip region has zero area")
        polygon = polygon[::-1] if area < 0 else polygon
        check_ring(polygon)
        return Region(tuple(np.eye(4).ravel()), polygon, tuple(convex_parts(polygon)))


def ecef(lon: np.ndarray, lat: np.ndarray, height: float = 0.0) -> np.ndarray:
    lo, la = np.radians(lon), np.radians(lat)
    n = A / np.sqrt(1 - E2 * np.sin(la) ** 2)
    return np.stack([(n + height) * np.cos(la) * np.cos(lo), (n + height) * np.cos(la) * np.sin(lo), (n * (1 - E2) + height) * np.sin(la)], -1)


def ring_of(region: dict) -> np.ndarray:
    """The open ring of a rectangle, GeoJSON polygon or feature."""
    if "crs" in region:
        raise RegionError("GeoJSON CRS overrides are unsupported; provide WGS84 longitude/latitude")
    kind = region.get("type")
    if kind == "Feature":
        return ring_of(region.get("geometry") or {})
    if kind == "rectangle":
        w, s, e, n = map(float, region["bounds"])
        if w >= e or s >= n:
            raise RegionError("rectangle bounds must be west,south,east,north")
        return np.array([[w, s], [e, s], [e, n], [w, n]])
    if kind != "Polygon":
        raise RegionError("region must be rectangle or GeoJSON Polygon/Feature")
    rings = region.get("coordinates")
    if not isinstance(rings, list) or len(rings) != 1:
        raise RegionError("clip supports one polygon ring without holes")
    ring = np.asarray(rings[0], float)
    if ring.ndim != 2 or ring.shape[1] != 2 or len(ring) < 2 or (ring[0] != ring[-1]).any():
        raise RegionError("GeoJSON ring must be closed")
    return ring[:-1]


def parse(region: dict | str) -> Region:
    """A checked region. Raises RegionError with the reason otherwise."""
    ring = ring_of(json.loads(region) if isinstance(region, str) else region)
    if not LEAST_VERTICES <= len(ring) <= MOST_VERTICES:
        raise RegionError("clip polygon requires 3..256 vertices")
    if (np.abs(ring[:, 0]) > MOST_LON).any() or (np.abs(ring[:, 1]) > MOST_LAT).any() or not np.isfinite(ring).all():
        raise RegionError("clip longitude must be within ±180°, latitude within ±80°")
    lon, lat = ring.mean(0)
    lo, la = math.radians(lon), math.radians(lat)
    axes = np.array([[-math.sin(lo), math.cos(lo), 0], [-math.sin(la) * math.cos(lo), -math.sin(la) * math.sin(lo), math.cos(la)], [math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)]])
    origin = ecef(lon, lat)
    matrix = np.eye(4)
    matrix[:3, :3], matrix[:3, 3] = axes, -axes @ origin
    plane = (ecef(ring[:, 0], ring[:, 1]) - origin) @ axes.T
    if (np.abs(ring[:, 0] - lon) > MOST_SPAN).any() or (np.hypot(plane[:, 0], plane[:, 1]) > MOST_RADIUS).any():
        raise RegionError("clip region must fit within 10 km of its center and must not cross the date line")
    flat = Region.planar(plane[:, :2])
    return Region(tuple(matrix.T.ravel()), flat.polygon, flat.parts)


def edge_distance(part: np.ndarray, edge: int, x: Column, y: Column) -> Column:
    """Signed distance of a point from an edge's line, positive inside."""
    (ax, ay), (bx, by) = part[edge].tolist(), part[(edge + 1) % len(part)].tolist()
    length = math.hypot(bx - ax, by - ay)
    return ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / length


def contains(region: Region, x: Column, y: Column, tolerance: float = 0.0) -> Column:
    """Whether a point in the region's plane is in any convex part; the border belongs to it."""
    out = F.lit(False)
    for part in region.parts:
        inside = F.lit(True)
        for e in range(len(part)):
            inside = inside & (edge_distance(part, e, x, y) >= -tolerance)
        out = out | inside
    return out


def excludes_box(region: Region, lo_x: Column, lo_y: Column, hi_x: Column, hi_y: Column) -> Column:
    """Whether for every part some edge has the whole box outside: such content needs no geometry work."""
    corners = [(x, y) for x in (lo_x, hi_x) for y in (lo_y, hi_y)]
    out = F.lit(True)
    for part in region.parts:
        apart = F.lit(False)
        for e in range(len(part)):
            beyond = F.lit(True)
            for x, y in corners:
                beyond = beyond & (edge_distance(part, e, x, y) < 0)
            apart = apart | beyond
        out = out & apart
    return out


def even_odd(ring: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """The crossing rule: whether a ray to the right crosses the ring an odd number of times."""
    n = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
            n = n + F.when(crosses, 1).otherwise(0)
    return n % 2 == 1


def ring_crossings(edges: DataFrame) -> DataFrame:
    """(ring, i, j) of edges of one ring that properly cross; edges: ring, i, n, ax, ay, bx, by. A ring has 256 edges at most, so its pairs are bounded."""
    a, b = (edges.select("ring", "n", *(F.col(c).alias(f"{s}_{c}") for c in ("i", "ax", "ay", "bx", "by"))) for s in "pq")
    side = lambda s, px, py: (F.col(f"{s}_bx") - F.col(f"{s}_ax")) * (py - F.col(f"{s}_ay")) - (F.col(f"{s}_by") - F.col(f"{s}_ay")) * (px - F.col(f"{s}_ax"))
    both = a.join(b, ["ring", "n"]).filter((F.col("p_i") + 1 < F.col("q_i")) & ~((F.col("p_i") == 0) & (F.col("q_i") == F.col("n") - 1)))
    crossing = (side("p", F.col("q_ax"), F.col("q_ay")) * side("p", F.col("q_bx"), F.col("q_by")) < 0) & (side("q", F.col("p_ax"), F.col("p_ay")) * side("q", F.col("p_bx"), F.col("p_by")) < 0)
    return both.filter(crossing).select("ring", F.col("p_i").alias("i"), F.col("q_i").alias("j"))


def nearest_height(vertices: DataFrame, samples: DataFrame) -> DataFrame:
    """Each region vertex with the height of its nearest sample. A region has few vertices, so they are broadcast and samples are aggregated in place."""
    d = (F.col("vx") - F.col("x")) * (F.col("vx") - F.col("x")) + (F.col("vy") - F.col("y")) * (F.col("vy") - F.col("y"))
    return samples.join(F.broadcast(vertices)).groupBy("vertex").agg(F.min_by("z", F.struct(d.alias("d"), F.col("z"))).alias("height"))
