"""WGS84 positions and frames, and bounds of geographic regions, in column expressions. Angles of arguments are degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions import matrix as M

#: The WGS84 semi-major axis and squared eccentricity.
A, E2 = 6378137.0, 6.6943799901413165e-3


def ecef(lon: Column, lat: Column, height: Column) -> Column:
    """Geodetic position to earth-centred x, y, z."""
    return M.let(_ecef, lon, lat, height)


def _ecef(lon: Column, lat: Column, height: Column) -> Column:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    sl, cl = F.sin(F.radians(lon)), F.cos(F.radians(lon))
    n = A / F.sqrt(1 - E2 * s * s)
    return M.vector((n + height) * c * cl, (n + height) * c * sl, (n * (1 - E2) + height) * s)


def enu_frame(lon: Column, lat: Column, height: Column) -> Column:
    """Matrix from east, north, up at a place to earth-centred."""
    return M.let(lambda a, b, p: _enu_frame(a, b, p), lon, lat, ecef(lon, lat, height))


def _enu_frame(lon: Column, lat: Column, p: Column) -> Column:
    s, c = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    sl, cl = F.sin(F.radians(lon)), F.cos(F.radians(lon))
    return M.vector(-sl, cl, 0, 0, -s * cl, -s * sl, c, 0, c * cl, c * sl, s, 0, F.get(p, 0), F.get(p, 1), F.get(p, 2), 1)


def is_earth_centred(x: Column, y: Column, z: Column) -> Column:
    """Whether a position is at an earth radius from the centre: 6.0e6 to 7.0e6 metres."""
    return F.sqrt(x * x + y * y + z * z).between(6.0e6, 7.0e6)


def region_frame(lon: Column, lat: Column) -> Column:
    """Matrix from earth-centred to east, north, up at a region's centre on the ellipsoid."""
    return M.affine_inverse(enu_frame(lon, lat, F.lit(0.0)))


def placement(lon: Column, lat: Column, height: Column, heading: Column, pitch: Column, roll: Column, pivot: Column | None = None) -> Column:
    """Matrix that puts a model at a place: roll about x, pitch about -y, heading about -z (angles in degrees), all in the place's east-north-up frame; ``pivot`` of the model goes to the place."""
    (sh, ch), (sp, cp), (sr, cr) = ((F.sin(F.radians(a)), F.cos(F.radians(a))) for a in (heading, pitch, roll))
    about_z = M.vector(ch, -sh, 0, 0, sh, ch, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)
    about_y = M.vector(cp, 0, sp, 0, 0, 1, 0, 0, -sp, 0, cp, 0, 0, 0, 0, 1)
    about_x = M.vector(1, 0, 0, 0, 0, cr, sr, 0, 0, -sr, cr, 0, 0, 0, 0, 1)
    m = M.multiply(enu_frame(lon, lat, height), M.multiply(about_z, M.multiply(about_y, about_x)))
    if pivot is None:
        return m
    return M.multiply(m, M.translation(-F.get(pivot, 0), -F.get(pivot, 1), -F.get(pivot, 2)))


def _cos_bounds(a: Column, b: Column) -> tuple[Column, Column]:
    """Least and greatest cosine between two angles in radians (a <= b): the ends, and every multiple of pi between."""
    ends = (F.least(F.cos(a), F.cos(b)), F.greatest(F.cos(a), F.cos(b)))
    holds = lambda phase: F.floor((b - phase) / (2 * math.pi)) >= F.ceil((a - phase) / (2 * math.pi))
    return F.when(holds(math.pi), -1.0).otherwise(ends[0]), F.when(holds(0.0), 1.0).otherwise(ends[1])


def _product(x: tuple[Column, Column], y: tuple[Column, Column]) -> tuple[Column, Column]:
    all_ = [a * b for a in x for b in y]
    return F.least(*all_), F.greatest(*all_)


def region_bounds(west: Column, south: Column, east: Column, north: Column, low: Column, high: Column) -> Column:
    """Conservative earth-centred (min x, y, z, max x, y, z) of a region in radians; east below west crosses the date line. Interval arithmetic, so every point of the region is inside."""
    return M.let(_region_bounds, west, south, F.when(east < west, east + 2 * math.pi).otherwise(east), north, low, high)


def _region_bounds(west: Column, south: Column, to: Column, north: Column, low: Column, high: Column) -> Column:
    cos_lon, sin_lon = _cos_bounds(west, to), _cos_bounds(west - math.pi / 2, to - math.pi / 2)
    cos_lat, sin_lat = _cos_bounds(south, north), (F.sin(south), F.sin(north))
    squares = (F.when((south <= 0) & (north >= 0), 0.0).otherwise(F.least(sin_lat[0] * sin_lat[0], sin_lat[1] * sin_lat[1])), F.greatest(sin_lat[0] * sin_lat[0], sin_lat[1] * sin_lat[1]))
    radius = (A / F.sqrt(1 - E2 * squares[0]), A / F.sqrt(1 - E2 * squares[1]))
    of = lambda c: (F.get(c, 0), F.get(c, 1))
    z = _product((radius[0] * (1 - E2) + low, radius[1] * (1 - E2) + high), sin_lat)

    def body(flat: Column, lon_c: Column, lon_s: Column, up: Column) -> Column:
        x, y = _product(of(flat), of(lon_c)), _product(of(flat), of(lon_s))
        return M.vector(x[0], y[0], F.get(up, 0), x[1], y[1], F.get(up, 1))

    return M.let(body, F.array(*_product((radius[0] + low, radius[1] + high), cos_lat)), F.array(*cos_lon), F.array(*sin_lon), F.array(*z))
