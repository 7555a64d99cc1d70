"""4x4 matrices as column-major array<double>(16), points and boxes, in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Determinants below this count as singular.
SINGULAR = 1e-15


def let(body: Callable[..., Column], *values: Column) -> Column:
    """``body`` of the values, each of which is evaluated once, however often the body uses it; keeps nested expressions small."""
    bound = F.array(F.struct(*(v.alias(f"v{i}") for i, v in enumerate(values))))
    return F.get(F.transform(bound, lambda s: body(*(s[f"v{i}"] for i in range(len(values))))), 0)


def at(m: Column, row: int, col: int) -> Column:
    """Element of a column-major matrix."""
    return F.get(m, col * 4 + row)


def vector(*values: Column | float) -> Column:
    return F.array(*(v if isinstance(v, Column) else F.lit(float(v)) for v in values))


def identity() -> Column:
    return vector(*(float(i % 5 == 0) for i in range(16)))


def translation(x: Column, y: Column, z: Column) -> Column:
    return vector(1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, x, y, z, 1)


def multiply(a: Column, b: Column) -> Column:
    """a * b, so that a point goes through b first."""
    return let(_multiply, a, b)


def _multiply(a: Column, b: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: sum((F.get(a, (i % 4) + 4 * k) * F.get(b, F.floor(i / 4).cast("int") * 4 + k) for k in range(1, 4)), F.get(a, i % 4) * F.get(b, F.floor(i / 4).cast("int") * 4)))


def transform_point(m: Column, p: Column, perspective: bool = False) -> Column:
    """m * (p, 1); with ``perspective`` divided by w where that is not nearly zero."""
    return let(lambda a, b: _transform_point(a, b, perspective), m, p)


def _transform_point(m: Column, p: Column, perspective: bool) -> Column:
    out = [at(m, r, 0) * F.get(p, 0) + at(m, r, 1) * F.get(p, 1) + at(m, r, 2) * F.get(p, 2) + at(m, r, 3) for r in range(4)]
    if not perspective:
        return vector(*out[:3])
    return F.when(F.abs(out[3]) > 1e-12, vector(*(v / out[3] for v in out[:3]))).otherwise(vector(*out[:3]))


def transform_direction(m: Column, d: Column) -> Column:
    """The linear part only."""
    return let(lambda a, v: vector(*(at(a, r, 0) * F.get(v, 0) + at(a, r, 1) * F.get(v, 1) + at(a, r, 2) * F.get(v, 2) for r in range(3))), m, d)


def cofactors(m: Column) -> list[list[Column]]:
    """Cofactors of the upper 3x3 block, by row and column."""
    def minor(r: int, c: int) -> Column:
        rs, cs = [i for i in range(3) if i != r], [i for i in range(3) if i != c]
        value = at(m, rs[0], cs[0]) * at(m, rs[1], cs[1]) - at(m, rs[0], cs[1]) * at(m, rs[1], cs[0])
        return value if (r + c) % 2 == 0 else -value

    return [[minor(r, c) for c in range(3)] for r in range(3)]


def determinant3(m: Column) -> Column:
    co = cofactors(m)
    return at(m, 0, 0) * co[0][0] + at(m, 0, 1) * co[0][1] + at(m, 0, 2) * co[0][2]


def affine_inverse(m: Column) -> Column:
    """Inverse of an affine matrix; null where it is singular."""
    return let(_affine_inverse, m)


def _affine_inverse(m: Column) -> Column:
    co, det = cofactors(m), determinant3(m)
    inv = [[co[c][r] / det for c in range(3)] for r in range(3)]
    moved = [-(inv[r][0] * at(m, 0, 3) + inv[r][1] * at(m, 1, 3) + inv[r][2] * at(m, 2, 3)) for r in range(3)]
    columns = [v for c in range(3) for v in (inv[0][c], inv[1][c], inv[2][c], 0)]
    return F.when(F.abs(det) >= SINGULAR, vector(*columns, *moved, 1))


def is_affine(m: Column) -> Column:
    """Sixteen finite numbers, last row (0, 0, 0, 1), not singular."""
    return let(_is_affine, m)


def _is_affine(m: Column) -> Column:
    finite = F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    last = (at(m, 3, 0) == 0) & (at(m, 3, 1) == 0) & (at(m, 3, 2) == 0) & (at(m, 3, 3) == 1)
    return F.coalesce((F.size(m) == 16) & finite & last & (F.abs(determinant3(m)) >= SINGULAR), F.lit(False))


def max_abs_diff(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def relative_transform(parent: Column, child: Column) -> Column:
    """The local matrix with parent * local = child."""
    return multiply(affine_inverse(parent), child)


def trs(t: Column, q: Column, s: Column) -> Column:
    """Matrix of translation, rotation (x, y, z, w) and scale; null unless the quaternion has length 1 within 1e-5."""
    return let(_trs, t, q, s)


def _trs(t: Column, q: Column, s: Column) -> Column:
    x, y, z, w = (F.get(q, i) for i in range(4))
    a, b, c = (F.get(s, i) for i in range(3))
    m = vector(
        (1 - 2 * (y * y + z * z)) * a, 2 * (x * y + z * w) * a, 2 * (x * z - y * w) * a, 0,
        2 * (x * y - z * w) * b, (1 - 2 * (x * x + z * z)) * b, 2 * (y * z + x * w) * b, 0,
        2 * (x * z + y * w) * c, 2 * (y * z - x * w) * c, (1 - 2 * (x * x + y * y)) * c, 0,
        F.get(t, 0), F.get(t, 1), F.get(t, 2), 1,
    )
    return F.when(F.abs(F.sqrt(x * x + y * y + z * z + w * w) - 1) <= 1e-5, m)


def box_half_extents(box: Column, m: Column | None = None) -> list[Column]:
    """Half sizes of the axis-aligned hull of a 12-number box, optionally after an affine matrix: sums of absolute half axes."""
    axes = [[F.get(box, 3 + 3 * k + r) for r in range(3)] for k in range(3)]
    if m is not None:
        axes = [[sum((at(m, r, c) * axis[c] for c in (1, 2)), at(m, r, 0) * axis[0]) for r in range(3)] for axis in axes]
    return [F.abs(axes[0][r]) + F.abs(axes[1][r]) + F.abs(axes[2][r]) for r in range(3)]


def box_aabb(box: Column, m: Column | None = None) -> Column:
    """(min x, y, z, max x, y, z) of a box in the frame that ``m`` leads to."""
    return let(_box_aabb, box) if m is None else let(_box_aabb, box, m)


def _box_aabb(box: Column, m: Column | None = None) -> Column:
    centre = F.slice(box, 1, 3)
    if m is not None:
        centre = transform_point(m, centre)
    half = box_half_extents(box, m)
    return vector(*(F.get(centre, r) - half[r] for r in range(3)), *(F.get(centre, r) + half[r] for r in range(3)))


def aabb_box(lo: list[Column], hi: list[Column], least: float = 0.0) -> Column:
    """A 12-number box from corners, its half sizes at least ``least``."""
    half = [F.greatest((h - l) * 0.5, F.lit(least)) for l, h in zip(lo, hi, strict=True)]  # noqa: E741
    return vector(*((l + h) * 0.5 for l, h in zip(lo, hi, strict=True)), half[0], 0, 0, 0, half[1], 0, 0, 0, half[2])  # noqa: E741


def box_to_local(box: Column, world: Column) -> Column:
    """A world box as an axis-aligned box in the frame of ``world``; unchanged where that can't be inverted."""
    as_box = lambda hull: aabb_box([F.get(hull, i) for i in range(3)], [F.get(hull, i + 3) for i in range(3)])
    inside = lambda inverse: F.when(inverse.isNull(), box).otherwise(let(as_box, box_aabb(let(as_box, box_aabb(box)), inverse)))
    return let(inside, affine_inverse(world))


def box_diagonal(box: Column) -> Column:
    """Space diagonal of an oriented box; 0 without a box."""
    return F.coalesce(2 * F.sqrt(sum((F.get(box, i) * F.get(box, i) for i in range(4, 12)), F.get(box, 3) * F.get(box, 3))), F.lit(0.0))


def scale_bound(m: Column) -> Column:
    """A bound of how much a matrix stretches: the root of its greatest column sum times its greatest row sum."""
    return let(_scale_bound, m)


def _scale_bound(m: Column) -> Column:
    a = [[F.abs(at(m, r, c)) for c in range(3)] for r in range(3)]
    return F.sqrt(F.greatest(*(a[0][c] + a[1][c] + a[2][c] for c in range(3))) * F.greatest(*(a[r][0] + a[r][1] + a[r][2] for r in range(3))))
