"""Simplification by quadrics over position, texture coordinates and colour, for nodes of any size.

A vertex is a point of 8 numbers: position, texture coordinates in metres on the surface, colour. A triangle's quadric measures
the squared distance of a point to its plane in that space, weighted by its area, so a collapse that keeps the shape but slides the
texture costs as much as one that moves the surface. The error is the root of the mean over the area that a point stands for.

Step one, in Spark: vertices of large nodes fall into cells of that space. Each payload gives its cells' quadrics and best points,
which are summed by cell as partial and final aggregates, and those triangles whose corners are in three cells. No task holds
more than one payload. Cells are sized by the surface, so that about LIMIT triangles are left for a node. Step two: what is left
of a node meets in one task, where edges are collapsed into vertices that stay as they are. Vertices on edges of one
triangle alone are locked in both steps: borders stay closed, and so do seams, where vertices are doubled.
"""

from __future__ import annotations

import heapq
import json
import math
import struct
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.lineage import cut
from quadrille.operators.looks import look_of, packed
from quadrille.operators.mesh import border_vertices, compacted, transformed, transformed_normals
from quadrille.sources import binary
from quadrille.sources.payload import read_bytes

DIMS = 8
UPPER = np.triu_indices(DIMS)
#: Each entry above the diagonal stands for two.
TWICE = np.where(UPPER[0] == UPPER[1], 1.0, 2.0)
TERMS = len(TWICE) + DIMS + 1
#: Triangles of a node that step two may get; metres that a full step of colour counts as; triangles at a time in step one.
LIMIT, COLOUR, PART = 60_000, 1.0, 200_000
#: Triangles in a row between the steps, and rounds of larger cells at most.
ROW, ROUNDS = 20_000, 8


def spread(positions: np.ndarray, uvs: np.ndarray | None, colours: np.ndarray | None, scale: float) -> np.ndarray:
    """The vertices as points of DIMS numbers; ``scale`` is the metres of a unit of texture coordinates."""
    out = np.zeros((len(positions), DIMS))
    out[:, :3] = positions
    if uvs is not None and scale:
        out[:, 3:5] = np.asarray(uvs, float) * scale
    if colours is not None:
        out[:, 5:] = np.asarray(colours, float)[:, :3] * COLOUR
    return out


def triangle_quadrics(points: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(m, TERMS) quadrics weighted by the triangles' areas, and these; nothing of degenerate ones."""
    p, a, d = points[tri[:, 0]], points[tri[:, 1]] - points[tri[:, 0]], points[tri[:, 2]] - points[tri[:, 0]]
    length = np.linalg.norm(a, axis=1, keepdims=True)
    u = a / np.maximum(length, 1e-300)
    v = d - (d * u).sum(1, keepdims=True) * u
    height = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.maximum(height, 1e-300)
    area = (length * height)[:, 0] / 2
    pu, pv = (p * u).sum(1), (p * v).sum(1)
    flat = (UPPER[0] == UPPER[1]).astype(float) - u[:, UPPER[0]] * u[:, UPPER[1]] - v[:, UPPER[0]] * v[:, UPPER[1]]
    line = pu[:, None] * u + pv[:, None] * v - p
    out = np.column_stack([flat, line, (p * p).sum(1) - pu * pu - pv * pv]) * area[:, None]
    return out, area


def quadric_errors(quadrics: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The quadrics' values at the points, row by row."""
    n = len(TWICE)
    square = (quadrics[:, :n] * TWICE * points[:, UPPER[0]] * points[:, UPPER[1]]).sum(1)
    return np.maximum(square + 2 * (quadrics[:, n : n + DIMS] * points).sum(1) + quadrics[:, -1], 0.0)


def vertex_quadrics(points: np.ndarray, tri: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, TERMS) sums of the triangles' quadrics by ``place`` of their corners, and the areas; PART triangles at a time."""
    quadrics, weights = np.zeros((n, TERMS)), np.zeros(n)
    for i in range(0, len(tri), PART):
        part = tri[i : i + PART]
        q, area = triangle_quadrics(points, part)
        for k in range(3):
            at = place[part[:, k]]
            weights += np.bincount(at, area, n)
            for t in range(TERMS):
                quadrics[:, t] += np.bincount(at, q[:, t], n)
    return quadrics, weights


def collapsed(points: np.ndarray, indices: np.ndarray, target: int, max_error: float = math.inf, locked: np.ndarray | None = None, quadrics: np.ndarray | None = None, weights: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Collapse edges, the cheapest first, until ``target`` triangles are left or the next costs over ``max_error``: indices into the same points, and the largest error made.

    A vertex is moved into a neighbour, so attributes stay as they are. Locked vertices (by default those of the border) never
    move; collapses that turn a face over or pinch the surface are not made.
    """
    tri = np.asarray(indices, int).reshape(-1, 3).copy()
    if len(tri) <= target:
        return tri.ravel(), 0.0
    if quadrics is None:
        quadrics, weights = vertex_quadrics(points, tri, np.arange(len(points)), len(points))
    if locked is None:
        locked = np.zeros(len(points), bool)
        locked[border_vertices(tri.ravel())] = True
    n = len(TWICE)
    form = np.zeros((len(points), DIMS + 1, DIMS + 1))
    form[:, UPPER[0], UPPER[1]] = form[:, UPPER[1], UPPER[0]] = quadrics[:, :n]
    form[:, :DIMS, DIMS] = form[:, DIMS, :DIMS] = quadrics[:, n : n + DIMS]
    form[:, DIMS, DIMS] = quadrics[:, -1]
    weight, at, place = weights.copy(), np.column_stack([points, np.ones(len(points))]), points[:, :3]
    faces: list[set[int]] = [set() for _ in range(len(points))]
    for f, corners in enumerate(tri.tolist()):
        for v in corners:
            faces[v].add(f)
    corners_of = tri.tolist()
    alive, version, dead = len(tri), [0] * len(points), np.zeros(len(tri), bool)
    heap: list[tuple[float, int, int, int, int]] = []

    def around(v: int) -> set[int]:
        return {w for f in faces[v] for w in corners_of[f]} - {v}

    def offer(a: int, both: bool) -> None:
        for b in around(a):
            for x, y in ((a, b), (b, a)) if both else ((a, b),):
                if not locked[x]:
                    h = at[y]
                    cost = max(0.0, float(h @ (form[x] + form[y]) @ h)) / max(weight[x] + weight[y], 1e-300)
                    heapq.heappush(heap, (cost, x, y, version[x], version[y]))

    for v in range(len(points)):
        if faces[v] and not locked[v]:
            offer(v, False)
    worst = 0.0
    while heap and alive > target:
        cost, a, b, va, vb = heapq.heappop(heap)
        if version[a] != va or version[b] != vb or not faces[a] or not faces[b]:
            continue
        if cost**0.5 > max_error:
            break
        shared = faces[a] & faces[b]
        if len(shared) != 2 or len(around(a) & around(b)) != 2:
            continue
        rest = list(faces[a] - shared)
        if rest:
            old = np.array([corners_of[f] for f in rest])
            p, q = place[old], place[np.where(old == a, b, old)]
            n0, n1 = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0]), np.cross(q[:, 1] - q[:, 0], q[:, 2] - q[:, 0])
            if ((n0 * n1).sum(1) <= 0.1 * np.linalg.norm(n0, axis=1) * np.linalg.norm(n1, axis=1)).any():
                continue
        for f in shared:
            dead[f] = True
            for v in corners_of[f]:
                faces[v].discard(f)
        for f in rest:
            corners_of[f] = [b if v == a else v for v in corners_of[f]]
            faces[b].add(f)
        faces[a] = set()
        form[b] += form[a]
        weight[b] += weight[a]
        alive -= 2
        worst = max(worst, cost**0.5)
        version[a] += 1
        version[b] += 1
        offer(b, True)
    return np.array(corners_of, int).reshape(-1, 3)[~dead].ravel(), worst


def mixed(values: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each row of whole numbers."""
    out = np.full(len(values), seed & (2**64 - 1), np.uint64)
    for k in range(values.shape[1]):
        out = (out ^ values[:, k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def cell_keys(points: np.ndarray, cell: float, locked: np.ndarray, source: str) -> np.ndarray:
    """Each vertex's cell; locked ones, and all where ``cell`` is 0, have cells of their own."""
    seed = int.from_bytes(blake2b(source.encode(), digest_size=8).digest(), "little")
    own = mixed(np.arange(len(points))[:, None], seed)
    return own if not cell else np.where(locked, own, mixed(np.floor(points / cell), 1))


def placed_primitives(data: bytes, matrix: np.ndarray, y_up: bool) -> Iterator[tuple[str, dict, dict]]:
    """(group, primitive in the node's frame, images by hash) of a payload; ``matrix`` leads from the payload's tile to the node.

    A group is what may be drawn as one: material with its images, and which attributes there are.
    """
    glb, _ = binary.unpack_b3dm(data)
    looks = look_of(glb)
    for p in binary.read_primitives(data, strict=True):
        m = np.asarray(matrix, float).reshape(4, 4).T
        if p["centre"]:
            m = m @ np.block([[np.eye(3), np.array(p["centre"])[:, None]], [np.zeros((1, 3)), np.ones((1, 1))]])
        if y_up:
            m = m @ np.array([[1.0, 0, 0, 0], [0, 0, -1, 0], [0, 1, 0, 0], [0, 0, 0, 1]])
        m = m.T.ravel()
        material, images = looks(p["material"])
        p["positions"] = transformed(p["positions"].astype(float), m)
        p["normals"] = None if p["normals"] is None else transformed_normals(p["normals"].astype(float), m)
        if "TANGENT" in p["more"]:
            p["more"]["TANGENT"] = binary.transformed_tangents(p["more"]["TANGENT"], np.asarray(m).reshape(4, 4).T[:3, :3])
        p["indices"] = p["indices"].reshape(-1, 3).astype(np.int64)
        widths = {name: values.shape[1] for name, values in sorted(p["more"].items())}
        group = {"material": material, "more": widths, "normals": p["normals"] is not None, "uvs": p["uvs"] is not None}
        yield json.dumps(group, sort_keys=True), p, images


FAULTS = (binary.BinaryError, KeyError, IndexError, TypeError, ValueError, OSError, struct.error, np.linalg.LinAlgError)


def group_sizes(children: DataFrame) -> DataFrame:
    """node, grp, triangles, area and texture area of every group of every child (node, child, path, y_up, matrix); an unreadable payload has an error."""
    schema = "node string, child string, grp string, triangles long, area double, uv_area double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                try:
                    for group, p, _ in placed_primitives(read_bytes(row.path), row.matrix, row.y_up):
                        corners = p["positions"][p["indices"]]
                        area = np.linalg.norm(np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]), axis=1).sum() / 2
                        flat = 0.0
                        if p["uvs"] is not None:
                            t = p["uvs"][p["indices"]]
                            flat = np.abs(np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])).sum() / 2 if t.shape[2] == 3 else np.abs((t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 1, 1] - t[:, 0, 1]) * (t[:, 2, 0] - t[:, 0, 0])).sum() / 2
                        rows.append((row.node, row.child, group, len(p["indices"]), area, flat, None))
                except FAULTS as e:
                    rows.append((row.node, row.child, None, 0, 0.0, 0.0, f"{row.path}: {type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return children.select("node", "child", "path", "y_up", "matrix").mapInPandas(run, schema)


def cell_sizes(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(node, plan): for each group its cell (0 where the node is small enough as it is) and the scale of its texture coordinates."""
    groups = sizes.filter("grp IS NOT NULL").groupBy("node", "grp").agg(*(F.sum(c).alias(c) for c in ("triangles", "area", "uv_area")))
    total = groups.groupBy("node").agg(F.sum("triangles").alias("total"))
    scale = F.when(F.col("uv_area") > 0, F.sqrt(F.col("area") / F.col("uv_area"))).otherwise(0.0)
    # About two triangles a cell, and surfaces cut some cells at their corners.
    cell = F.when(F.col("total") > limit, F.sqrt(4.5 * F.col("area") * F.col("total") / (F.col("triangles") * limit))).otherwise(0.0)
    return groups.join(total, "node").groupBy("node").agg(F.collect_list(F.struct("grp", cell.alias("cell"), scale.alias("scale"), "triangles")).alias("plan"))


PARTS = "kind int, node string, grp string, cell long, q array<double>, weight double, point array<double>, locked boolean, tri array<long>, hash string, mime string, data binary"
CELLS, TRIANGLES, IMAGES = range(3)


def flat_vertices(p: dict, used: np.ndarray) -> np.ndarray:
    """Positions, texture coordinates, further attributes and normals of some vertices, side by side."""
    there = [p["positions"], p["uvs"], *(p["more"][name] for name in sorted(p["more"])), p["normals"]]
    return np.column_stack([np.asarray(v, float)[used] for v in there if v is not None])


def clustered(children: DataFrame, plans: DataFrame, times: float = 1.0) -> DataFrame:
    """Step one (PARTS): the cells of each payload with their quadrics and best points, the triangles between three cells, and the images."""

    def rows_of(row) -> Iterator[tuple]:
        plan = {g["grp"]: g for g in row.plan}
        for k, (group, p, images) in enumerate(placed_primitives(read_bytes(row.path), row.matrix, row.y_up)):
            tri, cell = p["indices"], plan[group]["cell"] * times
            points = spread(p["positions"], p["uvs"], p["more"].get("COLOR_0"), plan[group]["scale"])
            locked = np.zeros(len(points), bool)
            locked[border_vertices(tri.ravel())] = True
            keys, place = np.unique(cell_keys(points, cell, locked, f"{row.child}/{k}"), return_inverse=True)
            quadrics, weights = vertex_quadrics(points, tri, place, len(keys))
            order = np.lexsort((quadric_errors(quadrics[place], points), place))
            best = order[np.r_[True, np.diff(place[order]) > 0]]
            values, fixed = flat_vertices(p, best), np.zeros(len(keys), bool)
            fixed[place[locked]] = True
            for i in range(len(keys)):
                yield (CELLS, row.node, group, keys[i], quadrics[i], weights[i], values[i], fixed[i], None, None, None, None)
            corners = keys[place[tri]]
            corners = corners[(corners[:, 0] != corners[:, 1]) & (corners[:, 1] != corners[:, 2]) & (corners[:, 0] != corners[:, 2])]
            first = corners.argmin(1)[:, None]
            corners = np.unique(np.take_along_axis(corners, (first + np.arange(3)) % 3, 1), axis=0)
            for i in range(0, len(corners), ROW):
                yield (TRIANGLES, row.node, group, None, None, None, None, None, corners[i : i + ROW].ravel(), None, None, None)
            for hash_, (mime, data) in images.items():
                yield (IMAGES, row.node, None, None, None, None, None, None, None, hash_, mime, data)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARTS.split(", ")]
        for batch in batches:
            for row in batch.itertuples(index=False):
                made = rows_of(row)
                while part := [r for r, _ in zip(made, range(ROW))]:
                    yield pd.DataFrame(part, columns=names, dtype=object)  # else numbers beside nulls become floats

    return children.join(plans, "node").select("node", "child", "path", "y_up", "matrix", "plan").mapInPandas(run, PARTS)


def few_enough(children: DataFrame, plans: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Step one, again with larger cells for nodes that are left with over twice the limit, as long as that helps."""
    parts, times = cut(clustered(children, plans)), 1.0
    count = lambda df: df.filter(F.col("kind") == TRIANGLES).groupBy("node").agg((F.sum(F.size("tri")) / 3).alias("left"))
    over = cut(count(parts).filter(F.col("left") > 2 * limit).join(plans.filter(F.exists("plan", lambda g: g["cell"] > 0)), "node").select("node", "left"))
    for _ in range(ROUNDS):
        if over.isEmpty():
            break
        times *= 1.6
        again = cut(clustered(children.join(over.select("node"), "node", "left_semi"), plans, times))
        parts = parts.join(over.select("node"), "node", "left_anti").select(*again.columns).union(again)
        now = count(again).join(over.withColumnRenamed("left", "before"), "node")
        over = cut(now.filter((F.col("left") > 2 * limit) & (F.col("left") < 0.95 * F.col("before"))).select("node", "left"))
    return parts


def summed_cells(parts: DataFrame) -> DataFrame:
    """(node, grp, cell, q, weight, points, locked): quadrics added up by cell; a cell's points are one for each payload that reaches it."""
    sums = [F.sum(F.get("q", i)).alias(f"q{i}") for i in range(TERMS)]
    cells = parts.filter(F.col("kind") == CELLS).groupBy("node", "grp", "cell").agg(*sums, F.sum("weight").alias("weight"), F.collect_list("point").alias("points"), F.max("locked").alias("locked"))
    return cells.select("node", "grp", "cell", F.array(*(f"q{i}" for i in range(TERMS))).alias("q"), "weight", "points", "locked")


BUILT = "node string, content binary, triangles_after long, triangles_target long, error double, texture_bytes long, warnings array<string>"


def built(parts: DataFrame, images: DataFrame, plans: DataFrame, budget: int, max_error: float, max_bytes: int = 0, b3dm: bool = False) -> DataFrame:
    """Step two (BUILT): each node's mesh within its budget as a GLB or B3DM, groups by their share of it (four triangles at least).

    images: node, hash, mime, data as they are to be embedded.
    """
    cells = summed_cells(parts).join(plans, "node")
    triangles = parts.filter(F.col("kind") == TRIANGLES).select("node", "grp", "tri", "hash", "mime", "data")
    others = triangles.union(images.select("node", F.lit(None).cast("string").alias("grp"), F.lit(None).cast("array<long>").alias("tri"), "hash", "mime", "data"))
    others = others.toDF("of", "group", "tri", "hash", "mime", "data")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        plan = {g["grp"]: g for g in left["plan"].iloc[0]} if len(left) else {}
        total = sum(g["triangles"] for g in plan.values())
        found = {r.hash: (r.mime, bytes(r.data)) for r in right[right["hash"].notna()].itertuples(index=False)}
        out, worst, warnings = [], 0.0, []
        by_group = dict(iter(right[right["tri"].notna()].groupby("group")))
        for group, rows in left.groupby("grp"):
            if group not in by_group:
                continue
            look = json.loads(group)
            keys = rows["cell"].to_numpy()
            quadrics, weights, locked = np.stack(rows["q"].to_list()), rows["weight"].to_numpy(float), rows["locked"].to_numpy(bool)
            which = np.repeat(np.arange(len(rows)), rows["points"].str.len())
            values = np.array([v for points in rows["points"] for v in points], float)
            columns, at = {}, 3
            for name, width in [("uvs", 2 * look["uvs"]), *look["more"].items(), ("normals", 3 * look["normals"])]:
                columns[name] = slice(at, at + width)
                at += width
            get = lambda v, name, columns=columns: v[:, columns[name]] if name in columns and columns[name].stop > columns[name].start else None
            points = spread(values[:, :3], get(values, "uvs"), get(values, "COLOR_0"), plan[group]["scale"])
            order = np.lexsort((quadric_errors(quadrics[which], points), which))
            best = order[np.r_[True, np.diff(which[order]) > 0]]
            values, points = values[best], points[best]
            sort = np.argsort(keys)
            corners = np.unique(np.concatenate(by_group[group]["tri"].to_list()).reshape(-1, 3), axis=0)
            tri = sort[np.searchsorted(keys, corners, sorter=sort)]
            target = max(4, math.floor(plan[group]["triangles"] / max(total, 1) * budget + 0.5))
            error = float(np.sqrt(quadric_errors(quadrics, points) / np.maximum(weights, 1e-300)).max()) if plan[group]["cell"] else 0.0
            kept, more = collapsed(points, tri.ravel(), target, max_error, locked, quadrics, weights)
            if len(kept) > 3 * (target + 1):
                warnings.append(f"BUDGET_NOT_REACHED: group tris {plan[group]['triangles']} -> {len(kept) // 3} (target {target})")
            worst = max(worst, error, more)
            (values,), kept = compacted([values], kept)
            out.append({"positions": values[:, :3].astype(np.float32), "uvs": get(values, "uvs"), "normals": get(values, "normals"), "more": {name: values[:, columns[name]] for name in look["more"]}, "indices": kept, "look": look["material"]})
        after = sum(len(p["indices"]) // 3 for p in out)
        if after > budget:
            warnings.append(f"BUDGET_NOT_REACHED: after={after} max={budget}")
        content = packed(out, found) if out else None
        if content and max_bytes and len(content) > max_bytes:
            warnings.append(f"GLB_BYTES_OVER_BUDGET: after={len(content)} max={max_bytes}")
        content = binary.pack_b3dm(content) if content and b3dm else content
        return pd.DataFrame([(key[0], content, after, budget, worst, sum(len(d) for _, d in found.values()), warnings)], columns=[c.split()[0] for c in BUILT.split(", ")])

    return cells.groupBy("node").cogroup(others.groupBy("of")).applyInPandas(run, BUILT)
