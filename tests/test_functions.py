"""Numeric invariants of functions and geometry, independent of any table."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import errors as E
from quadrille.functions import geodesy as G
from quadrille.functions import matrix as M
from quadrille.functions import text as T
from quadrille.operators import clip, mesh, region, simplify
from quadrille.sources import binary, scan


def one(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return list(row)


def lits(values):
    return F.array(*(F.lit(float(v)) for v in values))


def test_matrices(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(4, 4)), rng.normal(size=(4, 4))
    a[3], b[3] = [0, 0, 0, 1], [0, 0, 0, 1]
    ca, cb, p = lits(a.T.ravel()), lits(b.T.ravel()), lits([1, -2, 3])
    product, inverse, moved, turned, affine, flat, diff = one(spark, M.multiply(ca, cb), M.affine_inverse(ca), M.transform_point(ca, p), M.transform_direction(ca, p), M.is_affine(ca), M.affine_inverse(lits([0] * 16)), M.max_abs_diff(ca, cb))
    assert np.allclose(product, (a @ b).T.ravel()) and np.allclose(inverse, np.linalg.inv(a).T.ravel())
    assert np.allclose(moved, (a @ [1, -2, 3, 1])[:3]) and np.allclose(turned, a[:3, :3] @ [1, -2, 3])
    assert affine and flat is None and math.isclose(diff, np.abs(a - b).max())
    assert np.allclose(mesh.inverse(a.T.ravel()), np.linalg.inv(a).T.ravel()) and mesh.inverse(np.zeros(16)) is None
    local, back = one(spark, M.relative_transform(ca, cb), M.multiply(ca, M.relative_transform(ca, cb)))
    assert np.allclose(back, b.T.ravel())


def test_rotation_and_boxes(spark):
    h = math.sqrt(0.5)
    m, bad = one(spark, M.trs(lits([1, 2, 3]), lits([0, 0, h, h]), lits([2, 1, 1])), M.trs(lits([0, 0, 0]), lits([0, 0, 1, 1]), lits([1, 1, 1])))
    assert np.allclose(np.array(m).reshape(4, 4).T @ [1, 0, 0, 1], [1, 4, 3, 1]) and bad is None
    box = [5, 6, 7, 1, 1, 0, 0, 2, 0, 0, 0, 3]
    hull, diagonal, local = one(spark, M.box_aabb(lits(box)), M.box_diagonal(lits(box)), M.box_to_local(lits(box), M.translation(F.lit(5.0), F.lit(6.0), F.lit(7.0))))
    corners = np.array([np.array(box[:3]) + sx * np.array(box[3:6]) + sy * np.array(box[6:9]) + sz * np.array(box[9:]) for sx in (-1, 1) for sy in (-1, 1) for sz in (-1, 1)])
    assert np.allclose(hull, [*corners.min(0), *corners.max(0)])
    assert math.isclose(diagonal, 2 * math.sqrt(2 + 4 + 9)) and np.allclose(local[:3], 0)


def test_geodesy(spark):
    p, frame = one(spark, G.ecef(F.lit(0.0), F.lit(0.0), F.lit(0.0)), G.enu_frame(F.lit(117.0), F.lit(35.0), F.lit(10.0)))
    assert np.allclose(p, [6378137, 0, 0])
    m = np.array(frame).reshape(4, 4).T
    assert np.allclose(m[:3, :3].T @ m[:3, :3], np.eye(3)) and np.allclose(m[:3, 3], region.ecef(117.0, 35.0, 10.0))
    north, plain = one(spark, G.placement(*map(F.lit, (117.0, 35.0, 10.0, 90.0, 0.0, 0.0))), G.placement(*map(F.lit, (117.0, 35.0, 10.0, 0.0, 0.0, 0.0)), lits([1, 2, 3])))
    assert np.allclose(np.array(north).reshape(4, 4).T[:3, :3] @ [0, 1, 0], m[:3, :3] @ [1, 0, 0])  # heading 90 turns north to east
    assert np.allclose(np.array(plain).reshape(4, 4).T @ [1, 2, 3, 1], m[:, 3])


@pytest.mark.parametrize("w,s,e,n", [(-0.3, 0.2, 0.4, 0.6), (3.0, -0.5, -3.0, 0.5), (-3.1, -1.2, 3.1, 1.3), (1.5, -0.1, 1.6, 0.0)])
def test_region_bounds_hold_all_points(spark, w, s, e, n):
    (b,) = one(spark, G.region_bounds(*map(F.lit, (w, s, e, n, -50.0, 900.0))))
    to = e + 2 * math.pi if e < w else e
    lon, lat, h = np.meshgrid(np.linspace(w, to, 40), np.linspace(s, n, 40), [-50.0, 900.0])
    p = np.stack([region.ecef(np.degrees(a), np.degrees(b_), c) for a, b_, c in zip(lon.ravel(), lat.ravel(), h.ravel(), strict=True)])
    assert (p >= np.array(b[:3]) - 1e-6).all() and (p <= np.array(b[3:]) + 1e-6).all()


def test_error_rules(spark):
    got = one(spark, E.leaf_error(F.lit(1000.0), F.lit(100.0)), E.leaf_error(F.lit(-1.0), F.lit(0.0)), E.leaf_error(F.lit(float("nan")), F.lit(10.0)), E.proxy_error(F.lit(10.0), F.lit(-1.0), F.lit(0.0)), E.proxy_error(F.lit(0.2), F.lit(0.0), F.lit(0.0)), E.workers(F.lit(8), F.lit(None).cast("int")), E.workers(F.lit(4), F.lit(99)))
    assert got == [75.0, 1.0, 1.0, 20.0, 1.2, 4, 4]


def test_paths_and_names(spark):
    def path(b, u):
        return T.resolve_path(F.lit(b), F.lit(u))

    got = one(spark, path("a/b", "../c/./d.b3dm?x#y"), path("", "x//y"), path("a", "../../z"), T.normalise_uri(F.lit("././\\x\\y")), T.tile_x(F.lit("Data/Tile_+003_-001/t.json")), T.tile_y(F.lit("Tile_+003_-001")), T.is_task_id(F.lit("a-b_1")), T.is_task_id(F.lit("../a")), T.is_strict_descendant(F.lit("/a/b"), F.lit("/a/")), T.is_strict_descendant(F.lit("/ab"), F.lit("/a")))
    assert got == ["a/c/d.b3dm", "x/y", "../z", "x/y", 3, -1, True, False, True, False]
    got = one(spark, T.suggest_output(F.lit("/d/in/"), F.lit(""), "_out"), T.suggest_output(F.lit("C:\\d\\in"), F.lit("D:\\r\\"), "_out"), T.suggest_output(F.lit("x_OUT"), F.lit(None).cast("string"), "_out"), T.same_path(F.lit("C:\\A\\"), F.lit("c:/a")), T.same_path(F.lit(""), F.lit("")), T.clone_output(F.lit("/o/"), F.lit("s")))
    assert got == ["/d/in_out", "D:\\r\\in_out", "x_OUT", True, False, "/o_rerun_s"]
    assert one(spark, T.byte_tail(F.lit("aéß"), 3), T.byte_tail(F.lit("ab"), 9), T.byte_tail(F.lit("x\U0001f600y"), 3)) == ["ß", "ab", "y"]
    assert one(spark, T.describe_execution(F.lit(None).cast("int"), F.lit(4), F.lit(None).cast("int"), F.lit(4096), F.lit(2), F.lit(2)))[0] == "cpu_workers: auto → 4, memory_budget: 4096 MiB (default), io_workers: 2 (explicit)"


def test_material_library_lines():
    cases = {
        "map_Kd a.png": "a.png", "map_Kd -o 1 2 3 -s 1 my tex.png": "my tex.png", 'bump -bm 0.5 "q r.jpg"': "q r.jpg", "map_Kd -mm 0 1 x.png # c": "x.png",
        "newmtl a": None, "map_Kd": None, "map_Kd -o x.png": None, "map_Kd -what 1 x.png": None, "map_Kd -clamp": None,
    }
    assert {k: scan.texture_reference(k) for k in cases} == cases


U = [(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4)]


def area(ring):
    r = np.asarray(ring, float)
    return abs(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - r[:, 1] * np.roll(r[:, 0], -1))) / 2


def test_regions():
    for ring, size in ((U, 10), ([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)], 5)):
        for r in (ring, ring[::-1]):
            assert math.isclose(sum(map(area, region.Region.planar(r).parts)), size)
    for bad in ([(0, 0), (1, 1), (1, 0), (0, 1)], [(0, 0), (1, 0), (1, 0), (0, 1)], [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]):
        with pytest.raises(region.RegionError):
            region.Region.planar(bad)
    box = region.parse({"type": "rectangle", "bounds": [117.0, 35.0, 117.01, 35.01]})
    assert len(box.polygon) == 4 and len(box.parts) == 1
    feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[117, 35], [117.01, 35], [117.01, 35.01], [117, 35]]]}}
    assert len(region.parse(json.dumps(feature)).polygon) == 3
    for bad in ({"type": "rectangle", "bounds": [1, 0, 0, 1]}, {"type": "rectangle", "bounds": [0, 0, 1, 1]}, {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}, {"type": "Point"}, {"crs": 1, "type": "Polygon"}):
        with pytest.raises(region.RegionError):
            region.parse(bad)


def test_partition_keeps_area_and_interpolates():
    rng = np.random.default_rng(3)
    tri = np.concatenate([rng.uniform(-2, 6, (400, 3, 2)), rng.normal(size=(400, 3, 1))], 2)
    tri[..., 2] = 2 * tri[..., 0] - 3 * tri[..., 1] + 1  # a linear attribute must stay linear
    r = region.Region.planar(U)
    inside, outside = clip.partition(r, tri, slice(0, 2))
    whole = np.abs((tri[:, 1, 0] - tri[:, 0, 0]) * (tri[:, 2, 1] - tri[:, 0, 1]) - (tri[:, 1, 1] - tri[:, 0, 1]) * (tri[:, 2, 0] - tri[:, 0, 0])) / 2
    parts = sum(np.bincount(b[2], clip.polygon_area(b, slice(0, 2)), len(tri)) for b in (inside, outside))
    assert np.allclose(parts, whole)
    for values, counts, _ in (inside, outside):
        there = np.arange(values.shape[1])[None, :] < counts[:, None]
        assert np.allclose(values[there][:, 2], 2 * values[there][:, 0] - 3 * values[there][:, 1] + 1)
    huge = np.array([[[-100.0, -100, 0], [100, -100, 0], [0, 200, 0]]])
    assert math.isclose(clip.polygon_area(clip.clipped(r, huge, slice(0, 2)), slice(0, 2)).sum(), 10)
    assert len(clip.fans(clip.clipped(r, huge + 1000, slice(0, 2)))[0]) == 0


def test_flatten_makes_walls():
    r = region.Region.planar([(0, 0), (2, 0), (2, 2), (0, 2)])
    tri = np.array([[[-5.0, -5, 3], [15, -5, 3], [-5, 15, 3]]])
    got = clip.flattened(r, tri, 0.0)
    assert len(got["flat"]) == 2 and (got["flat"][..., 2] == 0).all() and len(got["wall"]) == 8
    w = got["wall"]
    assert math.isclose((np.linalg.norm(np.cross(w[:, 1] - w[:, 0], w[:, 2] - w[:, 0]), axis=1) / 2).sum(), 4 * 2 * 3)
    slanted = np.array([[[-5.0, -5, -6], [15, -5, 14], [-5, 15, -6]]])
    assert len(clip.flattened(r, slanted, 1.0)["wall"]) == 4  # one edge lies on the height, two end there
    assert len(clip.flattened(r, slanted, 0.0)["wall"]) == 8  # edges that cross the height are two walls of one triangle each
    normal, tangent = clip.face_frames(np.array([[[0.0, 0, 0, 0, 0], [1, 0, 0, 1, 0], [0, 1, 0, 0, 1]]]), slice(0, 3), slice(3, 5))
    assert np.allclose(normal, [[0, 0, 1]]) and np.allclose(tangent, [[1, 0, 0, 1]])


def test_simplify_keeps_borders():
    n = 20
    x, y = np.meshgrid(np.arange(n + 1.0), np.arange(n + 1.0))
    p = np.column_stack([x.ravel(), y.ravel(), 0.2 * np.sin(x.ravel()) * np.sin(y.ravel())])
    i, j = np.meshgrid(np.arange(n), np.arange(n))
    a = (j * (n + 1) + i).ravel()
    idx = np.column_stack([a, a + 1, a + n + 2, a, a + n + 2, a + n + 1]).ravel()
    before = mesh.border_vertices(idx)
    points = simplify.spread(p, None, None, 0.0)
    kept, error = simplify.collapsed(points, idx, 250)
    assert len(kept) // 3 <= 260 and error > 0
    assert set(before) <= set(mesh.border_vertices(kept))
    flat = p * [1, 1, 0]
    tri = flat[kept.reshape(-1, 3)]
    assert math.isclose(np.abs(np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])[:, 2]).sum() / 2, n * n, rel_tol=1e-6)
    assert (simplify.collapsed(points, idx, 10**6)[0] == idx).all()
    (q,), k = mesh.compacted([p], kept)
    assert np.allclose(q[k], p[kept]) and k[0] == 0 and len(q) == len(np.unique(kept))


def test_binary_round_trip(spark, tmp_path):
    pos, nor, uv, idx = mesh.box_mesh(2.0, 3, (10, 0, 0))
    glb = binary.write_glb([{"positions": pos, "normals": nor, "uvs": uv, "indices": idx, "colour": (0.5, 0.25, 1, 1)}])
    b3dm = binary.pack_b3dm(glb, (1.0, 2.0, 3.0))
    assert len(b3dm) % 8 == 0 and binary.realign_b3dm(b3dm) == b3dm
    inner, centre = binary.unpack_b3dm(b3dm)
    assert inner == glb and centre == (1, 2, 3)
    doc, blob = binary.split_glb(glb)
    assert binary.join_glb(doc, blob) == glb and np.allclose(binary.position_bounds(doc), [[9, -1, -1], [11, 1, 1]])
    table = b'{"BATCH_LENGTH":0}'
    crooked = b"b3dm" + np.array([1, 28 + len(table) + len(glb), len(table), 0, 0, 0], "<u4").tobytes() + table + glb
    straight = binary.realign_b3dm(crooked)
    assert straight != crooked and binary.unpack_b3dm(straight)[0] == glb and len(straight) % 8 == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.b3dm").write_bytes(b3dm)
    (tmp_path / "a/y.glb").write_bytes(glb[:-8])
    (tmp_path / "z.glb").write_bytes(glb)
    rows = {r.path.rsplit("/", 1)[1]: r for r in binary.primitives(binary.binary_files(spark, str(tmp_path))).collect()}
    assert rows["x.b3dm"].triangles == 6 * 9 * 2 and rows["x.b3dm"].material_key == "mat0:0.500,0.250,1.000,1.000" and np.allclose(rows["z.glb"].positions, pos.ravel())
    assert rows["y.glb"].triangles is None and "GLB" in rows["y.glb"].error
    texts = {r.path.rsplit("/", 1)[1]: r.doc for r in binary.documents(binary.binary_files(spark, str(tmp_path))).collect()}
    assert json.loads(texts["x.b3dm"])["asset"]["version"] == "2.0" and texts["y.glb"] is None


def test_box_mesh_is_closed_and_faces_out():
    pos, nor, _, idx = mesh.box_mesh(1.0, 2)
    tri = pos[idx.reshape(-1, 3)]
    face = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    assert ((face * nor[idx.reshape(-1, 3)[:, 0]]).sum(1) > 0).all()
    assert math.isclose((np.linalg.norm(face, axis=1) / 2).sum(), 6)


def test_accessors_and_headers():
    doc = {"accessors": [{"bufferView": 0, "componentType": 5121, "count": 2, "type": "VEC2", "normalized": True}], "bufferViews": [{"buffer": 0, "byteLength": 8, "byteStride": 4}]}
    assert np.allclose(binary.accessor(doc, bytes([255, 0, 9, 9, 0, 51, 9, 9]), 0), [[1, 0], [0, 0.2]])
    with pytest.raises(binary.BinaryError):
        binary.accessor(doc, b"123", 0)
    assert binary.image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big")) == (7, 5)
    assert binary.readable({"extensionsRequired": ["KHR_texture_basisu"], "textures": [{"extensions": {"KHR_texture_basisu": {"source": 3}}}]})["textures"][0]["source"] == 3
    with pytest.raises(binary.BinaryError):
        binary.node_matrix({"rotation": [0, 0, 1, 1]})
