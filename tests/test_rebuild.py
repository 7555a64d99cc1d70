"""The rebuild written out, its simplification, its textures and its copies."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.operators import mesh, simplify
from quadrille.plans import commands, rebuild
from quadrille.sources import binary, copies, raster, tileset

CELL = 100.0


def height(x, y):
    return 6 * np.sin(x / 37) + 4 * np.cos(y / 23)


def terrain(x0, y0, n, cell=CELL):
    """A patch of n x n quads in world coordinates with texture coordinates; neighbours have the same border points."""
    u, v = np.meshgrid(np.linspace(0, 1, n + 1), np.linspace(0, 1, n + 1), indexing="ij")
    x, y = (x0 + u * cell).ravel(), (y0 + v * cell).ravel()
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    a = (i * (n + 1) + j).ravel()
    idx = np.column_stack([a, a + n + 1, a + n + 2, a, a + n + 2, a + 1]).ravel()
    return np.column_stack([x, y, height(x, y)]), np.column_stack([u.ravel(), v.ravel()]), idx


def picture(seed, size=48):
    rng = np.random.default_rng(seed)
    out = rng.integers(0, 256, (size, size, 4), dtype=np.uint8)
    out[..., 3] = 255
    return raster.encoded(out)


def payload(x0, y0, n, png, tint=(1, 1, 1, 1), cell=CELL):
    p, uv, idx = terrain(x0, y0, n, cell)
    look = ({"materials": [{"name": "ground", "pbrMetallicRoughness": {"baseColorFactor": list(tint), "baseColorTexture": {"index": 0}}}], "textures": [{"source": 0, "sampler": 0}], "samplers": [{"wrapS": 33071}], "images": [{"mimeType": "image/png", "bufferView": 0}]}, [png])
    normals = np.tile([0.0, 0, 1], (len(p), 1))
    return binary.pack_b3dm(binary.write_glb([{"positions": p, "normals": normals, "uvs": uv, "indices": idx, "material": 0}], look))


def grid_tileset(folder, n, quads=(4, 8), origin=(0.0, 0.0, 0.0), shared_picture=True):
    """n x n blocks with a coarse and a fine content each, as a tileset at some origin; contents are Z up."""
    kids = []
    z0, z1 = -11.0, 11.0
    for gx in range(n):
        for gy in range(n):
            name = f"Tile_+{gx:03d}_+{gy:03d}"
            place = folder / "Data" / name
            place.mkdir(parents=True)
            box = [gx * CELL + 50, gy * CELL + 50, 0, 50, 0, 0, 0, 50, 0, 0, 0, (z1 - z0) / 2]
            png = picture(0 if shared_picture else gx * n + gy)
            for which, q in zip(("coarse", "fine"), quads, strict=True):
                (place / f"{which}.b3dm").write_bytes(payload(gx * CELL, gy * CELL, q, png))
            tile = {"boundingVolume": {"box": box}, "geometricError": 50, "refine": "REPLACE", "content": {"uri": "coarse.b3dm"}, "children": [{"boundingVolume": {"box": box}, "geometricError": 5, "refine": "REPLACE", "content": {"uri": "fine.b3dm"}}]}
            (place / "tileset.json").write_text(json.dumps({"asset": {"version": "1.0", "gltfUpAxis": "Z"}, "geometricError": 60, "root": tile}))
            kids.append({"boundingVolume": {"box": box}, "geometricError": 50, "content": {"uri": f"./Data/{name}/tileset.json"}})
    move = [1.0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, *origin, 1]
    root = {"boundingVolume": {"box": [n * 50, n * 50, 0, n * 50, 0, 0, 0, n * 50, 0, 0, 0, 11]}, "geometricError": 500, "refine": "ADD", "transform": move, "children": kids}
    (folder / "tileset.json").write_text(json.dumps({"asset": {"version": "1.0", "gltfUpAxis": "Z"}, "geometricError": 500, "root": root}))


def walk(tile, world=np.eye(4)):
    world = world @ np.asarray(tile.get("transform", np.eye(4).T.ravel()), float).reshape(4, 4).T
    yield tile, world
    for kid in tile.get("children", []):
        yield from walk(kid, world)


def rebuilt(spark, tmp_path, n, options=None, **more):
    src, out = tmp_path / "src", tmp_path / "out"
    grid_tileset(src, n, **more)
    found = rebuild.rebuild_tileset(spark, str(src), f"file://{src}/tileset.json", str(out), options)
    return found, out, json.loads((out / "tileset.json").read_text())


@pytest.mark.parametrize("origin", [(0.0, 0.0, 0.0), (6378137.0, 1000.0, 0.0)])
def test_rebuild_of_4x4_blocks(spark, tmp_path, origin):
    options = rebuild.Options(l1_max_triangles=90, l2_max_triangles=60)
    found, out, doc = rebuilt(spark, tmp_path, 4, options, origin=origin)
    assert {(r.level, r.n) for r in found["nodes"].groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()} == {(0, 16), (1, 4), (2, 1)}
    tiles = list(walk(doc["root"]))
    assert len(tiles) == 21 and doc["asset"]["gltfUpAxis"] == "Z"
    root = doc["root"]
    assert root["refine"] == "REPLACE" and len(root["transform"]) == 16 and len(root["children"]) == 4 and all(len(k["children"]) == 4 for k in root["children"])
    assert abs(root["boundingVolume"]["box"][0]) < 1e-6 and root["transform"][12] == origin[0] + 200
    # Errors never rise downwards, and every reference is there.
    def check(tile):
        assert (out / tile["content"]["uri"]).exists()
        for kid in tile.get("children", []):
            assert kid["geometricError"] < tile["geometricError"]
            check(kid)
    check(root)
    assert doc["geometricError"] == root["geometricError"]
    leaves = [(t, w) for t, w in tiles if t["content"]["uri"].endswith(".json")]
    assert len(leaves) == 16 and all(np.allclose(w[:3, 3], origin, atol=1e-8) and np.allclose(w[:3, :3], np.eye(3)) for _, w in leaves)
    # Blocks are whole copies.
    assert {r.status for r in found["copies"].collect()} == {"copied"} and found["copies"].count() == 48
    made = {r.id: r for r in found["proxies"].collect()}
    assert len(made) == 5 and all(r.triangles_before == 4 * 32 for i, r in made.items() if "_L1_" in i)
    for r in made.values():
        uri = out / "Data" / r.id / f"{r.id}.b3dm"
        prims = binary.read_primitives(uri.read_bytes(), strict=True)
        # Equal materials with equal images are one group.
        assert len(prims) == 1 and len(prims[0]["indices"]) // 3 == r.triangles_after < r.triangles_before
        assert prims[0]["normals"] is not None and prims[0]["uvs"] is not None
    placed = {t["content"]["uri"]: w for t, w in tiles}
    for uri, world in placed.items():
        if not uri.endswith(".b3dm"):
            continue
        p = binary.read_primitives((out / uri).read_bytes())[0]
        at = p["positions"].astype(float) @ world[:3, :3].T + world[:3, 3] - np.array(origin)
        # Vertices stay where the blocks have them (32 bits in the proxy's own frame), with their own texture coordinates.
        near = 1e-3 if origin[0] == 0 else 0.5
        assert np.abs(at[:, 2] - height(at[:, 0], at[:, 1])).max() < near
        turn = (at[:, :2] / CELL - p["uvs"]) % 1
        assert np.minimum(turn, 1 - turn).max() < near / 10
    assert not commands.validate_tileset(spark, str(out), strict=True).collect()
    report = json.loads((out / "rebuild_metrics.json").read_text())
    assert report["level_counts"] == [{"level": 0, "count": 16}, {"level": 1, "count": 4}, {"level": 2, "count": 1}] and report["totals"]["proxies"] == 5 and report["totals"]["textures_in"] > report["totals"]["textures_unique"]


def test_rebuild_of_16x16_blocks(spark, tmp_path):
    found, out, doc = rebuilt(spark, tmp_path, 16, rebuild.Options(l1_max_triangles=30, l2_max_triangles=30), quads=(2, 3))
    assert sorted((r.level, r["count"]) for r in found["nodes"].groupBy("level").count().collect()) == [(0, 256), (1, 64), (2, 16), (3, 4), (4, 1)]
    tiles = [t for t, _ in walk(doc["root"])]
    assert len(tiles) == 341 and sum(t["content"]["uri"].endswith(".json") for t in tiles) == 256
    assert [k["transform"][12:14] for k in doc["root"]["children"]] == [[-400.0, -400.0], [400.0, -400.0], [-400.0, 400.0], [400.0, 400.0]]
    assert not commands.check_errors(spark, str(out / "tileset.json")).collect()


def test_rebuild_with_fewer_levels(spark, tmp_path):
    for levels in (0, 1):
        found, _, doc = rebuilt(spark, tmp_path / str(levels), 2 + 2 * levels, rebuild.Options(max_levels=levels))
        root = doc["root"]
        assert "content" not in root and "transform" not in root and len(root["children"]) == 4
        assert ("proxies" in found) == bool(levels) and root["geometricError"] == max(k["geometricError"] for k in root["children"])


def test_rebuild_refuses_what_it_would_lose(spark, tmp_path):
    src = tmp_path / "src"
    grid_tileset(src, 2)
    victim = src / "Data/Tile_+001_+000/coarse.b3dm"
    whole = victim.read_bytes()
    glb, _ = binary.unpack_b3dm(whole)
    doc, blob = binary.split_glb(glb)
    doc["meshes"][0]["primitives"].append(doc["meshes"][0]["primitives"][0] | {"mode": 1})
    for data, word in ((b"b3dm broken", "CONTENT_UNREADABLE"), (binary.pack_b3dm(binary.join_glb(doc, blob)), "no triangle list")):
        victim.write_bytes(data)
        with pytest.raises(rebuild.RebuildError, match=word):
            rebuild.rebuild_tileset(spark, str(src), f"file://{src}/tileset.json", str(tmp_path / word[:3]))
    victim.unlink()
    with pytest.raises(rebuild.RebuildError, match="CONTENT_UNREADABLE.*FileNotFound"):
        rebuild.rebuild_tileset(spark, str(src), f"file://{src}/tileset.json", str(tmp_path / "gone"))


def plane_children(tmp_path, n_files, quads):
    rows = []
    for i in range(n_files):
        (tmp_path / f"{i}.b3dm").write_bytes(payload(i * CELL, 0, quads, picture(i % 2), tint=(1, 1, 1, 1) if i % 3 else (1, 0, 0, 1)))
        rows.append(("n", f"c{i}", f"{tmp_path}/{i}.b3dm", False, [float(v) for v in np.eye(4).ravel()]))
    return rows


CHILD = "node string, child string, path string, y_up boolean, matrix array<double>"


def borders(positions, indices):
    return {tuple(np.round(p, 3)) for p in np.asarray(positions, float)[mesh.border_vertices(indices)]}


def test_large_nodes_are_clustered_first(spark, tmp_path):
    """A node of 4 x 12,800 triangles with a bound of 3,000: borders stay, the surface stays near, textures don't slide."""
    children = spark.createDataFrame(plane_children(tmp_path, 4, 80), CHILD)
    sizes = simplify.group_sizes(children)
    plans = simplify.cell_sizes(sizes, 3000)
    plan = {g.grp: g for g in plans.first().plan}
    assert len(plan) == 4 and all(g.cell > 0 and abs(g.scale - CELL) < 5 for g in plan.values())
    parts = simplify.few_enough(children, plans, 3000)
    left = parts.filter(F.col("kind") == simplify.TRIANGLES).agg(F.sum(F.size("tri")) / 3).first()[0]
    assert left < 6000
    images = parts.filter(F.col("kind") == simplify.IMAGES).dropDuplicates(["node", "hash"])
    row = simplify.built(parts, images, plans, 2000, 0.5, 0).first()
    assert row.triangles_after < 4000 and row.error < 1.5
    prims = binary.read_primitives(bytes(row.content))
    found = np.concatenate([p["positions"] for p in prims]).astype(float)
    assert np.abs(found[:, 2] - height(found[:, 0], found[:, 1])).max() < 1e-3
    for i in range(4):
        p, _, idx = terrain(i * CELL, 0, 80)
        edge = p[mesh.border_vertices(idx)]
        assert np.linalg.norm(found[None] - edge[:, None], axis=2).min(1).max() < 1e-3
    for p in prims:
        local = p["positions"][:, :2] / CELL
        assert np.abs((local - np.floor(local.mean(0))) - p["uvs"]).max() < 2e-3
    # Every triangle's middle is near the surface, and its texture near where it was.
    for p in prims:
        tri = p["indices"].reshape(-1, 3)
        mid, uv = p["positions"][tri].mean(1).astype(float), p["uvs"][tri].mean(1)
        assert np.abs(mid[:, 2] - height(mid[:, 0], mid[:, 1])).max() < 3
        assert np.abs(mid[:, :2] / CELL - np.floor(p["positions"][:, :2].mean(0) / CELL) - uv).max() < 0.01


def test_seams_and_colours_hold(spark):
    """Half of a flat plate is red, half blue, and a seam doubles the vertices between: nothing crosses it."""
    p, uv, idx = terrain(0, 0, 10)
    p[:, 2] = 0
    left, right = (p[:, 0] <= 50.0001), (p[:, 0] >= 49.9999)
    tri = idx.reshape(-1, 3)
    parts = []
    for keep in (left, right):
        t = tri[keep[tri].all(1)]
        (q,), t = mesh.compacted([p], t.ravel())
        parts.append((q, t))
    positions, indices = mesh.merged(parts)
    red = np.repeat([[1.0, 0, 0], [0, 0, 1.0]], [len(parts[0][0]), len(parts[1][0])], axis=0)
    points = simplify.spread(positions, None, red, 0.0)
    kept, error = simplify.collapsed(points, indices, 4, 0.01)
    assert error < 1e-5 and len(kept) < len(indices)
    assert (np.ptp(red[kept.reshape(-1, 3)], axis=1) == 0).all()
    assert borders(positions, kept) == borders(positions, indices)
    # A fold in the texture alone is kept: without it the flat plate would lose its middle.
    bent = np.column_stack([np.abs(p[:, 0] - 50) / 100, p[:, 1] / 100])
    flat, _ = simplify.collapsed(simplify.spread(p, None, None, 0), idx, 4, 0.5)
    folded, _ = simplify.collapsed(simplify.spread(p, bent, None, 100.0), idx, 4, 0.5)
    assert len(folded) > len(flat)
    corners = p[folded.reshape(-1, 3)]
    assert ((corners[..., 0] <= 50.0001).all(1) | (corners[..., 0] >= 49.9999).all(1)).all()


def test_quadrics_measure_distances():
    rng = np.random.default_rng(0)
    tri = rng.normal(size=(5, 3, simplify.DIMS))
    q, area = simplify.triangle_quadrics(tri.reshape(-1, simplify.DIMS), np.arange(15).reshape(5, 3))
    for k in range(5):
        x = rng.normal(size=simplify.DIMS)
        base = np.stack([tri[k, 1] - tri[k, 0], tri[k, 2] - tri[k, 0]], axis=1)
        rest = x - tri[k, 0] - base @ np.linalg.lstsq(base, x - tri[k, 0], rcond=None)[0]
        got = simplify.quadric_errors(q[k : k + 1], x[None])[0]
        assert abs(got - area[k] * rest @ rest) < 1e-9
        assert abs(area[k] - np.sqrt(np.linalg.det(base.T @ base)) / 2) < 1e-9


def test_copies_resume_and_tell(spark, tmp_path):
    src, out = tmp_path / "a", tmp_path / "b"
    (src / "x/deep").mkdir(parents=True)
    (src / "xy").mkdir()
    for name, size in (("x/one.bin", 10), ("x/deep/two.bin", 20_000), ("x/empty.bin", 0), ("xy/other.bin", 5)):
        (src / name).write_bytes(bytes(i % 251 for i in range(size)))
    folders = spark.createDataFrame([(f"file://{src}/x", "Data/x")], "folder string, prefix string")
    plan = copies.below(folders)
    status = lambda: {r.target: r.status for r in copies.copied(plan, str(out), tag="t").collect()}
    assert status() == dict.fromkeys(("Data/x/one.bin", "Data/x/deep/two.bin", "Data/x/empty.bin"), "copied")
    (out / "Data/x/deep/two.bin").unlink()
    (out / "Data/x/one.bin").write_bytes(b"something else")
    assert status() == {"Data/x/one.bin": "differs", "Data/x/deep/two.bin": "copied", "Data/x/empty.bin": "kept"}
    assert (out / "Data/x/deep/two.bin").read_bytes() == (src / "x/deep/two.bin").read_bytes() and not list(out.rglob("*.part"))
    (out / "Data/x/one.bin").unlink()
    (out / "Data/x/one.bin").symlink_to(src / "x/one.bin")
    manifest = copies.copied(plan, str(out))
    assert [(r.target, r.status) for r in copies.faults(manifest).collect()] == [("Data/x/one.bin", "link")]
