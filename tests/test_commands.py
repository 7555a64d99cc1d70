"""Whole tasks over folders made here."""

import json

import numpy as np
from pyspark.sql import functions as F

from quadrille.operators import contents, features, mesh, region, validate
from quadrille.plans import commands
from quadrille.sources import binary, sinks
from tests.test_operators import write_tilesets


def place_mesh(folder):
    """A tileset at lon 117, lat 35 with one plate of 200 m, as GLB in its tile's frame."""
    frame = np.eye(4)
    lo, la = np.radians(117.0), np.radians(35.0)
    frame[:3, 0] = [-np.sin(lo), np.cos(lo), 0]
    frame[:3, 1] = [-np.sin(la) * np.cos(lo), -np.sin(la) * np.sin(lo), np.cos(la)]
    frame[:3, 2] = [np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)]
    frame[:3, 3] = region.ecef(117.0, 35.0)
    glb = binary.write_glb([{"positions": np.array([[-100, 5, 100], [100, 5, 100], [100, 5, -100], [-100, 5, -100]]), "normals": None, "uvs": None, "indices": [0, 1, 2, 0, 2, 3]}])
    doc = {"asset": {"version": "1.0"}, "geometricError": 10, "root": {"transform": frame.T.ravel().tolist(), "boundingVolume": {"box": [0, 0, 5, 100, 0, 0, 0, 100, 0, 0, 0, 1]}, "geometricError": 5, "refine": "ADD", "content": {"uri": "a.b3dm"}}}
    folder.mkdir(parents=True)
    (folder / "a.b3dm").write_bytes(binary.pack_b3dm(glb))
    (folder / "tileset.json").write_text(json.dumps(doc))


def square(half_m):
    d_lat = half_m / 110941.0
    d_lon = half_m / (111320.0 * np.cos(np.radians(35.0)))
    return {"type": "rectangle", "bounds": [117 - d_lon, 35 - d_lat, 117 + d_lon, 35 + d_lat]}


def test_clip_and_flatten_contents(spark, tmp_path):
    place_mesh(tmp_path / "t")
    got = commands.clip_contents(spark, str(tmp_path / "t"), square(50))
    row = got["contents"].first()
    assert row.error is None and row.before == 2 and row.after >= 2
    prims = binary.read_primitives(bytes(row.content))
    tri = prims[0]["positions"].astype(float)[prims[0]["indices"].reshape(-1, 3)]
    area = (np.linalg.norm(np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0]), axis=1) / 2).sum()
    assert abs(area - 100 * 100) < 150 and abs(row.box[2] - 5) < 0.01 and abs(row.box[3] - 50) < 1
    flat = commands.clip_contents(spark, str(tmp_path / "t"), square(50), height=0.0)["counters"].first()
    assert flat.walls >= 8 and flat.flattened >= 2 and flat.n_files == 1
    away = {"type": "rectangle", "bounds": [117.1, 35.1, 117.11, 35.11]}
    assert commands.clip_contents(spark, str(tmp_path / "t"), away)["contents"].count() == 0


def textured_plate(name="COLOR_0"):
    """A plate of 200 m whose texture coordinates and colours follow x, with a texture of embedded bytes, written as a GLB."""
    x = np.array([-100.0, 100, 100, -100])
    look = ({"materials": [{"name": "plain"}, {"name": "skin", "pbrMetallicRoughness": {"baseColorTexture": {"index": 0}}}], "textures": [{"source": 0}], "images": [{"mimeType": "image/png", "bufferView": 7}]}, [b"picture"])
    tint = np.column_stack([(x + 100) / 200, np.zeros(4), np.ones(4)])
    prim = {"positions": np.column_stack([x, np.full(4, 5.0), [100, 100, -100, -100]]), "normals": np.tile([0.0, 1, 0], (4, 1)), "uvs": np.column_stack([(x + 100) / 200, np.zeros(4)]), "more": {name: tint}, "indices": [0, 1, 2, 0, 2, 3], "material": 1}
    return binary.write_glb([prim], look)


def test_edited_contents_keep_their_looks(spark, tmp_path):
    place_mesh(tmp_path / "t")
    (tmp_path / "t/a.b3dm").write_bytes(binary.pack_b3dm(textured_plate()))
    for height in (None, 0.0):
        row = commands.clip_contents(spark, str(tmp_path / "t"), square(50), height=height)["contents"].first()
        assert row.error is None
        doc, blob = binary.split_glb(binary.unpack_b3dm(bytes(row.content))[0])
        assert [m["name"] for m in doc["materials"]] == ["plain", "skin"] and binary.images(doc, blob) == [("image/png", b"picture")]
        (p,) = binary.read_primitives(bytes(row.content))
        share = (p["positions"][:, 0] + 100) / 200
        assert p["material"] == 1 and np.allclose(p["uvs"][:, 0], share, atol=1e-4) and np.allclose(p["more"]["COLOR_0"][:, 0], share, atol=1e-4)
        assert np.allclose(np.linalg.norm(p["normals"], axis=1), 1, atol=1e-5)
        assert (np.abs(p["normals"][:, 1]) < 0.1).any() == (height is not None)  # walls alone stand upright


def test_contents_off_the_earth_are_errors(spark, tmp_path):
    place_mesh(tmp_path / "t")
    where = region.parse(square(50))
    files = binary.binary_files(spark, str(tmp_path / "t")).withColumn("transform", F.array(*(F.lit(float(v)) for v in np.eye(4).ravel())))
    row = contents.edited(files, where).first()
    assert row.content is None and "earth-centred" in row.error


def test_most_documents(spark):
    docs = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    assert [r.code for r in validate.too_many(docs, 1).collect()] == ["TOO_MANY_TILESETS"] and validate.too_many(docs, 2).count() == 0
    assert validate.too_many(docs.limit(0), 0).count() == 0


def test_pruned_trees(spark):
    rows = [("r", ["r"], 1.0, None), ("a", ["r", "a"], 4.0, [0.0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1]), ("b", ["r", "b"], 2.0, None), ("c", ["r", "b", "c"], 3.0, [10.0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 1]), ("d", ["r", "d"], 1.0, None)]
    rows = [(i, p, g, None if b is None else [float(x) for x in b]) for i, p, g, b in rows]
    got = {r.id: (r.ge, r.box[0], r.box[3]) for r in contents.pruned(spark.createDataFrame(rows, "id string, path array<string>, ge double, box array<double>")).collect()}
    assert got == {"r": (4.0, 5.0, 6.0), "a": (4.0, 0.0, 1.0), "b": (3.0, 10.0, 1.0), "c": (3.0, 10.0, 1.0)}


def test_validate_and_plan(spark, tmp_path):
    folder = tmp_path / "grid"
    folder.mkdir()
    write_tilesets(folder)
    codes = [r.code for r in commands.validate_tileset(spark, str(folder)).collect()]
    assert sorted(set(codes)) == ["CONTENT_MISSING"] and len(codes) == 8
    root = f"file://{folder}/tileset.json"
    plan = commands.rebuild_plan(spark, str(folder), root, target=100.0)
    assert {r.rep_index for r in plan["selected"].collect()} == {0} and plan["grid"].first().complete
    levels = {r.level: r.ge for r in plan["nodes"].filter("gx = 0 AND gy = 0").collect()}
    assert levels[1] > levels[0] and all(r.within for r in plan["residuals"].collect())
    assert commands.check_errors(spark, str(folder)).count() == 0
    assert commands.check_frontier(spark, str(folder), root).count() == 0
    assert commands.check_subtree(spark, str(folder), str(folder)).count() == 0
    (folder / "Data/Tile_+000_+000/Tile_+000_+000.b3dm").write_bytes(b"nonsense")
    assert "CONTENT_TOO_SMALL" in [r.code for r in commands.validate_tileset(spark, str(folder), strict=True).collect()]


def test_merge_folders(spark, tmp_path):
    for n in "ab":
        place_mesh(tmp_path / n)
    got = commands.merge_tilesets(spark, [str(tmp_path / n) for n in "ab"])
    doc = json.loads(got["document"].first()[0])
    assert len(doc["root"]["children"]) == 2 and doc["geometricError"] >= 10 and got["issues"].count() == 0 and got["duplicates"].count() == 0


def test_feature_rules(spark):
    docs = [('{"meshes":[{"weights":[1]}]}', "gltf"), ('{"extensionsUsed":["KHR_materials_unlit"],"extras":{"skins":1}}', "gltf"), ('{"extensionsRequired":["X"]}', "gltf"), ("{", "gltf")]
    got = [r[0] for r in spark.createDataFrame(docs, "doc string, kind string").select(features.document_fault(F.col("doc"), "gltf")).collect()]
    assert got[0].endswith("glTF weights") and got[1] is None and got[2].endswith("extension X") and got[3].startswith("invalid JSON")
    assert features.tileset_fault({"asset": {"version": "1.0"}, "root": {"children": [{"contents": []}]}}).endswith("multiple contents") and features.tileset_fault({"asset": {"version": "1.1"}, "root": {}}) is None
    assert features.legacy_images({"textures": [{"source": 4}], "materials": [{}, {"extensions": {"KHR_techniques_webgl": {"values": {"u_diffuse": {"index": 0}}}}}]}) == {1: 4}
    one = lambda c: spark.range(1).select(c.alias("c")).first()[0]
    paths = lambda *p: F.array(*map(F.lit, p))
    assert one(features.merge_form_fault(paths("/a", "/b"), F.lit("/c"))) is None and one(features.merge_form_fault(paths("/a", "/A/"), F.lit("/c"))) == "duplicate merge input"
    assert one(features.merge_form_fault(paths("/a", "/b"), F.lit("/b/x"))) == "output must not overlap any input" and one(features.overlap_fault(F.lit("/a/tileset.json"), F.lit("/a"))) is not None
    nums = F.array(F.lit(1.0), F.lit(2.0))
    assert one(features.model_fault(F.lit("fbx"), F.lit("m"), F.lit("y"), F.lit("anchor"), F.lit(181.0), F.lit(0.0), nums, F.lit(None).cast("string"))).startswith("anchor longitudeDeg")
    lines = one(features.bounded_lines(F.lit("ab\n" + "x" * 7 + "\n"), 3))
    assert [(r.line, r.truncated) for r in lines] == [("ab", False), ("xxx", True), ("xxx", True), ("x", False)]
    assert one(features.texture_fault(F.lit("uastc"), F.lit(True), F.lit(False))) is not None and one(features.texture_fault(F.lit("etc1s"), F.lit(True), F.lit(False))) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a/x.bin", bytearray(b"12")), ("y.bin", None)], "path string, content binary")
    sinks.payload_files(df, str(tmp_path / "out"))
    assert (tmp_path / "out/a/x.bin").read_bytes() == b"12" and not (tmp_path / "out/y.bin").exists()
    sinks.payload_table(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    sinks.event_lines(spark.createDataFrame([(1, None)], "seq int, message string"), str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"seq":1}']
    assert mesh.box_mesh(1.0, 1)[3].max() == 23
