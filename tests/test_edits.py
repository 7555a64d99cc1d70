"""Clipping and flattening of whole tilesets, made here."""

import json
import shutil

import numpy as np
import pytest

from quadrille.plans import commands, edits
from quadrille.sources import binary, sinks
from tests.test_commands import place_mesh, square


def two_documents(folder):
    """A root that refers to an external document with one plate, and has a plate of its own 1 km to the east."""
    place_mesh(folder / "near")
    doc = json.loads((folder / "near/tileset.json").read_text())
    frame = doc["root"].pop("transform")
    (folder / "near/tileset.json").write_text(json.dumps(doc))
    shutil.copy(folder / "near/a.b3dm", folder / "far.b3dm")
    east = np.eye(4)
    east[0, 3] = 1000.0
    box = {"box": [0, 0, 5, 100, 0, 0, 0, 100, 0, 0, 0, 1]}
    wide = {"box": [500, 0, 5, 600, 0, 0, 0, 100, 0, 0, 0, 1]}
    kids = [
        {"boundingVolume": box, "geometricError": 1, "content": {"uri": "far.b3dm"}, "transform": east.T.ravel().tolist()},
        {"boundingVolume": wide, "geometricError": 5, "content": {"uri": "./near/tileset.json"}, "extras": {"name": "kept"}},
    ]
    root = {"asset": {"version": "1.0", "extras": 1}, "geometricError": 10, "root": {"transform": frame, "boundingVolume": wide, "geometricError": 2, "refine": "ADD", "children": kids}}
    (folder / "tileset.json").write_text(json.dumps(root))
    return f"file://{folder}/tileset.json"


def texts(got):
    return {r.path.rsplit("/t/", 1)[1]: json.loads(r.text) for r in got["documents"].collect()}


def test_clipped_trees(spark, tmp_path):
    root_doc = two_documents(tmp_path / "t")
    got = edits.edit_tileset(spark, str(tmp_path / "t"), root_doc, square(50))
    docs = texts(got)
    assert sorted(docs) == ["near/tileset.json", "tileset.json"] and got["errors"].count() == 0
    (child,) = docs["tileset.json"]["root"]["children"]
    assert child["content"]["uri"] == "./near/tileset.json" and child["extras"] == {"name": "kept"} and docs["tileset.json"]["asset"]["extras"] == 1
    own = docs["near/tileset.json"]["root"]["boundingVolume"]["box"]
    assert abs(own[3] - 50) < 1 and abs(own[7] - 50) < 1
    # Boxes above hold it, and errors are not below those of contents.
    for tile in (child, docs["tileset.json"]["root"]):
        box = tile["boundingVolume"]["box"]
        assert tile["geometricError"] >= 5 and all(abs(box[i]) + own[3 + 4 * i] <= box[3 + 4 * i] + abs(own[i]) + 1e-3 for i in range(2)) and box[3] < 150
    sinks.payload_files(got["files"], str(tmp_path / "out"))
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*")) == ["near/a.b3dm", "near/tileset.json", "tileset.json"]
    away = {"type": "rectangle", "bounds": [118.0, 35.1, 118.01, 35.11]}
    assert edits.edit_tileset(spark, str(tmp_path / "t"), root_doc, away)["files"].count() == 0


def test_flattened_trees(spark, tmp_path):
    root_doc = two_documents(tmp_path / "t")
    got = edits.edit_tileset(spark, str(tmp_path / "t"), root_doc, square(50), height=0.0)
    docs = texts(got)
    assert len(docs["tileset.json"]["root"]["children"]) == 2 and got["counters"].first().walls >= 8
    far = docs["tileset.json"]["root"]["children"][0]
    assert far["boundingVolume"]["box"] == [0, 0, 5, 100, 0, 0, 0, 100, 0, 0, 0, 1]
    files = {r.path: bytes(r.content) for r in got["files"].collect()}
    assert set(files) == {"near/a.b3dm", "near/tileset.json", "tileset.json", "far.b3dm"} and files["far.b3dm"] == (tmp_path / "t/far.b3dm").read_bytes()


def test_contents_of_two_tiles_and_broken_ones(spark, tmp_path):
    root_doc = two_documents(tmp_path / "t")
    (tmp_path / "t/near/a.b3dm").write_bytes(b"nonsense")
    got = edits.edit_tileset(spark, str(tmp_path / "t"), root_doc, square(50))
    assert got["errors"].count() == 1 and "content" in texts(got)["near/tileset.json"]["root"]
    doc = json.loads((tmp_path / "t/tileset.json").read_text())
    whole = doc["root"]["children"]
    doc["root"]["children"] = [whole[0] | {"contents": [{}]}, whole[1]]
    (tmp_path / "t/tileset.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="unsupported"):
        edits.edit_tileset(spark, str(tmp_path / "t"), root_doc, square(50))
    doc["root"]["children"] = [*whole, whole[0]]
    (tmp_path / "t/tileset.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="more than one tile"):
        edits.edit_tileset(spark, str(tmp_path / "t"), root_doc, square(50))


def tangent_plate(hand=(1, 1, 1, 1)):
    """A plate of 200 m with normals, tangents along x that lean a little at one end, texture coordinates and a normal map."""
    x = np.array([-100.0, 100, 100, -100])
    lean = np.column_stack([np.ones(4), np.zeros(4), np.where(x > 0, 0.5, 0.0), hand])
    lean[:, :3] /= np.linalg.norm(lean[:, :3], axis=1, keepdims=True)
    look = ({"materials": [{"normalTexture": {"index": 0, "texCoord": 1}}], "textures": [{"source": 0}], "images": [{"mimeType": "image/png", "bufferView": 0}]}, [b"map"])
    uv = np.column_stack([(x + 100) / 200, [0.0, 0, 1, 1]])
    prim = {"positions": np.column_stack([x, np.full(4, 5.0), [100, 100, -100, -100]]), "normals": np.tile([0.0, 1, 0], (4, 1)), "uvs": np.zeros((4, 2)), "more": {"TEXCOORD_1": uv, "TANGENT": lean}, "indices": [0, 1, 2, 0, 2, 3], "material": 0}
    return binary.write_glb([prim], look)


def test_tangents_are_cut_and_made_anew(spark, tmp_path):
    place_mesh(tmp_path / "t")
    (tmp_path / "t/a.b3dm").write_bytes(binary.pack_b3dm(tangent_plate()))
    for height in (None, 0.0):
        row = commands.clip_contents(spark, str(tmp_path / "t"), square(50), height=height)["contents"].first()
        assert row.error is None
        (p,) = binary.read_primitives(bytes(row.content), strict=True)
        tangent, normal = p["more"]["TANGENT"], p["normals"].astype(float)
        assert np.allclose(np.linalg.norm(tangent[:, :3], axis=1), 1, atol=1e-5) and np.allclose((tangent[:, :3] * normal).sum(1), 0, atol=1e-5)
        share = (p["positions"][:, 0] + 100) / 200
        lie = np.abs(normal[:, 1] - 1) < 1e-3
        if height is None:
            # Linear between the ends, then of length 1.
            ends = np.array([[1.0, 0, 0], np.array([1, 0, 0.5]) / np.sqrt(1.25)])
            want = ends[0] + (ends[1] - ends[0]) * share[:, None]
            assert np.allclose(tangent[:, :3], want / np.linalg.norm(want, axis=1, keepdims=True), atol=1e-4) and (tangent[:, 3] == 1).all()
        else:
            made = lie & (np.abs(p["positions"][:, 1]) < 1)
            assert made.any() and np.allclose(tangent[made, :3], [1, 0, 0], atol=1e-3)


def broken_documents():
    """What an edit would lose or misread, as changes of a document, with a word of the error."""
    prim = lambda d: d["meshes"][0]["primitives"][0]
    yield lambda d: d["meshes"][0]["primitives"].append(prim(d) | {"mode": 1}), "triangle list"
    yield lambda d: d.update(skins=[{}]), "skins"
    yield lambda d: d.update(animations=[{}]), "animations"
    yield lambda d: prim(d).update(targets=[{}]), "targets"
    yield lambda d: d.update(extensionsUsed=["KHR_draco_mesh_compression"]), "extension"
    yield lambda d: prim(d)["attributes"].update(_BATCHID=0), "_BATCHID"
    yield lambda d: prim(d)["attributes"].update(NORMAL=prim(d)["indices"]), "malformed"
    yield lambda d: prim(d).update(material=7), "material"
    yield lambda d: d["buffers"].append({"uri": "x.bin", "byteLength": 4}), "outside"
    yield lambda d: d["asset"].update(version="1.0"), "version"
    yield lambda d: d["accessors"][prim(d)["indices"]].update(count=5), "triangles"


def test_what_an_edit_would_lose_is_an_error(spark, tmp_path):
    place_mesh(tmp_path / "t")
    good = tangent_plate()
    for change, word in broken_documents():
        doc, blob = binary.split_glb(good)
        change(doc)
        (tmp_path / "t/a.b3dm").write_bytes(binary.pack_b3dm(binary.join_glb(doc, blob)))
        row = commands.clip_contents(spark, str(tmp_path / "t"), square(50))["contents"].first()
        assert row.content is None and word in row.error, (word, row.error)
    (tmp_path / "t/a.b3dm").write_bytes(binary.pack_b3dm(tangent_plate((1, -1, 1, 1))))
    assert "handedness" in commands.clip_contents(spark, str(tmp_path / "t"), square(50))["contents"].first().error


def test_documents_that_editing_would_break_are_refused(spark, tmp_path):
    root_doc = two_documents(tmp_path / "t")
    whole = json.loads((tmp_path / "t/near/tileset.json").read_text())
    for change, word in (({"asset": {"version": "1.0", "gltfUpAxis": "Z"}}, "Y up"), ({"extensionsRequired": ["X"]}, "extensions"), ({"asset": {"version": "0.0"}}, "version"), ({"schema": {}}, "schema")):
        (tmp_path / "t/near/tileset.json").write_text(json.dumps(whole | change))
        with pytest.raises(ValueError, match=word):
            edits.edit_tileset(spark, str(tmp_path / "t"), root_doc, square(50))
