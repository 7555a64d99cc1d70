"""Payload headers by ranged reads."""

import json

import numpy as np

from quadrille.operators import mesh
from quadrille.plans import commands
from quadrille.sources import binary, headers


def box_glb(cells=20):
    pos, nor, uv, idx = mesh.box_mesh(2.0, cells, (10, 0, 0))
    return binary.write_glb([{"positions": pos, "normals": nor, "uvs": uv, "indices": idx}])


def changed(glb, change):
    doc, blob = binary.split_glb(glb)
    change(doc)
    return binary.join_glb(doc, blob)


def test_geometry_is_not_read(spark, tmp_path):
    glb = box_glb(60)
    (tmp_path / "a.glb").write_bytes(glb)
    (tmp_path / "b.b3dm").write_bytes(binary.pack_b3dm(glb, (1.0, 2.0, 3.0)))
    doc, blob = binary.split_glb(glb)
    rows = {r.path.rsplit("/", 1)[1]: r for r in headers.headers(spark, str(tmp_path)).collect()}
    size = len(json.dumps(doc, separators=(",", ":")))
    for name, kind in (("a.glb", "glb"), ("b.b3dm", "b3dm")):
        r = rows[name]
        assert r.kind == kind and r.fault is None and json.loads(r.doc) == doc and r.bin_length == len(blob)
        # The JSON chunk and less than a hundred bytes more, of over half a megabyte.
        assert size <= r.bytes_read <= size + 100 and r.length > 500_000
    known = {r.path.rsplit("/", 1)[1]: r for r in headers.facts(headers.headers(spark, str(tmp_path))).collect()}
    assert np.allclose(known["a.glb"].bounds, [9, -1, -1, 11, 1, 1]) and known["b.b3dm"].references == [] and known["a.glb"].n_meshes == 1


def test_faults_of_payloads(spark, tmp_path):
    glb = box_glb(2)
    head = lambda *v: b"b3dm" + np.array(v, "<u4").tobytes()
    cases = {
        "ok.glb": (glb, None), "cut.b3dm": (b"b3dm\1\0", "B3DM_HEADER"), "version.b3dm": (head(2, 28, 0, 0, 0, 0), "B3DM_VERSION"), "long.b3dm": (head(1, 99, 0, 0, 0, 0), "B3DM_LENGTH"),
        "tables.b3dm": (head(1, 28, 50, 0, 0, 0), "B3DM_TABLES"), "none.b3dm": (head(1, 28, 0, 0, 0, 0), "GLB_MAGIC"), "magic.glb": (b"abcd" + glb[4:], "GLB_MAGIC"), "short.glb": (glb[:16], "GLB_SHORT"),
        "v1.glb": (glb[:4] + b"\1" + glb[5:], "GLB_VERSION"), "length.glb": (glb[:-4], "GLB_LENGTH"), "chunk.glb": (glb[:16] + b"BIN\0" + glb[20:], "GLB_CHUNK"), "json.glb": (glb[:20] + b"x" + glb[21:], "GLB_JSON"),
        "view.glb": (changed(glb, lambda d: d["bufferViews"][0].update(byteLength=10**9)), "BUFFER_VIEW"), "free.glb": (changed(glb, lambda d: d["bufferViews"][0].pop("byteLength")), "BUFFER_VIEW"),
        "other.glb": (changed(glb, lambda d: (d["buffers"].append({"uri": "x.bin", "byteLength": 10**9}), d["bufferViews"].append({"buffer": 1, "byteLength": 10**8}))), None),
    }
    at = glb.index(b"BIN\0")
    cases["bin.glb"] = (glb[: at - 4] + np.array([10**9], "<u4").tobytes() + glb[at:], "GLB_BIN")
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r.fault for r in headers.headers(spark, str(tmp_path)).collect()}
    assert {n: f and f.split(":")[0] for n, f in got.items()} == {n: f for n, (_, f) in cases.items()}
    (tmp_path / "tileset.json").write_text("{}")
    issues = {(r.code, r.path.rsplit("/", 1)[1]) for r in commands.validate_tileset(spark, str(tmp_path), strict=True).collect()}
    assert {("BUFFER_VIEW", "view.glb"), ("BUFFER_VIEW", "free.glb"), ("GLB_JSON", "json.glb"), ("GLB_BIN", "bin.glb")} <= issues
    assert not {p for _, p in issues} & {"ok.glb", "other.glb"}
