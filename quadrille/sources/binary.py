"""Binary glTF and B3DM: readers, writers and byte alignment, and their tables over binaryFile scans."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the formats: magics, component types with their numpy kinds, and elements per shape.
GLB_MAGIC, B3DM_MAGIC, JSON_CHUNK, BIN_CHUNK = b"glTF", b"b3dm", b"JSON", b"BIN\0"
COMPONENTS = {5120: "<i1", 5121: "<u1", 5122: "<i2", 5123: "<u2", 5125: "<u4", 5126: "<f4"}
SHAPES = {"SCALAR": 1, "VEC2": 2, "VEC3": 3, "VEC4": 4}
#: Required extensions that readers may leave out of account.
TEXTURE_EXTENSIONS = ("KHR_texture_basisu", "KHR_materials_pbrSpecularGlossiness", "KHR_techniques_webgl", "EXT_texture_webp")


class BinaryError(ValueError):
    """A payload that can't be read, with the reason."""


def split_glb(data: bytes) -> tuple[dict, bytes]:
    """The JSON document and binary chunk of a GLB."""
    if len(data) < 20 or data[:4] != GLB_MAGIC:
        raise BinaryError("not a GLB")
    version, length = struct.unpack_from("<II", data, 4)
    if version != 2 or length > len(data):
        raise BinaryError("GLB version or length is wrong")
    at, doc, blob = 12, None, b""
    while at + 8 <= length:
        size, kind = struct.unpack_from("<I4s", data, at)
        if at + 8 + size > length:
            raise BinaryError("GLB chunk exceeds the file")
        body = data[at + 8 : at + 8 + size]
        if kind == JSON_CHUNK and doc is None:
            try:
                doc = json.loads(body)
            except ValueError as e:
                raise BinaryError(f"GLB JSON: {e}") from e
        elif kind == BIN_CHUNK and not blob:
            blob = body
        at += 8 + size
    if doc is None:
        raise BinaryError("GLB has no JSON")
    return doc, blob


def join_glb(doc: dict, blob: bytes) -> bytes:
    """A GLB of a document and binary chunk, both padded to 4 bytes."""
    text = json.dumps(doc, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    blob += b"\0" * (-len(blob) % 4)
    chunks = struct.pack("<I4s", len(text), JSON_CHUNK) + text + (struct.pack("<I4s", len(blob), BIN_CHUNK) + blob if blob else b"")
    return GLB_MAGIC + struct.pack("<II", 2, 12 + len(chunks)) + chunks


def unpack_b3dm(data: bytes) -> tuple[bytes, tuple[float, float, float] | None]:
    """The GLB within a B3DM and its RTC centre; a GLB is returned as it is. Up to 7 bytes of padding after the GLB are taken off."""
    if data[:4] != B3DM_MAGIC:
        return data, None
    if len(data) < 28:
        raise BinaryError("B3DM header is cut short")
    _, length, fj, fb, bj, bb = struct.unpack_from("<6I", data, 4)
    start = 28 + fj + fb + bj + bb
    if length > len(data) or start > length:
        raise BinaryError("B3DM lengths are wrong")
    glb = data[start:length]
    if glb[:4] == GLB_MAGIC and len(glb) >= 12:
        size = struct.unpack_from("<I", glb, 8)[0]
        if size > len(glb) or len(glb) - size > 7:
            raise BinaryError("GLB length within B3DM is wrong")
        glb = glb[:size]
    centre = None
    if fj:
        table = json.loads(data[28 : 28 + fj].rstrip(b"\0 ") or b"{}")
        if isinstance(c := table.get("RTC_CENTER"), list) and len(c) == 3:
            centre = tuple(map(float, c))
    return glb, centre


def pack_b3dm(glb: bytes, centre: tuple[float, float, float] | None = None) -> bytes:
    """An unbatched B3DM; all parts are aligned to 8 bytes."""
    table = json.dumps({"BATCH_LENGTH": 0} | ({"RTC_CENTER": list(centre)} if centre else {}), separators=(",", ":")).encode()
    table += b" " * (-(28 + len(table)) % 8)
    glb += b"\0" * (-len(glb) % 8)
    return B3DM_MAGIC + struct.pack("<6I", 1, 28 + len(table) + len(glb), len(table), 0, 0, 0) + table + glb


def realign_b3dm(data: bytes) -> bytes:
    """The same B3DM with its tables and body on 8-byte borders; other payloads and aligned ones are returned unchanged."""
    if data[:4] != B3DM_MAGIC:
        return data
    _, length, *sizes = struct.unpack_from("<6I", data, 4)
    parts, at = [], 28
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    body = data[at:length]
    ends = np.cumsum([28, *sizes])[1:]
    if length % 8 == 0 and all(e % 8 == 0 for e, s in zip(ends, sizes, strict=True) if s):
        return data
    out, offset = [], 28
    for k, part in enumerate(parts):
        if part or k == 0:
            part += (b" " if k % 2 == 0 else b"\0") * (-(offset + len(part)) % 8)
        out.append(part)
        offset += len(part)
    body += b"\0" * (-len(body) % 8)
    return B3DM_MAGIC + struct.pack("<6I", 1, offset + len(body), *map(len, out)) + b"".join(out) + body


def accessor(doc: dict, blob: bytes, index: int) -> np.ndarray:
    """Values (n, width) of an accessor as floats (or integers of indices), with stride and normalisation."""
    a = doc["accessors"][index]
    kind, width, n = np.dtype(COMPONENTS[a["componentType"]]), SHAPES[a["type"]], a["count"]
    if "bufferView" not in a or "sparse" in a:
        raise BinaryError("accessors without a plain buffer view are unsupported")
    view = doc["bufferViews"][a["bufferView"]]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    stride = view.get("byteStride") or width * kind.itemsize
    if n and start + (n - 1) * stride + width * kind.itemsize > min(len(blob), view.get("byteOffset", 0) + view["byteLength"]):
        raise BinaryError("accessor exceeds its buffer view")
    values = np.ndarray((n, width), kind, blob, start, (stride, kind.itemsize)) if n else np.empty((0, width), kind)
    if a.get("normalized") and kind.kind in "iu":
        return np.maximum(values.astype(float) / np.iinfo(kind).max, -1.0)
    return values.astype(float) if kind.kind == "f" else values.astype(np.int64)


def node_matrix(node: dict) -> np.ndarray:
    """Local 4x4 matrix (rows by columns) of a node; a matrix and TRS may not be mixed, and the rotation must have length 1."""
    if "matrix" in node:
        if {"translation", "rotation", "scale"} & node.keys():
            raise BinaryError("node mixes matrix and TRS")
        return np.asarray(node["matrix"], float).reshape(4, 4).T
    x, y, z, w = map(float, node.get("rotation", (0, 0, 0, 1)))
    if abs((x * x + y * y + z * z + w * w) ** 0.5 - 1) > 1e-5:
        raise BinaryError("node rotation is no unit quaternion")
    m = np.eye(4)
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    m[:3, :3] = turn * np.asarray(node.get("scale", (1, 1, 1)), float)
    m[:3, 3] = node.get("translation", (0, 0, 0))
    return m


def scene_nodes(doc: dict) -> Iterator[tuple[dict, np.ndarray]]:
    """Nodes of the default scene with their world matrices."""
    scenes = doc.get("scenes") or [{"nodes": list(range(len(doc.get("nodes", []))))}]
    todo = [(i, np.eye(4), 0) for i in reversed(scenes[doc.get("scene", 0)].get("nodes", []))]
    while todo:
        i, up, depth = todo.pop()
        if depth > 128:
            raise BinaryError("node tree is too deep or has a cycle")
        node = doc["nodes"][i]
        world = up @ node_matrix(node)
        yield node, world
        todo += [(c, world, depth + 1) for c in reversed(node.get("children", []))]


def transformed_tangents(tangents: np.ndarray, linear: np.ndarray) -> np.ndarray:
    """Unit tangents (n, 4) through a linear map; a mirroring one turns their handedness."""
    along = tangents[:, :3] @ linear.T
    along /= np.maximum(np.linalg.norm(along, axis=1, keepdims=True), 1e-300)
    return np.column_stack([along, tangents[:, 3] * (-1.0 if np.linalg.det(linear) < 0 else 1.0)])


def read_primitives(data: bytes, strict: bool = False) -> list[dict]:
    """Primitives of a GLB or B3DM in its root frame (Y up as stored): positions, normals, uvs, further texture coordinates, colours and tangents, indices, material.

    Primitives that are no triangle lists are left out, or an error if ``strict``.
    """
    glb, centre = unpack_b3dm(data)
    doc, blob = split_glb(glb)
    out = []
    for node, world in scene_nodes(doc):
        if "mesh" not in node:
            continue
        for prim in doc["meshes"][node["mesh"]]["primitives"]:
            if prim.get("mode", 4) != 4 or "POSITION" not in prim.get("attributes", {}):
                if strict:
                    raise BinaryError("a primitive is no triangle list with positions")
                continue
            get = lambda name, p=prim: accessor(doc, blob, p["attributes"][name]) if name in p["attributes"] else None
            pos = get("POSITION") @ world[:3, :3].T + world[:3, 3]
            nor = get("NORMAL")
            if nor is not None:
                nor = nor @ np.linalg.inv(world[:3, :3])
                nor /= np.maximum(np.linalg.norm(nor, axis=1, keepdims=True), 1e-300)
            idx = accessor(doc, blob, prim["indices"]).ravel() if "indices" in prim else np.arange(len(pos))
            index = prim.get("material")
            colour = (doc["materials"][index].get("pbrMetallicRoughness") or {}).get("baseColorFactor", [1.0, 1, 1, 1]) if index is not None else None
            key = "default" if index is None else f"mat{index}:" + ",".join(f"{c:.3f}" for c in colour)
            more = {name: get(name) for name in prim["attributes"] if name.startswith(("TEXCOORD_", "COLOR_")) and name != "TEXCOORD_0"}
            if "TANGENT" in prim["attributes"]:
                more["TANGENT"] = transformed_tangents(get("TANGENT"), world[:3, :3])
            out.append({"positions": pos.astype(np.float32), "normals": None if nor is None else nor.astype(np.float32), "uvs": get("TEXCOORD_0"), "more": more, "indices": idx.astype(np.int32), "material": index, "material_key": key, "centre": centre})
    return out


def looks(doc: dict, blob: bytes) -> tuple[dict, list[bytes | None]]:
    """What a document's primitives look like: its materials, textures, samplers, images and the extensions they use, and each image's embedded bytes (None where it has a URI)."""
    kept = {k: doc[k] for k in ("materials", "textures", "samplers", "images", "extensionsUsed", "extensionsRequired") if doc.get(k)}
    data = []
    for image in kept.get("images", []):
        view = doc["bufferViews"][image["bufferView"]] if "bufferView" in image else None
        at = view.get("byteOffset", 0) if view else 0
        if view and at + view["byteLength"] > len(blob):
            raise BinaryError("image exceeds the binary chunk")
        data.append(blob[at : at + view["byteLength"]] if view else None)
    return kept, data


def write_glb(primitives: list[dict], look: tuple[dict, list[bytes | None]] | None = None) -> bytes:
    """A GLB with one node per primitive: positions (with min and max), and normals, texture coordinates and colours where given.

    With the ``looks`` of a document its materials and textures are kept, a primitive's ``material`` is its number in them, and
    embedded images are moved to the new binary chunk; else each primitive has a material of its ``colour``.
    """
    doc = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": []}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": []} | (look[0] if look else {"materials": []})
    blob = bytearray()

    def add(values: np.ndarray, kind: int, shape: str, target: int, bounds: bool = False) -> int:
        raw = np.ascontiguousarray(values, COMPONENTS[kind]).tobytes()
        doc["bufferViews"].append({"buffer": 0, "byteOffset": len(blob), "byteLength": len(raw), "target": target})
        blob.extend(raw + b"\0" * (-len(raw) % 4))
        a = {"bufferView": len(doc["bufferViews"]) - 1, "componentType": kind, "count": len(values), "type": shape}
        if bounds:
            f = np.asarray(values, np.float32)
            a |= {"min": f.min(0).tolist(), "max": f.max(0).tolist()}
        doc["accessors"].append(a)
        return len(doc["accessors"]) - 1

    for p in primitives:
        attributes = {"POSITION": add(p["positions"], 5126, "VEC3", 34962, True)}
        if p.get("normals") is not None:
            attributes["NORMAL"] = add(p["normals"], 5126, "VEC3", 34962)
        if p.get("uvs") is not None:
            attributes["TEXCOORD_0"] = add(p["uvs"], 5126, "VEC2", 34962)
        for name, values in p.get("more", {}).items():
            attributes[name] = add(values, 5126, f"VEC{values.shape[1]}", 34962)
        prim = {"attributes": attributes, "indices": add(np.asarray(p["indices"]), 5125, "SCALAR", 34963)}
        if look is None:
            doc["materials"].append({"pbrMetallicRoughness": {"baseColorFactor": list(p.get("colour", (1.0, 1.0, 1.0, 1.0)))}})
            prim["material"] = len(doc["materials"]) - 1
        elif p.get("material") is not None:
            prim["material"] = p["material"]
        doc["meshes"].append({"primitives": [prim]})
        doc["scenes"][0]["nodes"].append(len(doc["nodes"]))
        doc["nodes"].append({"mesh": len(doc["meshes"]) - 1})
    if look and "images" in look[0]:
        doc["images"] = []
        for image, data in zip(look[0]["images"], look[1], strict=True):
            if data is not None:
                doc["bufferViews"].append({"buffer": 0, "byteOffset": len(blob), "byteLength": len(data)})
                blob.extend(data + b"\0" * (-len(data) % 4))
                image = image | {"bufferView": len(doc["bufferViews"]) - 1}
            doc["images"].append(image)
    doc["buffers"] = [{"byteLength": len(blob) + -len(blob) % 4}]
    return join_glb(doc, bytes(blob))


def readable(doc: dict) -> dict:
    """The document without required texture extensions, each texture's source filled from its extension."""
    out = dict(doc)
    for name in ("extensionsRequired", "extensionsUsed"):
        left = [e for e in doc.get(name, []) if e not in TEXTURE_EXTENSIONS]
        out.pop(name, None)
        if left:
            out[name] = left
    if "textures" in doc:
        found = lambda t: next((e["source"] for e in (t.get("extensions") or {}).values() if isinstance(e, dict) and "source" in e), None)
        out["textures"] = [t if "source" in t or found(t) is None else t | {"source": found(t)} for t in doc["textures"]]
    return out


def position_bounds(doc: dict) -> np.ndarray | None:
    """(min, max) rows over the scene from accessor minima and maxima alone; geometry is not read."""
    corners = []
    for node, world in scene_nodes(doc):
        for prim in doc["meshes"][node["mesh"]]["primitives"] if "mesh" in node else ():
            a = doc["accessors"][prim["attributes"]["POSITION"]]
            box = np.array([[a[("min", "max")[k >> i & 1]][i] for i in range(3)] for k in range(8)], float)
            corners.append(box @ world[:3, :3].T + world[:3, 3])
    return None if not corners else np.stack([np.concatenate(corners).min(0), np.concatenate(corners).max(0)])


def references(doc: dict) -> list[str]:
    """External files that buffers and images name."""
    return [x["uri"] for part in ("buffers", "images") for x in doc.get(part, []) if "uri" in x and not x["uri"].startswith("data:")]


def images(doc: dict, blob: bytes) -> list[tuple[str, bytes]]:
    """(mime, bytes) of embedded images; those with a URI are left out."""
    out = []
    for image in doc.get("images", []):
        if "bufferView" in image:
            v = doc["bufferViews"][image["bufferView"]]
            at = v.get("byteOffset", 0)
            out.append((image.get("mimeType", ""), blob[at : at + v["byteLength"]]))
    return out


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from a PNG, JPEG or KTX2 header; None for others."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:12] == b"\xabKTX 20\xbb\r\n\x1a\n":
        return struct.unpack_from("<II", data, 20)
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker in range(0xC0, 0xD0) and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", data, at + 5)
            return w, h
        at += 2 + size
    return None


def binary_files(spark: SparkSession, path: str, glob: str = "*.{b3dm,glb}") -> DataFrame:
    """path, length, modificationTime, content of matching files below a folder. The content is only read where a query uses it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def primitives(files: DataFrame) -> DataFrame:
    """One row per primitive of each payload: path, prim, material_key, triangles, positions, normals, uvs, indices, and error where a payload can't be read."""
    schema = "path string, prim int, material_key string, triangles long, vertices long, positions array<float>, normals array<float>, uvs array<float>, indices array<int>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    for k, p in enumerate(read_primitives(bytes(content))):
                        rows.append((path, k, p["material_key"], len(p["indices"]) // 3, len(p["positions"]), p["positions"].ravel(), None if p["normals"] is None else p["normals"].ravel(), None if p["uvs"] is None else p["uvs"].astype(np.float32).ravel(), p["indices"], None))
                except (BinaryError, KeyError, IndexError, struct.error) as e:
                    rows.append((path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInPandas(run, schema)


def documents(files: DataFrame) -> DataFrame:
    """path and the JSON document of each payload as text; geometry stays unread."""

    @F.pandas_udf("string")
    def text(content: pd.Series) -> pd.Series:
        def one(c: bytes) -> str | None:
            try:
                return json.dumps(split_glb(unpack_b3dm(bytes(c))[0])[0])
            except BinaryError:
                return None

        return content.map(one)

    return files.select("path", text("content").alias("doc"))
