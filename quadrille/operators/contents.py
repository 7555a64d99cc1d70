"""Clipping and flattening whole contents: binary payloads in, edited payloads out, one row each. Contents that a region excludes are filtered before by their boxes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import matrix as M
from quadrille.operators import clip, features, region
from quadrille.operators.clip import face_frames
from quadrille.sources import binary

#: glTF's Y-up frame in the tiles' Z-up frame.
Z_UP = np.array([[1.0, 0, 0, 0], [0, 0, -1, 0], [0, 1, 0, 0], [0, 0, 0, 1]])
OUT = "path string, content binary, before long, after long, flattened long, walls long, box array<double>, error string"


def in_reach(tiles: DataFrame, where: region.Region) -> DataFrame:
    """Tiles whose world box the region does not exclude: boxes (12 numbers) and world transforms are turned into the region's frame in SQL."""
    frame = F.array(*(F.lit(float(v)) for v in where.frame))
    hull = M.box_aabb(F.col("box"), M.multiply(frame, F.coalesce("transform", M.identity())))
    return tiles.withColumn("__hull", hull).filter(~region.excludes_box(where, *(F.get("__hull", i) for i in (0, 1, 3, 4)))).drop("__hull")


#: Metres from the earth's centre between which vertices of georeferenced contents lie.
EARTH = (6.0e6, 7.0e6)


def stacked(p: dict) -> tuple[np.ndarray, dict[str, slice]]:
    """Vertices (n, d) of a primitive, positions first, and the columns of each further attribute."""
    there = {"normals": p["normals"], "uvs": p["uvs"]} | p["more"]
    parts, at, where = [p["positions"]], 3, {}
    for name, values in there.items():
        if values is not None:
            parts.append(values)
            where[name] = slice(at, at + values.shape[1])
            at += values.shape[1]
    return np.concatenate([np.asarray(v, float) for v in parts], axis=1), where


def normal_uv(material: dict | None) -> tuple[str, np.ndarray]:
    """The texture coordinates that a material's normal map uses, and the linear part of its texture transform."""
    texture = (material or {}).get("normalTexture") or {}
    turn = (texture.get("extensions") or {}).get("KHR_texture_transform") or {}
    number = turn.get("texCoord", texture.get("texCoord", 0))
    if number not in (0, 1):
        raise binary.BinaryError("normal maps must use texture coordinates 0 or 1")
    (u, v), angle = turn.get("scale", (1.0, 1.0)), float(turn.get("rotation", 0.0))
    c, s = np.cos(angle), np.sin(angle)
    return ("uvs", "TEXCOORD_1")[number], np.array([[c * u, s * v], [-s * u, c * v]])


def tangents(at: np.ndarray, own: np.ndarray, normal: np.ndarray, local: np.ndarray, columns: dict[str, slice], material: dict | None) -> np.ndarray:
    """Tangents (m, 3, 4) of triangles: interpolated ones made square to the normal, and those of their faces for triangles that are new."""
    name, linear = normal_uv(material)
    faces, uv = local, None
    if name in columns:
        faces, uv = np.concatenate([local, at[..., columns[name]] @ linear.T], axis=2), slice(3, 5)
    _, fresh = face_frames(faces, slice(0, 3), uv)
    smooth = at[..., columns["TANGENT"]]
    along = smooth[..., :3] - normal * (smooth[..., :3] * normal).sum(2, keepdims=True)
    length = np.linalg.norm(along, axis=2, keepdims=True)
    if (own[:, None] & (length[..., 0] < 1e-12)).any():
        raise binary.BinaryError("a cut tangent has no length")
    kept = np.concatenate([along / np.maximum(length, 1e-300), np.sign(smooth[..., 3:])], axis=2)
    return np.where(own[:, None, None], kept, np.repeat(fresh[:, None], 3, 1))


def edit(content: bytes, transform: np.ndarray, where: region.Region, height: float | None) -> tuple[bytes | None, dict[str, int], list[float] | None]:
    """The content with what lies in the region cut out (``height`` None: kept in the region only; else flattened to it), counts, and its new box in the tile's frame.

    Texture coordinates and colours are interpolated where triangles are cut, materials, textures and embedded images are kept.
    Normals and tangents are interpolated too, but flattened triangles, walls, and primitives without normals take those of their
    faces. What would be lost (other features, extensions, attributes, primitives that are no triangle lists) is an error.
    Positions are rounded to 32 bits as stored, and the box is that of the rounded ones. Vertices that are not at an earth
    radius from the centre are an error.
    """
    glb, centre = binary.unpack_b3dm(content)
    doc, blob = binary.split_glb(glb)
    if fault := features.content_fault(doc, len(content)):
        raise binary.BinaryError(fault)
    tile = np.eye(4)
    tile[:3, 3] = centre or (0, 0, 0)
    up = tile @ Z_UP
    world = np.asarray(transform, float).reshape(4, 4).T @ up
    to_region = np.asarray(where.frame).reshape(4, 4).T @ world
    back = np.linalg.inv(to_region)
    counts = {"before": 0, "after": 0, "flattened": 0, "walls": 0}
    out, corners = [], []
    for p in binary.read_primitives(content, strict=True):
        if len(p["indices"]) % 3 or (len(p["indices"]) and p["indices"].max() >= len(p["positions"])):
            raise binary.BinaryError("indices are no triangles of the vertices")
        if "TANGENT" in p["more"]:
            hand = p["more"]["TANGENT"][:, 3][p["indices"].reshape(-1, 3)]
            if (np.abs(hand) != 1).any() or (hand != hand[:, :1]).any():
                raise binary.BinaryError("tangents of a triangle differ in handedness")
        vertices, columns = stacked(p)
        radius = np.linalg.norm(vertices[:, :3] @ world[:3, :3].T + world[:3, 3], axis=1)
        if not ((radius >= EARTH[0]) & (radius <= EARTH[1])).all():
            raise binary.BinaryError("vertices are not earth-centred")
        vertices[:, :3] = vertices[:, :3] @ to_region[:3, :3].T + to_region[:3, 3]
        tri = vertices[p["indices"].reshape(-1, 3)]
        counts["before"] += len(tri)
        if height is None:
            kept, _ = clip.fans(clip.clipped(where, tri, slice(0, 2)))
            made = {"kept": kept}
        else:
            made = clip.flattened(where, tri, height)
            counts["flattened"] += len(made["flat"])
            counts["walls"] += len(made["wall"])
        at = np.concatenate(list(made.values()))
        own = np.concatenate([np.full(len(m), kind == "kept") for kind, m in made.items()])
        local = (at[..., :3] @ back[:3, :3].T + back[:3, 3]).astype(np.float32)
        good = clip.solid(local.astype(float), slice(0, 3)) if len(local) else np.empty(0, bool)
        at, own, local = at[good], own[good], local[good]
        if not len(local):
            continue
        counts["after"] += len(local)
        face, _ = face_frames(local.astype(float), slice(0, 3))
        normal = np.repeat(face[:, None], 3, 1)
        if "normals" in columns:
            smooth = at[..., columns["normals"]]
            length = np.linalg.norm(smooth, axis=2, keepdims=True)
            normal = np.where(own[:, None, None] & (length > 1e-12), smooth / np.maximum(length, 1e-12), normal)
        more = {}
        if "TANGENT" in columns:
            material = None if p["material"] is None else doc["materials"][p["material"]]
            more["TANGENT"] = tangents(at, own, normal, local.astype(float), columns, material).reshape(-1, 4)
        if 3 * len(local) > features.MOST_VERTICES:
            raise binary.BinaryError("the edited primitive exceeds 1000000 vertices")
        flat = local.reshape(-1, 3)
        part = lambda name, at=at, columns=columns: at[..., columns[name]].reshape(len(at) * 3, -1) if name in columns else None
        out.append({"positions": flat, "normals": normal.reshape(-1, 3), "uvs": part("uvs"), "more": {name: part(name) for name in p["more"]} | more, "indices": np.arange(len(flat)), "material": p["material"]})
        corners.append(flat.astype(float) @ up[:3, :3].T + up[:3, 3])
    if not out:
        return None, counts, None
    glb = binary.write_glb(out, binary.looks(doc, blob))
    data = binary.pack_b3dm(glb, centre) if content[:4] == binary.B3DM_MAGIC else glb
    lo, hi = np.concatenate(corners).min(0), np.concatenate(corners).max(0)
    half = np.maximum((hi - lo) / 2, 1e-6)
    box = [*((lo + hi) / 2), half[0], 0, 0, 0, half[1], 0, 0, 0, half[2]]
    return data, counts, [float(v) for v in box]


def edited(files: DataFrame, where: region.Region, height: float | None = None) -> DataFrame:
    """Edit contents (path, content, transform: the tile's world matrix). A null content in the result means that nothing is left; an unreadable one has an error. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content, transform in zip(batch["path"], batch["content"], batch["transform"], strict=True):
                try:
                    data, n, box = edit(bytes(content), transform, where, height)
                    rows.append((path, data, n["before"], n["after"], n["flattened"], n["walls"], box, None))
                except (binary.BinaryError, KeyError, IndexError, struct.error, np.linalg.LinAlgError) as e:
                    rows.append((path, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    return files.select("path", "content", "transform").mapInPandas(run, OUT)


def counters(results: DataFrame) -> DataFrame:
    """One row: triangles before and after, flattened, walls, contents written and removed."""
    return results.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("before", "after", "flattened", "walls")), F.count("content").alias("n_files"), F.count_if(F.col("content").isNull()).alias("n_removed"))


def pruned(tiles: DataFrame) -> DataFrame:
    """Tiles that still lead to content, with boxes that hold all content below and errors that are not below their children's: one aggregate over (ancestor, content) rows by path.

    tiles: id, path (array of ids from the root), ge, box (of own content, null where none).
    """
    content = tiles.filter("box IS NOT NULL").select(F.explode("path").alias("id"), "box", F.col("ge").alias("below"))
    hull = M.box_aabb(F.col("box"))
    spread = content.select("id", "below", hull.alias("h")).groupBy("id").agg(*(F.min(F.get("h", i)).alias(f"l{i}") for i in range(3)), *(F.max(F.get("h", i + 3)).alias(f"h{i}") for i in range(3)), F.max("below").alias("below"))
    box = M.aabb_box([F.col(f"l{i}") for i in range(3)], [F.col(f"h{i}") for i in range(3)], 1e-6)
    return tiles.drop("box").join(spread.select("id", box.alias("box"), "below"), "id").withColumn("ge", F.greatest("ge", "below")).drop("below")
