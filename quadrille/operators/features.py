"""Rules on documents and options: unsupported features, required extensions, limits, forms. Each gives a reason, null where all is well."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quadrille.functions import text as T
from quadrille.sources.fixed import lines

#: Keys of documents that editing does not support, and extensions that it does.
GLTF_KEYS = ("skins", "animations", "targets", "weights", "skin", "sparse")
GLTF_EXTENSIONS = ("KHR_materials_unlit", "KHR_texture_transform")
TILESET_VERSIONS = ("1.0", "1.1")
#: Limits of contents.
MOST_CONTENT, MOST_JSON, MOST_VERTICES, MOST_NODES, MOST_DEPTH = 128 << 20, 16 << 20, 1_000_000, 100_000, 128
LOW_DISK = 1 << 30
LINE_BYTES = 64 * 1024


def _walk(value: object) -> Iterator[dict]:
    """Every object in a document but those below ``extras``."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            yield v
            todo += [c for k, c in v.items() if k != "extras"]
        elif isinstance(v, list):
            todo += v


def gltf_fault(doc: dict) -> str | None:
    """The first feature or extension of a glTF document that editing does not support."""
    for o in _walk(doc):
        if bad := next((k for k in GLTF_KEYS if k in o), None):
            return f"clip does not support glTF {bad}"
        names = list(o["extensions"]) if isinstance(o.get("extensions"), dict) else []
        for key in ("extensionsRequired", "extensionsUsed"):
            names += o[key] if isinstance(o.get(key), list) else []
        if bad := next((n for n in names if n not in GLTF_EXTENSIONS), None):
            return f"clip does not support glTF extension {bad}"
    return None


#: Attributes that editing interpolates, with the accessor types they may have.
ATTRIBUTES = {"POSITION": ("VEC3",), "NORMAL": ("VEC3",), "TANGENT": ("VEC4",), "TEXCOORD_0": ("VEC2",), "TEXCOORD_1": ("VEC2",), "COLOR_0": ("VEC3", "VEC4")}
FLOAT, INDEX_TYPES = 5126, (5121, 5123, 5125)


def content_fault(doc: dict, n_bytes: int) -> str | None:
    """Why a payload's document can't be edited without a loss: features, limits, primitives or attributes that would vanish, references that lead nowhere."""
    if fault := gltf_fault(doc):
        return fault
    if n_bytes > MOST_CONTENT:
        return "content exceeds 128 MiB"
    if len(doc.get("nodes") or []) > MOST_NODES:
        return "content exceeds 100000 nodes"
    if (doc.get("asset") or {}).get("version") != "2.0":
        return "asset version is not 2.0"
    if any("uri" in b for b in doc.get("buffers") or []):
        return "a buffer lies outside the payload"
    accessors = doc.get("accessors") or []
    for mesh in doc.get("meshes") or []:
        for p in mesh.get("primitives") or []:
            if p.get("mode", 4) != 4:
                return "a primitive is no triangle list"
            if "material" in p and not 0 <= p["material"] < len(doc.get("materials") or []):
                return "a primitive's material is missing"
            used = p.get("attributes") or {}
            if "POSITION" not in used:
                return "a primitive has no positions"
            for name, number in used.items():
                a = accessors[number] if isinstance(number, int) and 0 <= number < len(accessors) else None
                if name not in ATTRIBUTES:
                    return f"attribute {name} would be lost"
                if a is None or a.get("type") not in ATTRIBUTES[name]:
                    return f"attribute {name} is malformed"
                if name in ("POSITION", "NORMAL", "TANGENT") and a.get("componentType") != FLOAT:
                    return f"attribute {name} is not of floats"
            counts = {accessors[i].get("count") for i in used.values()}
            if len(counts) != 1:
                return "attributes differ in their counts"
            if counts.pop() > MOST_VERTICES:
                return "primitive exceeds 1000000 vertices"
            if "indices" in p:
                a = accessors[p["indices"]] if 0 <= p["indices"] < len(accessors) else {}
                if a.get("type") != "SCALAR" or a.get("componentType") not in INDEX_TYPES or a.get("normalized"):
                    return "indices are malformed"
    return None


def tileset_fault(doc: dict) -> str | None:
    """Why a tileset document can't be merged or clipped."""
    for o in _walk(doc):
        if "root" in o:
            if not isinstance(o.get("asset"), dict) or o["asset"].get("version") not in TILESET_VERSIONS:
                return "merge supports tileset asset.version 1.0 or 1.1"
            if {"schema", "schemaUri", "groups"} & o.keys():
                return "merge does not yet support structural metadata schemas or groups"
        if isinstance(o.get("metadata"), dict) and "class" in o["metadata"]:
            return "merge does not yet support structural metadata classes"
        if "implicitTiling" in o or "contents" in o:
            return "merge does not yet support implicitTiling or multiple contents"
        if o.get("extensionsRequired"):
            return "merge does not yet support required tileset extensions"
    return None


def legacy_images(doc: dict) -> dict[int, int]:
    """Material number to image number where a material names its texture in the older technique."""
    out, textures = {}, doc.get("textures") or []
    for i, material in enumerate(doc.get("materials") or []):
        diffuse = (((material.get("extensions") or {}).get("KHR_techniques_webgl") or {}).get("values") or {}).get("u_diffuse")
        index = diffuse.get("index") if isinstance(diffuse, dict) else diffuse
        if isinstance(index, int) and 0 <= index < len(textures) and isinstance(textures[index].get("source"), int):
            out[i] = textures[index]["source"]
    return out


@F.pandas_udf(StringType())
def _faults(docs: pd.Series, kinds: pd.Series) -> pd.Series:
    def one(text: str | None, kind: str) -> str | None:
        try:
            doc = json.loads(text or "")
        except ValueError as e:
            return f"invalid JSON: {e}"
        return gltf_fault(doc) if kind == "gltf" else tileset_fault(doc)

    return pd.Series([one(t, k) for t, k in zip(docs, kinds, strict=True)], dtype=object)


def document_fault(doc: Column, kind: str) -> Column:
    """As gltf_fault or tileset_fault, over a column of JSON texts."""
    return _faults(doc, F.lit(kind))


def unsupported_required(required: Column, allowed: tuple[str, ...] | None = None) -> Column:
    """Required extensions that a validator does not know: all but the allowed ones (by default those of the data file) and those of the Khronos group."""
    known = lines("required_extensions") if allowed is None else allowed
    return F.array_sort(F.filter(F.coalesce(required, F.array().cast("array<string>")), lambda n: ~n.isin(*known) & ~n.startswith("KHR_")))


def limit_fault(bytes_: Column, vertices: Column, nodes: Column, depth: Column) -> Column:
    """The first limit that a content exceeds."""
    return F.when(bytes_ > MOST_CONTENT, "content exceeds 128 MiB").when(vertices > MOST_VERTICES, "primitive exceeds 1000000 vertices").when(nodes > MOST_NODES, "content exceeds 100000 nodes").when(depth > MOST_DEPTH, "nodes are nested deeper than 128")


def model_fault(format_: Column, unit: Column, axes: Column, mode: Column, lon: Column, lat: Column, numbers: Column, crs: Column) -> Column:
    """What is wrong with model options; ``numbers``: all that the georeference mode needs."""
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when((format_ == "obj") & (unit == "fromMetadata"), "OBJ requires an explicit model.unit")
        .when((format_ == "obj") & (axes == "fromMetadata"), "OBJ requires explicit model.axes")
        .when((mode == "anchor") & ~finite, "anchor georeference values must be finite numbers")
        .when((mode == "anchor") & ~lon.between(-180, 180), "anchor longitudeDeg must be between -180 and 180")
        .when((mode == "anchor") & ~lat.between(-90, 90), "anchor latitudeDeg must be between -90 and 90")
        .when((mode == "projected") & (F.trim(F.coalesce(crs, F.lit(""))) == ""), "projected georeference requires sourceCrs")
        .when((mode == "projected") & ~finite, "projected originOffset values must be finite numbers")
    )


def overlap_fault(input_: Column, output: Column) -> Column:
    """Why an output can't be written for an input: the same folder, or one in the other."""
    norm = lambda p: F.lower(F.regexp_replace(F.regexp_replace(F.replace(F.trim(p), F.lit("\\"), F.lit("/")), "/+$", ""), r"(?i)/[^/]+\.json$", ""))
    i, o = norm(input_), norm(output)
    return F.when((i == "") | (o == ""), "input and output are required").when((i == o) | T.is_strict_descendant(i, o) | T.is_strict_descendant(o, i), "output must not overlap the input")


def merge_form_fault(inputs: Column, output: Column) -> Column:
    """What is wrong with the inputs (an array of paths) and output of a merge."""
    norm = F.transform(inputs, lambda p: F.lower(F.regexp_replace(F.replace(F.trim(p), F.lit("\\"), F.lit("/")), "/+$", "")))
    return (
        F.when(~F.size(inputs).between(2, 64), "merge needs 2 to 64 inputs")
        .when(F.exists(norm, lambda p: p == ""), "every input needs a path")
        .when(F.size(F.array_distinct(norm)) < F.size(norm), "duplicate merge input")
        .when(F.exists(inputs, lambda p: overlap_fault(p, output).isNotNull()), "output must not overlap any input")
    )


def low_disk(free: Column, threshold: int = LOW_DISK) -> Column:
    return F.coalesce(free < threshold, F.lit(False))


def texture_fault(mode: Column, native: Column, tools: Column) -> Column:
    """Why a texture mode is not available: it needs the native route (not for UASTC) or the post-processing tools."""
    m = T.texture_mode(mode)
    return F.when((m == "keep") | (native & (m != "ktx2-uastc")) | tools, F.lit(None).cast("string")).otherwise(F.concat(F.lit("texture mode '"), m, F.lit("' unavailable")))


def cache_key(image: Column, mode: Column, quality: Column, encoder: str, version: str) -> Column:
    """Key of an encoded texture in the cache."""
    return F.sha2(F.concat(image, mode.cast("binary"), quality.cast("string").cast("binary"), F.lit(encoder + version).cast("binary")), 256)


def search(tools: DataFrame, query: str) -> DataFrame:
    """Tools whose title or description holds the query; all for an empty one."""
    q = query.strip().lower()
    hit = lambda c: F.contains(F.lower(c), F.lit(q))
    return tools if not q else tools.filter(hit("title") | hit("description"))


def bounded_lines(text: Column, most: int = LINE_BYTES) -> Column:
    """Lines of a text, longer ones cut into pieces of ``most`` characters: an array of (line, truncated)."""
    def cut(line: Column) -> Column:
        n = F.greatest(F.ceil(F.length(line) / most).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.substring(line, i * most + 1, F.lit(most)).alias("line"), (i < n - 1).alias("truncated")))

    return F.flatten(F.transform(F.split(F.regexp_replace(text, "\n$", ""), "\n"), cut))


def probe_once(files: DataFrame) -> DataFrame:
    """One row per distinct (path, length, time), so that no content is probed twice."""
    return files.dropDuplicates(["path", "length", "modificationTime"])


def texture_chain(prims: DataFrame, materials: DataFrame, textures: DataFrame, images: DataFrame) -> DataFrame:
    """Primitives with their texture's hash: primitive > material > texture > image, each step a left join."""
    return prims.join(materials, ["path", "material"], "left").join(textures, ["path", "texture"], "left").join(images, ["path", "image"], "left")


def world_mismatch(source: DataFrame, output: DataFrame, eps: float = 1e-6) -> DataFrame:
    """References whose world transform differs between two trees by more than eps (uri, transform)."""
    from quadrille.functions.matrix import max_abs_diff

    other = output.select("uri", F.col("transform").alias("other"))
    return source.join(other, "uri").withColumn("difference", max_abs_diff(F.col("transform"), F.col("other"))).filter(F.col("difference") > eps).select("uri", "difference")


def latest_checkpoint(marks: DataFrame) -> DataFrame:
    """The last stage that each task reached."""
    return marks.groupBy("task_id").agg(F.max_by("stage", "at").alias("stage"))
