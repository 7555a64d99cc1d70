"""Payloads without their geometry: ranged reads of the header, the tables' sizes and the JSON chunk of GLB and B3DM files."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from quadrille.sources import binary
from quadrille.sources.payload import opened

SCHEMA = "path string, length long, kind string, doc string, bin_length long, bytes_read long, fault string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Bytes between a B3DM's tables and its GLB at most.
MOST_PADDING = 7


class _Reader:
    """A file whose bytes are fetched by range and counted."""

    def __init__(self, path: str) -> None:
        self.file, self.read = opened(path), 0

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        out = self.file.read(size)
        self.read += len(out)
        return out


def view_fault(doc: dict, bin_length: int) -> str | None:
    """The first buffer view without a length or beyond the binary chunk (where there is one)."""
    for i, view in enumerate(doc.get("bufferViews") or []):
        length, start = view.get("byteLength"), view.get("byteOffset", 0)
        if not isinstance(length, int) or not isinstance(start, int) or length < 0 or start < 0:
            return f"BUFFER_VIEW: bufferView[{i}] has no valid byteLength and byteOffset"
        own = isinstance(view.get("buffer", 0), int) and view.get("buffer", 0) == 0
        if own and bin_length and start + length > bin_length:
            return f"BUFFER_VIEW: bufferView[{i}] ends at {start + length} of {bin_length}"
    return None


def scanned(path: str, length: int) -> tuple:
    """A row of SCHEMA for a GLB or B3DM; ``fault`` is the first thing wrong with it."""
    kind, doc, bin_length, fault = None, None, 0, None
    reader = _Reader(path)
    with reader.file:
        def scan() -> str | None:
            nonlocal kind, doc, bin_length
            head, start = reader.at(0, 28), 0
            if head[:4] == binary.B3DM_MAGIC:
                kind = "b3dm"
                if len(head) < 28:
                    return "B3DM_HEADER: the header is cut short"
                version, whole, *tables = struct.unpack_from("<6I", head, 4)
                if version != 1:
                    return f"B3DM_VERSION: {version}"
                if whole > length:
                    return f"B3DM_LENGTH: {whole} of {length} bytes"
                start = 28 + sum(tables)
                if start > length:
                    return "B3DM_TABLES: tables exceed the file"
            else:
                kind = "glb"
            front = reader.at(start, 20 + MOST_PADDING)
            pad = front.find(binary.GLB_MAGIC, 0, MOST_PADDING + 4)
            if pad < 0:
                return "GLB_MAGIC: there is no GLB"
            if kind == "glb" and pad:
                return "GLB_MAGIC: bytes before the GLB"
            start += pad
            front = front[pad : pad + 20]
            if len(front) < 20:
                return "GLB_SHORT: the GLB is cut short"
            version, total, size, chunk = struct.unpack_from("<III4s", front, 4)
            if version != 2:
                return f"GLB_VERSION: {version}"
            if start + total > length:
                return f"GLB_LENGTH: {total} of {length - start} bytes"
            if chunk != binary.JSON_CHUNK:
                return "GLB_CHUNK: the JSON chunk is missing"
            if 20 + size > total:
                return "GLB_JSON: the JSON chunk exceeds the GLB"
            text = reader.at(start + 20, size)
            try:
                parsed = json.loads(text)
                doc = text.decode("utf-8").rstrip(" \0")
            except ValueError as e:
                return f"GLB_JSON: {e}"
            if not isinstance(parsed, dict):
                return "GLB_JSON: no object"
            if 20 + size + 8 <= total:
                found, chunk = struct.unpack("<I4s", reader.at(start + 20 + size, 8))
                if chunk == binary.BIN_CHUNK:
                    bin_length = found
                    if 28 + size + found > total:
                        return "GLB_BIN: the binary chunk exceeds the GLB"
            return view_fault(parsed, bin_length)

        fault = scan()
    return path, length, kind, doc, bin_length, reader.read, fault


def headers(spark: SparkSession, folder: str, glob: str = "*.{b3dm,glb}") -> DataFrame:
    """SCHEMA of all payloads below a folder: their JSON documents and faults. A task reads headers and JSON alone; geometry stays where it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                try:
                    rows.append(scanned(path, int(length)))
                except OSError as e:
                    rows.append((path, length, None, None, 0, 0, f"CONTENT_UNREADABLE: {e}"))
            yield pd.DataFrame(rows, columns=NAMES)

    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "length")
    return listing.mapInPandas(run, SCHEMA)


def facts(found: DataFrame) -> DataFrame:
    """path, bounds (min and max of the scene, from the accessors' own), references (external files), meshes and images of payloads with a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["doc"], strict=True):
                doc, box = json.loads(text), None
                try:
                    corners = binary.position_bounds(doc)
                    box = None if corners is None else [float(v) for v in corners.ravel()]
                except (binary.BinaryError, KeyError, IndexError, TypeError, np.linalg.LinAlgError):
                    pass  # accessors without bounds have none here
                rows.append((path, box, binary.references(doc), len(doc.get("meshes") or []), len(doc.get("images") or [])))
            yield pd.DataFrame(rows, columns=["path", "bounds", "references", "n_meshes", "n_images"])

    return found.filter("doc IS NOT NULL").select("path", "doc").mapInPandas(run, "path string, bounds array<double>, references array<string>, n_meshes long, n_images long")
