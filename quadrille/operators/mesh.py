"""Indexed meshes: transforms, compaction, merging, borders, box meshes. Numpy on one node's meshes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def transformed(positions: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Positions (n, 3) through a column-major matrix of 16."""
    m = np.asarray(matrix, float).reshape(4, 4).T
    return positions @ m[:3, :3].T + m[:3, 3]


def transformed_normals(normals: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Unit normals through the inverse transpose of the linear part, which stays right under uneven scales."""
    m = np.asarray(matrix, float).reshape(4, 4).T[:3, :3]
    n = normals @ np.linalg.inv(m)
    return n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)


def inverse(matrix: np.ndarray) -> np.ndarray | None:
    """General inverse of a column-major matrix; None where it is singular."""
    m = np.asarray(matrix, float).reshape(4, 4)
    if not np.isfinite(m).all() or abs(np.linalg.det(m)) < 1e-15:
        return None
    return np.linalg.inv(m).ravel()


def compacted(attributes: list[np.ndarray], indices: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Drop unused vertices; those left are numbered by first use."""
    used, first, place = np.unique(indices, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    return [a[used[order]] for a in attributes], rank[place.ravel()]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One mesh of several (positions, indices)."""
    offsets = np.cumsum([0, *(len(p) for p, _ in parts)])
    return np.concatenate([p for p, _ in parts]), np.concatenate([i + o for (_, i), o in zip(parts, offsets, strict=False)])


def border_vertices(indices: np.ndarray) -> np.ndarray:
    """Vertices on edges that one triangle alone has."""
    tri = indices.reshape(-1, 3)
    edges = np.sort(np.concatenate([tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]]), axis=1)
    edges, counts = np.unique(edges, axis=0, return_counts=True)
    return np.unique(edges[counts == 1])


def box_mesh(size: float, cells: int, centre: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions, normals, texture coordinates and indices of a cube of cells x cells quads per face."""
    u, v = np.meshgrid(np.linspace(0, 1, cells + 1), np.linspace(0, 1, cells + 1), indexing="ij")
    uv = np.column_stack([u.ravel(), v.ravel()])
    i, j = np.meshgrid(np.arange(cells), np.arange(cells), indexing="ij")
    a = (i * (cells + 1) + j).ravel()
    quad = np.column_stack([a, a + cells + 1, a + cells + 2, a, a + cells + 2, a + 1]).ravel()
    pos, nor, uvs, idx = [], [], [], []
    for axis in range(3):
        for sign in (-1.0, 1.0):
            p = np.empty((len(uv), 3))
            p[:, axis] = sign * size / 2
            p[:, (axis + 1) % 3], p[:, (axis + 2) % 3] = (uv - 0.5).T * size
            n = np.zeros((len(uv), 3))
            n[:, axis] = sign
            faces = quad if sign > 0 else quad.reshape(-1, 3)[:, [0, 2, 1]].ravel()
            idx.append(faces + len(pos) * len(uv))
            pos.append(p + np.asarray(centre))
            nor.append(n)
            uvs.append(uv)
    return np.concatenate(pos), np.concatenate(nor), np.concatenate(uvs), np.concatenate(idx)


def border_table(meshes: DataFrame) -> DataFrame:
    """(mesh, x, y, z) of border points of whole meshes (mesh, positions, indices)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for mesh, positions, indices in zip(batch["mesh"], batch["positions"], batch["indices"], strict=True):
                p = np.asarray(positions, float).reshape(-1, 3)[border_vertices(np.asarray(indices, int))]
                yield pd.DataFrame({"mesh": mesh, "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    return meshes.select("mesh", "positions", "indices").mapInPandas(run, "mesh string, x double, y double, z double")
