"""Queries on what a rebuild computes: errors and frames of all levels, and pixels through the image codec."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import errors as E
from quadrille.functions import matrix as M
from quadrille.operators.lineage import cut
from quadrille.plans import rebuild
from quadrille.plans.registry import query
from quadrille.plans.spatial import LEVELS_SQL, blocks
from quadrille.sources import raster
from quadrille.sources.tables import table

#: All nodes with their ids, centres and diagonals.
NODES_SQL = f"""{LEVELS_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, t AS (SELECT CAST(level AS INT) AS level, gx, gy, CASE WHEN level = 0 THEN 'L0_' || block_id ELSE 'Proxy_L' || level || '_' || gx || '_' || gy END AS id, block_id,
 (min_x + max_x) / 2 AS cx, (min_y + max_y) / 2 AS cy, (min_z + max_z) / 2 AS cz, sqrt((max_x - min_x) ** 2 + (max_y - min_y) ** 2 + (max_z - min_z) ** 2) AS diagonal FROM n JOIN k USING (level))"""
#: Simplification errors stand in for those of meshes: a number that follows from a proxy's place.
ERRORS_SQL = """leaf AS (SELECT t.id, t.gx, t.gy, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 1.0 END AS src, greatest(diagonal * 0.75, 1.0) AS most FROM t JOIN supplier ON s_suppkey = block_id WHERE level = 0),
 r AS (SELECT id, 0 AS level, gx, gy, CASE WHEN src > most * 2 THEN most ELSE src END AS ge FROM leaf
 UNION ALL SELECT t.id, t.level, t.gx, t.gy, greatest(b.below + (t.gx * 7 + t.gy) % 5 * 0.5, b.below * 2, t.diagonal * 0.75, b.below + 1) FROM (SELECT level + 1 AS level, CAST(floor(gx / 2) AS INT) AS gx, CAST(floor(gy / 2) AS INT) AS gy, max(ge) AS below FROM r GROUP BY 1, 2, 3) b JOIN t ON t.level = b.level AND t.gx = b.gx AND t.gy = b.gy)"""


def tree_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with their errors, blocks) over suppliers, whose account is the error of their content."""
    placed = blocks(spark, sf_dir).withColumn("block_id", F.col("block_id").cast("string"))
    nodes = cut(rebuild.tree_nodes(placed))
    source = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("block_id"), "s_acctbal")
    leaf = nodes.filter("level = 0").join(source, "block_id").select("id", E.leaf_error(F.col("s_acctbal"), F.col("diagonal")).alias("ge"))
    error = nodes.filter("level > 0").select("id", ((F.col("gx") * 7 + F.col("gy")) % 5 * 0.5).alias("error"))
    return nodes.join(rebuild.level_errors(nodes, leaf, error).select("id", "ge"), "id"), placed


@query(f"{NODES_SQL}, {ERRORS_SQL} SELECT id, level, round(ge, 6) AS ge FROM r")
def rebuild_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of all nodes of a rebuild, bottom up."""
    nodes, _ = tree_of(spark, sf_dir)
    return nodes.select("id", "level", F.round("ge", 6).alias("ge"))


@query(f"""{NODES_SQL} SELECT t.id, u.id AS parent_id, CASE WHEN t.level = 0 THEN 0.0 ELSE t.cx END - coalesce(u.cx, 0.0) AS dx, CASE WHEN t.level = 0 THEN 0.0 ELSE t.cy END - coalesce(u.cy, 0.0) AS dy, CASE WHEN t.level = 0 THEN 0.0 ELSE t.cz END - coalesce(u.cz, 0.0) AS dz,
 CASE WHEN t.level = 0 THEN './Data/' || t.block_id || '/tileset.json' WHEN (t.gx + t.gy) % 3 <> 1 THEN './Data/' || t.id || '/' || t.id || '.b3dm' END AS uri FROM t LEFT JOIN t u ON u.level = t.level + 1 AND u.gx = CAST(floor(t.gx / 2) AS INT) AND u.gy = CAST(floor(t.gy / 2) AS INT)""")
def rebuild_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each tile of a rebuilt document stands in its parent's frame, and what it refers to; every third proxy is empty."""
    nodes, placed = tree_of(spark, sf_dir)
    box = M.aabb_box([F.col(f"min_{a}") for a in "xyz"], [F.col(f"max_{a}") for a in "xyz"])
    made = nodes.withColumn("has_content", (F.col("level") == 0) | ((F.col("gx") + F.col("gy")) % 3 != 1))
    bodies = rebuild.body(made, placed.select("block_id", box.alias("box"), M.identity().alias("transform")), rebuild.Options())
    tile = F.from_json("body", "transform array<double>, content struct<uri: string>")
    return bodies.select("id", "parent_id", tile.alias("t")).select("id", "parent_id", *(F.get("t.transform", 12 + i).alias(f"d{a}") for i, a in enumerate("xyz")), F.col("t.content.uri").alias("uri"))


#: Pixels in a row of a text's picture.
WIDTH = 64


@query(f"SELECT doc_id, n AS n_pixels, sha256(b || repeat(chr(0), n * 4 - strlen(b))) AS digest FROM (SELECT doc_id, coalesce(text, '') AS b, CAST(ceil(greatest(strlen(coalesce(text, '')), 1) / {4.0 * WIDTH}) AS BIGINT) * {WIDTH} AS n FROM documents)")
def pixels_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's bytes as RGBA pixels through the PNG writer and reader."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                raw = (text or "").encode()
                rows_ = -(-max(len(raw), 1) // (4 * WIDTH))
                pixels = np.frombuffer(raw.ljust(rows_ * WIDTH * 4, b"\0"), np.uint8).reshape(rows_, WIDTH, 4)
                again = raster.decoded(raster.encoded(pixels))
                rows.append((doc_id, rows_ * WIDTH, sha256(again.tobytes()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_pixels", "digest"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, n_pixels long, digest string")
