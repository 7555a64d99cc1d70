"""Tilesets as tables: one row per tile, blocks with their grid place, representations with their world transforms."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import matrix as M
from quadrille.functions import text as T
from quadrille.operators import tree

TILE = (
    "doc string, base string, loc string, parent_loc string, depth int, pos int, ge double, doc_ge double, refine string, has_refine boolean, has_volume boolean, "
    "box array<double>, region array<double>, sphere array<double>, has_transform boolean, transform array<double>, uri string, legacy_url string, n_contents int, version string, required array<string>, error string"
)


#: Reports that a rebuild leaves beside a tileset; they are no tile documents.
REPORTS = ("rebuild_metrics.json",)


def documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """path and whole text of the JSON files below a folder, reports left out."""
    texts = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return texts.select(F.input_file_name().alias("path"), F.col("value").alias("text")).filter(~F.element_at(F.split("path", "/"), -1).isin(*REPORTS))


def _numbers(value: object) -> list[float] | None:
    """A list as floats, NaN where an element is no number; None if it is no list."""
    if not isinstance(value, list):
        return None
    return [float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else math.nan for v in value]


def _rows(path: str, text: str) -> list[tuple]:
    base = path.rpartition("/")[0]
    try:
        doc = json.loads(text)
        if not isinstance(doc, dict):
            raise ValueError("not an object")
    except ValueError as e:
        return [(path, base, None, None, None, None, None, None, None, False, False, None, None, None, False, None, None, None, 0, None, None, f"TILESET_JSON_INVALID: {e}")]
    fault = "ASSET_MISSING" if "asset" not in doc else None
    if "root" not in doc:
        return [(path, base, None, None, None, None, None, None, None, False, False, None, None, None, False, None, None, None, 0, None, None, "; ".join(filter(None, [fault, "ROOT_MISSING"])))]
    asset = doc.get("asset") if isinstance(doc.get("asset"), dict) else {}
    doc_ge = doc.get("geometricError")
    doc_ge = float(doc_ge) if isinstance(doc_ge, (int, float)) else None
    out, todo = [], [(doc["root"], f"{path}#root", None, 0, 0)]
    while todo:
        tile, loc, up, depth, pos = todo.pop()
        tile = tile if isinstance(tile, dict) else {}
        ge, volume, content = tile.get("geometricError"), tile.get("boundingVolume"), tile.get("content")
        volume_map, content = volume if isinstance(volume, dict) else {}, content if isinstance(content, dict) else {}
        contents = tile.get("contents")
        ge = math.nan if ge is not None and not isinstance(ge, (int, float)) else None if ge is None else float(ge)
        out.append((
            path, base, loc, up, depth, pos, ge, doc_ge, tile.get("refine") if isinstance(tile.get("refine"), str) else None, "refine" in tile, volume is not None,
            _numbers(volume_map.get("box")), _numbers(volume_map.get("region")), _numbers(volume_map.get("sphere")), "transform" in tile, _numbers(tile.get("transform")),
            content.get("uri") if isinstance(content.get("uri"), str) else None, content.get("url") if isinstance(content.get("url"), str) else None, len(contents) if isinstance(contents, list) else 0,
            asset.get("version"), doc.get("extensionsRequired"), fault if up is None else None,
        ))
        kids = tile.get("children")
        if isinstance(kids, list):
            todo += [(k, f"{loc}/children[{i}]", loc, depth + 1, i) for i, k in reversed(list(enumerate(kids)))]
    return out


def tiles(docs: DataFrame) -> DataFrame:
    """Every tile of every document (path, text); a document that can't be read gives one row with its error. A document is walked without recursion, so depth is not limited."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for p, t in zip(batch["path"], batch["text"], strict=True) for r in _rows(p, t)], columns=[c.split()[0] for c in TILE.split(", ")])

    return docs.select("path", "text").mapInPandas(run, TILE)


def with_parents(tiles_: DataFrame) -> DataFrame:
    """Add parent_ge (the document's error for a root) and is_root, as the validators need them. A tile without error passes its parent's on only by one level."""
    up = tiles_.select(F.col("loc").alias("parent_loc"), F.coalesce("ge", "doc_ge").alias("up_ge"))
    joined = tiles_.join(up, "parent_loc", "left")
    return joined.withColumn("parent_ge", F.when(F.col("parent_loc").isNull(), F.col("doc_ge")).otherwise(F.col("up_ge"))).withColumn("is_root", F.col("parent_loc").isNull()).drop("up_ge")


def blocks(tiles_: DataFrame, root_doc: str) -> DataFrame:
    """Children of the root document that refer to external tilesets, with the grid place in their name, their error and their box in the world: block_id, doc (the external document), gx, gy, ge, transform, bounds."""
    local = F.coalesce("transform", M.identity())
    root = tiles_.filter((F.col("doc") == root_doc) & F.col("parent_loc").isNull()).select(F.col("loc").alias("root_loc"), local.alias("root_world"))
    kids = tiles_.filter((F.col("doc") == root_doc) & F.lower(T.clean_uri(F.col("uri"))).endswith(".json")).join(F.broadcast(root), F.col("parent_loc") == F.col("root_loc"))
    world = M.multiply(F.col("root_world"), local)
    found = kids.withColumn("world", world).withColumn("uri", T.normalise_uri(F.col("uri")))
    hull = M.box_aabb(F.col("box"), F.col("world"))
    return found.select(F.regexp_extract("uri", r"([^/]+)/[^/]*$", 1).alias("block_id"), F.concat(F.lit(root_doc.rsplit("/", 1)[0] + "/"), T.clean_uri(F.col("uri"))).alias("doc"), T.tile_x(F.col("uri")).alias("gx"), T.tile_y(F.col("uri")).alias("gy"), "ge", "uri", "box", F.col("world").alias("transform"), *(F.get(hull, i).alias(n) for i, n in enumerate(("min_x", "min_y", "min_z", "max_x", "max_y", "max_z"))))


def representations(tiles_: DataFrame, blocks_: DataFrame) -> DataFrame:
    """Content nodes of each block's own document in depth-first order, numbered from 0, with the accumulated transform: block_id, rep_index, ge, uri, transform."""
    mine = tiles_.join(blocks_.select("block_id", "doc", F.col("transform").alias("block_world")), "doc")
    nodes = mine.select(F.col("loc").alias("id"), F.col("parent_loc").alias("parent_id"), "transform", "block_id", "block_world", "ge", "uri")
    world = tree.with_world(nodes).select("id", "world")
    order = F.transform(F.filter(F.split("id", r"/children\["), lambda x: ~F.contains(x, F.lit("#root"))), lambda x: F.regexp_replace(x, r"\]", "").try_cast("int"))
    content = nodes.join(world, "id").filter("uri IS NOT NULL AND NOT lower(uri) LIKE '%.json'").withColumn("order", order)
    per = content.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("order", "id"))).alias("all"))
    return content.join(per, "block_id").select("block_id", (F.array_position(F.transform("all", lambda x: x["id"]), F.col("id")) - 1).cast("int").alias("rep_index"), "ge", "uri", M.multiply(F.col("block_world"), F.col("world")).alias("transform"))
