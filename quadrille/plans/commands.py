"""Whole tasks over folders: scan, validate, check, plan a rebuild, merge, clip, flatten. Each returns DataFrames; nothing is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import errors as E
from quadrille.functions import matrix as M
from quadrille.functions import text as T
from quadrille.operators import contents, features, grid, merge, quadtree, region, tree, validate
from quadrille.sources import binary, scan, tileset
from quadrille.sources import headers as payloads


def scan_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Tile folders, totals and issues of a photogrammetry dataset."""
    folders = scan.tile_folders(scan.files(spark, folder))
    return {"folders": folders, "totals": scan.totals(folders), "issues": scan.scan_issues(folders)}


def validate_tileset(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    """Issues of every document, tile, reference and payload header below a folder."""
    all_ = tileset.tiles(tileset.documents(spark, folder))
    broken = all_.filter("error IS NOT NULL").select(F.regexp_extract("error", "^([A-Z_]+)", 1).alias("code"), F.col("doc").alias("path"), F.col("error").alias("message"), F.lit("error").alias("severity"))
    tiles = all_.filter("loc IS NOT NULL")
    own = validate.tile_issues(tileset.with_parents(tiles), strict)
    root = f"^(?:file:)?/*{folder.strip('/')}/?"
    inside = lambda c: F.regexp_replace(c, root, "")
    uri = F.coalesce("uri", "legacy_url") if strict else F.col("uri")
    refs = tiles.withColumn("uri", uri).select("loc", inside(F.col("base")).alias("base"), "uri")
    listing = scan.files(spark, folder).select(inside(F.col("path")).alias("path"))
    out = broken.union(own).union(validate.content_issues(refs, listing))
    headers = binary.binary_files(spark, folder, "*.{b3dm,glb,i3dm,pnts,cmpt}").select(validate.header_issue(F.col("content")).alias("fault"), "path").filter("fault IS NOT NULL")
    out = out.union(headers.select(F.regexp_extract("fault", "^([A-Z_]+)", 1), "path", "fault", F.lit("error")))
    documents = tiles.filter(F.lower(T.clean_uri(F.col("uri"))).endswith(".json")).select(T.resolve_path(inside(F.col("base")), F.col("uri")).alias("resolved"))
    out = out.union(validate.repeated_documents(documents))
    if strict:
        # What the JSON chunk tells, from ranged reads; the headers above have told the rest.
        inner = payloads.headers(spark, folder).filter("fault RLIKE '^(GLB_JSON|GLB_BIN|GLB_CHUNK|GLB_MAGIC|BUFFER_VIEW)'")
        out = out.union(inner.select(F.regexp_extract("fault", "^([A-Z0-9_]+)", 1), "path", "fault", F.lit("error")))
        unknown = tiles.filter("parent_loc IS NULL").withColumn("names", features.unsupported_required(F.col("required"))).filter(F.size("names") > 0)
        out = out.union(unknown.select(F.lit("UNSUPPORTED_EXTENSION"), "doc", F.concat(F.lit("unsupported extensionsRequired: "), F.array_join("names", ", ")), F.lit("error")))
        many = tiles.filter("n_contents > 0").select(F.lit("UNSUPPORTED_CONTENTS"), "loc", F.lit("contents[] is unsupported"), F.lit("error"))
        deep = tiles.filter(F.col("depth") > validate.MAX_NESTING).select(F.lit("NESTING_TOO_DEEP"), "loc", F.lit("tiles are nested too deep"), F.lit("error"))
        out = out.union(many).union(deep).union(validate.too_many(tiles.select(F.col("doc").alias("path"))))
    return out


def check_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Children whose error is above their parent's."""
    tiles = tileset.tiles(tileset.documents(spark, folder)).filter("loc IS NOT NULL")
    return tree.error_violations(tiles.select(F.col("loc").alias("id"), F.col("parent_loc").alias("parent_id"), "ge"))


def check_frontier(spark: SparkSession, folder: str, root_doc: str) -> DataFrame:
    """Cells of the blocks' rectangle that no block fills."""
    return grid.missing_cells(tileset.blocks(tileset.tiles(tileset.documents(spark, folder)), root_doc).select("gx", "gy"))


def check_subtree(spark: SparkSession, before: str, after: str) -> DataFrame:
    """External documents that the first folder refers to and the second does not."""
    refs = lambda f: tileset.tiles(tileset.documents(spark, f)).filter(F.lower("uri").endswith(".json")).select(F.regexp_extract("uri", r"([^/]+)/[^/]*$", 1).alias("block_id"))
    return grid.lost(refs(before), refs(after), "block_id")


def rebuild_plan(spark: SparkSession, folder: str, root_doc: str, target: float | None = None) -> dict[str, DataFrame]:
    """What a rebuild would do: the selected representation of each block, the levels' nodes with bounds and errors, and the checks that must pass first."""
    tiles = tileset.tiles(tileset.documents(spark, folder)).filter("loc IS NOT NULL")
    blocks = tileset.blocks(tiles, root_doc)
    reps = tileset.representations(tiles, blocks)
    goal = target if target is not None else quadtree.default_target(reps).first()[0]
    chosen = quadtree.select_representations(reps, goal)
    mid = lambda a: (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2
    placed = blocks.withColumns({"cx": mid("x"), "cy": mid("y")})
    leaf = chosen.join(blocks.select("block_id", "box"), "block_id").select("block_id", E.leaf_error(F.col("ge"), M.box_diagonal(F.col("box"))).alias("ge"))
    nodes = quadtree.level_nodes(blocks, ids=True)
    box = M.aabb_box([F.col(f"min_{a}") for a in "xyz"], [F.col(f"max_{a}") for a in "xyz"])
    worst = leaf.agg(F.max("ge").alias("leaf_ge"))
    # A proxy's error is at least twice its children's, so level k is at least 2^k times the worst leaf.
    with_error = nodes.join(F.broadcast(worst)).withColumn("ge", F.when(F.col("level") == 0, F.col("leaf_ge")).otherwise(E.proxy_error(F.col("leaf_ge") * F.pow(F.lit(2.0), F.col("level") - 1), F.lit(0.0), M.box_diagonal(box)))).drop("leaf_ge")
    return {"selected": chosen, "nodes": with_error, "children": quadtree.child_lists(blocks), "grid": grid.completeness(blocks), "residuals": grid.residuals(placed)}


def merge_tilesets(spark: SparkSession, folders: list[str]) -> dict[str, DataFrame]:
    """The merged root document of several tilesets, and why any of them can't be merged."""
    if not merge.LEAST_SOURCES <= len(folders) <= merge.MOST_SOURCES:
        raise ValueError("merge needs 2 to 64 inputs")
    roots = None
    for i, folder in enumerate(folders, 1):
        top = tileset.tiles(tileset.documents(spark, folder, "tileset.json").filter(F.col("path").endswith(f"{folder.rstrip('/')}/tileset.json"))).filter("parent_loc IS NULL AND loc IS NOT NULL")
        row = top.select(F.lit(i).alias("source"), F.lit("tileset.json").alias("file"), "box", "region", "sphere", "transform", "ge", "doc_ge", "refine", "version")
        roots = row if roots is None else roots.union(row)
    checked = merge.root_bounds(roots)
    return {"document": merge.merged_root(checked), "issues": merge.root_issues(checked), "duplicates": merge.duplicates(spark.createDataFrame([(f.rstrip("/"),) for f in folders], "path string"))}


def clip_contents(spark: SparkSession, folder: str, where: dict | str, height: float | None = None) -> dict[str, DataFrame]:
    """Contents within a region, cut out or flattened to a height, and the counters. Tiles out of reach are not read."""
    area = region.parse(where)
    tiles = tileset.tiles(tileset.documents(spark, folder)).filter("loc IS NOT NULL")
    world = tree.with_world(tiles.select(F.col("loc").alias("id"), F.col("parent_loc").alias("parent_id"), "transform")).select(F.col("id").alias("loc"), F.col("world").alias("transform"))
    wanted = tiles.drop("transform").join(world, "loc").filter("uri IS NOT NULL AND box IS NOT NULL AND NOT lower(uri) LIKE '%.json'")
    near = contents.in_reach(wanted, area).select(F.regexp_replace(F.concat("base", F.lit("/"), T.normalise_uri(F.col("uri"))), "^file:/+", "/").alias("file"), "transform")
    files = binary.binary_files(spark, folder).withColumn("file", F.regexp_replace("path", "^file:/+", "/")).join(near, "file")
    done = contents.edited(files, area, height)
    return {"contents": done, "counters": contents.counters(done)}
