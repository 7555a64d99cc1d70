"""The rebuild: levels of simplified proxies over a tileset's blocks, written out with a new tileset document.

Level by level: the children's payloads, of which the files just written are read, are brought into their parent's frame,
simplified within the level's budget, and written; a level is a few Spark jobs, and levels grow with the logarithm of the grid.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import errors as E
from quadrille.functions import matrix as M
from quadrille.functions import text as T
from quadrille.operators import quadtree, simplify, textures, tree
from quadrille.operators.lineage import cut
from quadrille.sources import copies, sinks, tileset


@dataclass(frozen=True)
class Options:
    """Budgets of a rebuild. Zero bytes are no bound; ``limit`` is how many triangles of a node meet in one task."""

    pack_as_b3dm: bool = True
    l1_max_triangles: int = 4_000
    l2_max_triangles: int = 2_000
    target_error_meters: float = 2.0
    source_error_ratio: float = quadtree.DEFAULT_RATIO
    target_proxy_error: float | None = None
    max_levels: int | None = None
    max_texture_size: int = 1024
    max_texture_bytes: int = 8 << 20
    max_glb_bytes: int = 16 << 20
    strict_budget: bool = False
    limit: int = simplify.LIMIT


class RebuildError(ValueError):
    """Why a tileset can't be rebuilt: the first fault, and how many there are."""


def refuse(faults: DataFrame, code: str) -> None:
    """Raise with the first of some faults (a column ``fault``)."""
    row = faults.agg(F.min("fault").alias("first"), F.count(F.lit(1)).alias("n")).first()
    if row.n:
        raise RebuildError(f"{code}: {row.first}" + (f" (and {row.n - 1} more)" if row.n > 1 else ""))


def moved(matrix: Column, back: list[Column]) -> Column:
    """A column-major matrix followed by a shift by -back."""
    return F.array(*(F.get(matrix, i) - (back[i - 12] if 12 <= i < 15 else F.lit(0.0)) for i in range(16)))


def shift(by: list[Column]) -> Column:
    return F.array(*(by[i - 12] if 12 <= i < 15 else F.lit(1.0 if i % 5 == 0 else 0.0) for i in range(16)))


def tree_nodes(blocks: DataFrame, max_levels: int | None = None) -> DataFrame:
    """id, parent_id, level, gx, gy, block_id (of leaves), bounds, centre and diagonal of every node; blocks in one cell are refused."""
    double = blocks.groupBy("gx", "gy").agg(F.count(F.lit(1)).alias("n"), F.min("block_id").alias("fault")).filter("n > 1 OR gx IS NULL OR gy IS NULL").select("fault")
    refuse(double, "GRID_PLACE_UNCLEAR")
    nodes = quadtree.level_nodes(blocks, max_levels, ids=True)
    top = nodes.agg(F.max("level").alias("top"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int")
    parent = F.when(F.col("level") < F.col("top"), quadtree.node_id(F.col("level") + 1, half("gx"), half("gy")))
    box = M.aabb_box([F.col(f"min_{a}") for a in "xyz"], [F.col(f"max_{a}") for a in "xyz"])
    centre = [((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2).alias(f"c{a}") for a in "xyz"]
    name = quadtree.node_id(F.col("level"), F.col("gx"), F.col("gy"), F.col("block_id"))
    return nodes.join(F.broadcast(top)).select(name.alias("id"), parent.alias("parent_id"), "level", "gx", "gy", F.when(F.col("level") == 0, F.col("block_id")).alias("block_id"), *quadtree.BOUNDS, *centre, M.box_diagonal(box).alias("diagonal"), "n_blocks")


def level_errors(nodes: DataFrame, leaf_errors: DataFrame, simplification: DataFrame | None = None) -> DataFrame:
    """(id, level, ge) of all nodes (tree_nodes): leaves have theirs (id, ge), a proxy's is above its children's by the rule of proxies.

    simplification: id and error of proxies, 0 where it is missing. One aggregate a level, on the level below alone.
    """
    own = nodes.select("id", "parent_id", "level", "diagonal")
    own = own.withColumn("error", F.lit(0.0)) if simplification is None else own.join(simplification, "id", "left").withColumn("error", F.coalesce("error", F.lit(0.0)))
    own = cut(own)
    level = cut(own.filter("level = 0").join(leaf_errors, "id").select("id", "parent_id", "level", "ge"))
    out, top = level, own.agg(F.max("level")).first()[0] or 0
    for k in range(1, top + 1):
        below = level.groupBy(F.col("parent_id").alias("id")).agg(F.max("ge").alias("below"))
        level = cut(own.filter(F.col("level") == k).join(below, "id").select("id", "parent_id", "level", E.proxy_error(F.col("below"), F.col("error"), F.col("diagonal")).alias("ge")))
        out = out.union(level)
    return out.select("id", "level", "ge")


def leaves(spark: SparkSession, folder: str, root_doc: str, options: Options) -> tuple[DataFrame, DataFrame]:
    """(blocks, chosen): the blocks with their folder, and for each the representation that its first proxy is made of: block_id, ge, path, transform, y_up, reached."""
    documents = cut(tileset.documents(spark, folder))
    tiles = tileset.tiles(documents).filter("loc IS NOT NULL")
    blocks = cut(tileset.blocks(tiles, root_doc))
    if blocks.isEmpty():
        raise RebuildError("NO_SOURCE_BLOCKS: the root document refers to no block")
    refuse(blocks.filter("box IS NULL OR min_x IS NULL").select(F.col("block_id").alias("fault")), "BLOCK_WITHOUT_BOX")
    reps = cut(tileset.representations(tiles, blocks))
    refuse(blocks.join(reps, "block_id", "left_anti").select(F.col("block_id").alias("fault")), "BLOCK_WITHOUT_CONTENT")
    goal = options.target_proxy_error if options.target_proxy_error is not None else quadtree.default_target(reps).first()[0]
    chosen = quadtree.select_representations(reps, goal, options.source_error_ratio)
    axis = documents.select(F.col("path").alias("doc"), (F.coalesce(F.get_json_object("text", "$.asset.gltfUpAxis"), F.lit("Y")) == "Y").alias("y_up"))
    base = F.regexp_extract("doc", "^(.*)/[^/]*$", 1)
    # A document's path in a tile may be written otherwise than Spark lists it.
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    placed = chosen.join(blocks.select("block_id", plain("doc").alias("doc")), "block_id").join(axis.withColumn("doc", plain("doc")), "doc", "left")
    threshold = F.lit(float(goal)) * options.source_error_ratio
    warning = F.when(~F.col("reached"), quadtree.selection_warning(F.col("block_id"), F.col("rep_index").cast("string"), threshold, F.col("ge")))
    return blocks, cut(placed.select("block_id", "ge", F.concat(base, F.lit("/"), T.clean_uri(F.col("uri"))).alias("path"), "transform", F.coalesce("y_up", F.lit(True)).alias("y_up"), "reached", warning.alias("warning")))


def proxy_uri(name: Column, options: Options) -> Column:
    return F.concat(F.lit("Data/"), name, F.lit("/"), name, F.lit(".b3dm" if options.pack_as_b3dm else ".glb"))


def proxies(children: DataFrame, out: str, budget: int, options: Options) -> DataFrame:
    """Build and write one level's proxies of children (node, child, path, y_up, matrix): id, triangles before, after and target, error, bytes, textures, warnings."""
    sizes = cut(simplify.group_sizes(children))
    refuse(sizes.filter("error IS NOT NULL").select(F.col("error").alias("fault")), "CONTENT_UNREADABLE")
    plans = cut(simplify.cell_sizes(sizes, options.limit))
    parts = simplify.few_enough(children, plans, options.limit)
    images, spent = textures.processed(parts.filter(F.col("kind") == simplify.IMAGES).select("node", "hash", "mime", "data"), options.max_texture_size, options.max_texture_bytes)
    done = cut(simplify.built(parts, images, plans, budget, options.target_error_meters, options.max_glb_bytes, options.pack_as_b3dm))
    sinks.payload_files(done.select(proxy_uri(F.col("node"), options).alias("path"), "content"), out)
    before = sizes.groupBy("node").agg(F.sum("triangles").alias("triangles_before"))
    over = F.when(F.col("over_budget"), F.array(F.concat(F.lit("TEXTURE_BYTES_OVER_BUDGET: after="), F.col("bytes_after").cast("string"), F.lit(f" max={options.max_texture_bytes}")))).otherwise(F.array().cast("array<string>"))
    joined = done.join(before, "node").join(spent.select("node", "input_count", "unique_count", "dedup_removed", "bytes_before", "bytes_after", "max_dimension_after", over.alias("more")), "node", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("input_count", "unique_count", "dedup_removed", "bytes_before", "bytes_after", "max_dimension_after")]
    result = cut(joined.select(F.col("node").alias("id"), "triangles_before", "triangles_after", "triangles_target", "error", "texture_bytes", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("glb_bytes"), F.col("content").isNotNull().alias("has_content"), *counts, F.concat("warnings", F.coalesce("more", F.array().cast("array<string>"))).alias("warnings")))
    if options.strict_budget:
        refuse(result.select(F.explode("warnings").alias("fault")).filter("fault LIKE '%BYTES_OVER_BUDGET%'"), "BUDGET_EXCEEDED")
    return result


def body(nodes: DataFrame, blocks: DataFrame, options: Options) -> DataFrame:
    """id, parent_id, depth, order and the tile's JSON without children. Leaves keep their block's box and lead to its own document; boxes of proxies are in their frame."""
    parent = nodes.select(F.col("id").alias("parent_id"), *(F.col(f"c{a}").alias(f"p{a}") for a in "xyz"))
    source = blocks.select("block_id", "box", F.col("transform").alias("placed"))
    joined = nodes.join(source, "block_id", "left").join(parent, "parent_id", "left")
    leaf = F.col("level") == 0
    up = [F.coalesce(f"p{a}", F.lit(0.0)) for a in "xyz"]
    own = M.aabb_box([F.col(f"min_{a}") - F.col(f"c{a}") for a in "xyz"], [F.col(f"max_{a}") - F.col(f"c{a}") for a in "xyz"])
    transform = F.when(leaf, moved(F.col("placed"), up)).otherwise(shift([F.col(f"c{a}") - u for a, u in zip("xyz", up, strict=True)]))
    uri = F.when(leaf, F.concat(F.lit("./Data/"), F.col("block_id"), F.lit("/tileset.json"))).when(F.col("has_content"), F.concat(F.lit("./"), proxy_uri(F.col("id"), options)))
    tile = F.struct(F.struct(F.when(leaf, F.col("box")).otherwise(own).alias("box")).alias("boundingVolume"), F.col("ge").alias("geometricError"), F.lit("REPLACE").alias("refine"), transform.alias("transform"), F.when(uri.isNotNull(), F.struct(uri.alias("uri"))).alias("content"))
    top = nodes.agg(F.max("level").alias("top"))
    return joined.join(F.broadcast(top)).select("id", "parent_id", (F.col("top") - F.col("level")).alias("depth"), F.struct("gy", "gx").alias("order"), F.to_json(tile).alias("body"))


def document(nodes: DataFrame, blocks: DataFrame, options: Options) -> DataFrame:
    """One row: path and content of the tileset document. Several top nodes stand under one root without content."""
    roots = tree.emit(body(nodes, blocks, options), order="order")
    tops = nodes.filter("parent_id IS NULL")
    hull = tops.agg(F.count(F.lit(1)).alias("n"), F.max("ge").alias("ge"), *(F.min(f"min_{a}").alias(f"min_{a}") for a in "xyz"), *(F.max(f"max_{a}").alias(f"max_{a}") for a in "xyz"))
    box = M.aabb_box([F.col(f"min_{a}") for a in "xyz"], [F.col(f"max_{a}") for a in "xyz"])
    all_ = roots.join(tops.select("id", F.struct("gy", "gx").alias("order")), "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "json"))), lambda r: r["json"]).alias("roots"))
    row = all_.join(F.broadcast(hull))
    ge = F.to_json(F.struct(F.col("ge").alias("geometricError")))
    number = F.expr("substring(ge_json, 2, length(ge_json) - 2)")
    group = F.concat(F.lit('{"boundingVolume":'), F.to_json(F.struct(box.alias("box"))), F.lit(","), number, F.lit(',"refine":"REPLACE","children":['), F.array_join("roots", ","), F.lit("]}"))
    root = F.when(F.col("n") == 1, F.get("roots", 0)).otherwise(group)
    text = F.concat(F.lit('{"asset":{"version":"1.0","gltfUpAxis":"Z"},'), number, F.lit(',"root":'), root, F.lit("}"))
    return row.withColumn("ge_json", ge).select(F.lit("tileset.json").alias("path"), F.encode(text, "UTF-8").alias("content"))


def metrics(nodes: DataFrame, made: DataFrame | None, options: Options) -> DataFrame:
    """One row: path and content of the report: nodes of each level, budgets, and totals over all proxies, whose rows stand in a table of their own."""
    levels = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("count")).agg(F.array_sort(F.collect_list(F.struct("level", "count"))).alias("level_counts"))
    budgets = F.struct(*(F.lit(v).alias(k) for k, v in asdict(options).items() if v is not None))
    if made is None:
        totals = levels.select(F.lit(0).alias("proxies"))
    else:
        named = {"triangles_before": "triangles_before", "triangles_after": "triangles_after", "texture_bytes": "texture_bytes", "glb_bytes": "glb_bytes", "input_count": "textures_in", "unique_count": "textures_unique", "dedup_removed": "textures_removed"}
        totals = made.agg(F.count(F.lit(1)).alias("proxies"), *(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in named.items()), F.max("error").alias("max_error"), F.max("max_dimension_after").alias("max_dimension_after"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"))
    report = levels.join(F.broadcast(totals.select(F.struct("*").alias("totals")))).select("level_counts", budgets.alias("budgets"), "totals")
    return report.select(F.lit("rebuild_metrics.json").alias("path"), F.encode(F.to_json(F.struct("level_counts", "budgets", "totals")), "UTF-8").alias("content"))


def rebuild_tileset(spark: SparkSession, folder: str, root_doc: str, out: str, options: Options | None = None) -> dict[str, DataFrame]:
    """Rebuild the top of a tileset into ``out``, a folder that all executors mount and that is empty or holds an earlier run.

    Blocks are copied with all they hold and verified. Writes Data/<block>, Data/<proxy>, tileset.json and rebuild_metrics.json;
    gives nodes (id, parent_id, level, ge, bounds ...), proxies, warnings and the copies' manifest. Unreadable contents, contents
    that editing would lose a part of, blocks without box, content or grid place are errors before anything of their level is written.
    """
    options = options or Options()
    blocks, chosen = leaves(spark, folder, root_doc, options)
    nodes = cut(tree_nodes(blocks, options.max_levels))
    folders = blocks.select(F.regexp_extract("doc", "^(.*)/[^/]*$", 1).alias("folder"), F.concat(F.lit("Data/"), "block_id").alias("prefix"))
    manifest = copies.copied(copies.below(folders), out, tag="quadrille-copy")
    refuse(copies.faults(manifest).select(F.concat("target", F.lit(": "), "status").alias("fault")), "COPY_FAILED")
    box = blocks.select("block_id", M.box_diagonal(F.col("box")).alias("own"))
    leaf_errors = chosen.join(box, "block_id").select(F.concat(F.lit("L0_"), "block_id").alias("id"), E.leaf_error(F.col("ge"), F.col("own")).alias("ge"))
    centre = nodes.select(F.col("id").alias("parent_id"), *(F.col(f"c{a}").alias(f"p{a}") for a in "xyz"))
    up = [F.col(f"p{a}") for a in "xyz"]
    first = nodes.filter("level = 0 AND parent_id IS NOT NULL").join(chosen, "block_id").join(centre, "parent_id")
    children = first.select(F.col("parent_id").alias("node"), F.col("id").alias("child"), "path", "y_up", moved(F.col("transform"), up).alias("matrix"))
    top = nodes.agg(F.max("level")).first()[0]
    made = None
    for level in range(1, top + 1):
        now = proxies(children, out, options.l1_max_triangles if level == 1 else options.l2_max_triangles, options)
        now = now.withColumn("level", F.lit(level))
        made = now if made is None else made.union(now)
        mine = nodes.filter((F.col("level") == level) & F.col("parent_id").isNotNull()).join(now.filter("has_content").select("id"), "id").join(centre, "parent_id")
        path = F.concat(F.lit(out.rstrip("/") + "/"), proxy_uri(F.col("id"), options))
        children = cut(mine.select(F.col("parent_id").alias("node"), F.col("id").alias("child"), path.alias("path"), F.lit(False).alias("y_up"), shift([F.col(f"c{a}") - F.col(f"p{a}") for a in "xyz"]).alias("matrix")))
    errors = level_errors(nodes, leaf_errors, None if made is None else made.select("id", "error")).select("id", "ge")
    whole = nodes.join(errors, "id")
    whole = whole.withColumn("has_content", F.col("level") == 0) if made is None else whole.join(made.select("id", "has_content"), "id", "left").withColumn("has_content", F.coalesce("has_content", F.col("level") == 0))
    whole = cut(whole)
    sinks.payload_files(document(whole, blocks, options).union(metrics(whole, made, options)), out)
    warnings = chosen.filter("warning IS NOT NULL").select(F.col("block_id").alias("id"), "warning")
    if made is not None:
        warnings = warnings.union(made.select("id", F.explode("warnings").alias("warning")))
    found = {"nodes": whole, "warnings": warnings, "copies": manifest}
    return found | ({} if made is None else {"proxies": made.join(errors, "id")})
