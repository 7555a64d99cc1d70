"""Blocks, their levels of detail, and the quadtree over them.

Blocks: block_id, gx, gy, min_x .. max_z. Representations: block_id, rep_index, ge and more.
All levels come from one pass: floor division composes, so level k groups by floor(x / 2^k). The levels are an explode of one
row per block and level (their number grows with the logarithm of the grid), followed by one partial and final aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_RATIO = 0.5


def select_representations(reps: DataFrame, target: Column | float, ratio: float = DEFAULT_RATIO, key: str = "block_id") -> DataFrame:
    """Per block the coarsest representation with ge <= target * ratio, else the finest, with ``reached`` false. The first of equals wins.

    One aggregate by struct order, so no window has to sort a block's rows.
    """
    threshold = (target if isinstance(target, Column) else F.lit(float(target))) * ratio
    ok = F.col("ge") <= threshold
    others = [c for c in reps.columns if c not in (key, "ge", "rep_index")]
    row = F.struct("ge", (-F.col("rep_index")).alias("neg"), *others)
    fine = F.struct("ge", "rep_index", *others)
    best = reps.groupBy(key).agg(F.max(F.when(ok, row)).alias("coarse"), F.min(fine).alias("fine"))
    pick = lambda c: F.when(F.col("coarse").isNotNull(), F.col(f"coarse.{c}")).otherwise(F.col(f"fine.{c}"))
    return best.select(
        key,
        F.when(F.col("coarse").isNotNull(), -F.col("coarse.neg")).otherwise(F.col("fine.rep_index")).alias("rep_index"),
        pick("ge").alias("ge"),
        *(pick(c).alias(c) for c in others),
        F.col("coarse").isNotNull().alias("reached"),
    )


def selection_warning(block: Column, rep: Column, threshold: Column, error: Column) -> Column:
    return F.concat(F.lit("SOURCE_ERROR_TARGET_NOT_REACHED: block="), block, F.lit(" representation="), rep, F.lit(" threshold="), threshold.cast("string"), F.lit(" selected_error="), error.cast("string"))


def default_target(reps: DataFrame) -> DataFrame:
    """One row: twice the greatest error."""
    return reps.agg((F.greatest(F.coalesce(F.max("ge"), F.lit(0.0)), F.lit(0.0)) * 2).alias("target"))


def shifted(blocks: DataFrame) -> DataFrame:
    """Grid numbers from 0: the least are taken off. The two numbers come from an aggregate that is broadcast (one row)."""
    origin = blocks.agg(F.min("gx").alias("ox"), F.min("gy").alias("oy"))
    return blocks.join(F.broadcast(origin)).withColumns({"gx": F.col("gx") - F.col("ox"), "gy": F.col("gy") - F.col("oy")}).drop("ox", "oy")


BOUNDS = ("min_x", "min_y", "min_z", "max_x", "max_y", "max_z")


def level_nodes(blocks: DataFrame, max_level: int | None = None, ids: bool = False) -> DataFrame:
    """Every node of every level, bottom up, until one node is left or ``max_level``: level, gx, gy, n_blocks, bounds, and the node's child ids if asked for.

    An id list holds at most four names. Levels past the first with one node are cut off by a per-level count.
    """
    base = shifted(blocks)
    extent = base.agg(F.greatest(F.max("gx"), F.max("gy"), F.lit(0)).alias("extent"))
    top = F.ceil(F.log2(F.col("extent") + 1)).cast("int")
    top = top if max_level is None else F.least(top, F.lit(max_level))
    each = base.join(F.broadcast(extent)).withColumn("level", F.explode(F.sequence(F.lit(0), top)))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("int")
    bounds = [F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in BOUNDS if c in blocks.columns]
    nodes = each.withColumns({"gx": cell("gx"), "gy": cell("gy")}).groupBy("level", "gx", "gy").agg(F.count(F.lit(1)).alias("n_blocks"), *bounds, *([F.min("block_id").alias("block_id")] if ids else []))
    sizes = nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))
    root = sizes.filter("n_nodes = 1").agg(F.min("level").alias("root"))  # one row
    kept = sizes.join(F.broadcast(root)).filter(F.col("root").isNull() | (F.col("level") <= F.col("root"))).select("level")
    return nodes.join(F.broadcast(kept), "level")


def level_counts(blocks: DataFrame, max_level: int | None = None) -> DataFrame:
    """Nodes per level, whether the level has fewer nodes than the one below, and the first level where that fails makes the tree invalid."""
    counts = level_nodes(blocks, max_level).groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"))
    before = counts.select((F.col("level") + 1).alias("level"), F.col("n_nodes").alias("below"))
    return counts.join(before, "level", "left").select("level", "n_nodes", (F.col("below").isNull() | (F.col("n_nodes") < F.col("below"))).alias("shrinks"))


def node_id(level: Column, gx: Column, gy: Column, block: Column | None = None) -> Column:
    proxy = F.concat(F.lit("Proxy_L"), level.cast("string"), F.lit("_"), gx.cast("string"), F.lit("_"), gy.cast("string"))
    return proxy if block is None else F.when(level == 0, F.concat(F.lit("L0_"), block.cast("string"))).otherwise(proxy)


def child_lists(blocks: DataFrame) -> DataFrame:
    """Each proxy with its children's ids in order of (gy, gx): level, gx, gy, child_ids. A node has at most four."""
    nodes = level_nodes(blocks, ids=True)
    up = lambda c: F.floor(F.col(c) / 2).cast("int")
    named = nodes.select((F.col("level") + 1).alias("level"), up("gx").alias("px"), up("gy").alias("py"), F.struct(F.col("gy").alias("gy"), F.col("gx").alias("gx"), node_id(F.col("level"), F.col("gx"), F.col("gy"), F.col("block_id")).alias("id")).alias("child"))
    kept = nodes.select("level").distinct()
    lists = named.join(F.broadcast(kept), "level").groupBy("level", "px", "py").agg(F.transform(F.array_sort(F.collect_list("child")), lambda c: c["id"]).alias("child_ids"))
    return lists.select("level", F.col("px").alias("gx"), F.col("py").alias("gy"), "child_ids")


def first_seen_distinct(lists: Column) -> Column:
    """The distinct ids of several lists, in the order they first occur."""
    return F.array_distinct(F.flatten(lists))


def rollup(blocks: DataFrame, reps: DataFrame, target: float, ratio: float = DEFAULT_RATIO) -> DataFrame:
    """The flagship: levels with their nodes, bounds and the triangles of what was selected."""
    chosen = select_representations(reps, target, ratio).select("block_id", "triangles")
    base = shifted(blocks.join(chosen, "block_id"))
    nodes = level_nodes(base)
    total = chosen.agg(F.sum("triangles").alias("triangles"))
    bounds = [F.min(c).alias(c) if c.startswith("min") else F.max(c).alias(c) for c in BOUNDS]
    return nodes.groupBy("level").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum("n_blocks").alias("n_blocks"), *bounds).join(F.broadcast(total))
