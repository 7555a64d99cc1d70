"""Tile trees as rows: flattening, errors by level, probes and digests.

Trees come as (key, parent, ...) rows. Depths, paths and products along paths are found by pointers that double their reach from
round to round, each of which is checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import matrix as M
from quadrille.operators.lineage import cut


def jumped(nodes: DataFrame, key: str, up: str, combine: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """What lies on each node's way up, put together: ``combine`` says how a column of what is above joins the node's own.

    nodes: unique keys, ``up`` the parent (null at roots), and the columns. Pointers double: a node takes over all that its
    pointer has gathered, so rounds grow with the logarithm of the depth. Nodes that no root reaches are left out.
    """
    names = list(combine)
    state, before = cut(nodes.select(key, up, *names)), -1
    while True:
        todo, done = state.filter(F.col(up).isNotNull()), state.filter(F.col(up).isNull())
        n_todo, n_done = state.agg(F.count_if(F.col(up).isNotNull()), F.count_if(F.col(up).isNull())).first()
        # As long as a root is farther than the pointers reach, each round brings some nodes there; what is left then are cycles.
        if not n_todo or n_done == before:
            return done
        before = n_done
        above = state.select(F.col(key).alias("__key"), F.col(up).alias("__up"), *(F.col(n).alias(f"__{n}") for n in names))
        joined = todo.join(above, F.col(up) == F.col("__key")).select(key, F.col("__up").alias(up), *(f(F.col(f"__{n}"), F.col(n)).alias(n) for n, f in combine.items()))
        state = cut(done.union(joined))


def flatten(nodes: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Every node that a root reaches, however deep: key, parent, depth, path (sort order of a depth-first walk) and ``cycle``.

    A root has a null parent. Where a key is met again on its own path the row is marked and not followed, so the walk ends.
    Unique keys are a tree, whose paths double from round to round; keys with several parents are walked level by level.
    """
    edges = cut(nodes.select(key, parent))
    name = F.col(key).cast("string")
    if edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        rows = jumped(edges.select(key, F.col(parent).alias("__above"), F.array(name).alias("path"), parent), key, "__above", {"path": lambda a, b: F.concat(a, b), parent: lambda a, b: b})
        return rows.select(key, parent, (F.size("path") - 1).alias("depth"), "path", F.lit(False).alias("cycle"))
    level = cut(edges.filter(F.col(parent).isNull()).select(key, parent, F.lit(0).alias("depth"), F.array(name).alias("path"), F.lit(False).alias("cycle")))
    out, depth = level, 0
    while True:
        depth += 1
        up = level.filter(~F.col("cycle")).select(F.col(key).alias(parent), F.col("path").alias("above"))
        level = cut(edges.join(up, parent).select(key, parent, F.lit(depth).alias("depth"), F.concat("above", F.array(name)).alias("path"), F.array_contains("above", name).alias("cycle")))
        if level.isEmpty():
            return out
        out = out.union(level)


def with_world(nodes: DataFrame) -> DataFrame:
    """id, depth and world transform of each node that a root reaches: parent * local down from the root. Products double with the pointers; ids must be unique."""
    rows = cut(nodes.select("id", "parent_id", F.when(F.col("parent_id").isNull(), 0).otherwise(1).alias("depth"), F.coalesce("transform", M.identity()).alias("world")))
    if not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError("an id stands twice in the tree")
    return jumped(rows, "id", "parent_id", {"depth": lambda a, b: a + b, "world": M.multiply}).select("id", "depth", "world")


def error_violations(nodes: DataFrame, slack: float = 0.0) -> DataFrame:
    """Children whose error is above their parent's by more than ``slack``: child, parent and both errors."""
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("ge").alias("parent_ge"))
    return nodes.join(parents, "parent_id").filter(F.col("parent_ge") + slack < F.col("ge")).select("parent_id", "parent_ge", "id", "ge")


def probe(nodes: DataFrame) -> DataFrame:
    """One row on a tree with depth, kind and refine: proxies, external leaves, replacing nodes, deepest level, nodes without content."""
    return nodes.agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.count_if(F.col("kind") == "proxy").alias("n_proxies"),
        F.count_if(F.col("kind") == "external").alias("n_external"),
        F.count_if(F.upper("refine") == "REPLACE").alias("n_replace"),
        F.max("depth").alias("max_depth"),
        F.count_if(F.col("uri").isNull()).alias("n_without_content"),
    )


def digest(nodes: DataFrame) -> DataFrame:
    """One row: nodes, nodes with content, and a sum over the hashes of their references' stems (order free, so partial sums do)."""
    stem = F.regexp_extract("uri", r"([^/.]*)[^/]*$", 1)
    number = F.conv(F.substring(F.md5(stem.cast("binary")), 1, 8), 16, 10).cast("long")
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count("uri").alias("n_contents"), F.sum(number).alias("stem_sum"))


def emit(nodes: DataFrame, order: str = "id") -> DataFrame:
    """Nested JSON of a tree, bottom up: each level's children are put together per parent (a parent holds few) and join the level above, which is checkpointed.

    nodes: id, parent_id, depth, body (a JSON object as text); children come in the order of a column. Gives id and json of the roots.
    """
    nodes = cut(nodes.withColumn("__order", F.col(order)))
    deepest = nodes.agg(F.max("depth")).first()[0]
    if deepest is None:
        return nodes.select("id", F.lit(None).cast("string").alias("json"))
    below = None
    for depth in range(deepest, -1, -1):
        level = nodes.filter(F.col("depth") == depth)
        if below is None:
            done = level.select("id", "parent_id", "__order", F.col("body").alias("json"))
        else:
            kids = below.groupBy("parent_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__order", "id", "json"))), lambda c: c["json"]).alias("kids")).withColumnRenamed("parent_id", "id")
            joined = level.join(kids, "id", "left")
            inner = F.regexp_replace("body", r"\}\s*$", "")
            comma = F.when(F.trim(inner) == "{", "").otherwise(",")
            done = joined.select("id", "parent_id", "__order", F.when(F.col("kids").isNull(), F.col("body")).otherwise(F.concat(inner, comma, F.lit('"children":['), F.array_join("kids", ","), F.lit("]}"))).alias("json"))
        below = cut(done)
    return below.select("id", "json")


def dump(nodes: DataFrame) -> DataFrame:
    """Text lines of a tree, one per node, indented by depth, in order of the path."""
    return nodes.select("path", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.element_at("path", -1)).alias("line")).orderBy("path")
