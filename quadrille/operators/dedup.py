"""Deduplication, grouping and budgets of meshes and textures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.functions.errors import budget_share

#: Shrink steps while textures are over budget, and the factor of a step.
SHRINK_STEPS, SHRINK = 8, 0.7


def content_hash(*parts: Column) -> Column:
    """SHA-256 over the parts' bytes, as hex."""
    return F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256)


def dedup_stats(rows: DataFrame, hash_: Column, size: Column) -> DataFrame:
    """One row: rows, distinct contents, removed rows, bytes before and after. Rows meet by hash, summed map-side first."""
    per = rows.groupBy(hash_.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.first(size).alias("size"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_input"), F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_removed"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_after"))


def groups(prims: DataFrame, keys: list[str]) -> DataFrame:
    """Primitives that merge into one: counts, triangles and vertices per key."""
    return prims.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_prims"), F.sum("triangles").alias("triangles"), F.sum("vertices").alias("vertices"))


def vertex_offsets(prims: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Where each primitive's vertices start in its merged group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return prims.withColumn("vertex_offset", F.sum("vertices").over(w) - F.col("vertices"))


def shares(grouped: DataFrame, budget: int, node: str | None = None) -> DataFrame:
    """Each group's part of the triangle budget (of its node, or of all groups)."""
    if node:
        total = grouped.groupBy(node).agg(F.sum("triangles").alias("total"))
        both = grouped.join(total, node)
    else:
        both = grouped.join(F.broadcast(grouped.agg(F.sum("triangles").alias("total"))))
    return both.withColumn("target", budget_share(F.col("triangles"), F.col("total"), budget)).drop("total")


def rollup_metrics(rows: DataFrame) -> DataFrame:
    """One row over proxies: sums, the greatest, any, the first warning by node, and the node of the widest gap."""
    return rows.agg(
        F.sum("triangles").alias("triangles"),
        F.sum("texture_bytes").alias("texture_bytes"),
        F.max("error").alias("max_error"),
        F.bool_or("over_budget").alias("any_over_budget"),
        F.min_by("warning", F.when(F.col("warning").isNotNull(), F.col("node"))).alias("first_warning"),
        F.max("gap").alias("max_gap"),
        F.max_by("node", F.struct("gap", F.hash("node"), "node")).alias("widest_node"),
    )


def shrink_plan(sizes: DataFrame, budget: int, most_side: int) -> DataFrame:
    """Texture sides after the least number of shrink steps that brings the estimated bytes (4 per pixel) into the budget, eight at most.

    All steps are evaluated at once: one row of sums per step, of which the first that fits is taken.
    """
    side = lambda c, step: F.greatest(F.round(F.col(c) * F.least(F.lit(1.0), F.lit(float(most_side)) / F.greatest("width", "height")) * F.pow(F.lit(SHRINK), step)).cast("long"), F.lit(1).cast("long"))
    steps = sizes.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(SHRINK_STEPS)))).select("hash", "step", side("width", F.col("step")).alias("w"), side("height", F.col("step")).alias("h"))
    sums = steps.groupBy("step").agg(F.sum(F.col("w") * F.col("h") * 4).alias("bytes"))
    chosen = sums.agg(F.coalesce(F.min(F.when(F.col("bytes") <= budget, F.col("step"))), F.lit(SHRINK_STEPS)).alias("step"))
    return steps.join(F.broadcast(chosen), "step").select("hash", "step", "w", "h")


def encode_stats(rows: DataFrame) -> DataFrame:
    """One row over encoded files: seen, converted, textures, and the sorted error messages (bounded by the caller's filter)."""
    return rows.agg(F.count(F.lit(1)).alias("n_seen"), F.count_if("converted").alias("n_converted"), F.sum("textures").alias("n_textures"), F.array_sort(F.collect_set("error")).alias("errors"))


def evidence(files: DataFrame, needle: str = "KTX2", most_bytes: int = 2_000_000, samples: int = 5) -> DataFrame:
    """One row: files, files that mention the needle in their first bytes, whether any does, and the first few paths."""
    hit = F.contains(F.upper(F.substring(F.col("content"), 1, most_bytes).cast("string")), F.lit(needle))
    seen = files.select("path", hit.alias("hit"))
    few = seen.filter("hit").orderBy("path").limit(samples).agg(F.array_sort(F.collect_list("path")).alias("samples"))
    return seen.agg(F.count(F.lit(1)).alias("n_files"), F.count_if("hit").alias("n_mentions"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found")).join(F.broadcast(few))


def replaced(rows: DataFrame, mapping: DataFrame, old: str, new: str, column: str) -> DataFrame:
    """Put the new hash in place of the old one where the mapping has it."""
    m = mapping.select(F.col(old).alias(column), F.col(new).alias("__new"))
    return rows.join(m, column, "left").withColumn(column, F.coalesce("__new", F.col(column))).drop("__new")


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that were added, removed or changed between two listings (path, fingerprint)."""
    b, a = before.select("path", F.col("fingerprint").alias("b")), after.select("path", F.col("fingerprint").alias("a"))
    return b.join(a, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select("path", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed").alias("change"))
