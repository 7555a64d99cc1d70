"""Regular block grids: completeness, spacing, residuals, missing and lost blocks.

Adjacency is a window per row or column of the grid, never all pairs. Medians over spacings are taken by rank over grouped
counts, so equal spacings are summed up first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.lineage import cut
from quadrille.operators.running import element

#: Spacings below this mean that two cells have one centre; cells below CELL are none.
COLLAPSED, CELL = 1e-3, 1e-6
#: A centre may be off by this share of a cell, and by one metre anyway.
TOLERANCE = 0.35
#: The largest grid side that was verified.
VERIFIED_SIDE = 16


def completeness(blocks: DataFrame) -> DataFrame:
    """One row: extent, distinct cells, expected cells, whether the grid is complete and within the verified size."""
    cells = blocks.select("gx", "gy").distinct()
    found = cells.agg(F.min("gx").alias("min_x"), F.max("gx").alias("max_x"), F.min("gy").alias("min_y"), F.max("gy").alias("max_y"), F.count(F.lit(1)).alias("n_cells"))
    width, height = (F.col(f"max_{a}").cast("long") - F.col(f"min_{a}") + 1 for a in "xy")
    return found.select("*", width.alias("width"), height.alias("height"), (width * height).alias("expected")).select("*", (F.col("n_cells") == F.col("expected")).alias("complete"), ((F.col("width") <= VERIFIED_SIDE) & (F.col("height") <= VERIFIED_SIDE)).alias("verified"))


def spacings(blocks: DataFrame) -> DataFrame:
    """(axis, spacing) of each pair of neighbours in a row (axis x) or column (axis y); blocks need gx, gy, cx, cy."""
    def along(axis: str, other: str) -> DataFrame:
        w = Window.partitionBy(f"g{other}").orderBy(f"g{axis}", f"c{axis}")
        pairs = blocks.select(f"g{axis}", f"c{axis}", F.lag(f"g{axis}").over(w).alias("g"), F.lag(f"c{axis}").over(w).alias("c"))
        return pairs.filter(F.col(f"g{axis}") - F.col("g") == 1).select(F.lit(axis).alias("axis"), F.abs(F.col(f"c{axis}") - F.col("c")).alias("spacing"))

    return along("x", "y").union(along("y", "x"))


def upper_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) with the element at index n / 2 of the sorted values, from counts per value."""
    return element(df, [key], value, lambda n: F.floor(n / 2)).withColumnRenamed(value, "median")


def cell_sizes(blocks: DataFrame) -> DataFrame:
    """One row: cell_x, cell_y (one stands in for the other where missing), and whether distinct cells have one centre."""
    all_ = spacings(blocks)
    medians = upper_median(all_.filter(F.col("spacing") >= COLLAPSED), "axis", "spacing")
    of = lambda a: F.coalesce(F.max(F.when(F.col("axis") == a, F.col("median"))), F.lit(0.0))
    cells = medians.agg(of("x").alias("x"), of("y").alias("y"))
    flat = F.col("spacing") < COLLAPSED
    seen = all_.agg(*(F.coalesce(F.bool_or(flat & (F.col("axis") == a)), F.lit(False)).alias(f"flat_{a}") for a in "xy"), F.coalesce(F.bool_or(~flat), F.lit(False)).alias("apart"))
    both = cells.join(F.broadcast(seen))
    own = lambda a, b: F.when(F.col(a) > CELL, F.col(a)).otherwise(F.col(b))
    clash = ((F.col("flat_x") | F.col("flat_y")) & F.col("apart")) | (F.col("flat_x") & F.col("flat_y"))
    return both.select(own("x", "y").alias("cell_x"), own("y", "x").alias("cell_y"), clash.alias("collapsed"))


def residuals(blocks: DataFrame) -> DataFrame:
    """Each block's distance from where the grid puts it, the tolerance, and whether it is within. The origin is the block of least (gx, gy)."""
    origin = blocks.agg(F.min(F.struct("gx", "gy", "cx", "cy")).alias("o")).select("o.*").toDF("ogx", "ogy", "ocx", "ocy")
    at = blocks.join(F.broadcast(origin)).join(F.broadcast(cell_sizes(blocks)))
    expect = lambda a: F.col(f"oc{a}") + (F.col(f"g{a}") - F.col(f"og{a}")) * F.col(f"cell_{a}")
    distance = F.hypot(F.col("cx") - expect("x"), F.col("cy") - expect("y"))
    tolerance = F.greatest(F.greatest("cell_x", "cell_y") * TOLERANCE, F.lit(1.0))
    none = (F.col("cell_x") <= CELL) & (F.col("cell_y") <= CELL)
    return at.select("block_id", "gx", "gy", distance.alias("distance"), tolerance.alias("tolerance"), (none | (distance <= tolerance)).alias("within"))


def missing_cells(blocks: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Expected cells that no block fills; by default every cell of the blocks' own rectangle."""
    if expected is None:
        return gaps(blocks.select("gx", "gy").distinct())
    return expected.join(blocks.select("gx", "gy").distinct(), ["gx", "gy"], "left_anti")


def gaps(cells: DataFrame) -> DataFrame:
    """(gx, gy) of the rectangle's cells that are not among distinct ones: what lies between neighbours of a column, and the columns without any. Full columns cost nothing."""
    cells = cut(cells)
    box = cells.agg(*(f(f"g{a}").alias(f"{n}{a}") for a in "xy" for n, f in (("lo", F.min), ("hi", F.max)))).filter("lox IS NOT NULL")
    column = Window.partitionBy("gx").orderBy("gy")
    at = cells.join(F.broadcast(box)).select("gx", "gy", "loy", "hiy", F.lag("gy").over(column).alias("before"), F.lead("gy").over(column).alias("after"))
    below = at.select("gx", F.coalesce(F.col("before") + 1, "loy").alias("first"), (F.col("gy") - 1).alias("last"))
    above = at.filter("after IS NULL").select("gx", (F.col("gy") + 1).alias("first"), F.col("hiy").alias("last"))
    filled = cells.select("gx").distinct()
    columns = filled.join(F.broadcast(box)).select("gx", "hix", F.lead("gx").over(Window.orderBy("gx")).alias("next"), "loy", "hiy")
    empty = columns.filter("next > gx + 1").select(F.explode(F.sequence(F.col("gx") + 1, F.col("next") - 1)).alias("gx"), F.col("loy").alias("first"), F.col("hiy").alias("last"))
    spans = below.union(above).union(empty).filter("first <= last")
    return spans.select("gx", F.explode(F.sequence("first", "last")).alias("gy"))


def lost(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys that were in the input and are not in the output."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def retained(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    return before.select(key).distinct().join(after.select(key), key, "left_semi")
