"""Several tilesets under one root: checked inputs, bounds and errors of their roots, and the merged document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import geodesy as G
from quadrille.functions import matrix as M

LEAST_SOURCES, MOST_SOURCES = 2, 64


def duplicates(sources: DataFrame, key: str = "path") -> DataFrame:
    """Inputs that are given more than once."""
    return sources.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def root_bounds(roots: DataFrame) -> DataFrame:
    """Add bounds (6 numbers, in the world) and error to root tiles: box, region or sphere, transform, ge, doc_ge.

    A box's hull is the sum of its absolute half axes, a sphere's extent the length of the matrix rows, and a region ignores
    the transform. The error is the greater of both, times a bound of the stretch.
    """
    m = F.coalesce("transform", M.identity())
    centre = M.transform_point(m, F.slice("sphere", 1, 3))
    reach = [F.get("sphere", 3) * F.sqrt(M.at(m, r, 0) * M.at(m, r, 0) + M.at(m, r, 1) * M.at(m, r, 1) + M.at(m, r, 2) * M.at(m, r, 2)) for r in range(3)]
    sphere = M.vector(*(F.get(centre, r) - reach[r] for r in range(3)), *(F.get(centre, r) + reach[r] for r in range(3)))
    region = G.region_bounds(*(F.get("region", i) for i in range(6)))
    bounds = F.when(F.col("box").isNotNull(), M.box_aabb(F.col("box"), m)).when(F.col("sphere").isNotNull(), sphere).when(F.col("region").isNotNull(), region)
    return roots.withColumn("bounds", bounds).withColumn("error", F.greatest("ge", "doc_ge") * M.scale_bound(m))


def root_issues(roots: DataFrame) -> DataFrame:
    """Why a source can't be merged; roots as with bounds and error."""
    m = F.coalesce("transform", M.identity())
    why = (
        F.when(~F.coalesce(F.col("refine").isin("ADD", "REPLACE"), F.lit(False)), "merge input root requires explicit refine ADD or REPLACE")
        .when(~((M.at(m, 3, 0) == 0) & (M.at(m, 3, 1) == 0) & (M.at(m, 3, 2) == 0) & (M.at(m, 3, 3) == 1)), "merge root transform must be affine")
        .when(F.col("bounds").isNull(), "merge supports box, sphere or WGS84 region bounds")
        .when(F.get("sphere", 3) < 0, "merge sphere radius must be nonnegative")
        .when(~F.coalesce((F.col("ge") >= 0) & (F.col("doc_ge") >= 0) & (F.abs("error") < float("inf")) & F.forall("bounds", lambda x: F.abs(x) < float("inf")), F.lit(False)), "merge bounds or geometricError are invalid or overflow")
    )
    return roots.withColumn("why", why).filter("why IS NOT NULL").select("source", "why")


def union_bounds(rows: DataFrame, keys: list[str], bounds: str = "bounds") -> DataFrame:
    """The hull of bounds (6 numbers) per key; null bounds count as nothing."""
    agg = rows.groupBy(*keys).agg(*(F.min(F.get(bounds, i)).alias(f"b{i}") for i in range(3)), *(F.max(F.get(bounds, i)).alias(f"b{i}") for i in range(3, 6)))
    return agg.select(*keys, F.when(F.col("b0").isNotNull(), F.array(*(F.col(f"b{i}") for i in range(6)))).alias(bounds))


def merged_root(roots: DataFrame, generator: str = "quadrille") -> DataFrame:
    """The merged document as one JSON text. roots: source (1, 2, ...), file, bounds, error, version; 64 at most, so its children are one bounded list."""
    box = lambda b: M.aabb_box([F.get(b, i) for i in range(3)], [F.get(b, i + 3) for i in range(3)])
    child = F.struct(F.col("source"), F.to_json(F.struct(F.struct(box(F.col("bounds")).alias("box")).alias("boundingVolume"), F.col("error").alias("geometricError"), F.struct(F.format_string("sources/source-%03d/%s", "source", "file").alias("uri")).alias("content"))).alias("json"))
    hull = M.vector(*(F.min(F.get("bounds", i)) for i in range(3)), *(F.max(F.get("bounds", i)) for i in range(3, 6)))
    one = roots.agg(F.array_sort(F.collect_list(child)).alias("kids"), hull.alias("hull"), F.max("error").alias("ge"), F.max(F.when(F.col("version") == "1.1", "1.1").otherwise("1.0")).alias("version"))
    head = F.concat(F.lit('{"asset":{"version":"'), "version", F.lit(f'","generator":"{generator}"}},"geometricError":'), F.col("ge").cast("string"), F.lit(',"root":{"boundingVolume":{"box":'), F.to_json(box(F.col("hull"))), F.lit('},"geometricError":'), F.col("ge").cast("string"), F.lit(',"refine":"ADD","children":['))
    return one.select(F.concat(head, F.array_join(F.transform("kids", lambda k: k["json"]), ","), F.lit("]}}")).alias("document"))
