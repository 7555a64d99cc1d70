"""Queries on mesh groups, seams and regions. Points are the first numbers of embeddings times ten, meshes their labels; (part, supplier) of a line item is an edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import clip, dedup, gap, region
from quadrille.plans.registry import query
from quadrille.sources.tables import table


@query("SELECT p_brand, p_size > 25 AS has_normals, count(*) AS n_prims, CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS triangles, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS vertices FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def material_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", (F.col("p_size") > 25).alias("has_normals"))
    prims = table(spark, sf_dir, "lineitem").join(parts, "l_partkey").withColumns({"triangles": F.round("l_extendedprice").cast("long"), "vertices": F.round("l_quantity").cast("long")})
    return dedup.groups(prims, ["p_brand", "has_normals"])


@query("WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS triangles FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, triangles, greatest(CAST(round(triangles / (SELECT sum(triangles) FROM g)::DOUBLE * 8000) AS BIGINT), 4) AS target FROM g")
def budget_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("triangles"))
    return dedup.shares(grouped, 8000)


@query("""SELECT l_orderkey, l_linenumber, CAST(sum(CAST(round(l_quantity) AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - CAST(round(l_quantity) AS BIGINT) AS BIGINT) AS vertex_offset FROM lineitem""")
def vertex_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    prims = table(spark, sf_dir, "lineitem").withColumn("vertices", F.round("l_quantity").cast("long"))
    return dedup.vertex_offsets(prims, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "vertex_offset")


@query("SELECT CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS triangles, CAST(sum(l_partkey) AS BIGINT) AS texture_bytes, max(l_tax) AS max_error, bool_or(l_quantity > 49) AS any_over_budget, min_by('w' || l_orderkey, l_orderkey * 10 + l_linenumber) FILTER (WHERE l_discount > 0.09) AS first_warning, max(l_quantity) AS max_gap FROM lineitem")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("node"), F.round("l_extendedprice").cast("long").alias("triangles"), c("l_partkey").alias("texture_bytes"), c("l_tax").alias("error"), (c("l_quantity") > 49).alias("over_budget"), F.when(c("l_discount") > 0.09, F.concat(F.lit("w"), "l_orderkey")).alias("warning"), c("l_quantity").alias("gap"))
    return dedup.rollup_metrics(rows).drop("widest_node")


@query("SELECT l_orderkey AS mesh, least(a, b) AS a, greatest(a, b) AS b FROM (SELECT l_orderkey, l_partkey % 7 AS a, l_suppkey % 7 + 7 AS b FROM lineitem UNION ALL SELECT l_orderkey, l_suppkey % 7 + 7, l_linenumber + 14 FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber + 14, l_partkey % 7 FROM lineitem) GROUP BY 1, 2, 3 HAVING count(*) = 1")
def border_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    triangles = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mesh"), (F.col("l_partkey") % 7).alias("i0"), (F.col("l_suppkey") % 7 + 7).alias("i1"), (F.col("l_linenumber").cast("long") + 14).alias("i2"))
    return gap.border_edges(triangles)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: (F.get("embedding", i).cast("double") * 10)
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("mesh"), F.col("vec_id").alias("point_id"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


POINTS_SQL = "p AS (SELECT label AS mesh, vec_id AS point_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z FROM embeddings)"
PAIRS_SQL = POINTS_SQL + """, m AS (SELECT mesh, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, greatest(max(x) - min(x), 1e-3) AS ex, greatest(max(y) - min(y), 1e-3) AS ey, greatest(max(z) - min(z), 1e-3) AS ez FROM p GROUP BY 1),
 j AS (SELECT a.mesh AS a, b.mesh AS b, a.mx AS amx, b.mx AS bmx, a.my AS amy, b.my AS bmy, a.mz AS amz, b.mz AS bmz, a.ex AS aex, b.ex AS bex, a.ey AS aey, b.ey AS bey, a.ez AS aez, b.ez AS bez,
 greatest(a.x0, b.x0) <= least(a.x1, b.x1) + 1e-3 AS ox, greatest(a.y0, b.y0) <= least(a.y1, b.y1) + 1e-3 AS oy, greatest(a.z0, b.z0) <= least(a.z1, b.z1) + 1e-3 AS oz FROM m a JOIN m b ON a.mesh < b.mesh),
 ax AS (SELECT *, CASE WHEN abs(amx - bmx) <= (aex + bex) * 0.8 + 1e-3 AND abs(amx - bmx) > 1e-6 AND oy AND oz THEN 'x' WHEN abs(amy - bmy) <= (aey + bey) * 0.8 + 1e-3 AND abs(amy - bmy) > 1e-6 AND oz AND ox THEN 'y' WHEN abs(amz - bmz) <= (aez + bez) * 0.8 + 1e-3 AND abs(amz - bmz) > 1e-6 AND ox AND oy THEN 'z' END AS axis FROM j),
 pr AS (SELECT a, b, axis, CASE axis WHEN 'x' THEN (amx + bmx) / 2 WHEN 'y' THEN (amy + bmy) / 2 ELSE (amz + bmz) / 2 END AS mid, CASE axis WHEN 'x' THEN greatest((aex + bex) * 0.15, 0.5) WHEN 'y' THEN greatest((aey + bey) * 0.15, 0.5) ELSE greatest((aez + bez) * 0.15, 0.5) END AS band FROM ax WHERE axis IS NOT NULL)"""


@query(f"WITH {PAIRS_SQL} SELECT a, b, axis, round(mid, 6) AS mid, round(band, 6) AS band FROM pr")
def adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gap.adjacent(gap.boxes(points(spark, sf_dir)))
    return found.select("a", "b", "axis", F.round("mid", 6).alias("mid"), F.round("band", 6).alias("band"))


BAND_SQL = PAIRS_SQL + """, s AS (SELECT pr.a, pr.b, p.mesh = pr.a AS left_side, point_id, x, y, z, abs(CASE axis WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END - mid) <= band AS inside FROM pr JOIN p ON p.mesh IN (pr.a, pr.b)),
 f AS (SELECT a, b, count(*) FILTER (WHERE inside AND left_side) AS na, count(*) FILTER (WHERE inside AND NOT left_side) AS nb FROM s GROUP BY 1, 2), k AS (SELECT s.* FROM s JOIN f USING (a, b) WHERE inside OR na = 0 OR nb = 0),
 d AS (SELECT u.a, u.b, u.left_side, u.point_id, min(sqrt((u.x - v.x) ** 2 + (u.y - v.y) ** 2 + (u.z - v.z) ** 2)) AS d FROM k u JOIN k v ON u.a = v.a AND u.b = v.b AND u.left_side <> v.left_side GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {BAND_SQL} SELECT a, b, point_id, round(d, 6) AS d FROM d WHERE left_side")
def nearest_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair the distance of the first mesh's band points to the second mesh's: always the true nearest."""
    all_ = points(spark, sf_dir)
    sided = gap.band_points(gap.adjacent(gap.boxes(all_)), all_)
    found = gap.nearest(sided.filter("side = 'a'").drop("side"), sided.filter("side = 'b'").drop("side"), ["a", "b"])
    return found.withColumn("d", F.round("d", 6))


@query(f"WITH {BAND_SQL} SELECT a, b, count(*) AS n, round(max(d), 6) AS max_gap, round(list_sort(list(d))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS INT) + 1], 6) AS p95_gap FROM d GROUP BY 1, 2")
def gap_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = points(spark, sf_dir)
    return gap.gap_metrics(all_, gap.adjacent(gap.boxes(all_))).withColumns({c: F.round(c, 6) for c in ("max_gap", "p95_gap")})


L_SHAPE = [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (1.0, 1.0), (1.0, 3.0), (0.0, 3.0)]


@query(f"WITH {POINTS_SQL} SELECT point_id, (x >= 0 AND x <= 3 AND y >= 0 AND y <= 1) OR (x >= 0 AND x <= 1 AND y >= 0 AND y <= 3) AS inside, (x >= 0 AND x < 3 AND y >= 0 AND y < 1) OR (x >= 0 AND x < 1 AND y >= 0 AND y < 3) AS even_odd FROM p")
def point_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in an L shape, by its convex parts and by the crossing rule."""
    r, x, y = region.Region.planar(L_SHAPE), F.col("x"), F.col("y")
    return points(spark, sf_dir).select("point_id", region.contains(r, x, y).alias("inside"), region.even_odd(L_SHAPE, x, y).alias("even_odd"))


@query(f"WITH {POINTS_SQL} SELECT point_id, x + 1 < 0 OR x > 2 OR y + 1 < 0 OR y > 1 AS excluded FROM p")
def region_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit boxes that a rectangle excludes by one of its edges."""
    r, x, y = region.Region.planar([(0, 0), (2, 0), (2, 1), (0, 1)]), F.col("x"), F.col("y")
    return points(spark, sf_dir).select("point_id", region.excludes_box(r, x, y, x + 1, y + 1).alias("excluded"))


RING = 8


@query(f"""WITH e AS (SELECT vec_id AS ring, i::INT AS i, embedding[2 * i + 1]::DOUBLE AS ax, embedding[2 * i + 2]::DOUBLE AS ay, embedding[2 * ((i + 1) % {RING}) + 1]::DOUBLE AS bx, embedding[2 * ((i + 1) % {RING}) + 2]::DOUBLE AS by_ FROM embeddings, unnest(range(0, {RING})) t(i))
 SELECT p.ring, p.i, q.i AS j FROM e p JOIN e q ON p.ring = q.ring AND p.i + 1 < q.i AND NOT (p.i = 0 AND q.i = {RING - 1})
 WHERE ((p.bx - p.ax) * (q.ay - p.ay) - (p.by_ - p.ay) * (q.ax - p.ax)) * ((p.bx - p.ax) * (q.by_ - p.ay) - (p.by_ - p.ay) * (q.bx - p.ax)) < 0
 AND ((q.bx - q.ax) * (p.ay - q.ay) - (q.by_ - q.ay) * (p.ax - q.ax)) * ((q.bx - q.ax) * (p.by_ - q.ay) - (q.by_ - q.ay) * (p.bx - q.ax)) < 0""")  # fmt: skip
def ring_self_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossing edges of rings made of eight points of an embedding."""
    at = lambda i: F.get("embedding", i.cast("int")).cast("double")
    i, nxt = F.col("i"), (F.col("i") + 1) % RING
    edges = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ring"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(RING - 1))).alias("i"), F.lit(RING).alias("n"))
    return region.ring_crossings(edges.select("ring", "i", "n", at(2 * i).alias("ax"), at(2 * i + 1).alias("ay"), at(2 * nxt).alias("bx"), at(2 * nxt + 1).alias("by")))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle of each embedding, grown so that many reach into the region."""
    at = lambda i: F.get("embedding", i).cast("double") * 10
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(at(3 * k + i).alias(f"{a}{k}") for k in range(3) for i, a in enumerate("xyz")))


@query()
def clip_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of triangles in and out of the L shape; tests hold their areas against the whole triangles."""
    return clip.clip_triangles(triangles(spark, sf_dir), region.Region.planar(L_SHAPE)).select("id", "side", F.round("area", 6).alias("area"))


@query("SELECT vec_id AS id, round(abs((embedding[4]::DOUBLE - embedding[1]::DOUBLE) * (embedding[8]::DOUBLE - embedding[2]::DOUBLE) - (embedding[5]::DOUBLE - embedding[2]::DOUBLE) * (embedding[7]::DOUBLE - embedding[1]::DOUBLE)) * 50, 5) AS area FROM embeddings")
def partition_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In and out together have the area of the triangle: SQL gives the whole one."""
    cut = clip.clip_triangles(triangles(spark, sf_dir), region.Region.planar(L_SHAPE))
    return cut.groupBy("id").agg(F.round(F.sum("area"), 5).alias("area"))


@query()
def flatten_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles flattened to height 0 within the L shape, with walls."""
    return clip.flatten_triangles(triangles(spark, sf_dir), region.Region.planar(L_SHAPE), 0.0).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
