"""Queries on blocks, levels of detail, trees and geodesy.

Roles of the tables: suppliers are blocks on a grid 16 wide (gx = key % 16, gy = key / 16), line items are the representations
of their order (error = quantity, numbered by line), region > nation > customer > orders is the tree, and the first numbers of
an embedding are a point.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import errors as E
from quadrille.functions import geodesy as G
from quadrille.functions import matrix as M
from quadrille.operators import grid, merge, quadtree, tree, validate
from quadrille.plans.registry import query
from quadrille.sources.tables import table


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as blocks, 100 apart; the account balance is the height."""
    gx, gy = (F.col("s_suppkey") % 16).cast("int"), F.floor(F.col("s_suppkey") / 16).cast("int")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("block_id"), gx.alias("gx"), gy.alias("gy"), (gx * 100 - 50.0).alias("min_x"), (gy * 100 - 50.0).alias("min_y"), F.lit(-10.0).alias("min_z"),
        (gx * 100 + 50.0).alias("max_x"), (gy * 100 + 50.0).alias("max_y"), F.greatest(F.col("s_acctbal"), F.lit(0.0)).alias("max_z"), (gx * 100.0).alias("cx"), (gy * 100.0 + F.col("s_suppkey") % 7).alias("cy"),
    )


BLOCKS_SQL = """blocks AS (SELECT s_suppkey AS block_id, CAST(s_suppkey % 16 AS INT) AS gx, CAST(floor(s_suppkey / 16.0) AS INT) AS gy,
 CAST((s_suppkey % 16) * 100 - 50.0 AS DOUBLE) AS min_x, floor(s_suppkey / 16.0) * 100 - 50.0 AS min_y, CAST((s_suppkey % 16) * 100 + 50.0 AS DOUBLE) AS max_x, floor(s_suppkey / 16.0) * 100 + 50.0 AS max_y,
 greatest(s_acctbal, 0.0) AS max_z, CAST((s_suppkey % 16) * 100.0 AS DOUBLE) AS cx, floor(s_suppkey / 16.0) * 100.0 + s_suppkey % 7 AS cy FROM supplier)"""


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as representations of their order."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("block_id"), (F.col("l_linenumber") - 1).alias("rep_index"), F.col("l_quantity").alias("ge"), F.round("l_extendedprice").cast("long").alias("triangles"))


@query("""WITH r AS (SELECT l_orderkey AS block_id, l_linenumber - 1 AS rep_index, l_quantity AS ge, CAST(round(l_extendedprice) AS BIGINT) AS triangles, l_quantity <= 20.0 AS ok FROM lineitem),
 n AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY ok DESC, CASE WHEN ok THEN -ge ELSE ge END, rep_index, CASE WHEN ok THEN -triangles ELSE triangles END) AS k FROM r)
 SELECT block_id, CAST(rep_index AS INT) AS rep_index, ge, triangles, ok AS reached FROM n WHERE k = 1""")  # fmt: skip
def select_representation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The representation of each order at a target error of 40 and ratio 0.5."""
    return quadtree.select_representations(representations(spark, sf_dir), 40.0)


LEVELS_SQL = f"""WITH {BLOCKS_SQL}, o AS (SELECT min(gx) AS ox, min(gy) AS oy, max(gx) AS mx, max(gy) AS my FROM blocks),
 lv AS (SELECT unnest(range(0, 8)) AS level), n AS (SELECT level, CAST(floor((gx - ox) / pow(2, level)) AS INT) AS gx, CAST(floor((gy - oy) / pow(2, level)) AS INT) AS gy, count(*) AS n_blocks,
 min(min_x) AS min_x, min(min_y) AS min_y, min(-10.0) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z, min(block_id) AS block_id FROM blocks, o, lv GROUP BY 1, 2, 3),
 s AS (SELECT level, count(*) AS n_nodes FROM n GROUP BY 1), k AS (SELECT level FROM s WHERE level <= (SELECT min(level) FROM s WHERE n_nodes = 1))"""


@query(f"""{LEVELS_SQL} SELECT CAST(s.level AS INT) AS level, s.n_nodes, b.n_nodes IS NULL OR s.n_nodes < b.n_nodes AS shrinks FROM s JOIN k USING (level) LEFT JOIN s b ON b.level = s.level - 1""")
def quadtree_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadtree.level_counts(blocks(spark, sf_dir))


@query(f"""{LEVELS_SQL} SELECT CAST(level AS INT) AS level, gx, gy, n_blocks, min_x, min_y, CAST(min_z AS DOUBLE) AS min_z, max_x, max_y, max_z FROM n JOIN k USING (level)""")
def quadtree_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadtree.level_nodes(blocks(spark, sf_dir)).select("level", "gx", "gy", "n_blocks", *quadtree.BOUNDS)


@query(f"""{LEVELS_SQL}, c AS (SELECT level + 1 AS level, CAST(floor(gx / 2.0) AS INT) AS px, CAST(floor(gy / 2.0) AS INT) AS py, gx, gy, CASE WHEN level = 0 THEN 'L0_' || block_id ELSE 'Proxy_L' || level || '_' || gx || '_' || gy END AS id FROM n)
 SELECT CAST(c.level AS INT) AS level, px AS gx, py AS gy, string_agg(id, ',' ORDER BY c.gy, c.gx) AS child_ids FROM c JOIN k ON k.level = c.level GROUP BY 1, 2, 3""")  # fmt: skip
def quadtree_child_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadtree.child_lists(blocks(spark, sf_dir)).withColumn("child_ids", F.array_join("child_ids", ","))


@query(LEVELS_SQL.replace("FROM supplier)", "FROM supplier WHERE s_suppkey IN (SELECT l_orderkey FROM lineitem))") + """, r AS (SELECT l_orderkey AS b, CAST(round(l_extendedprice) AS BIGINT) AS triangles, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity <= 20.0 DESC, CASE WHEN l_quantity <= 20.0 THEN -l_quantity ELSE l_quantity END, l_linenumber, CASE WHEN l_quantity <= 20.0 THEN -round(l_extendedprice) ELSE round(l_extendedprice) END) AS i FROM lineitem)
 SELECT CAST(level AS INT) AS level, count(*) AS n_nodes, CAST(sum(n_blocks) AS BIGINT) AS n_blocks, min(min_x) AS min_x, min(min_y) AS min_y, CAST(min(min_z) AS DOUBLE) AS min_z, max(max_x) AS max_x, max(max_y) AS max_y, max(max_z) AS max_z, (SELECT CAST(sum(triangles) AS BIGINT) FROM r WHERE i = 1) AS triangles FROM n JOIN k USING (level) GROUP BY 1""")  # fmt: skip
def quadtree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: levels with nodes and bounds of the suppliers that have an order of their number, and the triangles selected over all orders."""
    return quadtree.rollup(blocks(spark, sf_dir), representations(spark, sf_dir), 40.0)


@query("SELECT max(l_quantity) * 2 AS target FROM lineitem")
def default_target_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadtree.default_target(representations(spark, sf_dir))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN d > 0 AND src > 2 * greatest(d * 0.75, 1.0) THEN greatest(d * 0.75, 1.0) ELSE src END, 6) AS error FROM
 (SELECT l_orderkey, l_linenumber, l_tax * 100 AS d, CASE WHEN l_quantity - 10 > 0 THEN l_quantity - 10 ELSE 1.0 END AS src FROM lineitem)""")  # fmt: skip
def leaf_error_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(E.leaf_error(F.col("l_quantity") - 10, F.col("l_tax") * 100), 6).alias("error"))


@query("SELECT l_orderkey, round(greatest(c + greatest(s, 0.0), c * 2, CASE WHEN d > 0 THEN d * 0.75 ELSE 0.0 END, c + 1), 6) AS error FROM (SELECT l_orderkey, max(l_quantity) AS c, max(l_discount) * 100 - 5 AS s, max(l_tax) * 1000 AS d FROM lineitem GROUP BY 1)")
def proxy_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("c"), (F.max("l_discount") * 100 - 5).alias("s"), (F.max("l_tax") * 1000).alias("d"))
    return per.select("l_orderkey", F.round(E.proxy_error(F.col("c"), F.col("s"), F.col("d")), 6).alias("error"))


@query("SELECT l_orderkey, round(greatest(c * 2, CASE WHEN d > 0 THEN d * 0.25 ELSE 0.0 END, c + 1, c * 1.01 + 1e-3), 6) AS error FROM (SELECT l_orderkey, max(l_quantity) AS c, max(l_tax) * 1000 AS d FROM lineitem GROUP BY 1)")
def proxy_error_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_quantity").alias("c"), (F.max("l_tax") * 1000).alias("d"))
    return per.select("l_orderkey", F.round(E.baseline_error(F.col("c"), F.col("d")), 6).alias("error"))


def at(i: int):
    return F.get("embedding", i).cast("double")


@query("SELECT label, " + ", ".join(f"min(embedding[{i + 1}]::DOUBLE) AS min_{a}, max(embedding[{i + 1}]::DOUBLE) AS max_{a}" for i, a in enumerate("xyz")) + " FROM embeddings GROUP BY 1")
def aabb_union_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hull of each label's points."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.array(*(at(i) for i in range(3)), *(at(i) for i in range(3))).alias("bounds"))
    return merge.union_bounds(rows, ["label"]).select("label", *(F.get("bounds", 3 * k + i).alias(f"{n}_{a}") for i, a in enumerate("xyz") for k, n in enumerate(("min", "max"))))


def box_of() -> F.Column:
    return F.array(*(at(i) for i in range(12)))


@query("SELECT vec_id, " + ", ".join(f"round(embedding[{r + 1}]::DOUBLE {s} (abs(embedding[{r + 4}]::DOUBLE) + abs(embedding[{r + 7}]::DOUBLE) + abs(embedding[{r + 10}]::DOUBLE)), 9) AS {n}_{a}" for n, s in (("lo", "-"), ("hi", "+")) for r, a in enumerate("xyz")) + " FROM embeddings")
def box_corners_aabb(spark: SparkSession, sf_dir: str) -> DataFrame:
    hull = table(spark, sf_dir, "embeddings").select("vec_id", M.box_aabb(box_of()).alias("h"))
    return hull.select("vec_id", *(F.round(F.get("h", 3 * k + i), 9).alias(f"{n}_{a}") for k, n in enumerate(("lo", "hi")) for i, a in enumerate("xyz")))


@query("SELECT vec_id, round(2 * sqrt(" + " + ".join(f"embedding[{i}]::DOUBLE * embedding[{i}]::DOUBLE" for i in range(4, 13)) + "), 9) AS diagonal FROM embeddings")
def box_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(M.box_diagonal(box_of()), 9).alias("diagonal"))


def place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a place made of their key."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", ((k * 37) % 360 - 180.0).alias("lon"), ((k * 11) % 160 - 80.0).alias("lat"), F.col("c_acctbal").alias("height"))


PLACE_SQL = "p AS (SELECT c_custkey, radians((c_custkey * 37) % 360 - 180.0) AS lo, radians((c_custkey * 11) % 160 - 80.0) AS la, c_acctbal AS h FROM customer), q AS (SELECT *, 6378137.0 / sqrt(1 - 6.6943799901413165e-3 * sin(la) * sin(la)) AS n FROM p)"


@query(f"WITH {PLACE_SQL} SELECT c_custkey, round((n + h) * cos(la) * cos(lo), 3) + 0.0 AS x, round((n + h) * cos(la) * sin(lo), 3) + 0.0 AS y, round((n * (1 - 6.6943799901413165e-3) + h) * sin(la), 3) + 0.0 AS z FROM q")
def geodetic_to_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    xyz = place(spark, sf_dir).select("c_custkey", G.ecef(F.col("lon"), F.col("lat"), F.col("height")).alias("p"))
    return xyz.select("c_custkey", *((F.round(F.get("p", i), 3) + 0.0).alias(a) for i, a in enumerate("xyz")))


@query(f"WITH {PLACE_SQL} SELECT c_custkey, round(-sin(lo), 9) + 0.0 AS east_x, round(cos(lo), 9) + 0.0 AS east_y, round(-sin(la) * cos(lo), 9) + 0.0 AS north_x, round(-sin(la) * sin(lo), 9) + 0.0 AS north_y, round(cos(la), 9) + 0.0 AS north_z, round(sin(la), 9) + 0.0 AS up_z FROM q")
def enu_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = place(spark, sf_dir).select("c_custkey", G.enu_frame(F.col("lon"), F.col("lat"), F.col("height")).alias("m"))
    return m.select("c_custkey", *((F.round(F.get("m", i), 9) + 0.0).alias(n) for n, i in (("east_x", 0), ("east_y", 1), ("north_x", 4), ("north_y", 5), ("north_z", 6), ("up_z", 10))))


def matrix_of(shift: int = 0) -> F.Column:
    return F.array(*(at(i + shift) for i in range(16)))


@query("SELECT vec_id, " + ", ".join("round(" + " + ".join(f"embedding[{r + 4 * k + 1}]::DOUBLE * embedding[{c * 4 + k + 17}]::DOUBLE" for k in range(4)) + f", 9) AS m{c * 4 + r}" for c in (0, 3) for r in range(4)) + " FROM embeddings")
def matrix_multiply(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "embeddings").select("vec_id", M.multiply(matrix_of(), matrix_of(16)).alias("m"))
    return m.select("vec_id", *(F.round(F.get("m", c * 4 + r), 9).alias(f"m{c * 4 + r}") for c in (0, 3) for r in range(4)))


@query("SELECT vec_id, " + ", ".join("round(" + " + ".join(f"embedding[{r + 4 * k + 1}]::DOUBLE * embedding[{k + 17}]::DOUBLE" for k in range(3)) + f" + embedding[{r + 13}]::DOUBLE, 9) AS {a}" for r, a in enumerate("xyz")) + " FROM embeddings")
def matrix_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "embeddings").select("vec_id", M.transform_point(matrix_of(), F.array(at(16), at(17), at(18))).alias("p"))
    return p.select("vec_id", *(F.round(F.get("p", i), 9).alias(a) for i, a in enumerate("xyz")))


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT DISTINCT gx, gy FROM blocks), b AS (SELECT min(gx) AS min_x, max(gx) AS max_x, min(gy) AS min_y, max(gy) AS max_y, count(*) AS n_cells FROM c)
 SELECT *, max_x::BIGINT - min_x + 1 AS width, max_y::BIGINT - min_y + 1 AS height, (max_x::BIGINT - min_x + 1) * (max_y::BIGINT - min_y + 1) AS expected, n_cells = (max_x::BIGINT - min_x + 1) * (max_y::BIGINT - min_y + 1) AS complete, max_x - min_x < 16 AND max_y - min_y < 16 AS verified FROM b""")  # fmt: skip
def grid_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.completeness(blocks(spark, sf_dir))


SPACING_SQL = f"""WITH {BLOCKS_SQL}, sp AS (SELECT 'x' AS axis, abs(b.cx - a.cx) AS s FROM blocks a JOIN blocks b ON b.gy = a.gy AND b.gx = a.gx + 1 UNION ALL SELECT 'y', abs(b.cy - a.cy) FROM blocks a JOIN blocks b ON b.gx = a.gx AND b.gy = a.gy + 1),
 r AS (SELECT axis, s, row_number() OVER (PARTITION BY axis ORDER BY s) - 1 AS i, count(*) OVER (PARTITION BY axis) AS n FROM sp WHERE s >= 1e-3), med AS (SELECT axis, s AS median FROM r WHERE i = floor(n / 2.0)),
 cell AS (SELECT coalesce(max(CASE WHEN axis = 'x' THEN median END), 0.0) AS x, coalesce(max(CASE WHEN axis = 'y' THEN median END), 0.0) AS y FROM med)"""


@query(f"{SPACING_SQL} SELECT axis, median FROM med")
def grid_spacing_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.upper_median(grid.spacings(blocks(spark, sf_dir)).filter(F.col("spacing") >= grid.COLLAPSED), "axis", "spacing")


@query(f"""{SPACING_SQL}, o AS (SELECT gx AS ogx, gy AS ogy, cx AS ocx, cy AS ocy FROM blocks ORDER BY gx, gy LIMIT 1)
 SELECT block_id, gx, gy, round(sqrt((cx - ocx - (gx - ogx) * x) ** 2 + (cy - ocy - (gy - ogy) * y) ** 2), 6) AS distance, round(greatest(greatest(x, y) * 0.35, 1.0), 6) AS tolerance,
 sqrt((cx - ocx - (gx - ogx) * x) ** 2 + (cy - ocy - (gy - ogy) * y) ** 2) <= greatest(greatest(x, y) * 0.35, 1.0) AS "within" FROM blocks, cell, o""")  # fmt: skip
def grid_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.residuals(blocks(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("distance", "tolerance")})


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT min(gx) AS x0, max(gx) AS x1, min(gy) AS y0, max(gy) AS y1 FROM blocks), e AS (SELECT CAST(x AS INT) AS gx, CAST(y AS INT) AS gy FROM b, unnest(range(x0, x1 + 1)) t(x), unnest(range(y0, y1 + 1)) u(y))
 SELECT gx, gy FROM e EXCEPT SELECT gx, gy FROM blocks""")  # fmt: skip
def frontier_missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.missing_cells(blocks(spark, sf_dir))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def subtree_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a line of more than 45."""
    after = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return grid.lost(table(spark, sf_dir, "orders"), after, "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def subtree_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return grid.retained(table(spark, sf_dir, "orders"), after, "o_orderkey")


@query("SELECT o_orderkey AS parent_id, o_totalprice / 10 AS parent_ge, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS ge FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice / 10 + 1e-9 < l_extendedprice")
def error_monotonicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that cost more than a tenth of their order."""
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(None).cast("long").alias("parent_id"), (F.col("o_totalprice") / 10).alias("ge"))
    kids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("ge"))
    up = parents.select(F.col("id").alias("parent_id"), F.col("ge").alias("parent_ge"))
    return kids.join(up, "parent_id").filter(F.col("parent_ge") + validate.SLACK < F.col("ge")).select("parent_id", "parent_ge", "id", "ge")


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer as nodes."""
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    nation = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    customer = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"))
    return region.union(nation).union(customer)


TREE_SQL = """WITH RECURSIVE nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
 walk AS (SELECT id, parent_id, 0 AS depth, id AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.id, n.parent_id, w.depth + 1, w.path || '/' || n.id FROM walk w JOIN nodes n ON n.parent_id = w.id)"""


@query(f"{TREE_SQL} SELECT id, parent_id, depth, path FROM walk")
def tree_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.flatten(tree_nodes(spark, sf_dir)).select("id", "parent_id", "depth", F.array_join("path", "/").alias("path"))


@query(f"{TREE_SQL} SELECT count(*) AS n_nodes, count(*) FILTER (WHERE depth < 2) AS n_proxies, count(*) FILTER (WHERE depth = 2) AS n_external, count(*) FILTER (WHERE depth = 1) AS n_replace, max(depth) AS max_depth, count(*) FILTER (WHERE depth = 0) AS n_without_content FROM walk")
def tree_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = tree.flatten(tree_nodes(spark, sf_dir))
    return tree.probe(flat.select("depth", F.when(F.col("depth") < 2, "proxy").otherwise("external").alias("kind"), F.when(F.col("depth") == 1, "replace").otherwise("ADD").alias("refine"), F.when(F.col("depth") > 0, F.concat(F.lit("./"), "id", F.lit(".b3dm"))).alias("uri")))


@query("SELECT count(*) AS n_nodes, count(u) AS n_contents, CAST(sum(('0x' || substr(md5(regexp_extract(u, '([^/.]*)[^/]*$', 1)), 1, 8))::BIGINT) AS BIGINT) AS stem_sum FROM (SELECT CASE WHEN p_size > 5 THEN './Data/' || p_brand || '_' || p_partkey || '.b3dm' END AS u FROM part)")
def structure_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = F.concat(F.lit("./Data/"), "p_brand", F.lit("_"), "p_partkey", F.lit(".b3dm"))
    return tree.digest(table(spark, sf_dir, "part").select(F.when(F.col("p_size") > 5, uri).alias("uri")))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def missing_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no large line refers to (anti join)."""
    there = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(there, "p_partkey", "left_anti")


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def present_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(there, "p_partkey", "left_semi")


def issue_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tiles of their order, with faults that follow from their values."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 4).alias("parent_ge")), "l_orderkey")
    c, none = F.col, F.lit(None)
    return li.select(
        F.concat_ws("#", c("l_orderkey").cast("string"), c("l_linenumber").cast("string")).alias("loc"), F.when(c("l_linenumber") == 7, none).otherwise(c("l_extendedprice") - 1000).cast("double").alias("ge"), "parent_ge",
        F.lit(False).alias("is_root"), F.when(c("l_returnflag") == "R", "replace").when(c("l_returnflag") == "N", "ADD").otherwise("MERGE").alias("refine"), (c("l_linestatus") == "F").alias("has_refine"),
        (c("l_quantity") > 2).alias("has_volume"), F.when(c("l_quantity") > 2, F.array_repeat(c("l_tax"), F.when(c("l_quantity") > 49, 11).otherwise(12))).alias("box"), none.cast("array<double>").alias("region"), none.cast("array<double>").alias("sphere"),
        (c("l_discount") > 0.05).alias("has_transform"), F.array_repeat(c("l_tax"), F.when(c("l_discount") > 0.09, 15).otherwise(16)).alias("transform"),
    )


ISSUES_SQL = """WITH t AS (SELECT l_orderkey || '#' || l_linenumber AS loc, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice - 1000 END AS ge, o_totalprice / 4 AS pge, l_returnflag AS f, l_linestatus = 'F' AS has_refine, l_quantity AS q, l_discount AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 i AS (SELECT loc, 'GEOMETRIC_ERROR_INVALID' AS code, 'error' AS severity FROM t WHERE ge < 0 UNION ALL SELECT loc, 'GEOMETRIC_ERROR_INVALID', 'warning' FROM t WHERE ge IS NULL
 UNION ALL SELECT loc, 'GEOMETRIC_ERROR_MONOTONICITY', 'warning' FROM t WHERE pge + 1e-9 < ge UNION ALL SELECT loc, 'REFINE_INVALID', 'error' FROM t WHERE has_refine AND f NOT IN ('R', 'N')
 UNION ALL SELECT loc, 'BOUNDING_VOLUME_MISSING', 'error' FROM t WHERE q <= 2 UNION ALL SELECT loc, 'BOUNDING_VOLUME_INVALID', 'error' FROM t WHERE q > 49 UNION ALL SELECT loc, 'TRANSFORM_INVALID', 'error' FROM t WHERE d > 0.09)"""


@query(f"{ISSUES_SQL} SELECT loc AS path, code, severity FROM i")
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.tile_issues(issue_tiles(spark, sf_dir)).select("path", "code", "severity")


@query(f"{ISSUES_SQL} SELECT count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, count(*) FILTER (WHERE severity = 'error') = 0 AS ok FROM i")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(validate.tile_issues(issue_tiles(spark, sf_dir))).drop("first_error")


@query("""WITH s AS (SELECT o_orderstatus AS source, o_orderkey, o_totalprice AS ge FROM orders) SELECT source, count(*) AS n_tiles, max(ge) AS error FROM s GROUP BY 1 UNION ALL SELECT 'root', count(*), max(ge) FROM s""")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by status as sources under one root, whose error is the greatest."""
    per = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("source")).agg(F.count(F.lit(1)).alias("n_tiles"), F.max("o_totalprice").alias("error"))
    return per.union(per.agg(F.lit("root"), F.sum("n_tiles"), F.max("error")))


@query("SELECT o_custkey AS path, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.duplicates(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path")))


@query("SELECT s_suppkey, CASE WHEN a IS NULL THEN least(greatest(CAST(floor(c / 2.0) AS INT), 1), 8) ELSE least(greatest(a, 1), c) END AS workers FROM (SELECT s_suppkey, CAST(s_suppkey % 24 + 1 AS INT) AS c, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 40 AS INT) END AS a FROM supplier)")
def worker_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", E.workers((k % 24 + 1).cast("int"), F.when(k % 3 == 0, (k % 40).cast("int"))).alias("workers"))
