"""Queries on form rules, file and task rules, texture chains and transforms, each with its SQL.

Roles of the tables: parts are textures and model forms, line items are primitives, orders are tasks or files, customers are
listings, embeddings are points and matrices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import errors as E
from quadrille.functions import geodesy as G
from quadrille.functions import matrix as M
from quadrille.functions import text as T
from quadrille.operators import dedup, features, merge, region, tasks, validate
from quadrille.plans.registry import query
from quadrille.sources import scan
from quadrille.sources.tables import table


@query("""SELECT l_orderkey, l_linenumber, p_name, sha256(p_brand) AS image_hash FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size % 4 <> 0""")
def texture_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as primitives, parts as materials (some without texture), brands as images."""
    part = table(spark, sf_dir, "part")
    prims = table(spark, sf_dir, "lineitem").select(F.lit("p").alias("path"), F.col("l_partkey").alias("material"), "l_orderkey", "l_linenumber")
    materials = part.filter("p_size % 4 <> 0").select(F.lit("p").alias("path"), F.col("p_partkey").alias("material"), F.col("p_partkey").alias("texture"), "p_name")
    textures = part.select(F.lit("p").alias("path"), F.col("p_partkey").alias("texture"), F.col("p_brand").alias("image"))
    images = part.select(F.lit("p").alias("path"), F.col("p_brand").alias("image")).distinct().withColumn("image_hash", dedup.content_hash(F.col("image")))
    return features.texture_chain(prims, materials, textures, images).select("l_orderkey", "l_linenumber", "p_name", "image_hash")


@query("SELECT l_orderkey, l_linenumber, coalesce(md5(p.p_name), 'h' || l_partkey) AS texture FROM lineitem LEFT JOIN part p ON p_partkey = l_partkey AND p_size % 2 = 0")
def replaced_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The processed texture's hash in place of the old one, where there is one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("h"), F.col("l_partkey")).alias("texture"))
    done = table(spark, sf_dir, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("h"), F.col("p_partkey")).alias("old"), F.md5(F.col("p_name").cast("binary")).alias("new"))
    return dedup.replaced(rows, done, "old", "new", "texture").select("l_orderkey", "l_linenumber", "texture")


@query("""WITH b AS (SELECT c_name AS path, c_nationkey AS f FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT c_name AS path, c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS f FROM customer WHERE c_custkey % 3 <> 0)
 SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM b FULL JOIN a ON a.path = b.path WHERE a.f IS DISTINCT FROM b.f""")
def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings of customers as files."""
    c = table(spark, sf_dir, "customer")
    before = c.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("path"), F.col("c_nationkey").alias("fingerprint"))
    after = c.filter("c_custkey % 3 <> 0").select(F.col("c_name").alias("path"), (F.col("c_nationkey") + F.when(F.col("c_custkey") % 7 == 0, 1).otherwise(0)).alias("fingerprint"))
    return dedup.file_changes(before, after)


@query("SELECT count(*) AS n_seen, count(*) FILTER (WHERE p_size % 2 = 0) AS n_converted, CAST(sum(p_size) AS BIGINT) AS n_textures, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS errors FROM part")
def encode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 2 == 0).alias("converted"), F.col("p_size").cast("long").alias("textures"), F.col("p_type").alias("error"))
    return dedup.encode_stats(rows).withColumn("errors", F.array_join("errors", "|"))


@query("""WITH h AS (SELECT url, contains(upper(html), 'THE ') AS hit FROM pages) SELECT count(*) AS n_files, count(*) FILTER (WHERE hit) AS n_mentions, coalesce(bool_or(hit), false) AS found,
 (SELECT string_agg(url, '|' ORDER BY url) FROM (SELECT url FROM h WHERE hit ORDER BY url LIMIT 5)) AS samples FROM h""")
def mention_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that mention a word, and the first five."""
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content"))
    return dedup.evidence(pages, needle="THE ").withColumn("samples", F.array_join("samples", "|"))


@query("SELECT user_id AS task_id, arg_max(event_type, event_id) AS stage FROM events GROUP BY 1")
def latest_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.latest_checkpoint(table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("at")))


VERTICES = [(0, 0.0, 0.0), (1, 0.1, 0.0), (2, 0.1, 0.1), (3, -0.1, 0.05)]


@query("""WITH v AS (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 0.0::DOUBLE), (1, 0.1, 0.0), (2, 0.1, 0.1), (3, -0.1, 0.05)) t(vertex, vx, vy)), s AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
 n AS (SELECT vertex, z AS height, row_number() OVER (PARTITION BY vertex ORDER BY (vx - x) * (vx - x) + (vy - y) * (vy - y), z) AS k FROM v, s) SELECT vertex, height FROM n WHERE k = 1""")
def nearest_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as surface samples around four vertices."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    samples = table(spark, sf_dir, "embeddings").select(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))
    return region.nearest_height(spark.createDataFrame(VERTICES, "vertex int, vx double, vy double"), samples)


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An affine matrix of each embedding: its first nine numbers and a shift."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    cells = [*(x for c in range(3) for x in (*(at(3 * c + r) for r in range(3)), F.lit(0.0))), *(at(9 + r) for r in range(3)), F.lit(1.0)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*cells).alias("m"))


CELLS_SQL = "c AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i}" for i in range(12)) + " FROM embeddings)"


@query(f"""WITH {CELLS_SQL} SELECT vec_id, round(sqrt(greatest(abs(e0) + abs(e1) + abs(e2), abs(e3) + abs(e4) + abs(e5), abs(e6) + abs(e7) + abs(e8)) * greatest(abs(e0) + abs(e3) + abs(e6), abs(e1) + abs(e4) + abs(e7), abs(e2) + abs(e5) + abs(e8))), 9) AS scale FROM c""")
def error_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linear(spark, sf_dir).select("vec_id", F.round(M.scale_bound(F.col("m")), 9).alias("scale"))


@query(f"""WITH {CELLS_SQL}, d AS (SELECT *, e0 * (e4 * e8 - e7 * e5) - e3 * (e1 * e8 - e7 * e2) + e6 * (e1 * e5 - e4 * e2) AS det FROM c)
 SELECT vec_id, round((e4 * e8 - e7 * e5) / det, 6) AS inv0, round((e0 * e4 - e3 * e1) / det, 6) AS inv10 FROM d""")
def affine_inverses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two elements of the inverse of each matrix."""
    inverse = linear(spark, sf_dir).select("vec_id", M.affine_inverse(F.col("m")).alias("i"))
    return inverse.select("vec_id", F.round(F.get("i", F.lit(0)), 6).alias("inv0"), F.round(F.get("i", F.lit(10)), 6).alias("inv10"))


@query("SELECT vec_id, vec_id % 3 <> 0 AS affine FROM embeddings")
def affine_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of which a third has a last row that is not (0, 0, 0, 1)."""
    bad = F.transform("m", lambda x, i: F.when((i == 15) & (F.col("vec_id") % 3 == 0), 2.0).otherwise(x))
    return linear(spark, sf_dir).select("vec_id", M.is_affine(bad).alias("affine"))


@query("SELECT a.vec_id, greatest(" + ", ".join(f"abs(a.embedding[{i}]::DOUBLE - b.embedding[{i}]::DOUBLE)" for i in range(1, 13)) + ") AS difference FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def matrix_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest difference of each matrix to the next one."""
    m = linear(spark, sf_dir)
    other = m.select((F.col("vec_id") - 1).alias("vec_id"), F.col("m").alias("n"))
    return m.join(other, "vec_id").select("vec_id", M.max_abs_diff(F.col("m"), F.col("n")).alias("difference"))


@query(f"""WITH {CELLS_SQL} SELECT printf('u%d', vec_id) AS uri, round(0.5 * (vec_id % 4), 6) AS difference FROM c WHERE vec_id % 4 > 0""")
def world_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose transform was shifted between two trees."""
    source = linear(spark, sf_dir).select(F.format_string("u%d", "vec_id").alias("uri"), F.col("m").alias("transform"), "vec_id")
    moved = source.select("uri", F.transform("transform", lambda x, i: F.when(i == 12, x + 0.5 * (F.col("vec_id") % 4)).otherwise(x)).alias("transform"))
    return features.world_mismatch(source.drop("vec_id"), moved).withColumn("difference", F.round("difference", 6))


@query("SELECT vec_id, " + ", ".join(f"round(embedding[{a}]::DOUBLE - greatest(abs(embedding[{b}]::DOUBLE), 1e-6), 9) AS lo{k}" for k, (a, b) in enumerate([(1, 4), (2, 5), (3, 6)])) + " FROM embeddings")
def box_from_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners to a box and back: half sizes are 1e-6 at least."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    lo, hi = ([at(k) + s * F.abs(at(3 + k)) for k in range(3)] for s in (-1, 1))
    hull = M.box_aabb(M.aabb_box(lo, hi, 1e-6))
    return table(spark, sf_dir, "embeddings").select("vec_id", *(F.round(F.get(hull, F.lit(k)), 9).alias(f"lo{k}") for k in range(3)))


@query("SELECT c_custkey, round(sqrt(x * x + y * y + z * z) / 1000, 3) AS km, sqrt(x * x + y * y + z * z) BETWEEN 6.0e6 AND 7.0e6 AS earth_centred FROM (SELECT c_custkey, c_acctbal * 700 AS x, c_nationkey * 2.0e5 AS y, 6.0e6 AS z FROM customer)")
def earth_centred_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether points lie at an earth radius from the centre."""
    x, y, z = F.col("c_acctbal") * 700, F.col("c_nationkey") * 2.0e5, F.lit(6.0e6)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(F.sqrt(x * x + y * y + z * z) / 1000, 3).alias("km"), G.is_earth_centred(x, y, z).alias("earth_centred"))


@query("SELECT o_orderkey, CAST(8388608 + 3 * sum(CAST(floor(l_extendedprice) AS BIGINT)) + count(*) * 1000 + 2 * 5000 AS BIGINT) AS bytes FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.floor("l_extendedprice").cast("long")).alias("sizes"))
    return table(spark, sf_dir, "orders").join(sizes, "o_orderkey").select("o_orderkey", E.working_memory(F.col("sizes"), F.lit(1000).cast("long"), F.lit(5000).cast("long")).alias("bytes"))


@query("SELECT user_id, CAST(least(greatest(floor((user_id % 16 + 1) / least(greatest(event_id % 5, 1), 2)), 1), 4) AS INT) AS threads, event_id FROM events")
def encoder_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", E.encoder_threads((F.col("user_id") % 16 + 1), F.col("event_id") % 5).alias("threads"))


@query("SELECT p_partkey, CASE WHEN m = 'keep' OR (n AND m <> 'ktx2-uastc') OR t THEN NULL ELSE 'texture mode ''' || m || ''' unavailable' END AS fault FROM (SELECT p_partkey, ['keep', 'ktx2-etc1s', 'ktx2-uastc'][CAST(p_partkey % 3 AS INT) + 1] AS m, p_size % 2 = 0 AS n, p_size % 5 = 0 AS t FROM part)")
def texture_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.element_at(F.array(*map(F.lit, ("none", "etc1s", "uastc"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", features.texture_fault(mode, F.col("p_size") % 2 == 0, F.col("p_size") % 5 == 0).alias("fault"))


@query("SELECT p_partkey, sha256(p_name || CASE p_size % 2 WHEN 0 THEN 'ktx2' ELSE 'keep' END || CAST(p_size AS VARCHAR) || 'enc1.0') AS cache_key FROM part")
def texture_cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    mode = F.when(F.col("p_size") % 2 == 0, "ktx2").otherwise("keep")
    return table(spark, sf_dir, "part").select("p_partkey", features.cache_key(F.col("p_name").cast("binary"), mode, F.col("p_size"), "enc", "1.0").alias("cache_key"))


@query("SELECT c_custkey, coalesce(c_acctbal < 1073741824 - 1073740000, false) AS low FROM customer")
def low_disk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", features.low_disk(F.col("c_acctbal"), threshold=1824).alias("low"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')")
def tool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_type").alias("description"))
    return features.search(tools, "  RING ").select("p_partkey", F.col("title").alias("p_name"), F.col("description").alias("p_type"))


@query("SELECT count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT DISTINCT text, n_chars, lang FROM documents)")
def probed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one text, size and language are probed once."""
    files = table(spark, sf_dir, "documents").select(F.col("text").alias("path"), F.col("n_chars").alias("length"), F.col("lang").alias("modificationTime"))
    return features.probe_once(files).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("path")).alias("chars"))


@query("""SELECT conv_id, turn, CAST(sum(greatest(ceil(length(line) / 50.0), 1)) AS BIGINT) AS pieces FROM (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '\n$', ''), chr(10))) AS line FROM conversations) GROUP BY 1, 2""")
def bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations in pieces of 50 characters at most."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.sum(F.size(features.bounded_lines(F.col("text"), 50))).alias("pieces"))


@query("SELECT doc_id, CASE WHEN strlen(text) <= 40 THEN text ELSE right(text, len(list_filter(range(1, 42), lambda i: i <= length(text) AND strlen(right(text, i)) <= 40))::BIGINT) END AS tail FROM documents")
def byte_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 40 bytes of documents, from a whole code point on."""
    return table(spark, sf_dir, "documents").select("doc_id", T.byte_tail(F.col("text"), 40).alias("tail"))


@query("SELECT event_id, contains(props, '\"k\": 6') OR event_id % 10 = 3 AS retry FROM events")
def retry_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that one thread may avoid, by message or exit code."""
    message = F.when(F.contains("props", F.lit('"k": 6')), "converter returned no JSON for tile: x").otherwise("fine")
    return table(spark, sf_dir, "events").select("event_id", T.retry_single_threaded(message, F.when(F.col("event_id") % 10 == 3, -1073741819).otherwise(1)).alias("retry"))


@query("SELECT page_id, url || '_rerun_7' AS again, lower(trim(url)) = lower(trim(replace(url, 'example', 'EXAMPLE'))) AS same FROM pages WHERE NOT suffix(url, '/')")
def path_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.regexp_replace("url", "/$", "")
    return table(spark, sf_dir, "pages").filter(~F.col("url").endswith("/")).select("page_id", T.clone_output(u, F.lit("7")).alias("again"), T.same_path(F.concat(F.lit(" "), u, F.lit("/")), F.replace(u, F.lit("example"), F.lit("EXAMPLE"))).alias("same"))


@query("SELECT event_id, 'cpu_workers: ' || CASE WHEN event_id % 3 = 0 THEN 'auto → ' || c WHEN event_id % 3 = 1 THEN c || ' (explicit)' ELSE (c + 9) || ' (requested) → ' || c || ' (capped)' END || ', memory_budget: 512 MiB (default), io_workers: ' || (c + 1) || ' (explicit)' AS text FROM (SELECT event_id, event_id % 8 + 1 AS c FROM events)")
def execution_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = (F.col("event_id") % 8 + 1).cast("int"), F.col("event_id") % 3
    asked = F.when(k == 1, c).when(k == 2, c + 9)
    return table(spark, sf_dir, "events").select("event_id", T.describe_execution(asked, c, F.lit(None).cast("int"), F.lit(512), c + 1, c + 1).alias("text"))


@query("""WITH r AS (SELECT 'f' || (o_custkey % 50) AS path, o_orderkey AS id, o_custkey AS task, o_orderpriority AS kind, epoch(o_orderdate)::BIGINT AS t, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS s FROM orders)
 SELECT path, arg_min(id, (s, t, id)) AS id, arg_max(task, (s, t, id)) AS task_id, arg_max(kind, (s, t, id)) AS kind, min(t) AS created_at FROM r GROUP BY 1""")
def artifacts_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts registered again keep their id and first time."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("path"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("kind"), F.lit("l").alias("label"), F.unix_timestamp("o_orderdate").alias("created_at"))
    new = F.col("id") % 3 == 0
    return tasks.register_artifacts(rows.filter(~new), rows.filter(new)).drop("label")


@query("SELECT c_name AS name, c_custkey AS mtime FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 4 = 1 AND c_custkey > 0")
def stale_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose cached copy is missing (every fourth) or older."""
    c = table(spark, sf_dir, "customer")
    items = c.select(F.col("c_name").alias("name"), F.col("c_custkey").alias("mtime"))
    cache = c.filter("c_custkey % 4 <> 0").select(F.col("c_name").alias("name"), (F.col("c_custkey") - F.when(F.col("c_custkey") % 4 == 1, 1).otherwise(0)).alias("mtime"))
    return tasks.stale_cache(items, cache).select("name", "mtime")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('P', 'F')")
def pending_or_failed_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "failed").otherwise("succeeded")
    return tasks.pending_or_failed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", status.alias("status"))).drop("status")


@query("""SELECT c_custkey, 'Data/' || c_name AS a, CASE WHEN c_custkey % 2 = 0 THEN 'output must not overlap the input' END AS fault FROM customer""")
def overlap_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that lie in their input's folder."""
    a = F.concat(F.lit("Data/"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), features.overlap_fault(a, F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper(a), F.lit("/out"))).otherwise(F.lit("Other"))).alias("fault"))


@query("""SELECT c_custkey, CASE WHEN k = 0 AND c_nationkey % 2 = 0 THEN 'OBJ requires an explicit model.unit' WHEN k = 1 AND c_acctbal > 5000 THEN 'anchor longitudeDeg must be between -180 and 180' WHEN k = 2 THEN 'projected georeference requires sourceCrs' END AS fault FROM (SELECT *, c_custkey % 3 AS k FROM customer)""")
def model_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, even = F.col("c_custkey") % 3, F.col("c_nationkey") % 2 == 0
    lon = F.when(F.col("c_acctbal") > 5000, 200.0).otherwise(10.0)
    fault = features.model_fault(F.when(k == 0, "obj").otherwise("fbx"), F.when(even, "fromMetadata").otherwise("m"), F.lit("yUp"), F.when(k == 1, "anchor").when(k == 2, "projected").otherwise("none"), lon, F.lit(50.0), F.array(lon), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", fault.alias("fault"))


@query("""WITH r AS (SELECT vec_id, abs(embedding[1]::DOUBLE) + 0.001 AS r, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings) SELECT vec_id, round(x - r, 9) AS min_x, round(y - r, 9) AS min_y, round(z + r, 9) AS max_z FROM r""")
def sphere_root_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of root tiles that state a sphere."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    none = F.lit(None).cast("array<double>")
    roots = table(spark, sf_dir, "embeddings").select("vec_id", none.alias("box"), none.alias("region"), F.array(at(1), at(2), at(3), F.abs(at(0)) + 0.001).alias("sphere"), none.alias("transform"), F.lit(1.0).alias("ge"), F.lit(2.0).alias("doc_ge"))
    found = merge.root_bounds(roots)
    return found.select("vec_id", *(F.round(F.get("bounds", F.lit(i)), 9).alias(n) for i, n in ((0, "min_x"), (1, "min_y"), (5, "max_z"))))


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'x_bad' WHEN 1 THEN 'a_odd,x_bad' ELSE '' END AS missing FROM pages""")
def unsupported_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required extensions that are not allowed; the allowed ones come from a data file."""
    good = F.lit(validate.ALLOWED_REQUIRED[0])
    required = F.when(F.col("page_id") % 3 == 0, F.array(good, F.lit("x_bad"))).when(F.col("page_id") % 3 == 1, F.array(F.lit("x_bad"), F.lit("a_odd"))).otherwise(F.array(good))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(validate.unsupported(required), ",").alias("missing"))


@query("SELECT doc_id, substr(text, 3, 5) AS part FROM documents WHERE length(text) >= 7 AND strlen(text) = length(text)")
def byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 2 to 6 of documents of one-byte letters."""
    docs = table(spark, sf_dir, "documents").filter((F.octet_length("text") == F.length("text")) & (F.length("text") >= 7))
    return docs.select("doc_id", scan.byte_range(F.col("text").cast("binary"), F.lit(2), F.lit(6)).cast("string").alias("part"))
