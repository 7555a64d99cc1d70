"""Queries on names, references, messages and options. ``pages.url`` are references, ``pages.html`` is markup, ``events.props`` are options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import text as T
from quadrille.operators import dedup
from quadrille.plans.registry import query
from quadrille.sources import scan
from quadrille.sources.tables import table

#: Messages that orders stand for, by key; made for these queries.
MESSAGES = (
    "Input does not exist: x", "output already exists", "permission denied (os error 5)", "output must not be inside INPUT", "model.format is wrong", "only .fbx and .obj files", "unsupported OSGB origin override",
    "invalid OSGB ENU", "projected model georeference", "convert exited with 3: metadata.xml", "no SRS found", "rebuild stopped", "texture too large", "tileset is broken", "no space left", "something else",
)
MESSAGES_SQL = "[" + ", ".join(f"'{m}'" for m in MESSAGES) + "]"


def code_sql() -> str:
    """The classification as SQL, from the same fixed values."""
    like = lambda p: f"contains(m, '{p}')"
    rules = [" OR ".join("(" + " AND ".join(map(like, p if isinstance(p, tuple) else (p,))) + ")" for p in rule) for _, rule in T.ERROR_CODES]
    return "CASE " + " ".join(f"WHEN {r} THEN '{code}'" for r, (code, _) in zip(rules, T.ERROR_CODES, strict=True)) + " ELSE 'TASK_FAILED' END"


@query(f"SELECT o_orderkey, {code_sql()} AS code FROM (SELECT o_orderkey, lower({MESSAGES_SQL}[o_orderkey % {len(MESSAGES)} + 1]) AS m FROM orders)")
def error_code_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("o_orderkey") % len(MESSAGES)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.error_code(message).alias("code"))


MODES = (" KTX2 ", "etc1s", "UASTC", "ktx2-uastc", "none", "", "keep", "passthrough", "webp")


@query("SELECT p_partkey, CASE WHEN m IN ('keep', 'none', '', 'passthrough') THEN 'keep' WHEN m IN ('ktx2', 'ktx2-etc1s', 'etc1s') THEN 'ktx2-etc1s' WHEN m IN ('ktx2-uastc', 'uastc') THEN 'ktx2-uastc' ELSE m END AS mode FROM (SELECT p_partkey, trim(lower(coalesce([" + ", ".join(f"'{m}'" for m in MODES) + "][CAST(p_partkey % 10 AS INT) + 1], 'keep'))) AS m FROM part)")
def mode_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.texture_mode(F.get(F.array(*map(F.lit, MODES)), (F.col("p_partkey") % 10).cast("int"))).alias("mode"))


@query("SELECT p_partkey, coalesce(e, CASE q WHEN 'quality' THEN 8000 WHEN 'speed' THEN 2000 WHEN '' THEN NULL ELSE 4000 END) AS l1, CASE q WHEN 'quality' THEN 4000 WHEN 'speed' THEN 1000 WHEN '' THEN NULL ELSE 2000 END AS l2 FROM (SELECT p_partkey, ['quality', 'speed', 'balanced', '', 'other'][CAST(p_partkey % 5 AS INT) + 1] AS q, CASE WHEN p_size > 45 THEN p_size END AS e FROM part)")
def quality_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.get(F.array(*map(F.lit, ("Quality", "SPEED", "balanced", "", "other"))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.preset_budget(q, 1, F.when(F.col("p_size") > 45, F.col("p_size"))).alias("l1"), T.preset_budget(q, 2).alias("l2"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(replace(u, '\', '/'), '^(\./)+', ''), '^/+', '') AS uri FROM (SELECT page_id, ['./', '././', '/', '.\', ''][CAST(page_id % 5 AS INT) + 1] || url AS u FROM pages)")
def uri_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.get(F.array(*map(F.lit, ("./", "././", "/", ".\\", ""))), (F.col("page_id") % 5).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", T.normalise_uri(F.concat(head, "url")).alias("uri"))


@query(r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean, regexp_matches(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?//') OR starts_with(lower(url), 'data:') AS remote, p <> '' AND NOT regexp_matches(p, '[?#\\:%]') AND NOT starts_with(p, '/') AND NOT regexp_matches(p, '(^|/)\.\.(/|$)') AS plain FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN replace(replace(url, 'https://', ''), 'http://', '') ELSE '../x' END AS p FROM pages)")
def uri_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("page_id") % 2 == 0, F.replace(F.replace(F.col("url"), F.lit("https://"), F.lit("")), F.lit("http://"), F.lit(""))).otherwise("../x")
    return table(spark, sf_dir, "pages").select("page_id", T.clean_uri(F.col("url")).alias("clean"), T.is_remote(F.col("url")).alias("remote"), T.plain_relative(path).alias("plain"))


@query(r"SELECT s_suppkey, CAST(nullif(regexp_extract(u, '(?i)Tile_\+?(-?\d+)_\+?(-?\d+)', 1), '') AS INT) AS gx, CAST(nullif(regexp_extract(u, '(?i)Tile_\+?(-?\d+)_\+?(-?\d+)', 2), '') AS INT) AS gy FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'other' ELSE './Data/tile_+00' || (s_suppkey % 16) || '_-0' || (s_suppkey // 16) || '/tileset.json' END AS u FROM supplier)")
def tile_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    u = F.when(k % 9 == 0, "other").otherwise(F.concat(F.lit("./Data/tile_+00"), (k % 16).cast("string"), F.lit("_-0"), F.floor(k / 16).cast("string"), F.lit("/tileset.json")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.tile_x(u).alias("gx"), T.tile_y(u).alias("gy"))


SRS_SQL = "CASE CAST(c_custkey % 6 AS INT) WHEN 0 THEN 'ENU: ' || (c_custkey % 120 - 10) || ', -' || (c_custkey % 200) || '.5' WHEN 1 THEN 'epsg:' || (4320 + c_custkey % 12) WHEN 2 THEN 'PROJCS[\"x\"]' WHEN 3 THEN NULL WHEN 4 THEN '  ' ELSE 'local' END"


def srs() -> F.Column:
    """References that customers stand for, by key."""
    k = F.col("c_custkey")
    enu = F.concat(F.lit("ENU: "), (k % 120 - 10).cast("string"), F.lit(", -"), (k % 200).cast("string"), F.lit(".5"))
    return F.when(k % 6 == 0, enu).when(k % 6 == 1, F.concat(F.lit("epsg:"), (4320 + k % 12).cast("string"))).when(k % 6 == 2, 'PROJCS["x"]').when(k % 6 == 3, F.lit(None)).when(k % 6 == 4, "  ").otherwise("local")


@query(f"""SELECT c_custkey, CASE WHEN k = 0 AND abs(c_custkey % 120 - 10) <= 90 AND c_custkey % 200 + 0.5 <= 180 THEN CAST(c_custkey % 120 - 10 AS DOUBLE) END AS lat, CASE WHEN k = 0 AND abs(c_custkey % 120 - 10) <= 90 AND c_custkey % 200 + 0.5 <= 180 THEN CAST(-(c_custkey % 200) - 0.5 AS DOUBLE) END AS lon,
 CASE WHEN k = 1 THEN 4320 + c_custkey % 12 END AS epsg, CASE k WHEN 0 THEN 'enu-metres' WHEN 1 THEN CASE WHEN 4320 + c_custkey % 12 = 4326 THEN 'epsg-degrees' ELSE 'epsg-metres' END WHEN 2 THEN 'wkt' WHEN 3 THEN 'missing' ELSE 'custom' END AS kind FROM (SELECT c_custkey, c_custkey % 6 AS k, {SRS_SQL} AS s FROM customer)""")  # fmt: skip
def crs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return table(spark, sf_dir, "customer").select("c_custkey", srs().alias("s")).select("c_custkey", T.enu_lat(s).alias("lat"), T.enu_lon(s).alias("lon"), T.epsg(s).alias("epsg"), T.crs_class(s).alias("kind"))


@query(f"SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_nationkey % 3 = 0 THEN ' EPSG:4547 ' WHEN c_nationkey % 3 = 1 THEN ' ' END), ''), nullif(trim({SRS_SQL}), '')) AS crs FROM customer")
def effective_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.when(F.col("c_nationkey") % 3 == 0, " EPSG:4547 ").when(F.col("c_nationkey") % 3 == 1, " ")
    return table(spark, sf_dir, "customer").select("c_custkey", T.effective_crs(asked, srs()).alias("crs"))


@query("SELECT page_id, nullif(trim(regexp_extract(html, '(?s)<title(?:\\s[^>]*)?>(.*?)</title\\s*>', 1)), '') AS title, nullif(trim(regexp_extract(html, '(?s)<h1(?:\\s[^>]*)?>(.*?)</h1\\s*>', 1)), '') AS heading FROM pages")
def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.tag_value(F.col("html"), "title").alias("title"), T.tag_value(F.col("html"), "h1").alias("heading"))


@query()
def markup_well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page would pass as XML; no SQL has an XML parser here, so tests check it."""
    return table(spark, sf_dir, "pages").select("page_id", scan.xml_error(F.col("html")).isNull().alias("well_formed"))


@query("SELECT event_id, CAST(coalesce(CASE WHEN event_id % 2 = 0 THEN json_extract(props, '$.k') END, CASE WHEN event_id % 3 = 0 THEN 7 END, 4) AS INT) AS cpu_workers FROM events")
def json_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An explicit option wins over the older name, and that over the default."""
    explicit = F.when(F.col("event_id") % 2 == 0, F.try_variant_get(F.parse_json("props"), "$.k", "int"))
    legacy = F.when(F.col("event_id") % 3 == 0, 7)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(explicit, legacy, F.lit(4)).alias("cpu_workers"))


@query("SELECT count(*) AS n_input, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_removed, CAST(sum(length(text)) AS BIGINT) AS bytes_before, (SELECT CAST(sum(length(t)) AS BIGINT) FROM (SELECT DISTINCT text AS t FROM documents)) AS bytes_after FROM documents")
def hash_dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents by SHA-256; sizes are in characters, which both engines count alike."""
    docs = table(spark, sf_dir, "documents")
    return dedup.dedup_stats(docs, dedup.content_hash(F.col("text")), F.length("text"))


@query("SELECT source, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS bytes FROM documents GROUP BY ROLLUP (source)")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and size per folder, and in all."""
    return table(spark, sf_dir, "documents").rollup("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.length("text")).alias("bytes"))


@query("SELECT CAST(sum(length(text)) AS BIGINT) AS bytes FROM documents")
def directory_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.directory_bytes(table(spark, sf_dir, "documents").select(F.length("text").alias("length")))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'default' ELSE printf('mat%d:%.3f,%.3f,%.3f,%.3f', p_size, 0.5, 0.25, 1.0, 1.0) END || CASE WHEN p_size % 3 = 0 THEN '#tex:' || substr(md5(p_name), 1, 16) ELSE '' END AS key, CAST(CASE WHEN p_size % 4 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS red FROM part")
def material_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = F.when(F.col("p_size") % 4 != 0, F.col("p_size"))
    key = T.material_key(index, F.array(*map(F.lit, (0.5, 0.25, 1.0, 1.0))), F.when(F.col("p_size") % 3 == 0, F.md5(F.col("p_name").cast("binary"))))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("key")).withColumn("red", F.get(T.material_colour(F.col("key")), 0))


@query("SELECT event_id, CASE WHEN t > 0 THEN CAST(least(greatest(floor(c * 100.0 / t + 0.5), 0), 100) AS INT) END AS percent FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS c, event_id % 50 AS t FROM events)")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.percent(F.floor("value"), F.col("event_id") % 50).alias("percent"))
