"""Queries on task stores and event logs. Events of a user are a task's log (seq by time and id); orders are tasks, their date the time of creation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.operators import tasks
from quadrille.plans.registry import query
from quadrille.sources.tables import table

KINDS = ("stage", "progress", "log", "warning", "error", "result")
STAGES = ("scan", "convert", "rebuild-l1", "validate")
EVENTS_SQL = """e AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, ['stage', 'progress', 'log', 'warning', 'error', 'result'][CAST(event_id % 6 AS INT) + 1] AS type,
 ['scan', 'convert', 'rebuild-l1', 'validate'][CAST(event_id // 6 % 4 AS INT) + 1] AS stage, event_type || event_id AS message, CAST(floor(value) AS BIGINT) AS completed, CASE WHEN event_id % 5 = 0 THEN 'CANCELLED' END AS code FROM events)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a task log."""
    i = F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("task_id"), seq.alias("seq"), "event_id", "ts", F.get(F.array(*map(F.lit, KINDS)), (i % 6).cast("int")).alias("type"), F.get(F.array(*map(F.lit, STAGES)), (F.floor(i / 6) % 4).cast("int")).alias("stage"),
        F.concat("event_type", i.cast("string")).alias("message"), F.floor("value").alias("completed"), F.lit(100).cast("long").alias("total"), F.when(i % 5 == 0, "CANCELLED").alias("code"), F.concat(F.lit("/out/"), i.cast("string")).alias("path"),
    )


@query(f"""WITH {EVENTS_SQL} SELECT task_id, max_by(CASE WHEN stage LIKE 'rebuild%' THEN 'rebuild' WHEN stage = 'validate' THEN 'check' ELSE stage END, seq) FILTER (WHERE type = 'stage') AS stage, max_by(stage, seq) FILTER (WHERE type IN ('stage', 'progress')) AS progress_stage,
 max_by(message, seq) FILTER (WHERE type = 'stage') AS progress_message, max_by(completed, seq) FILTER (WHERE type = 'progress') AS completed, max_by(100::BIGINT, seq) FILTER (WHERE type = 'progress') AS total, min_by(message, seq) FILTER (WHERE type = 'error' AND code IS NULL) AS error,
 max_by(coalesce(code, 'ERROR'), seq) FILTER (WHERE type = 'error') AS error_code, max_by('/out/' || event_id, seq) FILTER (WHERE type = 'result') AS result_path, count(*) AS n_events, count(*) FILTER (WHERE type = 'warning') AS n_warnings FROM e GROUP BY 1""")  # fmt: skip
def event_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.fold(log(spark, sf_dir))


@query(f"WITH {EVENTS_SQL} SELECT task_id, min_by(message, seq) AS error, min(seq) AS seq FROM e WHERE type = 'error' AND code IS NULL GROUP BY 1")
def event_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = log(spark, sf_dir).filter("type = 'error' AND code IS NULL")
    return found.groupBy("task_id").agg(F.min_by("message", "seq").alias("error"), F.min("seq").alias("seq"))


@query("SELECT event_id AS line_no, event_type AS line FROM events ORDER BY event_id DESC LIMIT 500")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 500 lines: a limit is what a tail is."""
    return tasks.tail(table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.col("event_type").alias("line")), 0)


THROTTLE_MS = 3_600_000


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) // 1000 AS at_ms, CAST(floor(value) AS BIGINT) AS completed FROM events),
 w AS (SELECT task_id, seq, at_ms, completed, true AS emit, at_ms AS last_ms, completed AS last FROM e WHERE seq = 1 UNION ALL
 SELECT e.task_id, e.seq, e.at_ms, e.completed, e.completed <> w.last AND e.at_ms - w.last_ms >= {THROTTLE_MS}, CASE WHEN e.completed <> w.last AND e.at_ms - w.last_ms >= {THROTTLE_MS} THEN e.at_ms ELSE w.last_ms END, CASE WHEN e.completed <> w.last AND e.at_ms - w.last_ms >= {THROTTLE_MS} THEN e.completed ELSE w.last END
 FROM w JOIN e ON e.task_id = w.task_id AND e.seq = w.seq + 1) SELECT task_id, seq, at_ms, completed, 100::BIGINT AS total FROM w WHERE emit""")  # fmt: skip
def progress_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress at most once an hour per task (the sample's events are minutes apart)."""
    rows = log(spark, sf_dir).select("task_id", "seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "completed", "total")
    return tasks.throttle(rows, ms=THROTTLE_MS)


STATE_SQL = "['queued', 'running', 'cancelling', 'succeeded', 'failed'][CAST(event_id % 5 AS INT) + 1]"
STATES = ("queued", "running", "cancelling", "succeeded", "failed")


@query(f"""WITH s AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {STATE_SQL} AS status FROM events), l AS (SELECT *, lag(status) OVER (PARTITION BY task_id ORDER BY seq) AS b FROM s)
 SELECT task_id, seq, b AS from_status, status AS to_status, (b = 'queued' AND status IN ('running', 'cancelled', 'interrupted')) OR (b = 'running' AND status IN ('succeeded', 'failed', 'cancelling', 'interrupted')) OR (b = 'cancelling' AND status IN ('cancelled', 'failed', 'succeeded', 'interrupted')) AS allowed FROM l WHERE b IS NOT NULL AND b <> status""")  # fmt: skip
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = log(spark, sf_dir).select("task_id", "seq", F.get(F.array(*map(F.lit, STATES)), (F.col("event_id") % 5).cast("int")).alias("status"))
    return tasks.transitions(states)


STATUS = {"O": "queued", "F": "succeeded", "P": "running"}
TASKS_SQL = "t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'succeeded' ELSE 'running' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS stage, o_orderdate AS created_at, o_orderdate AS updated_at, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate END AS finished_at, o_custkey % 5 = 0 AS cancel_requested FROM orders)"


def task_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("id"), F.when(c("o_orderstatus") == "O", "queued").when(c("o_orderstatus") == "F", "succeeded").otherwise("running").alias("status"), F.when(c("o_orderkey") % 3 == 0, "").otherwise(c("o_orderpriority")).alias("stage"),
        c("o_orderdate").alias("created_at"), c("o_orderdate").alias("updated_at"), F.when(c("o_orderkey") % 4 == 0, c("o_orderdate")).alias("finished_at"), (c("o_custkey") % 5 == 0).alias("cancel_requested"),
    )


@query(f"WITH {TASKS_SQL} SELECT id, created_at FROM t WHERE status = 'queued' AND NOT cancel_requested ORDER BY created_at, id LIMIT 1")
def next_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.next_queued(task_table(spark, sf_dir)).select("id", "created_at")


@query(f"WITH {TASKS_SQL} SELECT id, created_at FROM t WHERE status = 'running'")
def list_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_table(spark, sf_dir).filter("status = 'running'").select("id", "created_at")


NOW = "2030-01-01 00:00:00"


@query(f"""WITH {TASKS_SQL}, s AS (SELECT *, status IN ('running', 'cancelling', 'queued') AS stale FROM t) SELECT id, CASE WHEN stale THEN 'interrupted' ELSE status END AS status, CASE WHEN stale THEN coalesce(nullif(stage, ''), 'interrupted') ELSE stage END AS stage,
 CASE WHEN stale THEN coalesce(finished_at, TIMESTAMP '{NOW}') ELSE finished_at END AS finished_at, NOT stale AND cancel_requested AS cancel_requested FROM s""")  # fmt: skip
def mark_interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.mark_interrupted(task_table(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("id", "status", "stage", "finished_at", "cancel_requested")


@query("""WITH a AS (SELECT o_custkey AS id, o_orderdate AS updated_at, 0 AS fresh, o_orderkey AS v FROM orders UNION ALL SELECT user_id, ts, 1, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, fresh DESC, v DESC) AS k FROM a)
 SELECT id, updated_at, v FROM r WHERE k = 1""")  # fmt: skip
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, overwritten by newer events of the user of that number."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderkey").alias("v"))
    new = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("updated_at"), F.col("event_id").alias("v"))
    return tasks.upsert(old, new, ["id"], ["updated_at"])


@query("""SELECT doc_id, kept, CAST(upto AS BIGINT) AS bytes_upto FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id % 977 DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS upto, sum(length(text)) OVER (ORDER BY doc_id % 977 DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) <= 1000000 AS kept FROM documents)""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as cache entries, the newest kept up to a million characters."""
    entries = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 977).alias("mtime"), F.length("text").alias("size"))
    return tasks.evict(entries, 1_000_000, "doc_id", "mtime", "size").select("doc_id", "kept", "bytes_upto")


@query("""SELECT source, doc_id, CAST(b AS BIGINT) AS bytes_from_end FROM (SELECT source, doc_id, row_number() OVER w AS k, sum(length(text) + 1) OVER w AS b FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE k <= 100 AND b <= 65536""")
def tail_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last documents of each source within 100 and 64 KiB."""
    return tasks.budget_tail(table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("size")), "source", "doc_id", F.col("size")).select("source", "doc_id", "bytes_from_end")


@query("SELECT o_orderkey AS id, o_orderstatus = 'F' AND (o_custkey % 3 = 0 OR (o_orderpriority IS NOT NULL AND o_orderpriority = '1-URGENT')) AS reusable FROM orders")
def work_unit_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as work units: those of every third customer ask for no fingerprint."""
    units = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("pending").alias("status"), F.col("o_orderpriority").alias("input_fingerprint"), F.lit("p").alias("param_hash"))
    want = F.when(F.col("o_custkey") % 3 != 0, "1-URGENT")
    return units.select("id", tasks.reusable(units, want, F.lit("p")).alias("reusable"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def resume_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT date_trunc('second', ts) AS second, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS n_proxy, count(*) FILTER (WHERE event_type <> 'click') AS n_original, count(DISTINCT user_id % 8) AS n_levels FROM events GROUP BY 1")
def render_metrics_1s(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select("ts", F.when(F.col("event_type") == "click", "proxy").otherwise("original").alias("kind"), (F.col("user_id") % 8).alias("level"))
    return tasks.render_metrics(frames).withColumn("second", F.col("second").cast("timestamp_ntz"))
