"""Task stores and event logs: folds, queues, upserts, tails, throttles.

An event log folds per task by aggregates over (seq, value) structs, so partial aggregation works and no task's events have
to meet in sorted order. Where the order of emitted rows matters (the throttle), each task's events are walked once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.running import running

#: Milliseconds between emitted progress events.
THROTTLE_MS = 400
LOG_BYTES, TAIL_LINES, TAIL_LINES_MOST, STDERR_LINES, STDERR_BYTES = 200_000, 500, 5000, 100, 64 * 1024
#: States and the states each may lead to.
NEXT_STATES = {"queued": ("running", "cancelled", "interrupted"), "running": ("succeeded", "failed", "cancelling", "interrupted"), "cancelling": ("cancelled", "failed", "succeeded", "interrupted")}


def latest(when: Column, value: Column, seq: str = "seq") -> Column:
    """The value of the last event for which ``when`` holds."""
    return F.max_by(value, F.when(when & value.isNotNull(), F.col(seq)))


def first(when: Column, value: Column, seq: str = "seq") -> Column:
    return F.min_by(value, F.when(when & value.isNotNull(), F.col(seq)))


def shown_stage(stage: Column) -> Column:
    """The stage as a task shows it."""
    return F.when(stage.startswith("rebuild"), "rebuild").when(stage == "validate", "check").otherwise(stage)


def fold(events: DataFrame, task: str = "task_id") -> DataFrame:
    """One row per task: the last stage, merged progress, the first error that is no cancellation, the last error, the last result, and counts.

    events: task_id, seq, type, stage, message, completed, total, code, path. Missing parts of an event change nothing.
    """
    c, kind = F.col, F.col("type")
    stage = F.nullif(c("stage"), F.lit(""))
    is_stage, is_progress, is_error = kind == "stage", kind == "progress", kind == "error"
    return events.groupBy(task).agg(
        shown_stage(latest(is_stage, stage)).alias("stage"),
        latest(is_stage | is_progress, c("stage")).alias("progress_stage"),
        latest(is_stage, F.nullif(c("message"), F.lit(""))).alias("progress_message"),
        latest(is_progress, c("completed")).alias("completed"),
        latest(is_progress, c("total")).alias("total"),
        first(is_error & (F.coalesce(c("code"), F.lit("ERROR")) != "CANCELLED"), F.coalesce(c("message"), F.lit(""))).alias("error"),
        latest(is_error, F.coalesce(c("code"), F.lit("ERROR"))).alias("error_code"),
        latest(kind == "result", c("path")).alias("result_path"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(kind == "warning").alias("n_warnings"),
    )


def log_line() -> Column:
    """The line that an event adds to its task's log; null for those that add none."""
    c, kind = F.col, F.col("type")
    said = F.coalesce(c("message"), F.lit(""))
    tagged = lambda name, default: F.concat(F.lit(f"[{name}:"), F.coalesce(c("code"), F.lit(default)), F.lit("] "), said)
    return (
        F.when(kind == "stage", F.when(said != "", F.concat(F.lit("["), F.coalesce(c("stage"), F.lit("")), F.lit("] "), said)))
        .when(kind == "log", c("message"))
        .when(kind == "warning", tagged("warning", "WARN"))
        .when(kind == "error", tagged("error", "ERROR"))
        .when(kind == "result", F.concat(F.lit("[result] "), c("path")))
    )


def upsert(current: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; of equals, a change wins over what is there. One aggregate over whole rows."""
    rows = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rest = [c for c in current.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.max(F.struct(*order, "__new", *rest)).alias("r"))
    return best.select(*key, *(F.col(f"r.{c}").alias(c) for c in order + rest)).select(*current.columns)


def register_artifacts(current: DataFrame, added: DataFrame) -> DataFrame:
    """Artifacts once per path. Again registered, a path keeps its id and first time; task, kind and label change where the new ones say something."""
    rows = current.withColumn("__seq", F.lit(0)).unionByName(added.withColumn("__seq", F.lit(1)))
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    last = lambda v: F.max_by(v, F.when(v.isNotNull(), F.struct("__seq", "created_at", "id")))
    return rows.groupBy("path").agg(F.min_by("id", F.struct("__seq", "created_at", "id")).alias("id"), last(F.col("task_id")).alias("task_id"), last(said("kind")).alias("kind"), last(said("label")).alias("label"), F.min("created_at").alias("created_at")).select(*current.columns)


def mark_interrupted(tasks: DataFrame, now: Column) -> DataFrame:
    """After a restart: what was running, cancelling or queued is interrupted."""
    stale = F.col("status").isin("running", "cancelling", "queued")
    return tasks.withColumns(
        {
            "stage": F.when(stale, F.coalesce(F.nullif(F.col("stage"), F.lit("")), F.lit("interrupted"))).otherwise(F.col("stage")),
            "updated_at": F.when(stale, now).otherwise(F.col("updated_at")),
            "finished_at": F.when(stale, F.coalesce(F.col("finished_at"), now)).otherwise(F.col("finished_at")),
            "cancel_requested": F.when(stale, False).otherwise(F.col("cancel_requested")),
            "status": F.when(stale, "interrupted").otherwise(F.col("status")),
        }
    )


def request_cancel(tasks: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """Cancel the asked-for tasks: queued ones at once, running ones go to cancelling, others stay."""
    hit = tasks.join(asked.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    queued, running = F.col("__hit") & (F.col("status") == "queued"), F.col("__hit") & (F.col("status") == "running")
    either = F.coalesce(queued | running, F.lit(False))
    return hit.withColumns(
        {
            "stage": F.when(queued, "cancelled").otherwise(F.col("stage")),
            "finished_at": F.when(queued, now).otherwise(F.col("finished_at")),
            "cancel_requested": either | F.col("cancel_requested"),
            "status": F.when(queued, "cancelled").when(running, "cancelling").otherwise(F.col("status")),
        }
    ).select(*tasks.columns)


def next_queued(tasks: DataFrame) -> DataFrame:
    """The oldest queued task that nobody cancelled."""
    return tasks.filter((F.col("status") == "queued") & ~F.col("cancel_requested")).orderBy("created_at", "id").limit(1)


def tail(lines: DataFrame, n: int = TAIL_LINES) -> DataFrame:
    """The last lines by ``line_no``; 0 asks for the usual number, and 5,000 is the most."""
    return lines.orderBy(F.desc("line_no")).limit(TAIL_LINES if n == 0 else min(n, TAIL_LINES_MOST))


def budget_tail(lines: DataFrame, key: str, order: str, size: Column, most_lines: int = STDERR_LINES, most_bytes: int = STDERR_BYTES) -> DataFrame:
    """Per key the longest run of last lines within both limits; a line costs its size and one more. A key's lines are the work of many tasks."""
    upto = running(lines, [key], [F.desc(order)], {"from_end": F.lit(1), "bytes_from_end": size + 1})
    return upto.filter((F.col("from_end") <= most_lines) & (F.col("bytes_from_end") <= most_bytes))


def evict(entries: DataFrame, capacity: int, key: str, mtime: str, size: str) -> DataFrame:
    """Which cache entries stay: the oldest go until the rest fits. ``kept`` and the sum from the newest down to this one."""
    upto = running(entries, [], [F.desc(mtime), F.desc(key)], {"bytes_upto": F.col(size)})
    return upto.withColumn("kept", F.col("bytes_upto") <= capacity)


def transitions(states: DataFrame, task: str = "task_id", seq: str = "seq") -> DataFrame:
    """Each change of a task's status, and whether it is allowed."""
    before = F.lag("status").over(Window.partitionBy(task).orderBy(seq))
    ok = F.lit(False)
    for a, bs in NEXT_STATES.items():
        ok = ok | ((F.col("from_status") == a) & F.col("status").isin(*bs))
    return states.withColumn("from_status", before).filter("from_status IS NOT NULL AND from_status <> status").select(task, seq, "from_status", F.col("status").alias("to_status"), ok.alias("allowed"))


def throttle(progress: DataFrame, task: str = "task_id", ms: int = THROTTLE_MS) -> DataFrame:
    """Progress events that are emitted: changed against the last emitted one, and ``ms`` after it. The reference is the last *emitted* event, so a task's events are walked once, in batches that carry the state.

    progress: task_id long, seq long, at_ms long, completed long, total long. The first event is always emitted.
    """
    ordered = progress.select(F.col(task).cast("long").alias(task), "seq", "at_ms", "completed", "total").repartition(F.col(task)).sortWithinPartitions(task, "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, last = None, 0, (None, None)
        for batch in batches:
            keep = []
            for t, ms_at, done, total in batch[[task, "at_ms", "completed", "total"]].itertuples(index=False):
                if t != now or ((done, total) != last and ms_at - at >= ms):
                    now, at, last = t, ms_at, (done, total)
                    keep.append(True)
                else:
                    keep.append(False)
            yield batch[keep]

    return ordered.mapInPandas(run, f"{task} long, seq long, at_ms long, completed long, total long")


def reusable(units: DataFrame, fingerprint: Column, params: Column) -> Column:
    """Whether a work unit may be used again: succeeded, and equal to whichever expectation is not null."""
    same = lambda want, got: want.isNull() | F.coalesce(want == got, F.lit(False))
    return (units["status"] == "succeeded") & same(fingerprint, units["input_fingerprint"]) & same(params, units["param_hash"])


def pending_or_failed(units: DataFrame) -> DataFrame:
    return units.filter(F.col("status").isin("pending", "failed"))


def fingerprint(length: Column, mtime: Column) -> Column:
    """A fingerprint of a file's size and time."""
    return F.hex(F.xxhash64(length, mtime))


def stale_cache(items: DataFrame, cache: DataFrame, key: str = "name") -> DataFrame:
    """Items whose cached copy is missing or older than they are."""
    known = cache.select(key, F.col("mtime").alias("cached_mtime"))
    return items.join(known, key, "left").filter(F.col("cached_mtime").isNull() | (F.col("cached_mtime") < F.col("mtime")))


def render_metrics(frames: DataFrame, at: str = "ts") -> DataFrame:
    """Per second: frames, proxies and originals shown, distinct levels."""
    second = F.date_trunc("second", F.col(at)).alias("second")
    return frames.groupBy(second).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "proxy").alias("n_proxy"), F.count_if(F.col("kind") != "proxy").alias("n_original"), F.count_distinct("level").alias("n_levels"))
