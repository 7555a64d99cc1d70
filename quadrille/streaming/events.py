"""Task event logs as streams: JSON lines in, a task row per batch out, and the progress throttle with state per task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quadrille.operators.tasks import THROTTLE_MS, shown_stage

#: A line of the log; unknown fields are left out.
EVENT = "schemaVersion int, taskId string, seq long, type string, stage string, message string, completed long, total long, parallelism int, resourceWait boolean, code string, name string, path string"
FOLD = "task_id string, stage string, progress_stage string, progress_message string, completed long, total long, error string, error_code string, result_path string, n_events long, n_warnings long"
#: Parts of a task's row that events set, each with the seq of the event that did.
PARTS = {"stage": "string", "progress_stage": "string", "message": "string", "completed": "long", "total": "long", "error": "string", "code": "string", "path": "string"}
STATE = ", ".join(f"{p} {kind}, {p}_seq long" for p, kind in PARTS.items()) + ", n long, warnings long, ended boolean"
STATE_NAMES, FOLD_NAMES = ([c.split()[0] for c in schema.split(", ")] for schema in (STATE, FOLD))
START = (*[None] * (2 * len(PARTS)), 0, 0, False)


def lines(spark: SparkSession, path: str, most_files: int = 100) -> DataFrame:
    """A stream of the log lines that arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", most_files).text(path)


def parsed(lines_: DataFrame) -> DataFrame:
    """Events of JSON lines; lines that are no event of version 1 (or without version) are left out."""
    e = lines_.select(F.from_json("value", EVENT).alias("e")).select("e.*")
    return e.filter("taskId IS NOT NULL AND type IS NOT NULL AND (schemaVersion IS NULL OR schemaVersion = 1)").withColumnRenamed("taskId", "task_id")


def folded(events: DataFrame, grace_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """The task's row after each batch, as the batch fold gives it: each part is kept with the seq that it is from, so events may come late and in any order.

    With the two times, state goes ``grace_ms`` after a task's result, or ``idle_ms`` after its last event; what comes later
    starts anew. Such a stream runs batches without data too, so it ends only when it is stopped. Without them state stays.
    """
    timed = grace_ms is not None and idle_ms is not None

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        s = dict(zip(STATE_NAMES, state.get if state.exists else START, strict=True))

        def last(part: str, seq: int, value: object) -> None:
            """A later event's value wins; one that has none changes nothing."""
            if value is not None and (s[f"{part}_seq"] is None or seq >= s[f"{part}_seq"]):
                s[part], s[f"{part}_seq"] = value, seq

        text = lambda v: v if isinstance(v, str) else None
        number = lambda v: None if pd.isna(v) else int(v)
        for batch in batches:
            for r in batch.itertuples(index=False):
                seq = int(r.seq)
                s["n"] += 1
                if r.type == "stage":
                    last("stage", seq, text(r.stage) or None)
                    last("progress_stage", seq, text(r.stage))
                    last("message", seq, text(r.message) or None)
                elif r.type == "progress":
                    last("progress_stage", seq, text(r.stage))
                    last("completed", seq, number(r.completed))
                    last("total", seq, number(r.total))
                elif r.type == "error":
                    code = text(r.code) or "ERROR"
                    last("code", seq, code)
                    if code != "CANCELLED" and (s["error_seq"] is None or seq < s["error_seq"]):
                        s["error"], s["error_seq"] = text(r.message) or "", seq
                elif r.type == "result":
                    last("path", seq, text(r.path))
                    s["ended"] = True
                elif r.type == "warning":
                    s["warnings"] += 1
        state.update(tuple(s[n] for n in STATE_NAMES))
        if timed:
            state.setTimeoutDuration(grace_ms if s["ended"] else idle_ms)
        yield pd.DataFrame([(key[0], s["stage"], s["progress_stage"], s["message"], s["completed"], s["total"], s["error"], s["code"], s["path"], s["n"], s["warnings"])], columns=FOLD_NAMES)

    out = events.groupBy("task_id").applyInPandasWithState(run, FOLD, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if timed else GroupStateTimeout.NoTimeout)
    return out.withColumn("stage", shown_stage(F.col("stage")))


def throttled(progress: DataFrame, ms: int = THROTTLE_MS, idle_ms: int | None = None) -> DataFrame:
    """Progress events (task_id, seq, at_ms, completed, total) that are emitted: changed, and ``ms`` after the last emitted one of the task. With ``idle_ms``, state goes that long after a task's last event."""
    schema = "task_id string, seq long, at_ms long, completed long, total long"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, done, total = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        keep = []
        for r in rows.itertuples(index=False):
            emit = at is None or ((r.completed, r.total) != (done, total) and r.at_ms - at >= ms)
            if emit:
                at, done, total = int(r.at_ms), int(r.completed), int(r.total)
            keep.append(emit)
        state.update((at, done, total))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield rows[keep][["task_id", "seq", "at_ms", "completed", "total"]]

    return progress.groupBy("task_id").applyInPandasWithState(run, schema, "at long, completed long, total long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def per_second(events: DataFrame, at: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Events per second and kind, with a watermark for late ones."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 second"), "type").agg(F.count(F.lit(1)).alias("n"))
