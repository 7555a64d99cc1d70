"""Streams give what the batch operators give."""

import json
import os
import random
import time

from pyspark.sql import functions as F

from quadrille.operators import tasks
from quadrille.streaming import events


def write_log(folder, n_files=3):
    rng = random.Random(1)
    rows = []
    for seq in range(120):
        kind = rng.choice(["stage", "progress", "log", "warning", "error", "result"])
        e = {"schemaVersion": 1, "taskId": f"t{rng.randrange(3)}", "seq": seq, "type": kind}
        if kind == "stage":
            e |= {"stage": rng.choice(["scan", "rebuild-l1", "validate"]), "message": rng.choice(["", "m"])}
        elif kind == "progress":
            e |= {"stage": "convert", "completed": seq, "total": 200}
        elif kind == "error":
            e |= {"message": f"e{seq}"} | rng.choice([{"code": "CANCELLED"}, {"code": "X"}, {}])
        elif kind == "result":
            e |= {"path": f"/o/{seq}"}
        rows.append(e)
    for i in range(n_files):
        part = [json.dumps(e) for e in rows[i * 40 : (i + 1) * 40]]
        part_file = folder / f"{i}.jsonl"
        part_file.write_text("\n".join([*part, "no json", '{"schemaVersion": 2, "taskId": "t0", "seq": 1, "type": "log"}']))
        os.utime(part_file, (1_700_000_000 + i * 100,) * 2)  # a stream takes files by their time
    return rows


def test_fold_equals_batch(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    rows = write_log(src)
    stream = events.folded(events.parsed(events.lines(spark, str(src), 1)))
    q = stream.writeStream.outputMode("update").format("memory").queryName("fold").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    cols = ["task_id", "stage", "progress_stage", "progress_message", "completed", "total", "error", "error_code", "result_path", "n_events", "n_warnings"]
    last = {}
    for r in spark.sql("SELECT * FROM fold").collect():
        if r.task_id not in last or r.n_events > last[r.task_id].n_events:
            last[r.task_id] = r
    batch = tasks.fold(events.parsed(spark.read.text(str(src))))
    assert {tuple(r[c] for c in cols) for r in last.values()} == {tuple(r[c] for c in cols) for r in batch.collect()}
    assert sum(r.n_events for r in last.values()) == len(rows)


def test_throttle_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rng, rows, at = random.Random(2), [], 0
    for seq in range(90):
        at += rng.randrange(0, 300)
        rows.append((seq % 3, seq, at, rng.randrange(3), 9))
    schema = "task_id long, seq long, at_ms long, completed long, total long"
    for i in range(3):
        spark.createDataFrame(rows[i * 30 : i * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(src))
    for n, f in enumerate(sorted(src.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)):
        os.utime(f, (1_700_000_000 + n * 100,) * 2)
    stream = spark.readStream.schema(schema).parquet(str(src)).withColumn("task_id", F.col("task_id").cast("string"))
    q = events.throttled(stream).writeStream.outputMode("append").format("memory").queryName("throttle").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(str(r.task_id), r.seq) for r in tasks.throttle(spark.createDataFrame(rows, schema)).collect()}
    assert {(r.task_id, r.seq) for r in spark.sql("SELECT * FROM throttle").collect()} == want


def test_late_events_of_a_later_batch_are_folded_by_seq(spark, tmp_path):
    """The same events dealt to files in any order give the batch fold's rows."""
    src = tmp_path / "log"
    src.mkdir()
    rows = write_log(tmp_path, 0)
    rng = random.Random(7)
    rng.shuffle(rows)
    for i in range(4):
        f = src / f"{i}.jsonl"
        f.write_text("\n".join(json.dumps(e) for e in rows[i * 30 : (i + 1) * 30]))
        os.utime(f, (1_700_000_000 + i * 100,) * 2)
    q = events.folded(events.parsed(events.lines(spark, str(src), 1))).writeStream.outputMode("update").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in spark.sql("SELECT * FROM late").collect():
        if r.task_id not in last or r.n_events > last[r.task_id].n_events:
            last[r.task_id] = r
    batch = {r.task_id: r for r in tasks.fold(events.parsed(spark.read.text(str(src)))).collect()}
    assert {t: r.asDict() for t, r in last.items()} == {t: {c: r[c] for c in last[t].asDict()} for t, r in batch.items()}


def test_ended_tasks_leave_no_state(spark, tmp_path):
    """A task with a result loses its state after the grace time: its next event starts anew; one without keeps it."""
    src = tmp_path / "log"
    src.mkdir()
    event = lambda task, seq, kind: json.dumps({"taskId": task, "seq": seq, "type": kind, "path": "/o", "stage": "scan"})
    stream = events.folded(events.parsed(events.lines(spark, str(src), 1)), grace_ms=1, idle_ms=10**9)
    steps = [[event("done", 0, "stage"), event("done", 1, "result"), event("open", 0, "stage")], [event("tick", 0, "warning")], [event("done", 5, "warning"), event("open", 5, "warning")]]
    q = stream.writeStream.outputMode("update").format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        rows = 0
        for i, lines in enumerate(steps):
            (tmp_path / f"{i}.part").write_text("\n".join(lines))
            os.utime(tmp_path / f"{i}.part", (1_700_000_000 + i * 100,) * 2)
            os.replace(tmp_path / f"{i}.part", src / f"{i}.jsonl")
            rows, end = rows + len(lines), time.time() + 40
            # Such a stream never comes to rest: wait until the lines have been read.
            while sum(p["numInputRows"] for p in q.recentProgress) < rows and time.time() < end:
                time.sleep(0.2)
    finally:
        q.stop()
    last = {r.task_id: r for r in spark.sql("SELECT * FROM ended").collect()}
    assert last["done"].n_events == 1 and last["done"].result_path is None
    assert last["open"].n_events == 2 and last["open"].stage == "scan"
