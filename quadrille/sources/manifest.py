"""The work manifest as a versioned table: units of work as Parquet, and a log in which each version is put once.

A commit writes its units beside and then puts the log entry of the next version, which fails where another writer was first.
Entries are made by the file system that Spark has for the folder, with no overwriting, so one of two writers loses on any store
that keeps to that; nothing is ever changed in place, and every version stays readable.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.operators import tasks

UNITS = "job_key string, unit_type string, status string, attempts int, input_fingerprint string, param_hash string, output_checksum string, dependencies array<string>, last_updated_ms long"
PENDING, RUNNING, SUCCEEDED, FAILED = "pending", "running", "succeeded", "failed"


class ManifestConflict(ValueError):
    """Another writer has put the version."""


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _entry(folder: str, version: int) -> str:
    return f"{folder.rstrip('/')}/log/{version:020d}.json"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that the log has, in order; one file for each commit."""
    store, where = _store(spark, f"{folder.rstrip('/')}/log")
    if not store.exists(where):
        return []
    names = (s.getPath().getName() for s in store.listStatus(where))
    return sorted(int(n[:20]) for n in names if re.fullmatch(r"\d{20}\.json", n))


def read(spark: SparkSession, folder: str, version: int | None = None) -> tuple[int, DataFrame]:
    """(version, units) of the newest version or a given one; version 0 is empty."""
    known = versions(spark, folder)
    if version is None:
        version = known[-1] if known else 0
    if version == 0:
        return 0, spark.createDataFrame([], UNITS)
    if version not in known:
        raise ValueError(f"the manifest has no version {version}")
    entry = json.loads(spark.read.text(_entry(folder, version), wholetext=True).first().value)
    return version, spark.read.schema(UNITS).parquet(f"{folder.rstrip('/')}/data/{entry['data']}")


def commit(spark: SparkSession, folder: str, units: DataFrame, base: int, note: str = "") -> int:
    """Put ``units`` as the version after ``base`` and give its number; ManifestConflict where that version is there already. A loser's rows are removed."""
    store, _ = _store(spark, folder)
    data = uuid.uuid4().hex
    place = f"{folder.rstrip('/')}/data/{data}"
    units.select(*(c.split()[0] for c in UNITS.split(", "))).write.mode("errorifexists").parquet(place)
    text = json.dumps({"version": base + 1, "data": data, "note": note}).encode()
    _, where = _store(spark, _entry(folder, base + 1))
    jvm = spark.sparkContext._jvm
    # The entry is whole when it appears: it is written beside and put by a rename, after an empty claim that only one can make.
    claim = jvm.org.apache.hadoop.fs.Path(f"{_entry(folder, base + 1)}.claim")
    try:
        if base and base not in versions(spark, folder):
            raise ManifestConflict(f"version {base} is not there")
        if store.exists(where):
            raise ManifestConflict(f"version {base + 1} was put by another writer")
        store.create(claim, False).close()
    except ManifestConflict:
        store.delete(jvm.org.apache.hadoop.fs.Path(place), True)
        raise
    except Exception as e:
        store.delete(jvm.org.apache.hadoop.fs.Path(place), True)
        if "already exists" in str(e).lower() or "AlreadyExists" in str(e):
            raise ManifestConflict(f"version {base + 1} was put by another writer") from None
        raise
    part = jvm.org.apache.hadoop.fs.Path(f"{_entry(folder, base + 1)}.{data}.part")
    out = store.create(part, False)
    out.write(bytearray(text))
    out.close()
    if not store.rename(part, where):
        raise ManifestConflict(f"version {base + 1} could not be put")
    return base + 1


def release(spark: SparkSession, folder: str, version: int) -> bool:
    """Take back the claim on a version whose writer was lost before its entry was put; whether there was one."""
    store, where = _store(spark, _entry(folder, version))
    return not store.exists(where) and store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{_entry(folder, version)}.claim"), False)


def prepared(units: DataFrame, wanted: DataFrame, now_ms: int) -> DataFrame:
    """The units of a new run: what was running is pending again, and a unit is done only while it is reusable.

    wanted: job_key, unit_type, input_fingerprint, param_hash (null: any), dependencies. A succeeded unit stays so where fingerprint
    and parameters are as wanted; others are pending with what is wanted now. Units that nobody wants are left out.
    """
    before = units.select("job_key", "status", "attempts", F.col("input_fingerprint").alias("__fp"), F.col("param_hash").alias("__ph"), "output_checksum", "last_updated_ms")
    joined = wanted.join(before, "job_key", "left")
    known = joined.select("*").withColumnsRenamed({"input_fingerprint": "__want_fp", "param_hash": "__want_ph", "__fp": "input_fingerprint", "__ph": "param_hash"})
    keep = F.coalesce(tasks.reusable(known, F.col("__want_fp"), F.col("__want_ph")), F.lit(False))
    failed = F.coalesce(F.col("status") == FAILED, F.lit(False))
    return known.select(
        "job_key", "unit_type", F.when(keep, SUCCEEDED).when(failed, FAILED).otherwise(PENDING).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.when(keep, F.col("input_fingerprint")).otherwise(F.col("__want_fp")).alias("input_fingerprint"), F.when(keep, F.col("param_hash")).otherwise(F.col("__want_ph")).alias("param_hash"),
        F.when(keep, F.col("output_checksum")).alias("output_checksum"), "dependencies", F.when(keep, F.col("last_updated_ms")).otherwise(F.lit(now_ms)).alias("last_updated_ms"),
    )


def ready(units: DataFrame) -> DataFrame:
    """Pending and failed units whose dependencies have all succeeded."""
    todo = tasks.pending_or_failed(units)
    needs = todo.select("job_key", F.explode("dependencies").alias("need"))
    done = units.filter(F.col("status") == SUCCEEDED).select(F.col("job_key").alias("need"))
    return todo.join(needs.join(done, "need", "left_anti").select("job_key").distinct(), "job_key", "left_anti")


def marked(units: DataFrame, changes: DataFrame, now_ms: int) -> DataFrame:
    """Units after changes (job_key, new_status, checksum): running counts an attempt, success keeps the checksum."""
    joined = units.join(changes.select("job_key", "new_status", "checksum"), "job_key", "left")
    hit = F.col("new_status").isNotNull()
    return joined.select(
        "job_key", "unit_type", F.coalesce("new_status", "status").alias("status"), (F.col("attempts") + F.when(F.col("new_status") == RUNNING, 1).otherwise(0)).cast("int").alias("attempts"), "input_fingerprint", "param_hash",
        F.when(F.col("new_status") == SUCCEEDED, F.col("checksum")).otherwise(F.col("output_checksum")).alias("output_checksum"), "dependencies", F.when(hit, F.lit(now_ms)).otherwise(F.col("last_updated_ms")).alias("last_updated_ms"),
    )
