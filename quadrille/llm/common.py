"""What the corpus operators share: table access, the shared folder, staged tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/quadrille"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read ``<sf_dir>/<name>.parquet`` through Spark, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one is set only where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quadrille/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gone_at_exit(spark, path)  # only what exists can be marked
    return spark.read.schema(df.schema).parquet(path)


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Have the store delete a path when the driver's JVM ends: results are lazy, so their tables are needed until then."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(df[name], F.lit(""))


def fold(column: Column) -> Column:
    """The remainder base of every fold: crc32 of the id as text; a null id counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python stages get, by rows and bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
