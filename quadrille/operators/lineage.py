"""Cutting a plan that grows from round to round."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only where the session names no checkpoint folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/quadrille"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, checkpointed in the session's shared folder: what comes before is not run again, and a lost executor costs nothing."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
    return df.checkpoint()
