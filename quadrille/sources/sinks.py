"""Sinks: binary payloads, JSON events, reports and CSV rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payload_table(df: DataFrame, path: str) -> None:
    """(path, content) rows as Parquet: any store, atomic commit, an existing folder is refused."""
    df.select("path", "content").write.mode("errorifexists").parquet(path)


def payload_files(df: DataFrame, folder: str) -> None:
    """(path, content) rows as files below a folder that all executors mount. A file appears whole (written beside, then renamed), so a repeated task is harmless."""

    def write(rows) -> None:
        import os
        import uuid

        for row in rows:
            target = os.path.normpath(os.path.join(folder, row["path"].lstrip("/")))
            if not target.startswith(os.path.normpath(folder) + os.sep):
                raise ValueError(f"path leaves the folder: {row['path']}")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(row["content"])
            os.replace(part, target)

    df.select("path", "content").filter("content IS NOT NULL").foreachPartition(write)


def event_lines(events: DataFrame, path: str) -> None:
    """Events as JSON lines, appended; nulls are left out."""
    events.select(F.to_json(F.struct(*events.columns)).alias("value")).write.mode("append").text(path)


def report(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, as reports are stored."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("report"))


def csv_rows(df: DataFrame, path: str) -> None:
    """Result rows appended as CSV with a header per file."""
    df.write.mode("append").option("header", "true").csv(path)
