"""Copies of file trees as a job: listed folder by folder and copied file by file in tasks, verified by digest, resumed by what is there already."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.lineage import cut
from quadrille.sources.payload import opened, store_of

#: Bytes read at a time; rows of a listing returned at a time.
CHUNK, ROWS = 8 << 20, 10_000
MANIFEST = "source string, target string, length long, digest string, status string"
#: What became of a file: copied and read back, there before with the same bytes, or not copied and why.
COPIED, KEPT, LINK, DIFFERS, FAILED = "copied", "kept", "link", "differs", "failed"


def below(folders: DataFrame) -> DataFrame:
    """All files below some folders (folder, prefix): source, target (the prefix and the path within the folder), length. A folder is listed by one task; empty files count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, prefix in zip(batch["folder"], batch["prefix"], strict=True):
                store, top = store_of(folder.rstrip("/"))
                found = (f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File)
                while part := [(f.path, f"{prefix}/{f.path[len(top) :].lstrip('/')}", f.size) for f, _ in zip(found, range(ROWS))]:
                    yield pd.DataFrame(part, columns=["source", "target", "length"])

    return folders.select("folder", "prefix").mapInPandas(run, "source string, target string, length long")


def _digest(path: str) -> tuple[int, str]:
    h, n = sha256(), 0
    with opened(path) as f:
        while part := f.read(CHUNK):
            h.update(part)
            n += len(part)
    return n, h.hexdigest()


def _copy(source: str, root: str, target: str) -> tuple[int | None, str | None, str]:
    """Length, digest and status of one copy. The file appears whole: it is written beside, read back, and renamed."""
    place = os.path.normpath(os.path.join(root, target.lstrip("/")))
    top = os.path.normpath(root)
    if not place.startswith(top + os.sep):
        return None, None, f"{FAILED}: the path leaves the folder"
    up = place
    while up != top:
        if os.path.islink(up):
            return None, None, LINK
        up = os.path.dirname(up)
    if os.path.islink(source):
        return None, None, LINK
    try:
        n, want = _digest(source)
        if os.path.exists(place):
            return n, want, KEPT if _digest(place) == (n, want) else DIFFERS
        os.makedirs(os.path.dirname(place), exist_ok=True)
        part = f"{place}.{uuid.uuid4().hex}.part"
        with opened(source) as f, open(part, "wb") as out:
            while block := f.read(CHUNK):
                out.write(block)
        if _digest(part) != (n, want):
            os.remove(part)
            return n, want, f"{FAILED}: the copy differs from its source"
        os.replace(part, place)
    except OSError as e:
        return None, None, f"{FAILED}: {e}"
    return n, want, COPIED


def copied(plan: DataFrame, root: str, tag: str | None = None) -> DataFrame:
    """Copy (source, target, length) below ``root``, a folder that all executors mount; gives the MANIFEST once all is done.

    A file that is there with the same bytes is kept, so a job that was ended is run again. One that is there with other bytes
    is left and told, and so are links on either side. With a ``tag`` the jobs can be cancelled by it.
    """
    spark = plan.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r.source, r.target, *_copy(r.source, root, r.target)) for r in batch.itertuples(index=False)]
            out = pd.DataFrame(rows, columns=["source", "target", "length", "digest", "status"])
            out["length"] = out["length"].astype("Int64")
            yield out

    if tag:
        spark.addTag(tag)
    try:
        n = max(1, spark.sparkContext.defaultParallelism * 4)
        # Sizes differ, so files are dealt round robin, the largest first.
        return cut(plan.repartition(n).sortWithinPartitions(F.col("length").desc()).select("source", "target").mapInPandas(run, MANIFEST))
    finally:
        if tag:
            spark.removeTag(tag)


def faults(manifest: DataFrame) -> DataFrame:
    """The files that were not copied, and why."""
    return manifest.filter(~F.col("status").isin(COPIED, KEPT)).select("source", "target", "status")
