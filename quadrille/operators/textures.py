"""Textures of nodes within a size and a byte budget: images are decoded, resampled and encoded as rows, one task for each.

PNG images are changed; others (JPEG, KTX2) are passed on as they are and count with their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.operators.lineage import cut
from quadrille.sources import raster
from quadrille.sources.binary import image_size

#: A step of shrinking, and steps at most.
STEP, STEPS = 0.7, 8
PNG = "image/png"
SCHEMA = "node string, hash string, mime string, data binary, width long, height long, opaque boolean, changed boolean"


def resized(images: DataFrame, most: int | None = None, times: float | None = None) -> DataFrame:
    """Images (node, hash, mime, data) with their longer edge cut to ``most`` pixels, or ``times`` as large (at least a pixel)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                data, mime, changed = bytes(row.data), row.mime, False
                size = image_size(data) or (0, 0)
                opaque = not data.startswith(raster.SIGNATURE)
                if not opaque:
                    w, h = size
                    most_now = most if times is None else max(max(1, int(w * times + 0.5)), max(1, int(h * times + 0.5)))
                    wanted = raster.fitted(w, h, most_now)
                    if wanted != size:
                        try:
                            data, mime, size, changed = raster.encoded(raster.resampled(raster.decoded(data), *wanted)), PNG, wanted, True
                        except raster.RasterError:
                            opaque = True
                yield pd.DataFrame([(row.node, row.hash, mime, data, *size, opaque, changed)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return images.select("node", "hash", "mime", "data").mapInPandas(run, SCHEMA)


def processed(images: DataFrame, max_size: int, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(images, metrics) of nodes: equal images once, edges within ``max_size``, and up to STEPS steps of shrinking while a node's bytes exceed ``max_bytes`` (0: no bound).

    metrics: node, input_count, unique_count, dedup_removed, bytes_before, bytes_after, max_dimension_after, steps, over_budget.
    """
    counts = images.groupBy("node").agg(F.count(F.lit(1)).alias("input_count"), F.count_distinct("hash").alias("unique_count"))
    unique = images.dropDuplicates(["node", "hash"])
    before = unique.groupBy("node").agg(F.sum(F.length("data")).alias("bytes_before"))
    now = cut(resized(unique, max_size).withColumn("steps", F.lit(0)))
    over = lambda df: df.groupBy("node").agg(F.sum(F.length("data")).alias("bytes"), F.max((~F.col("opaque")).cast("int")).alias("any")).filter((F.col("bytes") > max_bytes) & (F.col("any") == 1)).select("node")
    for step in range(1, STEPS + 1) if max_bytes else ():
        heavy = cut(over(now))
        if heavy.isEmpty():
            break
        smaller = resized(now.join(heavy, "node", "left_semi"), times=STEP).withColumn("steps", F.lit(step))
        now = cut(now.join(heavy, "node", "left_anti").select(*smaller.columns).union(smaller))
    after = now.groupBy("node").agg(F.sum(F.length("data")).alias("bytes_after"), F.max(F.greatest("width", "height")).alias("max_dimension_after"), F.max("steps").alias("steps"))
    metrics = counts.join(before, "node").join(after, "node").withColumn("dedup_removed", F.col("input_count") - F.col("unique_count")).withColumn("over_budget", (F.col("bytes_after") > max_bytes) & F.lit(max_bytes > 0))
    return now, metrics
