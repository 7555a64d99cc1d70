"""Geometric error rules of level-of-detail trees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def leaf_error(source: Column, diagonal: Column) -> Column:
    """A leaf's error: 1 where the source's is invalid; cut to 0.75 of the diagonal (1 at least) where it is over twice that."""
    src = F.when(finite(source) & (source > 0), source).otherwise(1.0)
    spatial = F.greatest(diagonal * 0.75, F.lit(1.0))
    return F.when(finite(diagonal) & (diagonal > 0) & (src > spatial * 2), spatial).otherwise(src)


def proxy_error(max_child: Column, simplification: Column, diagonal: Column) -> Column:
    """A proxy's error: strictly above its children's."""
    child = F.greatest(F.coalesce(max_child, F.lit(0.0)), F.lit(0.0))
    return F.greatest(child + F.greatest(simplification, F.lit(0.0)), child * 2, F.when(diagonal > 0, diagonal * 0.75).otherwise(0.0), child + 1)


def baseline_error(max_child: Column, diagonal: Column) -> Column:
    """The older rule: twice the children, 0.25 of the diagonal, and always a little above the children."""
    return F.greatest(max_child * 2, F.when(diagonal > 0, diagonal * 0.25).otherwise(0.0), max_child + 1, max_child * 1.01 + 1e-3)


def working_memory(child_sizes: Column, max_texture_bytes: Column | int, max_output_bytes: Column | int) -> Column:
    """Bytes needed to build one proxy from children of these sizes (an array): 8 MiB, each child three times and a texture, and twice the output."""
    each = F.aggregate(child_sizes, F.lit(0).cast("long"), lambda a, x: a + x * 3 + max_texture_bytes)
    return F.lit(8 << 20) + each + F.lit(2) * max_output_bytes


def budget_share(triangles: Column, total: Column, budget: Column | int) -> Column:
    """A group's part of a triangle budget, rounded half away from zero, 4 at least."""
    return F.greatest(F.round(triangles / F.greatest(total, F.lit(1)) * budget).cast("long"), F.lit(4).cast("long"))


def workers(cpus: Column, explicit: Column) -> Column:
    """Workers to use: an explicit number up to the CPUs, or half of the CPUs, between 1 and 8."""
    auto = F.least(F.greatest(F.floor(cpus / 2), F.lit(1)), F.lit(8))
    return F.when(explicit.isNull(), auto).otherwise(F.least(F.greatest(explicit, F.lit(1)), cpus)).cast("int")


def encoder_threads(cpu_workers: Column, io_workers: Column) -> Column:
    """Threads of one texture encoder: the workers shared by at most two files at a time, between 1 and 4."""
    files = F.least(F.greatest(io_workers, F.lit(1)), F.lit(2))
    return F.least(F.greatest(F.floor(cpu_workers / files), F.lit(1)), F.lit(4)).cast("int")
