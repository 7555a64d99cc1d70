"""Running sums and ranks of ordered rows in two passes over ranges, so that a key with most of the rows is the work of many tasks.

Rows are dealt by ranges of (keys, order). A range's sums per key come first; a key's earlier ranges, at most one row for each,
give the offset; within a range a window does the rest.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrille.operators.lineage import cut


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equal in all these columns, where null equals null."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """The rows with running sums (the row's own value included) in an order within their keys; rows of equal order come in any order.

    Without keys all rows are one sequence.
    """
    n = ranges or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    valued = rows.withColumns({f"__{name}": value for name, value in sums.items()})
    # A range is what it was when it is read again, so it is written before it gets its number.
    dealt = cut(valued.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()))
    per = dealt.groupBy(*keys, "__range").agg(*(F.sum(f"__{name}").alias(f"__sum_{name}") for name in sums))
    earlier = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*keys, "__range", *(F.coalesce(F.sum(f"__sum_{name}").over(earlier), F.lit(0)).alias(f"__before_{name}") for name in sums))
    within = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.withColumns({f"__{name}": F.sum(f"__{name}").over(within) for name in sums})
    joined = inside.join(offsets, same(inside, offsets, [*keys, "__range"]))
    return joined.select(*(inside[c] for c in rows.columns), *((F.col(f"__{name}") + F.col(f"__before_{name}")).alias(name) for name in sums))


def element(rows: DataFrame, keys: list[str], value: str, index: Callable[[Column], Column]) -> DataFrame:
    """(keys, value): the element of each key's sorted values at a place from 0 that depends on their number. Equal values are counted first; nulls are left out."""
    counts = cut(rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n")))
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    upto = running(counts, keys, [F.col(value)], {"__upto": F.col("__n")})
    joined = upto.join(total, same(upto, total, keys)) if keys else upto.join(F.broadcast(total))
    hit = joined.filter(F.col("__upto") > index(F.col("__total")))
    return hit.groupBy(*(upto[k] for k in keys)).agg(F.min(upto[value]).alias(value)).filter(F.col(value).isNotNull())
