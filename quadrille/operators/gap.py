"""Seams between neighbouring meshes.

Points: mesh, point_id, x, y, z. Pairs of meshes come from a join over grid cells of their boxes, so far meshes never meet.
Nearest points are exact: a large set of targets is dealt in chunks along a curve, each the work of a task, which puts a tree
over it. A point asks the chunk whose box is nearest, and then those whose box is nearer than what it found. Points are never
crossed with all points of another mesh.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.operators import kdtree
from quadrille.operators.lineage import cut
from quadrille.operators.running import element, running

AXES = ("x", "y", "z")
#: Targets in a chunk (a task holds 24 bytes for each a few times); chunks of all sets, above which a chunk grows (a box of 48 bytes for each goes to all tasks).
LIMIT, CHUNKS = 1 << 18, 1 << 13
#: Steps that leave two free bits after each of 21.
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def border_edges(triangles: DataFrame) -> DataFrame:
    """(mesh, a, b) of the edges that one triangle alone has; triangles: mesh, i0, i1, i2."""
    sides = F.array(*(F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")) for a, b in (("i0", "i1"), ("i1", "i2"), ("i2", "i0"))))
    edges = triangles.select("mesh", F.explode(sides).alias("e")).select("mesh", "e.a", "e.b")
    return edges.groupBy("mesh", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("mesh", "a", "b")


def border_points(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """The points on border edges."""
    ids = border_edges(triangles).select("mesh", F.explode(F.array("a", "b")).alias("point_id")).distinct()
    return points.join(ids, ["mesh", "point_id"], "left_semi")


def boxes(points: DataFrame) -> DataFrame:
    """Bounds, centre and extent (1e-3 at least) of each mesh."""
    agg = points.groupBy("mesh").agg(*(f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max), ("mid", F.avg))))
    return agg.withColumns({f"ext_{a}": F.greatest(F.col(f"max_{a}") - F.col(f"min_{a}"), F.lit(1e-3)) for a in AXES})


def adjacent(meshes: DataFrame, cell: float | None = None) -> DataFrame:
    """Pairs (a < b) of meshes that share a face band, with the axis between them.

    Neighbours are apart on one axis by 1.6 mean extents at most (or are thin and close) and overlap on the other two. Meshes meet
    in x and y by a grid for each size: a mesh is at home where a cell is as wide as its grown box, so in four cells at most, and
    visits the coarser grids that others are at home in. A pair meets in the coarser one's home and is reported by one cell alone,
    so extents may differ by any factor. ``cell`` is the least width of a cell, where given.
    """
    close = F.greatest("ext_x", "ext_y", "ext_z", F.lit(1.0)) * 0.5
    by = {a: F.greatest(F.col(f"ext_{a}") * 1.6, close) for a in "xy"}
    low, high = {a: F.col(f"min_{a}") - by[a] for a in "xy"}, {a: F.col(f"max_{a}") + by[a] for a in "xy"}
    level = F.ceil(F.log2(F.greatest(high["x"] - low["x"], high["y"] - low["y"], F.lit(float(cell or 0.0))))).cast("int")
    boxed = cut(meshes.select(F.struct(*meshes.columns).alias("m"), level.alias("home"), *(low[a].alias(f"low_{a}") for a in "xy"), *(high[a].alias(f"high_{a}") for a in "xy")))
    # One row: a double has no more than some two thousand exponents.
    levels = boxed.agg(F.collect_set("home").alias("levels"))
    at = boxed.join(F.broadcast(levels)).withColumn("level", F.explode(F.filter("levels", lambda x: x >= F.col("home")))).drop("levels")
    place = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("long")
    for a in "xy":
        at = at.withColumn(f"first_{a}", place(f"low_{a}")).withColumn(f"cell_{a}", F.explode(F.sequence(F.col(f"first_{a}"), place(f"high_{a}"))))
    keys = ["level", "cell_x", "cell_y"]
    own = at.filter("level = home").select(*keys, F.col("m").alias("o"), F.col("first_x").alias("own_x"), F.col("first_y").alias("own_y"))
    visits = at.select(*keys, "m", "home", "first_x", "first_y")
    once = (F.col("cell_x") == F.greatest("own_x", "first_x")) & (F.col("cell_y") == F.greatest("own_y", "first_y"))
    met = own.join(visits, keys).filter(once & ((F.col("home") < F.col("level")) | (F.col("o.mesh") < F.col("m.mesh"))) & (F.col("o.mesh") != F.col("m.mesh")))
    first = F.col("o.mesh") < F.col("m.mesh")
    sides = met.select(F.when(first, F.col("o")).otherwise(F.col("m")).alias("a"), F.when(first, F.col("m")).otherwise(F.col("o")).alias("b"))
    pairs = sides.select(*(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in meshes.columns))
    sep = {a: F.abs(F.col(f"a_mid_{a}") - F.col(f"b_mid_{a}")) for a in AXES}
    mean = {a: (F.col(f"a_ext_{a}") + F.col(f"b_ext_{a}")) * 0.5 for a in AXES}
    over = {a: F.greatest(f"a_min_{a}", f"b_min_{a}") <= F.least(f"a_max_{a}", f"b_max_{a}") + 1e-3 for a in AXES}
    axis = F.lit(None).cast("string")
    for i in (2, 1, 0):
        a, b, c = AXES[i], AXES[(i + 1) % 3], AXES[(i + 2) % 3]
        near = (sep[a] <= mean[a] * 1.6 + 1e-3) | ((mean[a] < 0.05) & (sep[a] <= F.greatest(mean[b], mean[c], F.lit(1.0)) * 0.5))
        axis = F.when(near & (sep[a] > 1e-6) & over[b] & over[c], a).otherwise(axis)
    pick = lambda what: F.coalesce(*(F.when(F.col("axis") == a, what(a)) for a in AXES))
    found = pairs.withColumn("axis", axis).filter("axis IS NOT NULL")
    mid = pick(lambda a: (F.col(f"a_mid_{a}") + F.col(f"b_mid_{a}")) * 0.5)
    band = pick(lambda a: F.greatest((F.col(f"a_ext_{a}") + F.col(f"b_ext_{a}")) * 0.15, F.lit(0.5)))
    return cut(found.select(F.col("a_mesh").alias("a"), F.col("b_mesh").alias("b"), "axis", mid.alias("mid"), band.alias("band")))


def band_points(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """For each pair and side the points within the band; where a side has none there, all its points."""
    sided = pairs.select("*", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("mesh")), F.struct(F.lit("b").alias("side"), F.col("b").alias("mesh")))).alias("s")).select("a", "b", "axis", "mid", "band", "s.side", "s.mesh")
    at = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
    both = sided.join(points, "mesh").withColumn("inside", F.abs(at - F.col("mid")) <= F.col("band"))
    full = both.groupBy("a", "b").agg(F.count_if(F.col("inside") & (F.col("side") == "a")).alias("na"), F.count_if(F.col("inside") & (F.col("side") == "b")).alias("nb"))
    return cut(both.join(full, ["a", "b"]).filter(F.col("inside") | (F.col("na") == 0) | (F.col("nb") == 0)).select("a", "b", "side", "point_id", "x", "y", "z"))


def nearest(points: DataFrame, targets: DataFrame, keys: list[str], id_: str = "point_id", limit: int = LIMIT) -> DataFrame:
    """Exact distance (d) of every point to the nearest target with the same keys, a row per keys and id. Points without any target are left out.

    points and targets: keys, x, y, z (and the point's id). ``limit`` is how many targets meet in one task. A point with a null
    coordinate has a null distance; targets that aren't finite count as none.
    """
    finite = reduce(lambda a, b: a & b, (F.coalesce(F.abs(F.col(a)) < float("inf"), F.lit(False)) for a in AXES))
    places = cut(targets.filter(finite).select(*keys, *AXES).distinct())
    sets = cut(places.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *(f(a).alias(f"__{n}_{a}") for a in AXES for n, f in (("min", F.min), ("max", F.max)))).withColumn("__set", F.monotonically_increasing_id()))
    asked = points.join(sets.select(*keys, "__set"), keys).select("__set", F.col(id_).alias("__id"), *AXES, finite.alias("__finite"))
    odd = asked.filter(~F.col("__finite")).select("__set", "__id", sum((F.abs(a) for a in AXES[1:]), F.abs(AXES[0])).alias("__d2"))
    asked = asked.filter("__finite").select("__set", F.lit(0).alias("__chunk"), "__id", *AXES, F.lit(float("inf")).alias("__d2"))
    here = places.join(sets, keys)
    largest, total = sets.agg(F.max("__n"), F.sum("__n")).first()
    limit, boxes = max(limit, -(-(total or 0) // CHUNKS)), None
    many, here = here.filter(F.col("__n") > limit), here.filter(F.col("__n") <= limit).select("__set", F.lit(0).alias("__chunk"), *AXES)
    if largest is not None and largest > limit:
        dealt = chunks(many, limit)
        here, boxes = here.union(dealt), boxes_of(dealt)
        asked = cut(at_home(asked, boxes))
    found = answered(asked, here, limit, boxes)
    best = found.filter("__chunk IS NULL").select("__set", "__id", "__d2").union(odd)
    if boxes is not None:
        best = best.union(answered(found.filter("__chunk IS NOT NULL"), here, limit).select("__set", "__id", "__d2"))
    least = best.groupBy("__set", "__id").agg(F.min("__d2").alias("__d2"))
    return least.join(sets.select(*keys, "__set"), "__set").select(*keys, F.col("__id").alias(id_), F.sqrt("__d2").alias("d"))


def chunks(places: DataFrame, limit: int) -> DataFrame:
    """(__set, __chunk, x, y, z): runs of so many places of a set along a curve through its box (the bits of the three axes interleaved)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, low, high = coordinates(batch), coordinates(batch, "__min_{}"), coordinates(batch, "__max_{}")
            with np.errstate(all="ignore"):
                share = np.nan_to_num((at - low) / (high - low), nan=0.0, posinf=0.0, neginf=0.0)
            bits = (np.clip(share, 0, 1) * ((1 << 21) - 1)).astype(np.int64)
            for shift, mask in SPREAD:
                bits = (bits | bits << shift) & mask
            code = bits[:, 0] | bits[:, 1] << 1 | bits[:, 2] << 2
            yield pa.RecordBatch.from_arrays([batch.column("__set"), pa.array(code), *(pa.array(at[:, i]) for i in range(3))], ["__set", "__code", *AXES])

    coded = places.select("__set", *AXES, *(f"__{n}_{a}" for a in AXES for n in ("min", "max"))).mapInArrow(run, "__set long, __code long, x double, y double, z double")
    ranked = running(coded, ["__set"], [F.col(c) for c in ("__code", *AXES)], {"__upto": F.lit(1)})
    return cut(ranked.select("__set", F.floor((F.col("__upto") - 1) / limit).cast("int").alias("__chunk"), *AXES))


def boxes_of(dealt: DataFrame) -> Broadcast:
    """The boxes of all chunks by set; no more than two for each of CHUNKS."""
    per = dealt.groupBy("__set", "__chunk").agg(*(F.min(a) for a in AXES), *(F.max(a) for a in AXES)).orderBy("__set", "__chunk").collect()
    found: dict[int, list] = {}
    for set_, _, *box in per:
        found.setdefault(set_, []).append(box)
    return dealt.sparkSession.sparkContext.broadcast({k: (np.array(v)[:, :3], np.array(v)[:, 3:]) for k, v in found.items()})


def coordinates(batch: pa.RecordBatch, name: str = "{}") -> np.ndarray:
    return np.column_stack([batch.column(name.format(a)).to_numpy(zero_copy_only=False) for a in AXES]).astype(float)


def to_boxes(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Squared distances of places (rows) to boxes, some rows at a time, with the first row's number."""
    step = max(1, kdtree.STEP // len(low))
    for lo in range(0, len(at), step):
        gap = kdtree.outside(low[None], high[None], at[lo : lo + step, None])
        yield lo, kdtree.squared(*(gap[:, :, i] for i in range(3)))


def at_home(asked: DataFrame, boxes: Broadcast) -> DataFrame:
    """The asked places with the chunk whose box is nearest, where their set has several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, of = coordinates(batch), batch.column("__set").to_numpy()
            home = np.zeros(len(of), np.int32)
            for set_ in np.unique(of):
                if set_ in boxes.value:
                    rows = np.flatnonzero(of == set_)
                    for lo, d2 in to_boxes(at[rows], *boxes.value[set_]):
                        home[rows[lo : lo + len(d2)]] = d2.argmin(1)
            yield batch.set_column(1, "__chunk", pa.array(home))

    return asked.mapInArrow(run, asked.schema)


def answered(asked: DataFrame, here: DataFrame, limit: int, boxes: Broadcast | None = None) -> DataFrame:
    """(__set, __chunk, __id, x, y, z, __d2): the squared distance of each place to its chunk's nearest point or the bound it came with (no __chunk), and with boxes a row for each other chunk that may hold a nearer one.

    Rows come to a task sorted, a chunk's points before the places asked, which may be in parts, so a task holds one chunk and one batch.
    """
    spark, names = asked.sparkSession, asked.columns
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = cut(asked.groupBy("__set", "__chunk").agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("__parts")))
    key = ["__set", "__chunk"]
    ask = asked.join(parts, key).select(*key, F.pmod(F.xxhash64("__id", *AXES), F.col("__parts")).cast("int").alias("__part"), F.lit(True).alias("__asks"), "__id", *AXES, "__d2")
    give = here.join(parts, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"), F.lit(False), F.lit(None).cast(asked.schema["__id"].dataType), *AXES, F.lit(0.0))
    rows = ask.union(give).repartition(n, *key, "__part").sortWithinPartitions(*key, "__part", "__asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, tree = None, [], None
        for batch in batches:
            of = np.column_stack([batch.column(c).to_numpy() for c in (*key, "__part")])
            at, asks, best = coordinates(batch), batch.column("__asks").to_numpy(zero_copy_only=False), batch.column("__d2").to_numpy().copy()
            ends = [*(np.flatnonzero((of[1:] != of[:-1]).any(1)) + 1), len(of)] if len(of) else []
            for lo, hi in zip([0, *ends], ends, strict=False):
                if now is None or (of[lo] != now).any():
                    now, held, tree = of[lo].copy(), [], None
                first = hi - int(asks[lo:hi].sum())
                if first > lo:
                    held.append(at[lo:first])
                if first == hi:
                    continue
                if tree is None:
                    tree, held = kdtree.Tree(np.concatenate(held)), []
                best[first:hi] = tree.nearest(at[first:hi], best[first:hi])
                if boxes is not None and now[0] in boxes.value:
                    for start, d2 in to_boxes(at[first:hi], *boxes.value[now[0]]):
                        near = d2 < best[first + start : first + start + len(d2), None]
                        near[:, now[1]] = False
                        row, chunk = np.nonzero(near)
                        if len(row):
                            yield told(batch, row + first + start, best, chunk)
            yield told(batch, np.flatnonzero(asks), best)

    def told(batch: pa.RecordBatch, rows: np.ndarray, best: np.ndarray, chunk: np.ndarray | None = None) -> pa.RecordBatch:
        some = batch.take(pa.array(rows))
        other = pa.nulls(len(rows), pa.int32()) if chunk is None else pa.array(chunk.astype(np.int32))
        at = (pa.nulls(len(rows), pa.float64()) if chunk is None else some.column(a) for a in AXES)
        return pa.RecordBatch.from_arrays([some.column("__set"), other, some.column("__id"), *at, pa.array(best[rows])], names)

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in asked.schema]
    return cut(rows.mapInArrow(run, ", ".join(fields)))


def gap_metrics(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: samples, the widest gap, and the 95th percentile by rank (index round((n - 1) * 0.95))."""
    sided = band_points(pairs, points)
    facing = sided.withColumn("side", F.when(F.col("side") == "a", "b").otherwise("a"))
    both = cut(nearest(sided, facing, ["a", "b", "side"]).select("a", "b", "d"))
    # Samples without a distance are last in the order.
    ordered = both.withColumn("d", F.coalesce("d", F.lit(float("nan"))))
    rank = element(ordered, ["a", "b"], "d", p95_index).select("a", "b", F.when(~F.isnan("d"), F.col("d")).alias("p95_gap"))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("max_gap")).join(rank, ["a", "b"])


def p95_index(n: Column) -> Column:
    """The place of the 95th percentile among n sorted values."""
    return F.floor((n - 1) * 0.95 + 0.5)


def p95(value: Column) -> Column:
    """The element at index round((n - 1) * 0.95) of the sorted values, as an aggregate for small groups; 0 of none."""
    sorted_ = F.sort_array(F.collect_list(value))
    return F.coalesce(F.get(sorted_, F.floor((F.size(sorted_) - 1) * 0.95 + 0.5).cast("int")), F.lit(0.0))


def overall(pair_metrics: DataFrame) -> DataFrame:
    """One row: the widest gap, the 95th percentile of the pairs' percentiles, and the pairs."""
    pair_metrics = cut(pair_metrics)
    rank = element(pair_metrics, [], "p95_gap", p95_index).agg(F.coalesce(F.max("p95_gap"), F.lit(0.0)).alias("p95_gap"))
    all_ = pair_metrics.agg(F.coalesce(F.max("max_gap"), F.lit(0.0)).alias("max_gap"), F.count(F.lit(1)).alias("n_pairs"))
    return all_.join(F.broadcast(rank)).select("max_gap", "p95_gap", "n_pairs")

