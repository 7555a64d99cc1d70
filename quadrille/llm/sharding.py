"""Sharding by fixed virtual slots.

Records hash into thousands of slots; bytes are summed per slot; a small versioned map sends each slot to a shard. The map
is balanced by bytes (law ``bytes``) and later edited, not rebuilt: adding a shard moves slots into it and nowhere else. A slot
that outweighs HEAVY of a shard, as where one id repeats very often, is kept in parts, which are placed like slots.
A store keeps all versions of a map: a run reads the last one, moves only the slots that new sizes call for, and writes the next.
All row work is DataFrame functions. Only the map reaches the driver: one row per slot, and less than shards / HEAVY more for parts.
"""

from __future__ import annotations

import heapq
import math
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import gone_at_exit, shared_dir, staged

#: Bytes that each record needs besides its text.
RECORD_OVERHEAD = 8
SLOTS = 4096
#: The share of a shard's even bytes from which a slot is kept in parts.
HEAVY = 0.125
#: A stored map is left as it is while every shard's bytes are within this share of the mean.
TOLERANCE = 0.01


@dataclass(frozen=True)
class SlotMap:
    """``shard_of[unit]`` and the bytes and rows each unit held when the map was made. Units are slots and, of slots in parts, their parts, in order; ``parts_of[slot]`` (one each where empty)."""

    version: int
    shards: int
    shard_of: tuple[int, ...]
    bytes_of: tuple[int, ...]
    rows_of: tuple[int, ...]
    parts_of: tuple[int, ...] = ()

    def loads(self) -> list[int]:
        """Bytes per shard."""
        out = [0] * self.shards
        for shard, size in zip(self.shard_of, self.bytes_of, strict=True):
            out[shard] += size
        return out

    def bases(self) -> list[int]:
        """For each slot, how many rows of its shard lie in earlier slots."""
        seen, out = [0] * self.shards, []
        for shard, rows in zip(self.shard_of, self.rows_of, strict=True):
            out.append(seen[shard])
            seen[shard] += rows
        return out

    def grown(self) -> SlotMap:
        """The next version, with one more shard. Slots move only into the new shard: from the fullest shards, until it has its even share."""
        loads, shard_of = [*self.loads(), 0], list(self.shard_of)
        target = sum(loads) / len(loads)
        held: dict[int, list[int]] = {}
        for slot in sorted(range(len(shard_of)), key=lambda s: (self.bytes_of[s], s)):
            held.setdefault(shard_of[slot], []).append(slot)
        new = self.shards
        while loads[new] < target:
            giver = max(range(new), key=lambda s: (loads[s], -s))
            room = target - loads[new]
            fit = [s for s in held.get(giver, ()) if 0 < self.bytes_of[s] <= room]
            if not fit:
                break
            slot = fit[-1]
            held[giver].remove(slot)
            shard_of[slot] = new
            loads[giver] -= self.bytes_of[slot]
            loads[new] += self.bytes_of[slot]
        return replace(self, version=self.version + 1, shards=new + 1, shard_of=tuple(shard_of))

    def edited(self, shards: int, bytes_of: list[int], rows_of: list[int]) -> SlotMap:
        """This map for new sums and as many shards or more: the same version where nothing moves, else the next. Units go from the fullest to the lightest shard until all are within TOLERANCE or no move helps."""
        if shards < self.shards:
            raise ValueError(f"the stored map has {self.shards} shards, more than {shards}")
        now = replace(self, bytes_of=tuple(bytes_of), rows_of=tuple(rows_of))
        while now.shards < shards:
            now = now.grown()
        loads, shard_of = now.loads(), list(now.shard_of)
        mean, held = sum(loads) / len(loads), [set() for _ in loads]
        for unit, s in enumerate(shard_of):
            held[s].add(unit)
        while max(loads) > (1 + TOLERANCE) * mean or min(loads) < (1 - TOLERANCE) * mean:
            giver, taker = loads.index(max(loads)), loads.index(min(loads))
            gap = loads[giver] - loads[taker]
            # A move of less than the gap brings the two closer, so this ends.
            fit = [u for u in held[giver] if 0 < now.bytes_of[u] < gap]
            if not fit:
                break
            unit = min(fit, key=lambda u: (abs(2 * now.bytes_of[u] - gap), u))
            held[giver].remove(unit)
            held[taker].add(unit)
            shard_of[unit] = taker
            loads[giver] -= now.bytes_of[unit]
            loads[taker] += now.bytes_of[unit]
        same = now.shards == self.shards and tuple(shard_of) == self.shard_of
        return replace(now, shard_of=tuple(shard_of), version=self.version + (not same))

    def parts(self) -> list[int]:
        return list(self.parts_of) or [1] * len(self.shard_of)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write this version beside earlier ones; an existing version is never overwritten."""
        place = [(s, p) for s, n in enumerate(self.parts()) for p in range(n)]
        rows = ", ".join(f"({s}, {p}, {a}, {b}L, {r}L)" for (s, p), a, b, r in zip(place, self.shard_of, self.bytes_of, self.rows_of, strict=True))
        spark.sql(f"SELECT {self.shards} AS shards, * FROM VALUES {rows} AS t(slot, part, shard, bytes, n_rows)").coalesce(1).write.parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        """Read one version."""
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("slot", "part").collect()
        parts = [0] * (rows[-1]["slot"] + 1)
        for r in rows:
            parts[r["slot"]] += 1
        return SlotMap(version, rows[0]["shards"], *(tuple(r[c] for r in rows) for c in ("shard", "bytes", "n_rows")), tuple(parts) if max(parts) > 1 else ())


def latest(spark: SparkSession, path: str) -> SlotMap | None:
    """The last version in a store; None where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return SlotMap.load(spark, path, spark.read.parquet(path).agg(F.max("version")).first()[0])


def grow(spark: SparkSession, path: str) -> SlotMap:
    """Edit the last version in a store to one more shard and write it as the next; of two that do so at once, the later fails."""
    last = latest(spark, path)
    if last is None:
        raise ValueError(f"no map in {path}")
    last.grown().save(spark, path)
    return SlotMap.load(spark, path, last.version + 1)


def balanced(bytes_of: list[int], rows_of: list[int], shards: int, version: int = 1) -> SlotMap:
    """A first map: slots from the largest down, each to the shard with the fewest bytes."""
    heap = [(0, s) for s in range(shards)]
    shard_of = [0] * len(bytes_of)
    for slot in sorted(range(len(bytes_of)), key=lambda s: (-bytes_of[s], s)):
        load, shard = heapq.heappop(heap)
        shard_of[slot] = shard
        heapq.heappush(heap, (load + bytes_of[slot], shard))
    return SlotMap(version, shards, tuple(shard_of), tuple(bytes_of), tuple(rows_of))


def lookup(values: list[int], at: Column, kind: str) -> Column:
    """``values[at]`` as one folded literal; the list has one entry per slot."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), at + 1)


def narrowed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of each row. A null text has no bytes; rows without an id hash by their text."""
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    crc = F.crc32(raw)
    return docs.select(
        docs["doc_id"],
        (F.octet_length(raw).cast("long") + RECORD_OVERHEAD).alias("size"),
        crc.alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(docs["doc_id"].cast("long"), crc)), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sums(narrow: DataFrame, key: str, n: int) -> tuple[list[int], list[int]]:
    """Bytes and rows of each of n slots or units, summed map-side first."""
    sums = {r[key]: r for r in narrow.groupBy(key).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    return [sums[s]["b"] if s in sums else 0 for s in range(n)], [sums[s]["n"] if s in sums else 0 for s in range(n)]


def unit_of(parts: list[int]) -> Column:
    """The unit of a row: its slot's first unit, and in a slot of parts the part that the row's number falls to."""
    at, firsts = F.col("virtual_slot"), [0]
    for n in parts:
        firsts.append(firsts[-1] + n)
    part = F.pmod(F.xxhash64("row"), lookup(parts, at, "bigint")).cast("int")
    return lookup(firsts[:-1], at, "int") + part


def slot_map(narrow: DataFrame, shards: int, slots: int = SLOTS) -> tuple[SlotMap, DataFrame]:
    """A balanced map, and the rows with their unit."""
    bytes_of, rows_of = slot_sums(narrow, "virtual_slot", slots)
    most = max(1.0, HEAVY * sum(bytes_of) / shards)
    # A slot of one row can't be parted; one that few slots make heavy in a small table isn't worth it.
    parts = [min(rows, math.ceil(size / most)) if size > most and rows > 1 else 1 for size, rows in zip(bytes_of, rows_of, strict=True)]
    placed = narrow.withColumn("unit", unit_of(parts))
    if max(parts) > 1:
        bytes_of, rows_of = slot_sums(placed, "unit", sum(parts))
    return replace(balanced(bytes_of, rows_of, shards), parts_of=tuple(parts) if max(parts) > 1 else ()), placed


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """Place every row: its shard, and ``slot``, its place in the shard, gapless from 0. ``next_shard``: its shard once the map is edited to one more.

    Places come from a window per slot or part of one plus the rows of the shard's earlier ones, so no task holds a whole shard.
    With a ``store`` (a folder) its last map is edited to these rows and written as the next version if slots move; without one,
    the map and its edit to one more shard are versions 1 and 2 of a store that lasts as long as the session.
    Null texts weigh 8 bytes; ties and repeated rows get places of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    narrow = staged(narrowed(docs, slots).withColumn("row", F.monotonically_increasing_id()), "op7-narrow")
    path = store or f"{shared_dir(spark)}/quadrille/op7-map-{uuid.uuid4().hex}"
    known = latest(spark, store) if store else None
    if known is None:
        first, rows = slot_map(narrow, shards, slots)
        first.save(spark, path)
        placed = SlotMap.load(spark, path, first.version)
    else:
        parts = known.parts()
        if len(parts) != slots:
            raise ValueError(f"the stored map has {len(parts)} slots, not {slots}")
        rows = narrow.withColumn("unit", unit_of(parts))
        placed = known.edited(shards, *slot_sums(rows, "unit", sum(parts)))
        if placed.version > known.version:
            placed.save(spark, path)
    if store is None:
        gone_at_exit(spark, path)
    after = placed.grown() if store else grow(spark, path)
    within = F.row_number().over(Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size", "row"))
    return rows.withColumn("within", within).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        lookup(list(placed.shard_of), F.col("unit"), "int").alias("shard"),
        (lookup(placed.bases(), F.col("unit"), "bigint") + F.col("within") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(placed.version).alias("map_version"),
        lookup(list(after.shard_of), F.col("unit"), "int").alias("next_shard"),
    )
