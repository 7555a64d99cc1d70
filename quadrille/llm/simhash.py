"""Near duplicates by SimHash: fingerprints of 64 bits are embedded as bit counts per segment and meet in a grid.

A fingerprint's embedding is the number of set bits in each segment of two bits. The Manhattan distance of two embeddings never
exceeds the Hamming distance of the fingerprints, so a pair within LIMIT bits is within LIMIT there too. Written in unary (the
set bits of a segment first), an embedding fits 64 bits, and the Manhattan distance is the bit count of an exclusive or.

The grid's cells are the equal values of groups of segments: of GROUPS groups a pair within LIMIT agrees in GROUPS - LIMIT at
least, so each choice of so many groups makes a key, and every pair within reach meets at one. What meets is filtered by the
Manhattan distance and then by the fingerprints. More groups give smaller cells and more keys: 6 give 20 keys of 24 bits of
evidence, 8 give 56 keys of 30.

Cells of more than CELL fingerprints, as families of copies fill them, are not paired. Their fingerprints meet anew in a finer
grid, of FINEST groups, as in a large corpus cells are also full by chance. Those in crowded cells there list the points within
one bit; where a point has several, these are linked with the least of them, and so is each that is two bits away. A pair within
three bits has such a point between, so the same fingerprints are connected, with rows in proportion to the fingerprints.

Spark takes exploded rows to be as small as the fingerprints that they come from, so nothing exploded is left to its choice of
join: a broadcast would gather 2,016 points for each fingerprint in the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, staged
from quadrille.llm.near_dup import components
from quadrille.llm.words import long_column, split_lower, text_runs

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer.
LIMIT = 3
GROUPS = 6
#: Fingerprints in crowded cells meet again with so many groups before their points are listed.
FINEST = 8
CELL = 64
#: The first and the second bit of every segment.
FIRST, SECOND = 0x5555555555555555, 0xAAAAAAAAAAAAAAAA - (1 << 64)
#: Shingles hashed at a time, so that a very long text needs no list of all its slices.
PART = 1 << 18
#: For each byte, a number of eight bytes that hold its bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of each run of three words (all words where there are fewer), repeated ones too."""
    words = split_lower(text)
    if not words:
        return np.empty(0, np.uint64)
    joined, k = b" ".join(words), min(SHINGLE, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends, digest = (ends - sizes)[: len(words) - k + 1], ends[k - 1 :], xxhash.xxh64_intdigest
    parts = [np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[i : i + PART].tolist(), ends[i : i + PART].tolist())), np.uint64) for i in range(0, len(starts), PART)]
    return np.concatenate(parts)


def majority(sets: list[np.ndarray]) -> np.ndarray:
    """For each list of hashes the number whose bits are set in over half of them; zero for an empty list."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros(len(sets), np.uint64)
    filled = np.flatnonzero(sizes)
    if not len(filled):
        return out
    flat, sizes = np.concatenate([sets[i] for i in filled]).view(np.uint8).reshape(-1, 8), sizes[filled]
    # Bits are added eight to a number, so at most 255 hashes at once.
    runs = -(-sizes // 255)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    counts = np.stack([np.add.reduceat(LANES[flat[:, k]], cuts).view(np.uint8).reshape(-1, 8) for k in range(8)], axis=1)
    counts = np.add.reduceat(counts.reshape(-1, 64).astype(np.int64), first, axis=0)
    out[filled] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every row. Null and empty texts, or such without words, have zero."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in text_runs(batches):
            sets = [shingle_hashes(t) for t in part["text"].where(part["text"].notna(), None)]
            yield pd.DataFrame({"doc_id": long_column(part["doc_id"]), "fp": majority(sets).view(np.int64)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def embedding(fp: Column) -> Column:
    """The bit counts of the segments in unary: 00, 01 or 11 for none, one and two set bits."""
    least = F.shiftrightunsigned(fp, 1).bitwiseOR(fp).bitwiseAND(F.lit(FIRST))
    return least.bitwiseOR(F.shiftleft(fp, 1).bitwiseAND(fp).bitwiseAND(F.lit(SECOND)))


def apart(a: Column | str, b: Column | str) -> Column:
    """How many bits differ: the Hamming distance of fingerprints, the Manhattan distance of embeddings."""
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def cell_masks(groups: int = GROUPS) -> list[int]:
    """For each choice of groups - LIMIT groups of segments, the bits of these."""
    bits = [sum(3 << 2 * s for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    masks = [sum(chosen) for chosen in combinations(bits, groups - LIMIT)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keyed(nodes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(fp, e, at, cell) for each node and choice of groups."""
    with_e = nodes.select("fp", embedding(F.col("fp")).alias("e"))
    return with_e.select("fp", "e", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in cell_masks(groups)])).alias("at", "cell"))


def crowded_links(nodes: DataFrame) -> DataFrame:
    """(a, b) that connect the same nodes as all pairs within three bits do, by the points between them; every row is such a pair."""
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    near = nodes.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    hubs = staged(near.groupBy("point").agg(F.min("fp").alias("hub"), F.count(F.lit(1)).alias("m")), "op11-points")
    by_one = near.hint("merge").join(hubs.filter("m > 1"), "point").select("fp", "hub")
    pairs = nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    by_two = pairs.select(F.col("fp"), F.col("fp").bitwiseXOR(bit("i").bitwiseOR(bit("j"))).alias("point")).hint("merge").join(hubs, "point").select("fp", "hub")
    return by_one.union(by_two).filter((F.col("fp") != F.col("hub")) & (apart("fp", "hub") <= LIMIT)).distinct().select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def links(nodes: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(a, b): fingerprints within LIMIT bits; between them they connect all that such pairs connect."""
    cells = staged(keyed(nodes, groups).groupBy("at", "cell").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "op11-cells")
    shared = staged(keyed(nodes, groups).hint("merge").join(cells, ["at", "cell"]), "op11-shared")
    sparse = shared.filter(F.col("m") <= CELL).drop("m")
    other = sparse.select("at", "cell", F.col("fp").alias("fp2"), F.col("e").alias("e2"))
    found = sparse.join(other, ["at", "cell"]).filter(F.col("fp") < F.col("fp2")).filter(apart("e", "e2") <= LIMIT).filter(apart("fp", "fp2") <= LIMIT)
    out = found.select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct()
    crowded = staged(shared.filter(F.col("m") > CELL).select("fp").distinct(), "op11-crowded")
    if crowded.isEmpty():
        return out
    return out.union(links(crowded, FINEST) if groups < FINEST else crowded_links(crowded))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row.

    Texts without words have fingerprint zero and are linked like others. Repeated rows share a component. A row without doc_id
    is linked like others; component_id is the least id that can be reached, null where no row there has one.
    """
    rows = staged(fingerprints(docs), "op11-rows")
    nodes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "op11-nodes")
    labels = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    labelled = staged(nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "op11-labelled")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of_node = staged(labelled.join(least, "label").select("fp", "component_id"), "op11-of-node")
    return rows.join(of_node, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
