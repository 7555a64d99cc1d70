"""The prefix trie of conversations, by a merge sort that carries common prefixes.

Turns become digests, a conversation a list of them. Lists are dealt to tasks by ranges of their order (ids last, so that a
common conversation spans tasks). A task sorts runs of bounded size; each entry keeps its LCP, the number of leading turns that
it shares with the one before. A loser tree merges the runs: where two entries share less with the last winner than others do,
their LCPs alone decide, so no shared turn is compared again. The merged stream keeps the path of open nodes on a stack: an entry
closes what lies deeper than its LCP, and a closed node is finished.

Nodes on the path of a task's first or last entry may go on in other tasks. These, at most two paths a task, come out as parts:
sums over what is closed, which are added up by node; what hangs below is added to all nodes above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, staged
from quadrille.llm.words import long_column

#: Conversations share heads in groups of so many ids; heads have fewer than HEADS turns.
GROUP, HEADS = 5, 9
#: Conversations in a sorted run, turns for which a task is meant, ids in a row of a node's ends, rows returned at a time.
RUN, PART, ENDS, ROWS = 4_000, 100_000, 4_096, 10_000
CLOSED, WAITING, OPEN, END_IDS = range(4)
SCHEMA = "kind int, id binary, parent_id binary, above array<binary>, depth long, size long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct key, size) of every conversation: the head of its group's first one, then its own turns after the head."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    head = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % HEADS
    placed = rows.select("conv_id", at.alias("at"), key.alias("key"), F.octet_length("text").cast("long").alias("size"), head("conv_id").alias("head"))
    # A first row without a turn tells that the conversation exists.
    own = placed.filter("at >= head OR at = 0").select("conv_id", F.lit(True).alias("own"), F.when(F.col("at") >= F.col("head"), F.struct(F.lit(1).alias("part"), "at", "key", "size")).alias("turn"))
    lo, hi = F.when(F.col("conv_id") > 0, 0).otherwise(1 - GROUP), F.when(F.col("conv_id") < 0, 0).otherwise(GROUP - 1)
    served = placed.filter((F.col("at") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).select(F.explode(F.sequence(lo, hi)).alias("k"), "*").select(F.try_add("conv_id", "k").alias("conv_id"), "at", "key", "size").filter("conv_id IS NOT NULL")
    heads = served.filter(F.col("at") < head("conv_id")).select("conv_id", F.lit(False).alias("own"), F.struct(F.lit(0).alias("part"), "at", "key", "size").alias("turn"))
    whole = own.unionByName(heads).groupBy("conv_id").agg(F.max("own").alias("own"), F.sort_array(F.collect_list("turn")).alias("turns")).filter("own")
    return whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def sorted_run(entries: list[tuple[list[bytes], int, list[int]]]) -> list[tuple[int, list[bytes], int, list[int]]]:
    """(LCP with the one before, what follows it, id, sizes) of entries (keys, id, sizes) in order."""
    entries.sort(key=lambda e: e[:2])
    out, last = [], []
    for keys, conv, sizes in entries:
        lcp, most = 0, min(len(keys), len(last))
        while lcp < most and keys[lcp] == last[lcp]:
            lcp += 1
        out.append((lcp, keys[lcp:], conv, sizes))
        last = keys
    return out


def merged(runs: list[list[tuple]]) -> Iterator[tuple[int, list[bytes], int, list[int]]]:
    """(LCP with the one before, keys, id, sizes) of all entries of the runs in order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    feeds = [iter(r) for r in runs] + [iter(())] * (k - len(runs))
    heads: list[tuple | None] = [None] * k
    shared = [0] * k  # how much each head shares with the winner that it lost to, or with the last one given out

    def advance(i: int) -> None:
        entry = next(feeds[i], None)
        if entry is None:
            heads[i] = None
        else:
            lcp, rest, conv, sizes = entry
            heads[i] = ((heads[i][0][:lcp] if lcp else []) + rest, conv, sizes)
            shared[i] = lcp

    def play(i: int, j: int) -> tuple[int, int]:
        """(winner, loser) of two heads; the loser's share is set to what it has in common with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return (i, j) if b is None else (j, i)
        if shared[i] != shared[j]:
            return (i, j) if shared[i] > shared[j] else (j, i)
        x, y, at = a[0], b[0], shared[i]
        most = min(len(x), len(y))
        while at < most and x[at] == y[at]:
            at += 1
        first = x[at] < y[at] if at < most else (len(x), a[1]) < (len(y), b[1])
        shared[j if first else i] = at
        return (i, j) if first else (j, i)

    for i in range(k):
        advance(i)
    lost, won = [0] * k, [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        won[node], lost[node] = play(won[2 * node], won[2 * node + 1])
    best = won[1] if k > 1 else 0
    while heads[best] is not None:
        keys, conv, sizes = heads[best]
        yield shared[best], keys, conv, sizes
        advance(best)
        node = (best + k) // 2
        while node:
            best, lost[node] = play(best, lost[node])
            node //= 2


class Node:
    """An open node: sums over its members so far, and the finished nodes right below it that wait for its smallest member."""

    __slots__ = ("children", "conv", "convs", "depth", "edge", "ends", "id", "leaves", "saved", "size", "waiting")

    def __init__(self, depth: int, id_: bytes, size: int, edge: bool) -> None:
        self.depth, self.id, self.size, self.edge = depth, id_, size, edge
        self.conv, self.convs, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends: list[int] = []
        self.waiting: list[list] = []


def id_rows(node: Node) -> Iterator[list]:
    """The ids that end in a node that other tasks may have too, ENDS to a row, each with its first id."""
    for i in range(0, len(node.ends), ENDS):
        part = node.ends[i : i + ENDS]
        yield [END_IDS, node.id, None, None, None, None, part[0], None, None, None, None, None, ",".join(map(str, part))]


def nodes_of(entries: Iterator[tuple[int, list[bytes], int, list[int]]]) -> Iterator[list]:
    """The rows (SCHEMA) of all nodes that the sorted entries pass."""
    path: list[Node] = []

    def close(edge: bool) -> Iterator[list]:
        node = path.pop()
        above = path[-1] if path else None
        if above:
            above.convs += node.convs
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        parent_id = above.id if above else None
        if node.edge or edge:
            for row in node.waiting:
                row[0] = WAITING
                yield row
            yield [OPEN, node.id, parent_id, [n.id for n in path], node.depth, node.size, node.conv, None, node.convs, node.children, node.leaves, node.saved, None]
            yield from id_rows(node)
            return
        for row in node.waiting:
            row[7] = node.conv
            yield row
        leaves, saved = node.leaves or 1, node.saved + (node.convs - 1) * node.size
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        row = [CLOSED, None, parent_id, None, node.depth, None, node.conv, None, node.convs, node.children, leaves, saved, sha256(",".join(map(str, node.ends)).encode()).hexdigest()]
        if above.edge:
            row[0] = WAITING
            yield row
        else:
            above.waiting.append(row)

    for lcp, keys, conv, sizes in entries:
        edge = not path
        if edge:
            path.append(Node(0, b"", 0, True))
        while path[-1].depth > lcp:
            yield from close(False)
        for d in range(lcp, len(keys)):
            path.append(Node(d + 1, blake2b(path[-1].id + keys[d], digest_size=16).digest(), sizes[d], edge))
        end = path[-1]
        end.convs += 1
        end.conv = conv if end.conv is None else min(end.conv, conv)
        end.ends.append(conv)
    while path:
        yield from close(True)


def batches_of(rows: Iterator[list]) -> Iterator[pd.DataFrame]:
    """Rows of SCHEMA as frames of ROWS."""
    while part := [row for row, _ in zip(rows, range(ROWS))]:
        frame = pd.DataFrame(part, columns=NAMES, dtype=object)
        for name in ("depth", "size", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"):
            frame[name] = long_column(frame[name])
        yield frame.astype({"kind": "int32"})


def parts(lists: DataFrame, run: int = RUN) -> DataFrame:
    """The nodes (SCHEMA) that each task finds; lists are dealt by ranges of their order."""
    spark = lists.sparkSession
    bound_batches(spark)
    turns = lists.agg(F.sum(F.size("turns") + 1)).collect()[0][0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // PART))
    flat = lists.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.size").alias("sizes"))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = []
        for batch in batches:
            entries = [(list(k), c, list(s)) for k, c, s in zip(batch["keys"], batch["conv_id"].tolist(), batch["sizes"])]
            runs += [sorted_run(entries[i : i + run]) for i in range(0, len(entries), run)]
        yield from batches_of(nodes_of(merged(runs)))

    return flat.repartitionByRange(n, "keys", "conv_id").mapInPandas(task, SCHEMA)


def ends_digest(found: DataFrame) -> DataFrame:
    """(id, ends_sha256) of nodes whose end ids come in rows: rows of a node stream in order of their first id."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, digest, done = None, None, []
        for batch in batches:
            for id_, ids in zip(batch["id"], batch["ends"]):
                if id_ == last:
                    digest.update(b",")
                else:
                    if digest:
                        done.append((last, digest.hexdigest()))
                    last, digest = id_, sha256()
                digest.update(ids.encode())
            if len(done) >= ROWS:
                yield pd.DataFrame(done, columns=["id", "ends_sha256"])
                done = []
        if digest:
            done.append((last, digest.hexdigest()))
        if done:
            yield pd.DataFrame(done, columns=["id", "ends_sha256"])

    rows = found.filter(F.col("kind") == END_IDS).select("id", F.col("conv_id").alias("first"), "ends")
    return rows.repartition("id").sortWithinPartitions("id", "first").select("id", "ends").mapInPandas(task, "id binary, ends_sha256 string")


def trie(lists: DataFrame, run: int = RUN) -> DataFrame:
    """The nodes of the trie of (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found = staged(parts(lists, run), "op13-parts")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    open_ = found.filter(F.col("kind") == OPEN).groupBy("id").agg(F.min("conv_id").alias("conv_id"), *(F.first(c).alias(c) for c in ("parent_id", "above", "depth", "size")), *sums)
    below = open_.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("open_children"))
    counted = open_.join(below, "id", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0)))
    own = staged(counted.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")}), "op13-open")
    totals = own.select(F.explode(F.concat("above", F.array("id"))).alias("id"), "n_leaves", "saved_tokens").groupBy("id").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    parent = own.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    edges = own.drop("n_leaves", "saved_tokens").join(totals, "id").join(ends_digest(found), "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).join(parent, "parent_id", "left")
    closed = found.withColumnRenamed("ends", "ends_sha256")
    waiting = closed.filter(F.col("kind") == WAITING).drop("parent_conv_id").join(parent, "parent_id")
    return closed.filter(F.col("kind") == CLOSED).select(*columns).union(waiting.select(*columns)).union(edges.select(*columns))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node.

    Rows without conv_id belong to no conversation and are left out. Turns of equal number (or without one) are ordered by role,
    then text; null role and text are empty. Without conversations there is no node. An id's group starts at ``id - id % 5`` with
    the sign of SQL's remainder. A conversation is one row while it is sorted: 40 bytes for each of its turns.
    """
    return trie(staged(rebuilt(conversations), "op13-lists"))
