"""Near duplicates by MinHash with tensored banding.

Two small collections of half bands are computed per set. A table's key joins one half band of each collection, so
HALVES x HALVES tables need only 2 x HALVES x ROWS minhashes: about the square root of what separate tables would. With two rows
per half band and 12 halves, a pair at similarity 0.75 meets in some table with probability 0.9999.

Copies (sets of one 128-bit digest) collapse to one node first. Half bands that only one node has are dropped before keys are
formed, which removes most nodes. In each table bucket every member is compared with the bucket's centre on the full shingle
sets. Two members that the centre did not bring together can only be linked through shingles outside the centre, or by sharing
enough with it: these pairs are found by a prefix filter and compared too. No cap is set on buckets, and no link between
members is lost.

Large families don't meet in one task: the text of a common centre is sent in copies, one for about FAN of its members, and
pairs are dealt by centre and copy. What joins by a centre alone has few rows on one side, read from a written table, so that
Spark can split the other side. Where all that meet have one label already, nothing is joined.
Nodes, links and components stay distributed; each step that is read again is written to the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, staged
from quadrille.llm.words import WordTable, long_column, mixed, split_lower, text_runs, windows

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
#: From this similarity on a centre may be a node's home.
ALIKE = 20
#: Sizes of sets are taken in bands of this ratio; so many bands to either side may still be linked.
BAND, BANDS = 1.1, 4
#: Members that share one copy of their centre's text.
FAN = 64
#: Parts in which the pairs of an end are dealt where its count is looked up.
SALTS = 64
HALVES, ROWS = 12, 2
SEEDS = mixed(np.arange(1, 2 * HALVES * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(table: WordTable, words: list[list[bytes]]) -> list[np.ndarray]:
    """The 64-bit shingles of each text, repeated ones too: runs of five words, or all words where there are fewer."""
    sizes = [len(w) for w in words]
    index = table.indexes([w for ws in words for w in ws])
    flat = table.hashes[index]
    out, at, runs = [], 0, windows(flat, SHINGLE)
    for n in sizes:
        out.append(runs[at : at + n - SHINGLE + 1] if n >= SHINGLE else windows(flat[at : at + n], n) if n else np.empty(0, np.uint64))
        at += n
    table.trim()
    return out


def half_bands(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 2 * HALVES numbers per non-empty set, each from ROWS minhashes."""
    if not sets:
        return np.empty((0, 2 * HALVES), np.int64)
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), 2 * HALVES), np.uint64)
    for i, seed in enumerate(SEEDS):
        x = flat * seed
        least = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
        out[:, i // ROWS] = mixed(out[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (128 bits of the set; null without words), n_shingles, bands of every row."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable()
        for part in text_runs(batches):
            sets = [np.unique(s) for s in shingle_hashes(table, [split_lower(t) for t in part["text"].where(part["text"].notna(), None)])]
            filled = [i for i, s in enumerate(sets) if len(s)]
            bands = half_bands([sets[i] for i in filled])
            node, each = [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(filled):
                node[i] = blake2b(sets[i].tobytes(), digest_size=16).digest()
                each[i] = bands[k]
            yield pd.DataFrame({"doc_id": long_column(part["doc_id"]), "text_key": part["text_key"], "node": pd.Series(node, dtype=object), "n_shingles": [len(s) for s in sets], "bands": pd.Series(each, dtype=object)})

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInPandas(run, "doc_id long, text_key long, node binary, n_shingles long, bands array<long>")


def bucket_pairs(nodes: DataFrame) -> DataFrame:
    """(node, centre, weight) for each member of each tensored table bucket of two nodes or more.

    The centre is the member whose half bands are the most common (its weight), the likeliest origin of the others.
    """
    half = nodes.select("node", F.posexplode("bands").alias("at", "value"))
    shared = half.groupBy("at", "value").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    side = lambda first: F.collect_list(F.when((F.col("at") < HALVES) == first, F.xxhash64("at", "value")))
    per = half.join(shared, ["at", "value"]).groupBy("node").agg(F.sum("c").alias("common"), side(True).alias("a"), side(False).alias("b"))
    keys = per.select("node", "common", "b", F.explode("a").alias("x")).select("node", "common", "x", F.explode("b").alias("y")).select("node", "common", F.xxhash64("x", "y").alias("key"))
    full = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.max(F.struct("common", "node")).alias("top")).filter("m > 1").select("key", F.col("top.node").alias("centre"), F.col("top.common").alias("weight")), "op8-buckets")
    return keys.join(full, "key").filter("node <> centre").select("node", "centre", "weight").distinct()


def word_shingles(text: str) -> set[bytes]:
    """The shingles themselves, so that links rest on no hash."""
    w = split_lower(text)
    return {b" ".join(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


#: The columns that find a node's row again; a missing id counts as 0 and is told by ``no_id``.
ROW = ["no_id", "id", "text_key"]


def row_of(docs: DataFrame) -> list[Column]:
    """ROW of each row of the documents."""
    return [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("text_key")]


def counted(pairs: DataFrame, counts: DataFrame, side: str, other: str, name: str) -> DataFrame:
    """The pairs with the count of their end ``side`` as ``name``, null where it is not in ``counts`` (end, m).

    The join deals an end's pairs in SALTS parts by their other end; counts hold common ends only, so few rows are copied.
    """
    salted = counts.select(F.col("end").alias(side), F.col("m").alias(name), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("long"))
    return dealt.join(salted, [side, "salt"], "left").drop("salt")


def common_ends(ends: DataFrame, name: str) -> DataFrame:
    """(end, m): the ends that more than FAN rows have, and how many."""
    return staged(ends.groupBy("end").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > FAN), name)


def leaning(pairs: DataFrame) -> DataFrame:
    """The pairs, each turned so that its centre is the end that more pairs have: copies of the text go by centres."""
    many = common_ends(pairs.select(F.explode(F.array("node", "centre")).alias("end")), "op8-ends")
    turn = F.coalesce("node_m", F.lit(0)) > F.coalesce("centre_m", F.lit(0))
    both = counted(counted(pairs, many, "node", "centre", "node_m"), many, "centre", "node", "centre_m")
    return both.select(F.when(turn, F.col("centre")).otherwise(F.col("node")).alias("node"), F.when(turn, F.col("node")).otherwise(F.col("centre")).alias("centre"))


def compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Compare the full sets of each pair (node, centre): node, centre, n, centre_n, both, linked, and extra, the hashes of the node's shingles outside the centre.

    Only texts of candidate nodes travel beyond the first join. Pairs are dealt by their centre and a part of its members.
    """
    wanted = pairs.select("node").union(pairs.select("centre")).distinct().join(nodes.select("node", *ROW), "node")
    whole = docs.filter("text IS NOT NULL").select(*row_of(docs), "text")
    # Repeated rows become one again; the grouping keeps the join's partitioning.
    texts = staged(wanted.join(whole, ROW).groupBy(*ROW, "node").agg(F.first("text").alias("text")).select("node", "text"), "op8-texts")
    many = common_ends(pairs.select(F.col("centre").alias("end")), "op8-many")
    fan = F.coalesce(F.ceil(F.col("members") / FAN), F.lit(1)).cast("long")
    placed = counted(pairs.select("node", "centre"), many, "centre", "node", "members").select("node", "centre", F.pmod(F.xxhash64("node"), fan).alias("part"))
    copies = placed.select("centre", "part").distinct().join(texts.select(F.col("node").alias("centre"), F.col("text").alias("centre_text")), "centre")
    sides = placed.join(texts, "node").join(copies, ["centre", "part"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, set()
        for part in text_runs(batches):
            rows = []
            for node, centre, text, centre_text in part[["node", "centre", "text", "centre_text"]].itertuples(index=False):
                if centre != last:  # rows come in order of the centre
                    last, held = centre, word_shingles(centre_text)
                own = word_shingles(text)
                extra = own - held
                n, both = len(own), len(own) - len(extra)
                rows.append((node, centre, n, len(held), both, 100 * both >= PERCENT * (n + len(held) - both), [xxhash.xxh64_intdigest(x) >> 1 for x in extra]))
            yield pd.DataFrame(rows, columns=["node", "centre", "n", "centre_n", "both", "linked", "extra"])

    return sides.mapInPandas(run, "node binary, centre binary, n long, centre_n long, both long, linked boolean, extra array<long>")


def homes(seen: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, home): the heaviest centre that is at all similar to a node, or the home of that, and so on for three steps. Weights rise from step to step."""
    alike = seen.filter(100 * F.col("both") >= ALIKE * (F.col("n") + F.col("centre_n") - F.col("both"))).select("node", "centre")
    first = staged(pairs.join(alike, ["node", "centre"]).groupBy("node").agg(F.max(F.struct("weight", "centre")).alias("top")).select("node", F.col("top.centre").alias("home")), "op8-homes")
    out = first
    for _ in range(2):
        out = out.join(first.select(F.col("node").alias("home"), F.col("home").alias("next")), "home", "left").select("node", F.coalesce("next", "home").alias("home"))
    return out


def least_shared(both: Column, n: Column, other: Column) -> Column:
    """How many shingles outside the centre a link needs at least: overlap must reach PERCENT of the union, and within the centre it is ``both`` at most."""
    return F.greatest(F.ceil(F.lit(PERCENT) * (n + other) / F.lit(100 + PERCENT)).cast("long") - both, F.lit(1).cast("long"))


def leads(open_: DataFrame) -> DataFrame:
    """Prefix filter rows of nodes that share a centre: centre, own and aimed-at size band, shingle, and the node's columns.

    A node's shingles outside the centre are ordered by how many nodes of the centre have them, the rarest first. To link with
    a node of some size it must share so many of them that one is among the first; how many are first depends on the size, so
    each band of sizes has its own prefix. Shingles that no other node has take their places and are left out, and so are those
    whose nodes are in one component.
    """
    keys = ["centre", "node", "n", "both", "linked", "label", "home"]
    each = open_.select(*keys, F.size("extra").alias("n_extra"), F.explode("extra").alias("shingle"))
    common = staged(each.groupBy("centre", "shingle").agg(F.count(F.lit(1)).alias("f"), (F.min("label") != F.max("label")).alias("mixed")).filter("f > 1"), "op8-common")
    shared = each.join(common, ["centre", "shingle"]).groupBy(*keys, "n_extra").agg(F.sort_array(F.collect_list(F.struct("f", "shingle", "mixed"))).alias("shared"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(BAND))).cast("int")
    aimed = shared.withColumn("band", band).withColumn("other", F.explode(F.sequence(band - BANDS, band + BANDS)))
    smallest = F.greatest(F.ceil(F.pow(F.lit(BAND), F.col("other")) - 1e-6).cast("long"), F.ceil(F.col("n") * PERCENT / 100).cast("long"))
    first = F.col("n_extra") - least_shared(F.col("both"), F.col("n"), smallest) + 1 - (F.col("n_extra") - F.size("shared"))
    placed = aimed.withColumn("unshared", F.col("n_extra") - F.size("shared")).select(*keys, "n_extra", "unshared", "band", "other", F.posexplode(F.slice("shared", F.lit(1), F.greatest(first, F.lit(0)).cast("int"))).alias("at", "x"))
    # after: how many shingles of the order are left from this one on. Where all have one label there is nothing to find.
    return placed.filter("x.mixed").select(*keys, "band", "other", F.col("x.shingle").alias("shingle"), (F.col("n_extra") - F.col("unshared") - F.col("at")).cast("long").alias("after"))


def rest_candidates(seen: DataFrame, home: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs that share a centre, are in different components and can still be linked, as (node, centre).

    Of nodes x and y with centre c, at least one is not linked with c. What x and y share is shared with c as well, or lies
    outside c in both. So a link needs enough shingles outside c that both have (found by their leads), or both must share
    enough with c alone. Every pair that passes either test is returned: nothing is capped. A pair with one home is tested at
    home only, as both were compared with it.
    """
    known = seen.join(labels, "node", "left").join(home, "node", "left").select("centre", "node", "n", "both", "linked", "extra", F.coalesce("label", "node").alias("label"), F.coalesce("home", "node").alias("home"))
    mixed_ = staged(known.groupBy("centre").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("centre"), "op8-mixed")
    open_ = staged(known.join(mixed_, "centre"), "op8-open")
    renamed = {"node": "node2", "n": "n2", "label": "label2", "home": "home2", "both": "both2", "linked": "linked2"}
    ends = [F.least("node", "node2").alias("node"), F.greatest("node", "node2").alias("node2")]
    apart = (F.col("node") != F.col("node2")) & (F.col("label") != F.col("label2")) & ((F.col("home") != F.col("home2")) | (F.col("home") == F.col("centre")))
    apart = apart & (100 * F.least("n", "n2") >= PERCENT * F.greatest("n", "n2"))
    rows = staged(leads(open_), "op8-leads")
    other = rows.select("centre", "shingle", F.col("band").alias("other"), F.col("other").alias("band"), F.col("after").alias("after2"), *(F.col(a).alias(b) for a, b in renamed.items()))
    # The first shingle that a linked pair shares leaves as many in both orders as the pair must share; its actual sizes say how many.
    enough = F.least("after", "after2") >= least_shared(F.least("both", "both2"), F.col("n"), F.col("n2"))
    by_lead = rows.filter("NOT linked").join(other, ["centre", "shingle", "band", "other"]).filter(apart & enough).select(*ends).distinct()
    room = lambda both, n: F.floor((100 + PERCENT) * F.col(both) / F.lit(PERCENT)).cast("long") - F.col(n)
    # By size bands, and only into bands that hold another component.
    banded = open_.drop("extra").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(BAND))).cast("int"))
    spread = staged(banded.groupBy("centre", "band").agg(F.min("n").alias("least_n"), F.min("label").alias("lo"), F.max("label").alias("hi")), "op8-spread")
    aimed = banded.filter("NOT linked").withColumn("band", F.explode(F.sequence(F.col("band") - BANDS, F.col("band") + BANDS)))
    roomy = staged(aimed.join(spread, ["centre", "band"]).filter((room("both", "n") >= F.col("least_n")) & ((F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label")))).drop("least_n", "lo", "hi"), "op8-roomy")
    by_centre = roomy.join(banded.withColumnsRenamed(renamed), ["centre", "band"]).filter(apart & (F.col("n2") <= room("both", "n")) & (F.col("n") <= room("both2", "n2"))).select(*ends).distinct()
    return by_lead.union(by_centre).distinct().select("node", F.col("node2").alias("centre"))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the component's least node.

    Alternates two steps on edges until they stay the same: each node's larger neighbours, then its smaller ones, are hung on
    the least neighbour. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "op8-edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join can split a node with very many neighbours.
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "op8-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = staged(hung.distinct(), "op8-edges")
        now = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)))
        now = tuple(now.collect()[0])
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links: components of the labels that these join, which are few."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
    root = components(joined.distinct()).select(F.col("node").alias("label"), F.col("label").alias("root"))
    moved = labels.join(root, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return moved.union(root.select(F.col("label").alias("node"), "root").join(labels, "node", "left_anti"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null and empty texts, or such without words, have no set, form their own component and are kept. Repeated rows share a
    component. A row without doc_id is linked like others; its component is the least id in it, and null where there is none:
    then it is kept, as no id tells it from the others (``one_of_each`` keeps one of them).
    """
    found = grouped(docs)
    return found.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, and first_key: the text key of the component's first row (by id, then key)."""
    rows = staged(signatures(docs), "op8-rows")
    of_row = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("text_key"))
    nodes = staged(rows.filter("node IS NOT NULL").groupBy("node").agg(F.min(of_row).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands")).select("node", "row.*", "n_shingles", "bands"), "op8-nodes")
    pairs = staged(bucket_pairs(nodes), "op8-pairs")
    seen = staged(compared(pairs.select("node", "centre"), nodes, docs), "op8-compared")
    home = staged(homes(seen, pairs), "op8-home")
    farther = staged(home.filter("node <> home").select("node", F.col("home").alias("centre")).join(pairs, ["node", "centre"], "left_anti"), "op8-farther")
    if not farther.isEmpty():
        seen = seen.union(staged(compared(farther, nodes, docs), "op8-compared"))
    links = seen.filter("linked").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    labels = components(links)
    rest = staged(rest_candidates(seen, home, labels), "op8-rest")
    if not rest.isEmpty():
        more = staged(compared(staged(leaning(rest), "op8-leaning"), nodes, docs).filter("linked").select(F.col("node").alias("a"), F.col("centre").alias("b")), "op8-more")
        if not more.isEmpty():
            labels = staged(merged(labels, more), "op8-labels")
    own = nodes.select("node", F.struct(*ROW).alias("own"))
    labelled = labels.join(own, "node").select("label", "node", "own")
    least = staged(labelled.groupBy("label").agg(F.min("own").alias("first")), "op8-firsts")
    of_node = staged(own.join(labelled.select("node", "label").join(least, "label").select("node", "first"), "node", "left").select("node", F.coalesce("first", "own").alias("first")), "op8-of-node")
    placed = rows.drop("bands").join(of_node, "node", "left")
    first_id = F.when(F.col("first").isNull(), F.col("doc_id")).when(~F.col("first.no_id"), F.col("first.id"))
    return placed.select("doc_id", "text_key", "n_shingles", first_id.alias("component_id"), F.coalesce("first.text_key", "text_key").alias("first_key"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least doc_id (of equal ids the least hash of the text), once.

    Rows without doc_id come last in a component: one stays where no row has an id. Null and empty texts, or such without words, stay,
    of rows with equal id and text one.
    """
    found = staged(grouped(docs), "op8-found")
    first = found.filter("text_key = first_key AND doc_id <=> component_id").select(F.col("doc_id").isNull().alias("__no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("__id"), F.col("text_key").alias("__key")).distinct()
    no_id, id_, key = row_of(docs)
    keyed = docs.select("*", no_id.alias("__no_id"), id_.alias("__id"), key.alias("__key"))
    names = ["__no_id", "__id", "__key"]
    return keyed.join(first, names, "left_semi").dropDuplicates(names).select(*docs.columns)
