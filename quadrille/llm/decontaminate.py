"""Benchmark decontamination by templates.

Words become canonical: numbers, units after numbers, and names turn into typed placeholders. Runs of WINDOW canonical words
of the benchmark are hashed, and every run of every document is held against them; plain runs (no placeholders) are hashed
too, so that a change of case hides nothing, and runs where names at the start of sentences are placeholders as well. Documents
and items that share a window meet in a join by its hash. Hits are confirmed word by word, extended to both sides, and put
together per item: the share of the item's words that are covered must reach COVER, enough of them as they are, and its slots
must be filled consistently (in an occurrence, one value of the item stands for one value of the document and the other way
round), which tells a question with new numbers from chance. A long verbatim run is enough by itself. Items of few words are
found verbatim only, as wholes.

Nearly all windows of documents are in no item. A Bloom filter of the benchmark's windows, of BLOOM_BITS at most, is built in
Spark and sent to every task, so only windows that pass it are joined; if a huge benchmark fills it, more windows are joined and
the result is the same. The benchmark itself never meets in one place.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, staged
from quadrille.llm.words import long_column, mixed, text_runs, windows

WINDOW = 8
#: The least share of an item's covered words that must be the same words and no slots, unless all are the same, and their number.
SAME, SAME_WORDS = 0.3, 3
#: So many consecutive words of an item are reported whatever share of it they are.
VERBATIM = 13
COVER = 0.5
#: The least share of an occurrence's slots that pair one value of the item with one value of the document.
CONSISTENT = 0.8
#: An item with fewer words is looked for verbatim; one with fewer than WINDOW is looked for as a whole.
LEAST_WORDS = 4
#: Bits of the filter at least, for each window, and at most; probes of a window; bits of a part that is built at once.
BLOOM_LEAST, BLOOM_EACH, BLOOM_BITS, PROBES, PART = 1 << 23, 64, 1 << 28, 4, 1 << 20
#: Rows of a table that may be sent to all tasks; a larger one is joined by shuffles.
SENT_ROWS = 500_000
#: Units, taken as such after a number.
UNITS = frozenset("mm cm m km in inch inches ft feet yd yard yards mi mile miles mg g kg lb lbs oz ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent % kmh mph km/h hz khz mhz ghz w kw v volt volts a amp amps °c °f degrees".split())
NUMBER = re.compile(r"[$€£+-]?[0-9][0-9.,:/]*(?:st|nd|rd|th|%)?")
EDGE = re.compile(r"^[^\w$€£+%°-]+|[^\w%°]+$")
LITERAL, NUM, UNIT, NAME = range(4)
MARKS = np.array([0, 0xA5A5_0001_9E37_79B9, 0xA5A5_0002_9E37_79B9, 0xA5A5_0003_9E37_79B9], np.uint64)
KEEP = 400_000


class Canon(dict):
    """Raw word to its index; per index the plain hash, what it may be, and whether it ends a sentence."""

    def __init__(self) -> None:
        super().__init__()
        self.plain: list[str] = []
        self.kinds: list[int] = []
        self.stops: list[bool] = []
        self.hashes, self.may_be, self.ends = np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, bool)

    def __missing__(self, word: str) -> int:
        self[word] = index = len(self.plain)
        if word.isalpha() and word.islower():
            plain, kind = word, UNIT if word in UNITS else LITERAL
        else:
            core = EDGE.sub("", word)
            plain = core.lower() or word
            kind = NUM if NUMBER.fullmatch(core) else UNIT if plain in UNITS else NAME if core[:1].isupper() else LITERAL
        self.plain.append(plain)
        self.kinds.append(kind)
        self.stops.append(word[-1] in ".!?:")
        return index

    def read(self, words: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(index, plain hash, kind, kind with names at the start of sentences) of each word of texts that begin at ``starts``."""
        index = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        known = len(self.hashes)
        if known < len(self.plain):
            new = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in self.plain[known:]]
            self.hashes = np.append(self.hashes, np.array(new, np.uint64))
            self.may_be, self.ends = np.append(self.may_be, np.array(self.kinds[known:], np.int8)), np.append(self.ends, np.array(self.stops[known:], bool))
        kind = self.may_be[index]
        before_ends, before_num = np.ones(len(index), bool), np.zeros(len(index), bool)
        before_ends[1:], before_num[1:] = self.ends[index[:-1]], kind[:-1] == NUM
        first = starts[starts < len(index)]
        before_ends[first], before_num[first] = True, False
        kind[(kind == UNIT) & ~before_num] = LITERAL
        named = kind.copy()
        kind[(kind == NAME) & before_ends] = LITERAL
        return index, self.hashes[index], kind, named

    def trim(self) -> None:
        if len(self.plain) > KEEP:
            self.clear()
            self.__init__()


def template(plain: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return np.where(kind == LITERAL, plain, MARKS[kind])


def forms(plain: np.ndarray, kind: np.ndarray, named: np.ndarray, k: int) -> list[np.ndarray]:
    """The hashes of all runs of k words: of the template, of that with names at sentence starts, and plain."""
    return [windows(template(plain, kind), k), windows(template(plain, named), k), windows(plain, k)]


def item_windows(items: DataFrame) -> DataFrame:
    """(h, k, item, at) of every window of the items; an item of fewer than WINDOW words has one, of all its words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        for part in text_runs(batches):
            rows = []
            for item, text in zip(part["item"], part["text"], strict=True):
                _, plain, kind, named = canon.read(text.split(), np.zeros(1, np.int64))
                n, k = len(plain), min(len(plain), WINDOW)
                if not n:
                    continue
                # A run of placeholders alone says nothing by itself; extension reaches it from its neighbours.
                some = lambda kinds: (np.convolve(kinds == LITERAL, np.ones(k, int), "valid") > 0) & (n >= LEAST_WORDS)  # noqa: E731, B023
                for hashes, fits in zip(forms(plain, kind, named, k), (some(kind), some(named), np.ones(n - k + 1, bool)), strict=True):
                    rows += [(int(h), k, item, at) for at, h in zip(np.flatnonzero(fits).tolist(), hashes[fits].view(np.int64).tolist(), strict=True)]
            canon.trim()
            yield pd.DataFrame(rows, columns=["h", "k", "item", "at"])

    return items.select("item", "text").mapInPandas(run, "h long, k int, item long, at int").distinct()


def probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The filter's bits for each hash."""
    for i in range(1, PROBES + 1):
        yield (mixed(h.view(np.uint64) + np.uint64(i)) & np.uint64(bits - 1)).astype(np.int64)


def bloom(index: DataFrame) -> tuple[int, dict[int, bytes]]:
    """The filter of all windows: its bits, and its parts that are not empty. Parts are built in tasks; BLOOM_BITS bound what reaches the driver."""
    bits = BLOOM_LEAST
    while bits < min(BLOOM_BITS, BLOOM_EACH * index.count()):
        bits *= 2

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"bit": np.unique(np.concatenate(list(probes(part["h"].to_numpy(np.int64), bits))))})

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(PART, np.uint8)
        marks[rows["bit"].to_numpy() % PART] = 1
        return pd.DataFrame({"part": [int(rows["bit"].iloc[0]) // PART], "marks": [np.packbits(marks).tobytes()]})

    rows = index.select("h").mapInPandas(spread, "bit long").distinct().groupBy((F.col("bit") / PART).cast("long")).applyInPandas(build, "part long, marks binary")
    return bits, {r["part"]: bytes(r["marks"]) for r in rows.collect()}


class Filter:
    """The filter as one array of bytes."""

    def __init__(self, bits: int, parts: dict[int, bytes]):
        self.bits, self.marks = bits, np.zeros(bits // 8, np.uint8)
        for at, marks in parts.items():
            self.marks[at * PART // 8 : (at + 1) * PART // 8] = np.frombuffer(marks, np.uint8)

    def may_have(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be windows of items."""
        at = np.arange(len(h))
        for i in range(1, PROBES + 1):
            bit = mixed(h[at] + np.uint64(i)) & np.uint64(self.bits - 1)
            at = at[(self.marks[bit >> np.uint64(3)] >> (7 - (bit & np.uint64(7))).astype(np.uint8)) & 1 == 1]
        return at


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with ROW, which says what text they are; a missing id counts as 0 and is told by ``__no_id``."""
    return docs.select("*", F.col("doc_id").isNull().alias("__no_id"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("__id"), F.xxhash64("text").alias("__key"))


ROW = ["__no_id", "__id", "__key"]


def document_hits(docs: DataFrame, filter_: tuple[int, dict[int, bytes]], sizes: list[int]) -> DataFrame:
    """doc_id and ROW of every row; where windows pass the filter, also the text and the windows' places, sizes and hashes."""
    held = docs.sparkSession.sparkContext.broadcast(filter_)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon, known = Canon(), Filter(*held.value)
        for part in text_runs(batches):
            texts = part["text"].where(part["text"].notna(), "").tolist()
            split = [t.split() for t in texts]
            n_words = np.array([len(w) for w in split], np.int64)
            starts = np.cumsum(n_words) - n_words
            _, plain, kind, named = canon.read([w for ws in split for w in ws], starts)
            found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
            for k in sizes:
                for hashes in forms(plain, kind, named, k):
                    at = known.may_have(hashes)
                    text = np.searchsorted(starts, at, side="right") - 1
                    inside = at + k <= starts[text] + n_words[text]  # windows across two texts don't count
                    for i, t, h in zip((at - starts[text])[inside].tolist(), text[inside].tolist(), hashes[at][inside].view(np.int64).tolist(), strict=True):
                        found[t].append((i, k, h))
            canon.trim()
            hits = [sorted(set(found.get(i, ()))) for i in range(len(texts))]
            yield pd.DataFrame({"doc_id": long_column(part["doc_id"]), **{c: part[c] for c in ROW}, "text": [t if h else None for t, h in zip(texts, hits, strict=True)], "hits": hits})

    return docs.select("doc_id", *ROW, "text").mapInPandas(run, "doc_id long, __no_id boolean, __id long, __key long, text string, hits array<struct<i:int,k:int,h:long>>")


class Text:
    """The words of a text as they compare."""

    def __init__(self, text: str, canon: Canon):
        index, _, self.kind, self.named = canon.read(text.split(), np.zeros(1, np.int64))
        self.words = [canon.plain[i] for i in index]
        canon.trim()


def consistent(pairs: list[tuple[str, str]]) -> int:
    """How many slots of one occurrence, as (item's value, document's value), agree with the others both ways: the value most often met by each, and by each met."""
    return min(sum(max(c.values()) for c in side.values()) for side in (_counts(pairs), _counts([(b, a) for a, b in pairs]))) if pairs else 0


def _counts(pairs: list[tuple[str, str]]) -> dict[str, Counter]:
    out: dict[str, Counter] = defaultdict(Counter)
    for a, b in pairs:
        out[a][b] += 1
    return out


def judge(doc: Text, item: Text, places: list[tuple[int, int, int]]) -> tuple[float, bool] | None:
    """The share of an item's words that a text covers, and whether slots were filled anew; None where it is not found.

    ``places``: (place in the text, place in the item, words) of their common windows. A hit places the whole item against the
    text: the words around it that match as well belong to it, and make an occurrence.
    """
    n = len(item.words)
    spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, at, k in sorted(places):
        shift, last = i - at, spans[i - at]
        if last and at + k <= last[-1][1]:
            continue
        fits = lambda j: doc.words[shift + j] == item.words[j] or (doc.named[shift + j] == item.named[j] != LITERAL) or (doc.kind[shift + j] == item.kind[j] != LITERAL)  # noqa: E731, B023
        if n < LEAST_WORDS and doc.words[i : i + k] != item.words or not all(map(fits, range(at, at + k))):
            continue
        start, end = at, at + k
        while start > max(0, -shift) and fits(start - 1):
            start -= 1
        while end < min(n, len(doc.words) - shift) and fits(end):
            end += 1
        last.append((start, end))
    cover: set[int] = set()
    same = longest = slots = agree = 0
    anew = False
    for shift, found in sorted(spans.items(), key=lambda x: (-sum(e - s for s, e in x[1]), x[0])):  # the fullest occurrence first
        filled = []
        for start, end in found:
            run = 0
            for j in range(start, end):
                a, b = doc.words[shift + j], item.words[j]
                run = run + 1 if a == b else 0
                longest = max(longest, run)
                if j in cover:
                    continue
                cover.add(j)
                if item.kind[j] != LITERAL or a != b:
                    filled.append((b, a))
                else:
                    same += 1
        slots, agree = slots + len(filled), agree + consistent(filled)
        anew = anew or any(a != b for a, b in filled)
    if not cover:
        return None
    likely = not anew or same >= max(SAME_WORDS, SAME * len(cover))
    share = len(cover) / n
    return (share, anew) if share >= COVER and agree >= CONSISTENT * slots and likely or longest >= VERBATIM else None


def sent(table: DataFrame, rows: int) -> DataFrame:
    """The table, to be sent to all tasks if it has no more than SENT_ROWS rows; else Spark joins by shuffles and splits what is uneven."""
    return F.broadcast(table) if rows <= SENT_ROWS else table


def matches(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id and ROW of every row of ``docs`` (with ROW); and of the rows that contain items: ROW, items, coverage, reparameterised."""
    bound_batches(docs.sparkSession)
    items = staged(benchmark.filter("text IS NOT NULL").select("item_id", "text", F.xxhash64("item_id", "text").alias("item")).distinct(), "op9-items")
    index = staged(item_windows(items), "op9-windows")
    sizes = sorted(r["k"] for r in index.select("k").distinct().collect())  # 1 to WINDOW
    seen = staged(document_hits(docs, bloom(index), sizes), "op9-hits")
    near = staged(seen.filter(F.size("hits") > 0).dropDuplicates(ROW), "op9-near")
    places = near.select(*ROW, F.explode("hits").alias("x")).select(*ROW, "x.*").join(sent(index, index.count()), ["h", "k"])
    pairs = places.groupBy(*ROW, "item").agg(F.collect_set(F.struct("i", "at", "k")).alias("places"))
    both = pairs.join(near.select(*ROW, "text"), ROW).join(sent(items.withColumnRenamed("text", "item_text"), items.count()), "item")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon, last, text = Canon(), None, None
        for part in text_runs(batches):
            rows = []
            for *row, item_id, whole, item_text, found in part[[*ROW, "item_id", "text", "item_text", "places"]].itertuples(index=False):
                if row != last:
                    last, text = row, Text(whole, canon)
                verdict = judge(text, Text(item_text, canon), [(p["i"], p["at"], p["k"]) for p in found])
                if verdict:
                    rows.append((*row, None if pd.isna(item_id) else int(item_id), *verdict))
            out = pd.DataFrame(rows, columns=[*ROW, "item_id", "coverage", "reparameterised"])
            yield out.assign(item_id=out["item_id"].astype(object).where(out["item_id"].notna(), None))

    found = both.mapInPandas(run, "__no_id boolean, __id long, __key long, item_id long, coverage double, reparameterised boolean")
    # An item without id counts as item -1.
    each = found.groupBy(*ROW).agg(F.sort_array(F.collect_set(F.coalesce("item_id", F.lit(-1).cast("long")))).alias("items"), F.max("coverage").alias("coverage"), F.max("reparameterised").alias("reparameterised"))
    return seen.select("doc_id", *ROW), staged(each, "op9-found")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of ``docs`` with the items it contains: doc_id, contaminated, n_items, items, coverage, reparameterised.

    Null and empty texts contain nothing, nor does anything contain a null or empty item; repeated rows repeat; an item without id
    is given as -1; columns other than doc_id and text are not read.
    """
    rows, found = matches(keyed(docs.select("doc_id", "text")), benchmark)
    out = rows.join(sent(found, found.count()), ROW, "left")
    items = F.coalesce("items", F.array().cast("array<bigint>"))
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.size(items).cast("long").alias("n_items"), items.alias("items"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns. Null and empty texts stay; repeated rows stay or go together."""
    _, found = matches(keyed(docs.select("doc_id", "text")), benchmark)
    return keyed(docs).join(sent(found.select(*ROW), found.count()), ROW, "left_anti").select(*docs.columns)
