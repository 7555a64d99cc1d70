"""Phrase collocations: frequent phrases by pivot partitioning, scored against their weakest cut.

Words that are too rare separate, and so do pairs of neighbours that are too rare. Around each word, the pivot, stands a fragment:
what can be reached to both sides without meeting a rarer word, four words at most. A phrase belongs to the fragments of its
rarest word (of equal ones the first), so each occurrence is in one fragment as its own. Fragments go to their pivot, equal ones
with a number, all of a worker's in one row; there the phrases that hold the pivot are counted, and only the frequent ones come
out. Pivots with more than PART words are dealt in parts by fragment, and their counts are added up.

What tasks must know of all words is bounded: the order of words and the rare ones come from TABLE counters by hash, which hold
the count of the most frequent word there; rare pairs from a bitmap. Clashes in these keep more fragments, and change no result:
phrases are counted as they are, and every task orders words alike.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, staged
from quadrille.llm.words import MIX, WordTable, mixed, text_runs

#: Phrases of 2 to LONGEST words with LEAST occurrences; each language's first TOP are returned.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Bits of a hash that find a word's counter (16 MB in all), and a pair's bit (4 MB).
TABLE, PAIRS = 22, 25
#: Occurrences of a pivot that are mined at once; fragments in a row.
PART, ROW = 500_000, 5_000
#: Entries that a worker holds before it gives them out; words that it knows, of all languages; fragments that it puts in one frame.
HELD, KNOWN, FRAME = 400_000, 150_000, 50_000
NO_LANG = "und"
MARK = b"\xff"
SEPARATORS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", MARK * 10)


def tokens(texts: list[str | None]) -> list[bytes]:
    """The words of all texts in order, A-Z lowered, with MARK (no UTF-8 has it) where a piece ends."""
    joined = MARK.join(t.encode("utf-8", "surrogatepass") for t in texts if t)
    return joined.lower().translate(SEPARATORS).replace(MARK, b" \xff ").split()


def by_lang(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, tokens) in runs of bounded size."""
    for part in text_runs(batches):
        part = part[part["text"].notna()]
        for lang, rows in part.groupby(part["lang"].fillna(NO_LANG)):
            yield lang, tokens(rows["text"].tolist())


class Words:
    """The tokens' 64 bits, which differ by language. One table has the words of all languages, and starts anew beyond KNOWN."""

    def __init__(self) -> None:
        self.table = WordTable()

    def hashes(self, lang: str, words: list[bytes]) -> np.ndarray:
        index = self.table.indexes(words)
        out = mixed(self.table.hashes[index] ^ np.uint64(xxhash.xxh64_intdigest(lang)))
        if len(self.table) > KNOWN:
            self.table = WordTable()
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, f) of every distinct word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pd.DataFrame]:
            for lang, counts in held.items():
                counts.pop(MARK, None)
                words = list(counts)
                for i in range(0, len(words), 50_000):
                    part = words[i : i + 50_000]
                    yield pd.DataFrame({"lang": lang, "word": [w.decode("utf-8", "surrogatepass") for w in part], "hash": Words().hashes(lang, part).view(np.int64), "n": [counts[w] for w in part]})
            held.clear()

        for lang, words in by_lang(batches):
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    counts = docs.select("lang", "text").mapInPandas(run, "lang string, word string, hash long, n long")
    return counts.groupBy("lang", "word", "hash").agg(F.sum("n").alias("f"))


def counters(words: DataFrame) -> np.ndarray:
    """For each counter the count of its most frequent word of LEAST at least, else 0: TABLE bits of numbers, whatever the corpus."""
    slot = F.shiftrightunsigned("hash", 64 - TABLE)
    rows = words.filter(F.col("f") >= LEAST).groupBy(slot.alias("slot")).agg(F.least(F.max("f"), F.lit(2**32 - 1)).alias("f")).toArrow()
    out = np.zeros(1 << TABLE, np.uint32)
    out[rows["slot"].to_numpy()] = rows["f"].to_numpy()
    return out


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    """64 bits for each two neighbours."""
    return mixed(hashes[:-1] * np.uint64(MIX[0]) + hashes[1:])


def counted_pairs(docs: DataFrame, known) -> DataFrame:
    """(pair, n): how often two neighbours stand together, by hash; such of frequent words only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, held, size = Words(), [], 0

        def out() -> Iterator[pd.DataFrame]:
            # Sorted in place: np.unique would hold several copies.
            flat = np.concatenate(held)
            held.clear()
            flat.sort()
            first = np.append(np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)]), len(flat))
            for i in range(0, len(first) - 1, 500_000):
                some = first[i : i + 500_001]
                yield pd.DataFrame({"pair": flat[some[:-1]].view(np.int64), "n": np.diff(some)})

        for lang, run_ in by_lang(batches):
            h = words.hashes(lang, run_)
            ok = frequent(run_, h, known.value) > 0
            held.append(pair_hashes(h)[ok[:-1] & ok[1:]])
            size += len(held[-1])
            if size > 8 * HELD:
                yield from out()
                size = 0
        if size:
            yield from out()

    return docs.select("lang", "text").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(run: list[bytes], hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The counter of each token; 0 for rare words and marks."""
    out = known[(hashes >> np.uint64(64 - TABLE)).astype(np.int64)].astype(np.uint64)
    out[np.fromiter(map(MARK.__eq__, run), bool, len(run))] = 0
    return out


def pair_bits(pairs: DataFrame) -> np.ndarray:
    """A bitmap of PAIRS bits: set where a pair of LEAST at least falls."""
    slots = pairs.filter(F.col("n") >= LEAST).select(F.shiftrightunsigned("pair", 64 - PAIRS).alias("slot")).distinct().toArrow()
    bits = np.zeros(1 << PAIRS, bool)
    bits[slots["slot"].to_numpy()] = True
    return np.packbits(bits)


def windows_of(run: list[bytes], f: np.ndarray, hashes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, words to the left, words to the right, pivot) of each fragment of two words or more.

    To the left all words are more frequent than the pivot, to the right none is rarer.
    """
    n, steps = len(run), LONGEST - 1
    slot = pair_hashes(hashes) >> np.uint64(64 - PAIRS)
    together = (f[:-1] > 0) & (f[1:] > 0) & ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)
    order = (f << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    on = f > 0
    for s in range(1, min(steps, n - 1) + 1):
        on[:s] = False
        on[s:] &= together[: n - s] & (order[: n - s] > order[s:])
        left += on
    on = f > 0
    for s in range(1, min(steps, n - 1) + 1):
        on[n - s :] = False
        on[: n - s] &= together[s - 1 :] & (order[s:] >= order[: n - s])
        right += on
    at = np.flatnonzero(left + right)
    return at, left[at], right[at], order[at]


def fragments(docs: DataFrame, known, bits, share: int = 0) -> DataFrame:
    """(lang, pivot, parts, part, before, words, n): the fragments of a pivot in a worker's runs, equal ones once; ``before`` words stand left of the pivot."""
    share = share or PART

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, held = Words(), {}

        def rows(counts: Counter) -> Iterator[tuple[int, int, int, list]]:
            for head, keys in groupby(sorted(counts), lambda key: key[:8]):
                pivot = int.from_bytes(head, "big")
                parts, dealt = 1 + (pivot >> 32) // share, {}
                for key in keys:
                    dealt.setdefault(zlib.crc32(key[9:]) % parts, []).append(key)
                for part, own in dealt.items():
                    for i in range(0, len(own), ROW):
                        yield pivot, parts, part, own[i : i + ROW]

        def frame(lang: str, counts: Counter, some: list) -> pd.DataFrame:
            lists = {
                "before": [[key[8] for key in own] for *_, own in some],
                "words": [[key[9:].decode("utf-8", "surrogatepass") for key in own] for *_, own in some],
                "n": [[counts[key] for key in own] for *_, own in some],
            }
            pivots = np.array([r[0] for r in some], np.uint64).view(np.int64)
            return pd.DataFrame({"lang": lang, "pivot": pivots, "parts": [r[1] for r in some], "part": [r[2] for r in some]} | lists)

        def out() -> Iterator[pd.DataFrame]:
            for lang, counts in held.items():
                some, size = [], 0
                for row in rows(counts):
                    some.append(row)
                    size += len(row[-1])
                    if size >= FRAME:
                        yield frame(lang, counts, some)
                        some, size = [], 0
                if some:
                    yield frame(lang, counts, some)
            held.clear()

        for lang, run_ in by_lang(batches):
            if len(run_) < 2:
                continue
            h = table.hashes(lang, run_)
            at, left, right, pivot = windows_of(run_, frequent(run_, h, known.value), h, bits.value)
            joined = b" ".join(run_)
            ends = np.cumsum(np.fromiter(map(len, run_), np.int64, len(run_)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            # A key is the pivot (8 bytes), the words before it (1) and the words: one object, as very many are held.
            heads = np.column_stack([pivot.astype(">u8").view(np.uint8).reshape(-1, 8), left.astype(np.uint8)]).tobytes()
            cuts = zip(range(0, len(heads), 9), starts[at - left].tolist(), ends[at + right].tolist())
            held.setdefault(lang, Counter()).update(heads[i : i + 9] + joined[a:b] for i, a, b in cuts)
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInPandas(run, "lang string, pivot long, parts long, part long, before array<int>, words array<string>, n array<long>")


def mined(found: DataFrame) -> DataFrame:
    """(lang, phrase, size, a): the phrases of LEAST occurrences that hold their fragment's pivot.

    A task gets its pivots one after the other and holds the phrases of one. Those of a pivot in parts, or of one with more than
    HELD phrases, come out as partial counts, which are added up.
    """
    least, held = LEAST, HELD

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, whole, counts, rows = None, True, Counter(), []

        def close() -> None:
            for phrase, a in counts.items():
                if not whole or a >= least:
                    rows.append((last[0], phrase, phrase.count(" ") + 1, a, whole))
            counts.clear()

        def given() -> pd.DataFrame:
            frame = pd.DataFrame(rows, columns=["lang", "phrase", "size", "a", "whole"])
            rows.clear()
            return frame

        for batch in batches:
            for lang, pivot, parts, part, before, words, n in batch.itertuples(index=False):
                if (lang, pivot, part) != last:
                    if counts:
                        close()
                    last, whole = (lang, pivot, part), parts == 1
                for p, text, times in zip(before.tolist(), words, n.tolist()):
                    at = [0]
                    for w in text.split(" "):
                        at.append(at[-1] + len(w) + 1)
                    for i in range(p + 1):
                        for j in range(max(p + 1, i + 2), min(len(at) - 1, i + LONGEST) + 1):
                            counts[text[at[i] : at[j] - 1]] += times
                if len(counts) > held:
                    whole = False
                    close()
                if len(rows) > 20_000:
                    yield given()
        if counts:
            close()
        if rows:
            yield given()

    keys = ["lang", "pivot", "part"]
    dealt = found.repartition(*keys).sortWithinPartitions(*keys).select("lang", "pivot", "parts", "part", "before", "words", "n")
    counts = staged(dealt.mapInPandas(run, "lang string, phrase string, size int, a long, whole boolean"), "op12-counts")
    split = counts.filter("NOT whole").groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)
    return counts.filter("whole").select("lang", "phrase", "size", "a").union(split)


def scored(candidates: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of all candidates that no longer one with as many occurrences holds, by the lowest-scoring cut.

    Products are decimals of 38 digits, which is enough for 10^16 words.
    """
    part = lambda i, n: F.array_join(F.slice("w", i, n), " ")
    split = candidates.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    # A longer candidate that holds the phrase as often implies one that is longer by a word.
    covers = split.filter("size(w) > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase"))
    longer = covers.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    open_ = split.join(longer, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a").select("lang", "phrase", "a", "w")
    cuts = open_.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    known = staged(words.filter(F.col("f") >= LEAST).select("lang", F.col("word").alias("phrase"), "f").union(candidates.select("lang", "phrase", F.col("a").alias("f"))), "op12-known")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr("(cast(cast(a as decimal(19,0)) * 1000 as decimal(22,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a", "n").agg(least).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def ranked(scores: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their rank; parts of a language are cut to that number first, so no task sorts it whole."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    within = F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))
    some = scores.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", within).filter(F.col("rank") <= top).drop("deal")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases.

    Null texts have no words; a null lang is ``und``. Repeated rows count as often as they stand. Without frequent phrases no row
    comes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    words = staged(word_counts(docs), "op12-words")
    totals = staged(words.groupBy("lang").agg(F.sum("f").alias("n")), "op12-totals")
    known = spark.sparkContext.broadcast(counters(words))
    bits = spark.sparkContext.broadcast(pair_bits(counted_pairs(docs, known)))
    candidates = staged(mined(fragments(docs, known, bits)), "op12-candidates")
    return ranked(scored(candidates, words, totals), top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
