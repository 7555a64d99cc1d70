"""A hidden Markov language model, trained by Baum-Welch over the whole training folds.

States emit word classes: the TOP most frequent tokens each have their own, all others share SHAPES classes by their shape,
and the end of a text has one. A token's probability is its class's probability times its share of the class, from its count.
So sequences of small numbers are what the model reads, and the counts of rare tokens enter as a sum per text.

Token counts are summed over partitions by 64-bit hash. The HEAVY most frequent tokens are sent to every worker (a fixed
number); the counts of all others are joined by hash, where no key is frequent. Each Baum-Welch pass runs forward and backward
over every training text, packed so that texts advance together; expected counts are summed in Spark, and a table of fixed
size reaches the driver. Passes end when the likelihood of the training texts gains less than GAIN, or after PASSES. A few passes
over a small sample only give the starting point. The scaled forward recursion then gives the exact likelihood of every text.
A very long text is walked in chunks that hand their state on, so it needs the memory of one chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.common import bound_batches, fold, staged
from quadrille.llm.words import long_column, split_lower, text_runs

STATES = 8
TOP, SHAPES, HEAVY = 1000, 1024, 500_000
END = TOP + SHAPES
CLASSES = END + 1
#: Passes over all training texts, and how the starting point is found.
PASSES, SEED_PASSES, SEED_TEXTS, SEED_TOKENS = 4, 12, 600, 2000
#: The least gain in likelihood, as a share of it, for which another pass is made.
GAIN = 0.01
SMOOTH = 0.1
#: Tokens that advance together.
PACK = 1 << 19
#: Tokens of a chunk of a text that is longer.
CHUNK = 1 << 16
#: Tokens that are sorted by length before they are packed.
BUFFER = 1 << 24
KEEP = 400_000
FOLDS = 10


def held_out(doc_id):
    return F.pmod(fold(doc_id), F.lit(FOLDS)) == 0


def shape(word: bytes) -> int:
    """A token's shape class: length, what it ends in, letters or not, and the letters before the end."""
    core = word.rstrip(b".,;:!?*#$%&|\"')")
    tail = word[len(core) :][:2]
    kind = 0 if core.isalpha() else 1 if core.isdigit() else 2 if core.isascii() else 3
    return zlib.crc32(b"%d/%d/%b/%b" % (min(len(core) // 3, 6), kind, tail, core[-2:])) % SHAPES


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def token_counts(docs: DataFrame) -> DataFrame:
    """(h, shape, c) of every token of the training folds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"h": np.fromiter((xxhash.xxh64_intdigest(w) for w in counts), np.uint64, len(counts)).view(np.int64), "shape": np.fromiter(map(shape, counts), np.int32, len(counts)), "c": np.fromiter(counts.values(), np.int64, len(counts))})
            counts.clear()
            return out

        for part in text_runs(batches):
            get = counts.get
            for text in part["text"]:
                for w in split_lower(text):
                    counts[w] = get(w, 0) + 1
            if len(counts) > KEEP:
                yield flush()
        yield flush()

    train = docs.filter(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("text")
    return train.mapInPandas(run, "h long, shape int, c long").groupBy("h", "shape").agg(F.sum("c").alias("c"))


class Lexicon:
    """The heavy tokens, their counts, and the classes of the top ones."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        order = np.argsort(h)
        self.h, self.c = h[order], c[order]
        rank = np.lexsort((h, -c))[:TOP]
        klass = np.full(len(h), -1, np.int32)
        klass[rank] = np.arange(len(rank))
        self.klass = klass[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, top class or -1) of each hash; 0 where it isn't heavy."""
        if not len(self.h):
            return np.zeros(len(h), np.int64), np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        hit = self.h[at] == h
        return np.where(hit, self.c[at], 0), np.where(hit, self.klass[at], -1)


class Known(dict):
    """Word to index, with hash, count and class by index."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon, self.new = lexicon, []
        self.h, self.c, self.k = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int16)

    def __missing__(self, word: bytes) -> int:
        self[word] = index = len(self)
        self.new.append(word)
        return index

    def indexes(self, words: list[bytes]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if self.new:
            h = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.new), np.uint64, len(self.new)).view(np.int64)
            c, k = self.lexicon.find(h)
            k = np.where(k >= 0, k, TOP + np.fromiter(map(shape, self.new), np.int32, len(h)))
            self.h, self.c, self.k, self.new = np.append(self.h, h), np.append(self.c, c), np.append(self.k, k.astype(np.int16)), []
        return out

    def trim(self) -> None:
        if len(self) > KEEP:
            self.clear()
            self.__init__(self.lexicon)


def encoded(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Per row: its classes (16-bit numbers, the end last), sums over heavy tokens, and its other tokens with their numbers."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(held.value)
        for part in text_runs(batches):
            rows = []
            for text in part["text"].where(part["text"].notna(), None):
                at = known.indexes(split_lower(text))
                c, k = known.c[at], known.k[at]
                heavy = c > 0
                logs = np.log10(c[heavy] + SMOOTH)
                h, m = np.unique(known.h[at[~heavy]], return_counts=True)
                rows.append((len(at) + 1, int(heavy.sum()), float(logs.sum()), float(logs[k[heavy] >= TOP].sum()), np.append(k, END).astype("<i2").tobytes(), h, m))
            known.trim()
            out = pd.DataFrame(rows, columns=["n_tokens", "heavy_known", "heavy_sum", "heavy_shaped", "classes", "rare", "times"])
            out.insert(0, "held_out", part["held_out"])
            out.insert(0, "doc_id", long_column(part["doc_id"]))
            yield out

    kinds = "doc_id long, held_out boolean, n_tokens long, heavy_known long, heavy_sum double, heavy_shaped double, classes binary, rare array<long>, times array<long>"
    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(run, kinds).withColumn("rid", F.monotonically_increasing_id())


class Pack:
    """Sequences laid out by time: all first tokens, all second ones, ...; the longest sequences first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        ends = lengths[self.order]
        self.active = len(ends) - np.searchsorted(ends[::-1], np.arange(ends[0]), side="right")
        self.start = np.append(0, np.cumsum(self.active))
        self.flat = np.empty(self.start[-1], np.int32)
        for rank, i in enumerate(self.order):
            self.flat[self.start[: lengths[i]] + rank] = sequences[i]
        self.rank = np.arange(self.start[-1], dtype=np.int32) - np.repeat(self.start[:-1], self.active).astype(np.int32)

    def per_sequence(self, values: np.ndarray) -> np.ndarray:
        """Sums of a number per token over each sequence, in the order given."""
        out = np.empty(len(self.order))
        out[self.order] = np.bincount(self.rank, values, len(self.order))
        return out

    def room_of(self, room: np.ndarray) -> np.ndarray:
        """Sums over each sequence of a number per class."""
        return self.per_sequence(room[self.flat])

    def forward(self, model: Model, first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Natural-log likelihood of each sequence (as given), the scaled forward values of all tokens, and their scales. ``first``: the states' probabilities at the first token, where they are not those of a start."""
        pi, move, emit = model
        pi = pi if first is None else first
        alphas = emit[self.flat]
        scales = np.empty(len(self.flat))
        before = None
        for o, n in zip(self.start.tolist(), self.active.tolist(), strict=False):
            now = alphas[o : o + n]
            now *= pi if before is None else before[:n] @ move
            total = now.sum(1)
            scales[o : o + n] = total
            now /= total[:, None]
            before = now
        return self.per_sequence(np.log(scales)), alphas, scales

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, moves and emissions, and the log likelihood."""
        return self.chunk_expected(model)[:4]

    def chunk_expected(self, model: Model, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, np.ndarray]:
        """The same where one sequence goes on before (``first``, as in ``forward``) or behind (``last``: the backward values at its last token); and what the first tokens hand back."""
        _, move, emit = model
        ll, alphas, scales = self.forward(model, first)
        seen = emit[self.flat]
        seen /= scales[:, None]
        back, turned = np.ones_like(alphas), np.ascontiguousarray(move.T)
        if last is not None:
            back[-1] = last
        for t in range(len(self.active) - 1, 0, -1):
            o, p, b = self.start[t - 1], self.start[t], self.active[t]
            np.matmul(seen[p : p + b] * back[p : p + b], turned, out=back[o : o + b])
        second = self.start[1]
        seen *= back
        earlier = np.repeat(self.start[:-2], self.active[1:]) + self.rank[second:]
        moves = alphas[earlier].T @ seen[second:]
        alphas *= back  # from here on the probabilities of the states
        emits = np.stack([np.bincount(self.flat, alphas[:, k], CLASSES) for k in range(len(move))], 1)
        return alphas[:second].sum(0), moves * move, emits, float(ll.sum()), seen[0]


class Long:
    """One sequence of any length in chunks: as a pack of it, with the memory of one chunk and a state per chunk."""

    def __init__(self, sequence: np.ndarray):
        self.chunks = [sequence[i : i + CHUNK] for i in range(0, len(sequence), CHUNK)]

    def room_of(self, room: np.ndarray) -> np.ndarray:
        return np.array([sum(float(room[c].sum()) for c in self.chunks)])

    def states(self, model: Model) -> tuple[float, list[np.ndarray]]:
        """The log likelihood, and the forward values at the end of each chunk."""
        ll, first, ends = 0.0, None, []
        for chunk in self.chunks:
            part, alphas, _ = Pack([chunk]).forward(model, first)
            ll += float(part[0])
            ends.append(alphas[-1].copy())
            first = ends[-1] @ model[1]
        return ll, ends

    def forward(self, model: Model) -> tuple[np.ndarray, None, None]:
        return np.array([self.states(model)[0]]), None, None

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        _, move, _ = model
        ll, ends = self.states(model)
        moves, emits, last, start = np.zeros_like(move), 0.0, None, None
        for i in range(len(self.chunks) - 1, -1, -1):
            start, inside, seen, _, lead = Pack([self.chunks[i]]).chunk_expected(model, ends[i - 1] @ move if i else None, last)
            moves, emits = moves + inside, emits + seen
            if i:  # the move into this chunk
                moves = moves + np.outer(ends[i - 1], lead) * move
                last = move @ lead
        return start, moves, emits, ll


Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def packs(rows: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], Pack | Long]]:
    """Packs of about PACK tokens, with the row ids. Sequences are sorted by length in a buffer first, so that few steps are walked by few of them."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple[list[int], Pack]]:
        held.sort(key=lambda x: (-x[0], x[1]))
        while held and held[0][0] > CHUNK:
            _, rid, s = held.pop(0)
            yield [rid], Long(s)
        at = total = 0
        for i, (n, _, _) in enumerate(held):
            total += n
            if total >= PACK or i == len(held) - 1:
                part = held[at : i + 1]
                yield [rid for _, rid, _ in part], Pack([s for _, _, s in part])
                at, total = i + 1, 0
        held.clear()

    for batch in rows:
        for rid, raw in zip(batch["rid"], batch["classes"], strict=True):
            held.append((len(raw) // 2, rid, np.frombuffer(raw, "<i2")))
            size += len(raw) // 2
        if size >= BUFFER:
            yield from flush()
            size = 0
    yield from flush()


def maximised(first: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
    """The model of the expected counts, lightly smoothed towards the mean emission so that nothing is impossible."""
    overall = (emits.sum(1) + 0.5) / (emits.sum() + 0.5 * CLASSES)
    emit = emits + 20 * overall[:, None] + 1e-3
    return (first + 0.1) / (first + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emit / emit.sum(0, keepdims=True)


def seeded(table: DataFrame) -> Model:
    """A starting point from a small sample, by the same passes in memory."""
    rows = table.filter(~F.col("held_out") & (F.col("n_tokens") <= SEED_TOKENS)).orderBy(F.xxhash64("doc_id"), "rid").limit(SEED_TEXTS).select("rid", "classes").toArrow().to_pandas()
    rng = np.random.default_rng(7)
    emit = rng.dirichlet(np.ones(STATES), CLASSES) + 0.5
    move = np.full((STATES, STATES), 0.5 / STATES) + 0.5 * np.eye(STATES)
    model = (np.full(STATES, 1 / STATES), move, emit / emit.sum(0, keepdims=True))
    if len(rows):
        pack = Pack([np.frombuffer(r, "<i2") for r in rows["classes"]])
        for _ in range(SEED_PASSES):
            model = maximised(*pack.expected(model)[:3])
    return model


def baum_welch(table: DataFrame, model: Model) -> tuple[Model, float]:
    """One pass over all training rows: the next model, and the log likelihood under this one. Counts are summed in Spark; one number per count reaches the driver."""
    held = table.sparkSession.sparkContext.broadcast(model)
    s = STATES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for _, pack in packs(batches):
            first, moves, emits, ll = pack.expected(held.value)
            part = np.concatenate([first, moves.ravel(), emits.ravel(), [ll]])
            total = part if total is None else total + part
        if total is not None:
            at = np.flatnonzero(total)
            yield pd.DataFrame({"i": at.astype(np.int32), "v": total[at]})

    rows = table.filter(~F.col("held_out")).select("rid", "classes").mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    total = np.zeros(s + s * s + CLASSES * s + 1)
    total[rows["i"].to_numpy()] = rows["v"].to_numpy()
    return maximised(total[:s], total[s : s + s * s].reshape(s, s), total[s + s * s : -1].reshape(CLASSES, s)), float(total[-1])


def class_likelihood(table: DataFrame, model: Model, log_room: np.ndarray) -> DataFrame:
    """(rid, likelihood of the classes, sum of the log room of shape classes) of every row, base 10."""
    held = table.sparkSession.sparkContext.broadcast((model, log_room))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, room = held.value
        for ids, pack in packs(batches):
            ll, _, _ = pack.forward(model)
            rooms = pack.room_of(room)
            yield pd.DataFrame({"rid": ids, "ll": ll / np.log(10), "room": rooms})

    return table.select("rid", "classes").mapInPandas(run, "rid long, ll double, room double")


def heavy_from(counts: DataFrame) -> int:
    """The least count of heavy tokens: as low as leaves HEAVY tokens at most. It comes from a histogram of a few hundred steps, so nothing is sorted."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int").alias("step")
    rows = counts.groupBy(step).agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["n"]
        if total > HEAVY:
            break
        least = r["least"]
    return least


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null and empty texts are one end. Repeated rows repeat, each by itself. Without training texts all counts are 0 and the
    base is what the formula then gives; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    counts = staged(token_counts(docs), "op6-counts")
    texts = docs.filter(~held_out(F.col("doc_id"))).count()
    whole = counts.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).first()
    n, v = (whole["n"] or 0) + texts, whole["v"] + (texts > 0)
    least = heavy_from(counts)
    heavy = counts.filter(F.col("c") >= least).select("h", "c").toArrow().to_pandas()
    lexicon = Lexicon(heavy["h"].to_numpy(np.int64), heavy["c"].to_numpy(np.int64))
    table = staged(encoded(docs, lexicon), "op6-encoded")

    top = pd.DataFrame({"h": lexicon.h[lexicon.klass >= 0]})
    by_shape = counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow().to_pandas().set_index("shape")
    inside = counts.filter(F.col("h").isin([int(h) for h in top["h"]])).groupBy("shape").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow().to_pandas().set_index("shape") if len(top) else by_shape.iloc[:0]
    room = np.zeros(CLASSES)
    of = by_shape.sub(inside, fill_value=0).reindex(range(SHAPES), fill_value=0)
    room[TOP : TOP + SHAPES] = np.log10(of["c"].to_numpy(float) + SMOOTH * (of["v"].to_numpy(float) + 1))

    model, before = seeded(table), -np.inf
    for _ in range(PASSES):
        model, ll = baum_welch(table, model)
        if ll - before < GAIN * abs(ll):
            break
        before = ll

    rare = table.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("m"))
    found = rare.join(counts.filter(F.col("c") < least).select("h", "c"), "h", "left").select("rid", "m", F.coalesce("c", F.lit(0)).alias("c"))
    sums = found.groupBy("rid").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("rare_known"), F.sum(F.col("m") * F.log10(F.col("c") + SMOOTH)).alias("rare_sum"))
    narrow = table.select("rid", "doc_id", "held_out", "n_tokens", "heavy_known", "heavy_sum", "heavy_shaped")
    joined = narrow.join(class_likelihood(table, model, room), "rid").join(sums, "rid", "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    end = float(np.log10(texts + SMOOTH))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("heavy_known") + F.coalesce("rare_known", F.lit(0)) + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("heavy_sum") + rare_sum + end - F.col("n_tokens") * float(np.log10(n + SMOOTH * (v + 1)))).alias("base_score"),
        (F.col("ll") + F.col("heavy_shaped") + rare_sum - F.col("room")).alias("score"),
    )
