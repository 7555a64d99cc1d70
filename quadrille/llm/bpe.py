"""BPE by speculation: propose greedily, verify by pairs, merge exactly only where that fails.

A sequence of tokens is what BPE gives for a word exactly when each pair of neighbours is what BPE gives for the two together
(and a lone token when it encodes itself). So the longest known prefixes are proposed, the distinct pairs of many words are
checked at once against the pairs known as compatible, unknown pairs are settled once by exact merging, and only words with a
failing pair are merged in full. Words repeat, so their results are kept, up to a bound.

The tokenizer file is read once on the driver and sent to the executors (its size is fixed, about 2 MB). Its parts are
followed as the file states them: special tokens first, then the normaliser, the splitting pattern, bytes as letters, merges.
"""

from __future__ import annotations

import heapq
import itertools
import json
import struct
import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from quadrille.llm.common import bound_batches

#: White space as the file's ``\s`` means it (Unicode's property; Python's also has four control characters).
WHITE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words longer than this are not kept; as many words are kept as CACHE says.
LONG_WORD, CACHE = 64, 300_000
#: As many pairs of tokens are known at once; beyond that they are settled anew.
PAIRS = 2_000_000
#: Texts are handled in runs of about so many characters.
RUN = 1 << 20


def byte_letters() -> list[str]:
    """The letter for each byte: printable ones stand for themselves, the others for code points from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def member(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in a sorted array; its cost hardly grows with the array."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


class Encoder:
    """One tokenizer file of kind BPE with word ends."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Codes of mergeable pairs to their rank; and the token that each rank makes.
        self.rank = {self.vocab[a] << 20 | self.vocab[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        #: Tokens inside a word and at its end, by their letters; and the longest token by its first two letters.
        cut = len(self.end)
        self.ending = {t[:-cut]: i for t, i in self.vocab.items() if cut and t.endswith(self.end) and len(t) > cut} if cut else self.vocab
        self.inside = {t: i for t, i in self.vocab.items() if not (cut and t.endswith(self.end) and len(t) > cut)}
        self.reach: dict[str, int] = {}
        for t in (*self.ending, *self.inside):
            self.reach[t[:2]] = max(self.reach.get(t[:2], 1), len(t))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = self.vocab | self.special
        self.name_of = {i: t for t, i in names.items()}
        self.letters = byte_letters()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", WHITE))  # the file has it inside brackets only
        self.good: np.ndarray = np.empty(0, np.int64)  # pairs that are compatible, sorted
        self.bad: np.ndarray = np.empty(0, np.int64)
        self.ids: dict[str, bytes] = {}
        self.names: dict[str, str] = {}
        self.counts = {"words": 0, "merged": 0}

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter (no rule for final sigma). White space only parts words, so its runs may stay."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def letters_of(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])

    def symbols(self, letters: str) -> list[int]:
        """The tokens of single letters, before any merge."""
        return [*(self.inside[c] for c in letters[:-1]), self.ending[letters[-1]]]

    def merge(self, ids: list[int]) -> list[int]:
        """Exact BPE: of all neighbours, the pair of least rank first, the leftmost of equals."""
        if len(ids) > 64:
            return self.merge_long(ids)
        get, none = self.rank.get, len(self.made)
        ranks = [get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            ids[i : i + 2] = [self.made[least]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 20 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 20 | ids[i], none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, for words of any length."""
        n, get = len(ids), self.rank.get
        before, after, gone = [*range(-1, n - 1)], [*range(1, n), -1], bytearray(n)
        heap = [(r, i, ids[i] << 20 | ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, code = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or ids[i] << 20 | ids[j] != code:
                continue
            ids[i], gone[j] = self.made[r], 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0 and (r := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x] << 20 | ids[y]))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def propose(self, s: str) -> list[int]:
        """Longest known prefixes, one after the other."""
        n, at, out = len(s), 0, []
        inside, ending, reach = self.inside, self.ending, self.reach
        while at < n:
            far = at + reach.get(s[at : at + 2], 1)
            if far >= n:
                if (found := ending.get(s[at:])) is not None:
                    out.append(found)
                    break
                far = n - 1
            for to in range(far, at, -1):
                if (found := inside.get(s[at:to])) is not None:
                    out.append(found)
                    at = to
                    break
        return out

    def parts_of(self, token: int) -> list[int]:
        name = self.name_of[token]
        if self.end and name.endswith(self.end) and len(name) > len(self.end):
            return self.symbols(name[: -len(self.end)])
        return [self.inside[c] for c in name]

    def settle(self, codes: np.ndarray) -> None:
        """Find out exactly which pairs are compatible. A code is first * 2^20 + second; a lone token has second 2^20 - 1."""
        good, bad = [], []
        for code in codes.tolist():
            a, b = code >> 20, code & 0xFFFFF
            lone = b == 0xFFFFF
            want = [a] if lone else [a, b]
            (good if self.merge(self.parts_of(a) + ([] if lone else self.parts_of(b))) == want else bad).append(code)
        self.good, self.bad = np.union1d(self.good, np.array(good, np.int64)), np.union1d(self.bad, np.array(bad, np.int64))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Tokens of each word: proposals for all, one vectorised check of all pairs, exact merging for those that fail."""
        if not words:
            return []
        letters = [self.letters_of(w) for w in words]
        proposals = [self.propose(s) for s in letters]
        sizes = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        second = np.append(flat[1:], 0xFFFFF)
        second[ends - 1] = 0xFFFFF
        codes = (flat << 20) | second
        matters = second != 0xFFFFF
        matters[ends[sizes == 1] - 1] = True  # the last token of a longer word stands in the pair before it
        distinct = np.unique(codes[matters])
        if len(self.good) + len(self.bad) > PAIRS:
            self.good = self.bad = np.empty(0, np.int64)
        unknown = distinct[~member(self.good, distinct) & ~member(self.bad, distinct)]
        if len(unknown):
            self.settle(unknown)
        fails = np.logical_or.reduceat(matters & member(self.bad, codes), ends - sizes)
        self.counts["words"] += len(words)
        self.counts["merged"] += int(fails.sum())
        for i in np.flatnonzero(fails).tolist():
            proposals[i] = self.merge(self.symbols(letters[i]))
        return proposals

    def learn(self, words: set[str]) -> None:
        if len(self.ids) > CACHE:  # the words met first are the frequent ones: they stay
            for w in list(itertools.islice(self.ids, CACHE // 2, None)):
                del self.ids[w], self.names[w]
        new = [w for w in words if w not in self.ids]
        for w, tokens in zip(new, self.encode_words(new), strict=True):
            self.ids[w] = struct.pack(f"<{len(tokens)}I", *tokens)
            self.names[w] = " ".join([self.name_of[t] for t in tokens])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text, its ids as little-endian 32-bit integers, and the decoded text: the tokens' names with spaces between, as the file names no decoder."""
        for at, to in runs(texts):
            split = []
            for text in texts[at:to]:
                pieces = self.split_special.split(text) if self.split_special else [text]
                split.append([p if i % 2 else self.words.findall(self.normal(p)) for i, p in enumerate(pieces)])
            seen = set().union(*(p for pieces in split for p in pieces if isinstance(p, list)))
            self.learn(seen)
            for pieces in split:
                ids, names = [], []
                for p in pieces:
                    if isinstance(p, str):
                        ids.append(np.array([self.special[p]], "<u4").tobytes())
                        names.append(p)
                    else:
                        ids += map(self.ids.__getitem__, p)
                        names += map(self.names.__getitem__, p)
                yield b"".join(ids), " ".join(names)
            for w in seen:
                if len(w) > LONG_WORD:
                    del self.ids[w], self.names[w]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.name_of[i] for i in ids)


def runs(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of texts with about RUN characters."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= RUN:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


_loaded: dict[int, Encoder] = {}


def loaded(content: bytes) -> Encoder:
    """One encoder per worker and file."""
    key = hash(content)
    if key not in _loaded:
        _loaded[key] = Encoder(content)
    return _loaded[key]


def tokens(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Encode every whole text (null: empty) and decode it again. Texts stay in their partition; there is no shuffle.

    Gives doc_id, ids array<int>, decoded; with ``digest`` doc_id, n_tokens, ids_sha256, decoded_sha256 instead. Repeated rows
    repeat; an empty table gives none; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    with open(path, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = loaded(content.value)
        for batch in batches:
            results = encoder.encode(batch["text"].where(batch["text"].notna(), "").tolist())
            if digest:
                rows = [(len(i) // 4, sha256(i).hexdigest(), sha256(d.encode()).hexdigest()) for i, d in results]
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                out = pd.DataFrame([(np.frombuffer(i, "<u4").astype(np.int32), d) for i, d in results], columns=["ids", "decoded"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
            yield out

    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, {kinds}")
