"""Words of a text as numbers, in bulk: what the Python stages of several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash

#: As many distinct words are kept per worker; beyond that the table starts anew.
KEEP = 400_000
#: Texts are handled in runs of about so many characters.
RUN = 2 << 20
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class WordTable(dict):
    """Word (bytes) to its index, given at first sight; ``hashes[index]`` has 64 bits of it."""

    def __init__(self) -> None:
        super().__init__()
        self.order: list[bytes] = []
        self.hashes = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = index = len(self.order)
        self.order.append(word)
        return index

    def indexes(self, words: list[bytes]) -> np.ndarray:
        """The index of each word; ``hashes`` is as long as all indexes given so far."""
        out = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        if len(self.hashes) < len(self.order):
            new = [xxhash.xxh64_intdigest(w) for w in self.order[len(self.hashes) :]]
            self.hashes = np.concatenate([self.hashes, np.array(new, np.uint64)])
        return out

    def trim(self) -> None:
        if len(self.order) > KEEP:
            self.clear()
            self.order, self.hashes = [], np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[2])
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A number for each run of k consecutive ones; order matters. Shorter input gives none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(MIX[0]) + hashes[j : j + n]
    return mixed(out)


def split_lower(text: str | None) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, as UTF-8; bytes know no other letters or spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_runs(batches: Iterator[pd.DataFrame], column: str = "text") -> Iterator[pd.DataFrame]:
    """Cut batches so that each has about RUN characters of text."""
    for batch in batches:
        sizes = batch[column].str.len().fillna(0).to_numpy(dtype=np.int64)
        part = np.cumsum(sizes) // RUN
        for p in np.unique(part):
            yield batch[part == p].reset_index(drop=True)


def long_column(values: pd.Series) -> np.ndarray:
    """A nullable long column, as Arrow accepts it."""
    return values.astype("Int64").to_numpy(dtype=object, na_value=None)
