"""Words of whole texts inside Python tasks, and their number as a column.

bytes.split() and bytes.lower() of UTF-8 are exactly the contracts' words [^\\x20\\x09-\\x0D]+ and lower-casing of A-Z.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

from .copies import SPACE

#: An odd base: powers of it are invertible modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Distinct words that a task remembers the hashes of.
REMEMBERED = 1_000_000


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds REMEMBERED of them."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WindowHashes:
    """Hashes of all windows of `width` words of a document: a polynomial of the words' hashes modulo 2 ** 64."""

    def __init__(self, width: int, base: int = BASE):
        self.width, self.weights = width, powers(base, width - 1)[::-1].copy()
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up, self.down = powers(base, 1 << 12), powers(self.inverse, 1 << 12)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes)
        if n < self.width:
            return np.empty(0, np.uint64)
        if self.width <= 4:
            out = np.zeros(n - self.width + 1, np.uint64)
            for k in range(self.width):
                out += hashes[k : n - self.width + 1 + k] * self.weights[k]
            return mixed(out)
        if n >= len(self.up):
            self.up, self.down = powers(self.base, 2 * n), powers(self.inverse, 2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * self.up[:n], out=sums[1:])
        return mixed((sums[self.width :] - sums[: n - self.width + 1]) * self.down[: n - self.width + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads the entropy over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null. Each word with the white space behind it becomes one character, which leaves
    these and what stands before the first word: texts don't go to Python, and no list of words is made."""
    marks = F.regexp_replace(text.cast("string"), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "x")
    return F.coalesce(F.length(F.ltrim(marks, F.lit(SPACE))), F.lit(0)).cast("long")
