"""Terms of full-text search: tokenizers and the light stemmer, the same at index and query time."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = {"ascii": r"[^a-z0-9]+", "unicode": r"[^\p{L}\p{N}]+"}
#: Words that a task of `post` sorts at once.
WORDS_AT_ONCE = 1 << 21
#: Suffixes that the light stemmer drops, the first that fits.
SUFFIXES = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ation", "ator", "alism", "aliti", "alli", "fulness", "ousli", "iveness", "tional", "biliti", "lessli", "icate", "iciti", "ical", "ness", "ous", "ive", "ize", "iti", "ate", "al", "er", "ic")


class UnsupportedQuery(ValueError):
    """A query in a syntax that this search doesn't have."""


def tokens(text: Column, mode: str = "ascii") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT[mode]), lambda t: t != "")


def light_stem(word: str) -> str:
    """The word without its endings: always a beginning of the word."""
    voiced = lambda s: any(v in s for v in "aeiou")
    if len(word) <= 2:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss") and voiced(word[:-1]):
        word = word[:-1]
    if len(word) > 5 and word.endswith("ing") and voiced(word[:-3]):
        word = word[:-3]
    elif len(word) > 4 and word.endswith("ed") and voiced(word[:-2]):
        word = word[:-2]
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) > len(s) + 2), word)


def count_stems(batches: Iterator[pa.RecordBatch], terms: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The last field, an array of words for each column, becomes tf: for each term an array of how many words of each
    column have it as their stem."""
    for b in batches:
        counts = [[Counter(map(light_stem, own)) for own in columns] for columns in b.columns[-1].to_pylist()]
        tf = pa.array([[[c[t] for c in row] for t in terms] for row in counts], pa.list_(pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], tf], names=[*b.schema.names[:-1], "tf"])


def post(batches: Iterator[pa.RecordBatch], stem: str) -> Iterator[pa.RecordBatch]:
    """Of batches of a key and an array of words for each column: blocks (term, col, keys, tf, positions). A block has the
    rows of a term, their counts, and one after the other their positions, which ascend. Rows are taken together up to
    WORDS_AT_ONCE words, a longer row by itself."""
    for b in batches:
        key = b.columns[0]
        for col, words in enumerate(b.columns[1:]):
            n = pc.list_value_length(words).to_numpy().astype(np.int64)
            part = (np.cumsum(n) - n) // WORDS_AT_ONCE
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(n)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if not (total := int(n[lo:hi].sum())):
                    continue
                row, start = np.repeat(np.arange(lo, hi), n[lo:hi]), np.cumsum(n[lo:hi]) - n[lo:hi]
                coded = words.slice(lo, hi - lo).flatten().dictionary_encode()
                term, code = coded.dictionary, coded.indices.to_numpy()
                if stem == "light":
                    coded = pa.array(map(light_stem, term.to_pylist()), pa.string()).dictionary_encode()
                    term, code = coded.dictionary, coded.indices.to_numpy()[code]
                both = code.astype(np.int64) * len(n) + row  # rows of a term follow each other: these compress well
                order = np.argsort(both, kind="stable")  # words of a row and term stay in the order of the text
                both = both[order]
                first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
                block = np.flatnonzero(np.r_[True, np.diff(both[first] // len(n)) > 0])
                cut = pa.array(np.r_[block, len(first)], pa.int32())  # of the rows; of the positions it is first[cut]
                spot = (np.arange(total) - np.repeat(start, n[lo:hi]))[order].astype(np.int32)
                keys = pa.ListArray.from_arrays(cut, key.take(pa.array(both[first] % len(n))))
                tf = pa.ListArray.from_arrays(cut, pa.array(np.diff(np.r_[first, total]).astype(np.int32)))
                positions = pa.ListArray.from_arrays(pa.array(np.r_[first[block], total], pa.int32()), pa.array(spot))
                own = [term.take(pa.array(both[first[block]] // len(n))), pa.array(np.full(len(block), col, np.int32)), keys, tf, positions]
                yield pa.RecordBatch.from_arrays(own, names=["term", "col", "keys", "tf", "positions"])


def unblock(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Blocks as a row for each term, key and column."""
    for b in batches:
        keys, tf = b["keys"].flatten(), b["tf"].flatten()
        block = pa.array(np.repeat(np.arange(b.num_rows), pc.list_value_length(b["keys"]).to_numpy()))
        positions = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(tf.to_numpy())], pa.int32()), b["positions"].flatten())
        yield pa.RecordBatch.from_arrays([b["term"].take(block), keys, b["col"].take(block), tf.cast(pa.int64()), positions], names=["term", key, "col", "tf", "positions"])


def query_terms(query: str, stem: str = "none") -> list[str]:
    """Terms of a query of plain words, all of which must occur; repeated words stay repeated."""
    out = []
    for word in query.split():
        if word in ("AND", "OR", "NOT", "NEAR") or not re.fullmatch("[A-Za-z0-9_]+", word):
            raise UnsupportedQuery(query)
        out += [w for w in word.lower().split("_") if w]
    return [light_stem(w) for w in out] if stem == "light" else out
