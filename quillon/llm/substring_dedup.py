"""Substring dedup by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, table
from .copies import own_texts
from .words import BASE, WindowHashes, WordHashes, mixed

#: Perfect difference sets. Every residue modulo the period is a difference of two members, so for any two
#: positions some shift below the period brings both to cover positions.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
BASE2 = 0xD6E8FEB86659FD93
DECIDED, OPEN, KNOWN = 0, 1, 2
#: doc: the doc_id, by which texts are ordered; own: which of its texts, 0 where it has one.
ROWS = "key long, key2 long, doc long, own long, lo int, hi int, kind byte"
RANGES = "doc long, own long, lo int, hi int"


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def rows_of(key, key2, doc, own, lo, hi, kind) -> pa.RecordBatch:
    return batch(key=key.view(np.int64), key2=key2.view(np.int64), doc=doc, own=own, lo=lo.astype(np.int32), hi=hi.astype(np.int32), kind=kind.astype(np.int8))


def merged(doc: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The union of ranges [lo, hi], text by text, as few ranges."""
    if not len(doc):
        return doc, own, lo, hi
    order = np.lexsort((lo, own, doc))
    doc, own, lo, hi = doc[order], own[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])]
    # running maximum of hi within each text
    group = np.cumsum(fresh) - 1
    span = int(hi.max()) + 2
    top = np.maximum.accumulate(hi + group * span) - group * span
    start = fresh | np.r_[True, lo[1:] > top[:-1] + 1]
    first = np.flatnonzero(start)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], own[first], lo[first].astype(np.int32), top[last].astype(np.int32)


def emit(key, key2, doc, own, lo, hi, kind) -> Iterator[pa.RecordBatch]:
    """Rows of kind DECIDED as merged ranges, dealt by document; the others as they are."""
    done = kind == DECIDED
    d, o, a, b = merged(doc[done], own[done], lo[done], hi[done])
    if len(d):
        zero = np.zeros(len(d), np.uint64)
        yield rows_of(mixed(d.astype(np.uint64)), zero, d, o, a, b, zero)
    left = ~done
    if left.any():
        yield rows_of(*(x[left] for x in (key, key2, doc, own, lo, hi, kind)))


def runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys, the index of the first row of each row's run."""
    fresh = np.zeros(len(keys[0]), bool)
    fresh[:1] = True
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


def anchors(batches: Iterator[pa.RecordBatch], window: int, period: int) -> Iterator[pa.RecordBatch]:
    """Anchor hashes at cover positions, with the range of window starts that an anchor stands for.

    What a batch itself decides doesn't travel: anchors that two of its documents share become ranges at once, and one
    KNOWN row stands for them, so that an anchor of very many documents sends a row for each batch.
    """
    width = window - period + 1
    cover, words, hasher = np.array(COVERS[period]), WordHashes(), WindowHashes(width)
    for b in batches:
        parts = []
        for doc, own, text in zip(b["doc_id"].to_pylist(), b["own"].to_pylist(), b["text"].to_pylist(), strict=True):
            if len(ws := text.split()) < window:
                continue
            h = hasher.of(words.of(ws))
            at = (np.arange(0, len(h), period)[:, None] + cover).ravel()
            at = at[at < len(h)]
            parts.append((h[at], np.full(len(at), doc, np.int64), np.full(len(at), own, np.int64), np.maximum(at - period + 1, 0), np.minimum(at, len(ws) - window)))
        if not parts:
            continue
        key, doc, own, lo, hi = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((doc, key))
        key, doc, own, lo, hi = (x[order] for x in (key, doc, own, lo, hi))
        first = runs(key)
        ends = np.r_[np.flatnonzero(np.diff(first)), len(key) - 1]  # the last row of each run
        last = ends[np.searchsorted(ends, np.arange(len(key)))]
        shared = doc[first] != doc[last]
        kind = np.where(shared, DECIDED, OPEN)
        stand = shared & (first == np.arange(len(key)))
        zero = np.zeros(len(key), np.uint64)
        yield from emit(key, zero, doc, own, lo, hi, kind)
        if stand.any():
            yield rows_of(*(x[stand] for x in (key, zero, doc, own, lo, hi)), np.full(stand.sum(), KNOWN))


def sorted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        yield tuple(b[c].to_numpy(zero_copy_only=False) for c in ("key", "key2", "doc", "own", "lo", "hi", "kind"))


def shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and doc: the ranges of anchors that occur in two documents or more. Streams: of a run that
    goes on, one document's rows are held at most."""
    held: tuple[np.ndarray, ...] | None = None
    for rows in sorted_rows(batches):
        done = rows[6] == DECIDED
        if done.any():
            yield batch(doc=rows[2][done], own=rows[3][done], lo=rows[4][done], hi=rows[5][done])
            rows = tuple(x[~done] for x in rows)
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        key, _, doc, own, lo, hi, kind = rows
        if not len(key):
            continue
        first = runs(key)
        ends = np.r_[np.flatnonzero(np.diff(first)), len(key) - 1]
        shared = doc[first] != doc[ends[np.searchsorted(ends, np.arange(len(key)))]]
        out = shared & (kind == OPEN)
        if out.any():
            yield batch(doc=doc[out], own=own[out], lo=lo[out], hi=hi[out])
        tail = slice(first[-1], first[-1] + 1) if shared[-1] else slice(first[-1], None)
        held = tuple(x[tail].copy() for x in rows)
        if shared[-1]:
            held[6][:] = KNOWN


def covered(ranges: list[int], n: int) -> np.ndarray:
    """Which of n places lie in one of the packed ranges."""
    mark, r = np.zeros(n + 1, np.int32), np.array(ranges, np.int64)
    np.add.at(mark, r >> 32, 1)
    np.add.at(mark, (r & 0xFFFFFFFF) + 1, -1)
    return np.cumsum(mark[:-1]) > 0


def windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of the candidate windows. Windows that a smaller document of the same batch has are decided here."""
    words, again, one, two = WordHashes(), WordHashes(1), WindowHashes(window, BASE), WindowHashes(window, BASE2)
    for b in batches:
        parts = []
        for doc, own, text, ranges in zip(*(b[c].to_pylist() for c in ("doc_id", "own", "text", "ranges")), strict=True):
            ws = text.split()
            at = np.flatnonzero(covered(ranges, len(ws)))
            parts.append((one.of(words.of(ws))[at], two.of(again.of(ws))[at], np.full(len(at), doc, np.int64), np.full(len(at), own, np.int64), at))
        if not parts:
            continue
        key, key2, doc, own, at = map(np.concatenate, zip(*parts, strict=True))
        order = np.lexsort((doc, key2, key))
        key, key2, doc, own, at = (x[order] for x in (key, key2, doc, own, at))
        later = doc > doc[runs(key, key2)]
        yield from emit(key, key2, doc, own, at, at + window - 1, np.where(later, DECIDED, OPEN))


def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by keys and doc: the windows that a smaller document has."""
    held: tuple | None = None
    for rows in sorted_rows(batches):
        done = rows[6] == DECIDED
        out = done.copy()
        if not done.all():
            key, key2, doc = (x[~done] for x in rows[:3])
            first = runs(key, key2)
            least = doc[first]
            if held and (key[0], key2[0]) == held[:2]:
                least[first == 0] = held[2]
            out[~done] = doc > least
            held = (key[-1], key2[-1], least[-1])
        if out.any():
            yield batch(**dict(zip(("doc", "own", "lo", "hi"), merged(*(x[out] for x in rows[2:6])), strict=True)))


def gathered(ranges: DataFrame, name: str) -> DataFrame:
    """A row for each text with its ranges, packed lo << 32 | hi: never more than the text has words."""
    packed = F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")
    vid = F.when(F.col("own") == 0, F.col("doc")).otherwise(F.col("own")).alias("vid")
    return materialize(ranges.select(vid, packed.alias("r")).groupBy("vid").agg(F.collect_list("r").alias("ranges")), name)


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions(F.col("kind") != DECIDED, "key", "key2", "doc")


def apply_ranges(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_words, n_removed, kept = [], [], []
        for text, copy, ranges in zip(b["text"].to_pylist(), b["copy"].to_pylist(), b["ranges"].to_pylist(), strict=True):
            ws = (text or b"").split()
            n = len(ws)
            if copy:
                left = [] if n >= window else ws
            elif ranges:
                left = [ws[i] for i in np.flatnonzero(~covered(ranges, n))]
            else:
                left = ws
            n_words.append(n)
            n_removed.append(n - len(left))
            kept.append(b" ".join(left))
        out = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.binary())}
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 3)), *out.values()], names=[*b.schema.names[:-3], *out])


def drop_repeated_passages(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text as UTF-8 binary) of each row: words covered by a window of `window` words
    that also starts in a document with a smaller doc_id are removed.

    1. Exact copies of a smaller document are set aside: all their windows repeat.
    2. Windows are hashed at difference-cover positions only. If `window` words of two documents agree, some shift
       below the period brings both to cover positions, so they share an anchor of window - period + 1 words there.
    3. Around anchors that two documents share, all window starts that such an anchor can stand for are hashed in full
       (128 bits), and each window is compared with the smallest document that has it: the extension is exact.
    Both shuffles are by hash; what one batch of documents can decide is decided before them, so a passage that a third
    of the documents have sends a row for each batch, not for each document. Texts don't travel while the tables of
    ranges may be broadcast (`small`); beyond, the joins by doc_id shuffle.

    Null or empty text: no words. Null doc_id: nothing is removed, and the row removes nothing elsewhere. Repeated rows
    (same doc_id and text) give the same result each; a doc_id with several texts keeps them apart: each row is judged by
    its own text, and none of them is smaller than another.
    """
    period = max(p for p in COVERS if p == min(COVERS) or 3 * p <= 2 * window)
    if window < period:
        raise ValueError(f"window must be {period} or more")
    rows, copied, _ = own_texts(docs)
    number = F.col("doc_id").cast("long")
    known = rows.where("doc_id is not null and text is not null").join(small(copied.select("vid")), "vid", "left_anti")
    known = known.select("vid", number.alias("doc_id"), F.when(F.col("vid") == number, 0).otherwise(F.col("vid")).cast("long").alias("own"), "text")
    found = dealt(known.select("doc_id", "own", "text").mapInArrow(partial(anchors, window=window, period=period), ROWS)).mapInArrow(shared_anchors, RANGES)
    near = gathered(found, "anchors")
    bytes_of = F.size("ranges") * 8 + 24
    hashed = known.join(small(near, size=bytes_of), "vid").select("doc_id", "own", "text", "ranges").mapInArrow(partial(windows, window=window), ROWS)
    removed = gathered(dealt(hashed).mapInArrow(later_windows, RANGES), "repeats")
    rows = rows.join(small(copied.select("vid", F.lit(True).alias("copy"))), "vid", "left").join(small(removed, size=bytes_of), "vid", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "copy", "ranges").mapInArrow(partial(apply_ranges, window=window), f"doc_id {kind}, n_words long, n_removed long, kept_text binary")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
