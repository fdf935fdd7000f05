"""Benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, repeat
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialize, small, table
from .copies import own_texts

#: A passage is two neighbouring half passages of so many words.
HALF = 32
#: Benchmark items and distinct words that one round of passes serves; larger benchmarks are worked off in rounds. So a
#: round's matrices on the driver and in broadcasts are bounded whatever the benchmark's size: TERMS x (rank + 16) doubles
#: (75 MB) and ITEMS x rank floats (10 MB). A single item beyond TERMS words is a round of its own.
ITEMS, TERMS = 20_000, 65_536
#: Entries of the matrix that are worked on at once (their rows fit in a core's cache), terms of a block of sums, and
#: groups of tasks whose blocks are added up first.
STRIP, TERM_BLOCK, PARTS = 4096, 256, 32
#: Texts that a task unpacks at once, and terms of encoded documents that it works on at once (and the rest of the last
#: document): the sums of their half passages take TERMS_AT_ONCE x (rank + 16) floats (38 MB) at most, whatever the batch.
TEXTS_AT_ONCE, TERMS_AT_ONCE = 512, 1 << 16
#: Gaps between neighbouring terms count up to this.
GAP = 63
#: Pairs of neighbouring terms, none within another's reach, by which an item is also looked up.
ANCHORS = 3
#: Folds A-Z to lower case and ASCII marks to spaces.
FOLD = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x >= 128 else 32 for x in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass(frozen=True)
class Item:
    item_id: int
    words: tuple[bytes, ...]
    answer: frozenset[bytes]
    distinct: frozenset[bytes]


@dataclass(frozen=True)
class Latent:
    """Term weights and the latent space: terms x rank, and the items' unit vectors in it."""

    place: dict[bytes, int]
    idf: np.ndarray
    space: np.ndarray
    items: np.ndarray


@dataclass(frozen=True)
class Anchors:
    """Each item's rarest pairs of neighbouring terms, as sorted codes, with the item and the pair's offset in it."""

    codes: np.ndarray
    item: np.ndarray
    offset: np.ndarray


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of texts, in lots of TEXTS_AT_ONCE."""
    for b in batches:
        yield from (b.slice(at, TEXTS_AT_ONCE) for at in range(0, b.num_rows, TEXTS_AT_ONCE))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of encoded documents, cut where another TERMS_AT_ONCE terms are full."""
    for b in batches:
        n = pc.binary_length(b["terms"]).to_numpy() // 4
        part = (np.cumsum(n) - n) // TERMS_AT_ONCE
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), b.num_rows]
        yield from (b.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False) if hi > lo)


def count_terms(batches: Iterator[pa.RecordBatch], place: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """How many documents of this task have each benchmark word; the last number counts the documents."""
    df = np.zeros(len(place) + 1, np.int64)
    for b in lots(batches):
        for text in b["text"].to_pylist():
            df[[place[w] for w in place.keys() & set(words(text))]] += 1
            df[-1] += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], names=["term", "n"])


def encode(batches: Iterator[pa.RecordBatch], place: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The terms and word positions of each document that has any."""
    for b in lots(batches):
        ids, terms, spots = [], [], []
        for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            ws = words(text)
            found = np.fromiter(map(place.get, ws, repeat(-1)), np.int32, len(ws))
            at = np.flatnonzero(found >= 0)
            if len(at):
                ids.append(i)
                terms.append(found[at].tobytes())
                spots.append(at.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary()), pa.array(spots, pa.binary())], names=["doc_id", "terms", "spots"])


def halves(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of encoded documents: all terms, the row of the half passage of each, and each half's document and number."""
    terms = [np.frombuffer(x, np.int32) for x in b["terms"].to_pylist()]
    spots = [np.frombuffer(x, np.int32) // HALF for x in b["spots"].to_pylist()]
    if not terms:
        none = np.empty(0, np.int64)
        return none, none, none, none
    doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
    spot = np.concatenate(spots)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (spot[1:] != spot[:-1])]
    first = np.flatnonzero(fresh)
    return np.concatenate(terms), np.cumsum(fresh) - 1, doc[first], spot[first]


def sums(terms: np.ndarray, row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rows of the TF-IDF matrix times `weights` (terms x k, already times idf), for halves in order; in strips of terms."""
    out = np.zeros((int(row[-1]) + 1 if len(row) else 0, weights.shape[1]), np.float32)
    for at in range(0, len(terms), STRIP):
        r = row[at : at + STRIP]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        out[r[first]] += np.add.reduceat(weights[terms[at : at + STRIP]], first, axis=0)
    return out


def gram_times(batches: Iterator[pa.RecordBatch], idf: np.ndarray, basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's part of A' A basis, A: half passages by terms. One row for each term: the sum is partial in Spark."""
    out, weights = np.zeros(basis.shape), (basis * idf[:, None]).astype(np.float32)
    for b in pieces(batches):
        terms, row, _, _ = halves(b)
        if not len(terms):
            continue
        y = sums(terms, row, weights)
        order = np.argsort(terms, kind="stable")
        terms, row = terms[order], row[order]
        for at in range(0, len(terms), STRIP):
            t = terms[at : at + STRIP]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            out[t[first]] += np.add.reduceat(y[row[at : at + STRIP]], first, axis=0) * idf[t[first], None]
    used = np.flatnonzero(out.any(axis=1))
    for at in range(0, len(used), TERM_BLOCK):
        t = used[at : at + TERM_BLOCK]
        columns = [pa.array(t // TERM_BLOCK, pa.int32()), pa.array(t, pa.int32()), pa.array([x.tobytes() for x in out[t]], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "term", "row"])


def add_rows(group: pa.Table) -> pa.Table:
    total: dict[int, np.ndarray] = {}
    for t, x in zip(group["term"].to_pylist(), group["row"].to_pylist(), strict=True):
        total[t] = total.get(t, 0) + np.frombuffer(x)
    terms = pa.array(list(total), pa.int32())
    return pa.table({"block": pa.array([t // TERM_BLOCK for t in total], pa.int32()), "term": terms, "row": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def pair_codes(terms: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """A number for each two neighbouring terms and the gap between them."""
    return (terms[:-1].astype(np.int64) << 32) + (terms[1:].astype(np.int64) << 6) + np.minimum(spots[1:] - spots[:-1], GAP)


def anchors_of(items: list[Item], place: dict[bytes, int], idf: np.ndarray) -> Anchors:
    """The ANCHORS rarest pairs of each item that don't overlap, so that a changed word spoils one of them at most. Of an
    item with one term, that term is the anchor."""
    codes, which, offsets = [], [], []
    for i, x in enumerate(items):
        found = [(k, place[w]) for k, w in enumerate(x.words) if w in place]
        spots, terms = np.array([k for k, _ in found], np.int64), np.array([t for _, t in found], np.int64)
        if len(terms) == 1:
            own = [(-1 - int(terms[0]), int(spots[0]))]
        else:
            pairs, taken = pair_codes(terms, spots), np.zeros(len(x.words), bool)
            own = []
            for k in np.argsort(-(idf[terms[:-1]] + idf[terms[1:]]), kind="stable"):
                reach = slice(spots[k], spots[k + 1] + 1)
                if not taken[reach].any():
                    taken[reach] = True
                    own.append((int(pairs[k]), int(spots[k])))
                if len(own) == ANCHORS:
                    break
        codes += [c for c, _ in own]
        offsets += [at for _, at in own]
        which += [i] * len(own)
    order = np.argsort(codes, kind="stable")
    return Anchors(np.array(codes, np.int64)[order], np.array(which, np.int32)[order], np.array(offsets, np.int64)[order])


def anchored(b: pa.RecordBatch, anchors: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, half passage) where an anchor of an item occurs: all leaks with fewer changed words than the item has
    anchors, word-for-word ones among them, whatever their cosine."""
    terms = [np.frombuffer(x, np.int32) for x in b["terms"].to_pylist()]
    spots = [np.frombuffer(x, np.int32) for x in b["spots"].to_pylist()]
    doc, term, spot = np.repeat(np.arange(len(terms)), [len(x) for x in terms]), np.concatenate(terms), np.concatenate(spots).astype(np.int64)
    out = []
    same = doc[1:] == doc[:-1]
    for code, d, at in ((pair_codes(term, spot)[same], doc[:-1][same], spot[:-1][same]), (-1 - term.astype(np.int64), doc, spot)):
        lo, hi = np.searchsorted(anchors.codes, code, "left"), np.searchsorted(anchors.codes, code, "right")
        n = hi - lo
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)  # all anchors of a code
        out.append((np.repeat(d, n), anchors.item[k], np.maximum(np.repeat(at, n) - anchors.offset[k], 0) // HALF))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def search(batches: Iterator[pa.RecordBatch], model: Latent, anchors: Anchors, cosine: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, item, half, cosine) of all passages and items whose latent vectors have this cosine or more, and, with a
    null cosine, of the anchors."""
    weights = (model.space * model.idf[:, None]).astype(np.float32)
    names = ["doc_id", "item", "half", "cosine"]
    for b in pieces(batches):
        terms, row, doc, half = halves(b)
        s = sums(terms, row, weights)
        after = np.zeros(len(s), bool)
        after[:-1] = (doc[1:] == doc[:-1]) & (half[1:] == half[:-1] + 1)
        s[:-1][after[:-1]] += s[1:][after[:-1]]  # right to left isn't needed: numpy reads before it writes
        s /= np.maximum(np.linalg.norm(s, axis=1), 1e-9)[:, None]
        ids = b["doc_id"].to_numpy()
        strip = max(64, (4 << 20) // len(model.items))  # the products of a strip take 16 MB
        for at in range(0, len(s), strip):
            close = s[at : at + strip] @ model.items.T
            i, k = np.nonzero(close >= cosine)
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc[at + i]]), pa.array(k, pa.int32()), pa.array(half[at + i], pa.int32()), pa.array(close[i, k].astype(np.float64))], names=names)
        d, k, at = anchored(b, anchors)
        yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(k, pa.int32()), pa.array(at, pa.int32()), pa.nulls(len(d), pa.float64())], names=names)


def lcs(a: tuple[bytes, ...], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one number."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def best_match(item: Item, text: list[bytes], lo: int, hi: int, least: float) -> tuple[float, float, int]:
    """The best (share of the item's words in a common subsequence, share of its answer) between two places of a text, and
    where; a share of 0 if none reaches `least`. Windows are a quarter longer than the item."""
    n = len(item.words)
    width, step = n + max(4, n // 4), max(1, n // 6)
    best = (0.0, 0.0, lo)
    near = text[lo:hi]
    # a window that has few of the item's words can't hold a long subsequence
    upto = list(accumulate(map(item.distinct.__contains__, near), initial=0))
    for at in range(0, max(1, len(near) - width + step), step):
        if upto[min(at + width, len(near))] - upto[at] >= max(least, best[0]) * n:
            own = near[at : at + width]
            share = lcs(item.words, own) / n
            if share > best[0]:
                best = (share, len(item.answer.intersection(own)) / max(1, len(item.answer)), lo + at)
                if share == 1:
                    break
    return best


def verify(batches: Iterator[pa.RecordBatch], items: list[Item], sure: float, likely: float) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.float64())
    for b in lots(batches):
        out = []
        for doc, text, hits in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["hits"].to_pylist(), strict=True):
            ws, best = words(text), {}
            places: dict[int, list[tuple[int, float]]] = {}
            for h in hits:
                places.setdefault(h["item"], []).append((h["half"], h["cosine"]))
            for i, found in places.items():
                n, end = len(items[i].words), -1
                spans: list[list] = []  # passages of one item that overlap are one place
                for half, cosine in sorted(found, key=lambda x: x[0]):
                    lo, hi = max(0, half * HALF - n), min(len(ws), half * HALF + 2 * HALF + n)
                    if lo <= end:
                        spans[-1][1] = hi
                    else:
                        spans.append([lo, hi, None])
                    end = hi
                    if cosine is not None:
                        spans[-1][2] = max(cosine, spans[-1][2] or cosine)
                for lo, hi, cosine in spans:
                    share, answer, at = best_match(items[i], ws, lo, hi, likely)
                    if (share >= sure or (share >= likely and answer >= 0.5)) and share > best.get(i, (0,))[0]:
                        best[i] = (share, answer, at, cosine)
            out += [(doc, items[i].item_id, *x) for i, x in best.items()]
        cols = list(zip(*out, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "lcs", "answer", "start_word", "cosine"])


PAIRS = "doc_id long, item_id long, lcs double, answer double, start_word int, cosine double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, answer: str | None = None, rank: int = 128, cosine: float = 0.45, sure: float = 0.8, likely: float = 0.6, max_df: float = 0.05, seed: int = 5) -> DataFrame:
    """(doc_id, item_id, lcs, answer, start_word, cosine) of documents that hold a benchmark item, word for word or in
    other words; one row for each pair.

    1. One pass counts the benchmark's words over all documents; those in more than max_df of them are left out, except
       the four rarest of each item. A second pass keeps the positions of these terms: a small table.
    2. Randomised SVD of the TF-IDF matrix of passages (the items are passages too): A'A is applied twice, each time by a
       pass that adds up terms x (rank + 16) numbers, to a random basis; the driver only sees these.
    3. All passages of 2 * HALF words, HALF apart, are compared with all items in the latent space. Beside these, each
       place that has one of an item's ANCHORS rarest pairs of neighbouring terms is a candidate (with a null cosine),
       so that no leak that is word for word, or of a short item with a changed word, hangs on the rank.
    4. Candidates are checked on the words: a common subsequence of at least `sure` of the item's words within a window a
       quarter longer; or of `likely` of them if also half of the answer's words are there. The answer is the column
       `answer`, or else the item's three rarest words.

    Texts with the same bytes are searched once. Null or empty texts and items, and null ids, have no leaks; an item of
    one word leaks into every text that has it; repeated rows give a pair once, a doc_id with several texts the best of
    these. Beyond ITEMS items or TERMS words the passes are repeated. Case and ASCII marks don't count.
    """
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"), (F.col(answer) if answer else F.lit(None)).cast("binary").alias("answer"))
    rows, copied, several = own_texts(docs)
    known = rows.where("doc_id is not null and text is not null").select(F.col("vid").alias("doc_id"), "text")
    known = known.join(small(copied.select(F.col("vid").alias("doc_id"))), "doc_id", "left_anti")
    found = docs.sparkSession.createDataFrame([], PAIRS)
    for k, own in enumerate(rounds(bench)):
        found = found.unionAll(_round(known, own, rank, cosine, sure, likely, max_df, seed + k))
    found = materialize(found, "leaks")
    found = found.unionAll(hot_join(copied, found.withColumnRenamed("doc_id", "rep"), "rep").select(F.col("vid").alias("doc_id"), *found.columns[1:]))
    if several is not None:
        found = found.join(small(several.withColumnsRenamed({"doc_id": "own", "vid": "doc_id"})), "doc_id", "left").withColumn("doc_id", F.coalesce("own", "doc_id"))
    best = F.max(F.struct("lcs", "answer", (-F.col("start_word")).alias("before"), "cosine")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.lcs", "best.answer", (-F.col("best.before")).alias("start_word"), "best.cosine")


def rounds(bench: DataFrame) -> Iterator[list]:
    """The benchmark's rows in lots of at most ITEMS rows and TERMS distinct words (but one row at least)."""
    own, seen = [], set()
    for r in bench.orderBy("item_id").toLocalIterator():
        more = set(words(r.text))
        if own and (len(own) >= ITEMS or len(seen | more) > TERMS):
            yield own
            own, seen = [], set()
        own.append(r)
        seen |= more
    if own:
        yield own


def _round(known: DataFrame, bench: list, rank: int, cosine: float, sure: float, likely: float, max_df: float, seed: int) -> DataFrame:
    spark = known.sparkSession
    texts = [(r.item_id, tuple(words(r.text)), r.answer) for r in bench]
    texts = [x for x in texts if x[1]]
    every = {w: i for i, w in enumerate(sorted({w for _, ws, _ in texts for w in ws}))}
    if not every:
        return spark.createDataFrame([], PAIRS)
    counted = known.mapInArrow(lambda it: count_terms(it, every), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # as many as the benchmark has words
    df = np.zeros(len(every) + 1, np.int64)
    for r in counted:
        df[r.term] = r.n
    n = max(1, int(df[-1]))
    weight = lambda w: log((n + 1) / (int(df[every[w]]) + 0.5))
    kept = {w for w in every if df[every[w]] <= max_df * n}
    for _, ws, _ in texts:
        kept.update(sorted(set(ws), key=lambda w: (-weight(w), w))[:4])
    place = {w: i for i, w in enumerate(sorted(kept))}
    idf = np.array([max(0.1, weight(w)) for w in sorted(kept)])
    rarest = lambda ws: frozenset(sorted(set(ws), key=lambda w: (-weight(w), w))[:3])
    items = [Item(i, ws, frozenset(words(a)) if a else rarest(ws), frozenset(ws)) for i, ws, a in texts]
    encoded = materialize(known.mapInArrow(lambda it: encode(it, place), "doc_id long, terms binary, spots binary"), "passages")

    # the items as passages, as heavy as all others together: their directions stay in the space
    known_words = [np.array([place[w] for w in x.words if w in place], np.int32) for x in items]
    one_place = [np.zeros_like(x).tobytes() for x in known_words]
    own = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in known_words], pa.binary()), pa.array(one_place, pa.binary())], names=["terms", "spots"])

    def gram(basis: np.ndarray) -> np.ndarray:
        kind, part = "block int, term int, row binary", F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
        parts = encoded.mapInArrow(lambda it: gram_times(it, idf, basis), kind).select("*", part)
        # in two steps, so that no group has rows of every task
        parts = parts.groupBy("block", "part").applyInArrow(lambda t: add_rows(t), kind)
        out = np.zeros(basis.shape)
        for r in parts.groupBy("block").applyInArrow(lambda t: add_rows(t), kind).collect():
            out[r.term] = np.frombuffer(r.row)
        mine = np.zeros(basis.shape)
        for b in gram_times(iter([own]), idf, basis):
            mine[b["term"].to_numpy()] = [np.frombuffer(x) for x in b["row"].to_pylist()]
        return out + mine * max(1.0, np.linalg.norm(out) / max(1e-9, np.linalg.norm(mine)))

    width = min(len(place), rank + 16)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(place), width)))[0]
    basis = np.linalg.qr(gram(basis))[0]
    z = gram(basis)
    values, turn = np.linalg.eigh((basis.T @ z + z.T @ basis) / 2)
    space = basis @ turn[:, np.argsort(-values)[: min(rank, width)]]
    queries = np.zeros((len(items), space.shape[1]), np.float32)
    terms, row, which, _ = halves(own)
    queries[which] = sums(terms, row, (space * idf[:, None]).astype(np.float32))
    queries /= np.maximum(np.linalg.norm(queries, axis=1), 1e-9)[:, None]
    model = Latent(place, idf, space.astype(np.float32), queries)
    anchors = anchors_of(items, place, idf)
    hits = encoded.mapInArrow(lambda it: search(it, model, anchors, cosine), "doc_id long, item int, half int, cosine double")
    hits = materialize(hits.groupBy("doc_id").agg(F.collect_list(F.struct("item", "half", "cosine")).alias("hits")), "candidates")  # as long as a document at most, times its likely items
    return known.join(small(hits, size=F.size("hits") * 24 + 16), "doc_id").select("doc_id", "text", "hits").mapInArrow(lambda it: verify(it, items, sure, likely), PAIRS)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
