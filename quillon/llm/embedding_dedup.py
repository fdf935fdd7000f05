"""Embedding near-dedup by collision-counting projections."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import acos, ceil, comb, erf, floor, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, hot_join, materialize, table
from .ngram_join import forest

#: Vectors of a bucket that meet in one task; larger buckets are cut into chunks that meet pair by pair.
CHUNK = 1024
#: Vectors that a bucket holds on average.
BUCKET = 128
#: A projection of a unit vector as a byte: so many steps to 1.
STEPS = 32
#: Different vectors with copies that may be broadcast (a few hundred numbers each).
COPIED = 5_000
#: Pairs that are multiplied at once.
STRIP = 1 << 16


def plan(n: int, cosine: float, projections: int, recall: float) -> tuple[int, int, float, int]:
    """(bits, tables, window, least count) for n vectors.

    A projection parts two vectors of this cosine by a normal of deviation sqrt(2 - 2 cosine): the window is 1.5 of
    these to either side of the query, and the count is the largest that such a pair reaches with probability 0.995.
    Tables are as many as make such a pair share a bucket with probability `recall`; closer pairs do better.
    """
    window = 1.5 * sqrt(2 - 2 * cosine)
    p = erf(1.5 / sqrt(2))
    least, tail = projections, p**projections
    while tail < 0.995:
        least -= 1
        tail += comb(projections, least) * p**least * (1 - p) ** (projections - least)
    bits = max(0, floor(log2(max(1, n) / BUCKET)))
    same = (1 - acos(cosine) / pi) ** bits
    tables = 1 if bits == 0 else ceil(log(1 - recall) / log(1 - same))
    return bits, tables, window, least


@dataclass(frozen=True)
class Plan:
    """What the tasks share: `plan`'s numbers, the bound and the seed of all directions."""

    bits: int
    tables: int
    window: float
    least: int
    cosine: float
    projections: int
    seed: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Bucket numbers of unit vectors in all tables: on which side of zero their projections are, by dimension."""
        place = 1 << np.arange(self.bits, dtype=np.int64)
        side = unit @ directions(self.seed, unit.shape[1], self.bits * self.tables) > 0
        return side.reshape(len(unit), self.tables, self.bits) @ place * 65536 + unit.shape[1] % 65536

    def projected(self, unit: np.ndarray) -> np.ndarray:
        return unit @ directions(self.seed + 1, unit.shape[1], self.projections)


@lru_cache(maxsize=8)
def directions(seed: int, dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def unit_vectors(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the places of its vectors in the list, and these in double precision with norm 1."""
    size = np.array([len(v) for v in vectors])
    out = {}
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        x = np.array([vectors[i] for i in at], np.float64)
        x /= np.abs(x).max(axis=1)[:, None]  # squares neither overflow nor vanish
        out[int(dim)] = at, x / np.linalg.norm(x, axis=1)[:, None]
    return out


def sketched(batches: Iterator[pa.RecordBatch], p: Plan) -> Iterator[pa.RecordBatch]:
    """(rep, sketch, codes): a byte for each projection and the bucket numbers; the vectors themselves stay where they are."""
    for b in batches:
        sketch = np.empty((b.num_rows, p.projections), np.int8)
        codes = np.empty((b.num_rows, p.tables), np.int64)
        for at, x in unit_vectors(b["embedding"].to_pylist()).values():
            sketch[at] = np.clip(np.rint(p.projected(x) * STEPS), -127, 127)
            codes[at] = p.codes(x)
        columns = [b["rep"], pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["rep", "sketch", "codes"])


def collisions(values: np.ndarray, window: float) -> np.ndarray:
    """How many projections (columns) bring a pair of vectors (rows) into one window around either: each projection is
    sorted, and a query's window is a range of ranks."""
    n = len(values)
    out = np.zeros((n, n), np.int16)
    rank = np.arange(n, dtype=np.int32)
    for v in values.T:
        order = np.argsort(v, kind="stable")
        ranked, place = v[order], np.empty(n, np.int32)
        place[order] = rank
        lo, hi = (np.searchsorted(ranked, v + w, side).astype(np.int32) for w, side in ((-window, "left"), (window, "right")))
        out += (place >= lo[:, None]) & (place < hi[:, None])
    return out


def collided(values: np.ndarray, side: np.ndarray, window: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of rows that collide often enough; where there are two sides, pairs of both."""
    enough = np.triu(collisions(values, window) >= least, 1)
    if side.any():
        enough &= side[:, None] != side
    return np.nonzero(enough)


def candidates(group: pa.Table, p: Plan) -> pa.Table:
    """Those of a cell that collide with another one often enough. Bytes are rounded, so the window is a step wider."""
    side = group["side"].to_numpy()
    values = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.int8).reshape(len(side), -1).astype(np.int16)
    i, j = collided(values, side, ceil(p.window * STEPS) + 1, p.least)
    return group.drop_columns(["sketch"]).take(pa.array(np.union1d(i, j)))


def verified(group: pa.Table, p: Plan) -> pa.Table:
    """A cell's links as (id, links with others, root in the cell's forest): pairs of its candidates that collide often
    enough are multiplied in double precision, no others. A pair belongs to the first table in which its buckets agree,
    so it counts once."""
    order = np.argsort(group["rep"].to_numpy(), kind="stable")
    ids, copies, side = (group[c].to_numpy()[order] for c in ("rep", "copies", "side"))
    vectors = group["embedding"].take(pa.array(order)).to_pylist()
    t, n = int(group["t"][0].as_py()), np.zeros(len(ids), np.int64)
    linked = np.zeros((len(ids), len(ids)), bool)
    for at, x in unit_vectors(vectors).values():
        i, j = collided(p.projected(x), side[at], p.window, p.least)
        codes = p.codes(x)[:, :t]
        for k in range(0, len(i), STRIP):
            a, b = i[k : k + STRIP], j[k : k + STRIP]
            use = np.einsum("ij,ij->i", x[a], x[b]) >= p.cosine
            a, b = a[use], b[use]
            if t:
                new = ~(codes[a] == codes[b]).any(axis=1)
                a, b = a[new], b[new]
            linked[at[a], at[b]] = linked[at[b], at[a]] = True
    n = linked @ copies
    root = np.arange(len(ids))
    i, r = forest(linked)
    root[i] = r
    use = n > 0
    return pa.table({"id": ids[use], "n": n[use], "root": ids[root][use]})


def near_vectors(vectors: DataFrame, cosine: float = 0.9, projections: int = 48, recall: float = 0.98, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of vectors(vec_id, embedding).

    Equal vectors are one vector with a number of copies. Windows of a single projection hold a fixed share of all
    vectors, so counting collisions over whole projections is quadratic; here the signs of a few projections first deal
    the vectors into buckets, in several tables, so that a pair at the limit shares one with probability `recall`. Then:
    1. Only ids and sketches (a byte for each of `projections` other projections) go to the buckets. In each, every
       projection is sorted, a pair's collisions in windows around either are counted, and vectors without a pair that
       collides often enough drop out. Buckets beyond CHUNK vectors are cut into chunks that meet pair by pair.
    2. The vectors are fetched for those that are left, and the pairs that collide often enough, no others, are verified
       in double precision. A cell returns sums and a forest, not pairs.
    Only links found count: none below `cosine`; recall at the limit is about `recall` and grows quickly above it.

    Null or zero vectors, and vectors with null or non-finite components, link with nothing: n_links 0, their own
    component. Null vec_id: n_links 0, null component. vec_id identifies the vector: of several with one vec_id the
    smallest counts, and repeated rows are one vector. Vectors of different dimensions don't link.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(F.col("vec_id").isNotNull() & valid).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    reps = good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(reps, "vectors")
    bits, tables, window, least = plan(reps.count(), cosine, projections, recall)
    p = Plan(bits, tables, window, least, cosine, projections, seed)
    coded = materialize(reps.mapInArrow(lambda it: sketched(it, p), "rep long, sketch binary, codes array<bigint>"), "sketches")
    size = coded.select(F.posexplode("codes").alias("t", "code")).groupBy("t", "code").agg(F.count(F.lit(1)).alias("size"))
    # a row for each bucket that isn't one vector's
    size = size.where("size > 1").select(F.struct("t", "code").alias("bucket"), F.ceil(F.col("size") / CHUNK).alias("chunks"))
    at = coded.select("rep", "sketch", F.posexplode("codes").alias("t", "code")).select("rep", "sketch", F.struct("t", "code").alias("bucket"))
    at = hot_join(at, materialize(size, "buckets"), "bucket").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    cells = at.withColumn("other", other).select(
        "rep", "sketch", "bucket.*",
        F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    cell, kinds = ["t", "code", "lo", "hi"], "rep long, t int, code long, lo long, hi long, side int"
    left = materialize(cells.groupBy(*cell).applyInArrow(lambda g: candidates(g, p), kinds), "colliding")
    found = left.join(reps, "rep").groupBy(*cell).applyInArrow(lambda g: verified(g, p), "id long, n long, root long")
    found = materialize(found, "vector-links")
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "components")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    of_reps = reps.select("rep", "copies", "embedding").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    facts = [(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")]
    alone = of_reps.where("copies = 1").select(F.col("rep").alias("vec_id"), *facts)
    several = materialize(of_reps.where("copies > 1").select("embedding", *facts), "copied-vectors")
    ids = alone.unionAll(hot_join(good, several, "embedding", few=several.count() <= COPIED).select("vec_id", "n_links", "component_id"))
    out = rows.select("vec_id").join(ids, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
