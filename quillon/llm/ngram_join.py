"""N-gram Jaccard join as a blocked sparse matrix product of document by n-gram incidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, hot_join, is_small, materialize, small, table
from .copies import own_texts
from .words import BASE, WindowHashes, WordHashes, mixed

#: Buckets of the n-gram frequency table: a fixed size, whatever the corpus. Collisions only change which n-grams count
#: as rare, not the result.
BUCKETS, BLOCK = 1 << 22, 1 << 16
#: Groups of tasks whose tables are added up first.
PARTS = 32
#: Linked documents share at least so many of their rarest n-grams (all that must agree, if these are fewer).
SHARED = 4
#: Documents of an n-gram with no more than so many are paired one by one; those of other n-grams meet in blocks.
PAIRED = 32
#: A block of documents holds about so many documents and n-grams at most.
BLOCK_DOCS, BLOCK_GRAMS = 512, 400_000


class Shingles:
    """Distinct n-gram hashes of a text, sorted."""

    def __init__(self, width: int, lower: bool = True):
        self.width, self.lower, self.words, self.hasher = width, lower, WordHashes(), WindowHashes(width)

    def of(self, text: bytes) -> np.ndarray:
        h = self.words.of((text.lower() if self.lower else text).split())
        if not len(h):
            return h
        if len(h) < self.width:  # the whole sequence as one, apart from all n-grams of full width
            return WindowHashes(len(h), BASE + 2 * len(h)).of(h)
        return np.unique(self.hasher.of(h))


def frequencies(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """How many texts of this task have an n-gram of each hash bucket, in blocks; counts stop at 255 for a task."""
    counts, shingles = np.zeros(BUCKETS, np.uint32), Shingles(width)
    for b in batches:
        for text in b["text"].to_pylist():
            np.add.at(counts, (shingles.of(text) % BUCKETS).astype(np.int64), 1)
    low = np.minimum(counts, 255).astype(np.uint8).reshape(-1, BLOCK)
    used = np.flatnonzero(low.any(axis=1))
    columns = [pa.array(used, pa.int32()), pa.array([low[i].tobytes() for i in used], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["block", "counts"])


def add_up(group: pa.Table, kind: type) -> pa.Table:
    total = np.zeros(BLOCK, np.int64)
    for x in group["counts"]:
        total += np.frombuffer(x.as_py(), kind)
    return pa.table({"block": group["block"][:1], "counts": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())})


def frequency_table(texts: DataFrame, width: int) -> bytes:
    """BUCKETS counts of all texts: 16 MB. Summed in two steps, so that no group has a row of every task."""
    part = F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part")
    rows = texts.select("text").mapInArrow(partial(frequencies, width=width), "block int, counts binary").select("*", part)
    kind = "block int, counts binary"
    parts = rows.groupBy("block", "part").applyInArrow(lambda t: add_up(t, np.uint8), kind)
    often = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint32)
    for r in parts.groupBy("block").applyInArrow(lambda t: add_up(t, np.uint32), kind).collect():
        often[r.block] = np.frombuffer(r.counts, np.uint32)
    return often.tobytes()


def signatures(batches: Iterator[pa.RecordBatch], width: int, percent: int, table_of=None) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, set hashes, prefix): the prefix are the n - ceil(t n) + SHARED rarest n-grams. Sets of Jaccard similarity
    t or more have ceil(t n) n-grams in common, so their prefixes share SHARED (or all of these, if fewer)."""
    shingles, often = Shingles(width), None if table_of is None else np.frombuffer(table_of.value, np.uint32)
    for b in batches:
        ns, one, two, prefixes = [], [], [], []
        for text in b["text"].to_pylist():
            s = shingles.of(text or b"")
            n = len(s)
            keep = min(n, n - -(-percent * n // 100) + SHARED)
            if often is not None and keep:
                rank = np.lexsort((s, often[(s % BUCKETS).astype(np.int64)]))[:keep]
                prefixes.append(s[rank].view(np.int64))
            else:
                prefixes.append(np.empty(0, np.int64))
            ns.append(n)
            one.append(int(s.sum(dtype=np.uint64)))
            two.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
        ints = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        columns = [b["doc_id"], pa.array(ns, pa.int64()), ints(one), ints(two), pa.array(prefixes, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "h1", "h2", "prefix"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """The sparse product of the incidence matrix with its transpose: sizes of all intersections.

    N-grams of one document are left out, those of two are added up pair by pair, the rest in dense strips."""
    k = len(sets)
    rows = np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((k, k), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    two = count[column] == 2
    pairs = rows[two].reshape(-1, 2)
    out += np.bincount(pairs[:, 0] * k + pairs[:, 1], minlength=k * k).reshape(k, k).astype(np.float32)
    out += out.T
    many = count[column] > 2
    rows, column = rows[many], column[many]
    if len(rows):
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
        strip = max(256, (4 << 20) // k)
        for at in range(0, int(column[-1]) + 1, strip):
            lo, hi = np.searchsorted(column, (at, at + strip))
            part = np.zeros((k, min(strip, int(column[-1]) + 1 - at)), np.float32)
            part[rows[lo:hi], column[lo:hi] - at] = 1
            out += part @ part.T
    np.fill_diagonal(out, 0)
    return out


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, root of i) with the same components as the symmetric matrix `linked`; at most one for each row."""
    k = len(linked)
    linked = linked | np.eye(k, dtype=bool)
    label = np.arange(k)
    while True:
        new = np.where(linked, label, k).min(axis=1)
        new = new[new]
        if (new == label).all():
            i = np.flatnonzero(label != np.arange(k))
            return i, label[i]
        label = new


def block_product(group: pa.Table, width: int, percent: int) -> pa.Table:
    """Overlap counts of all pairs of a block (or between two blocks), as a forest of the links found.

    Pairs are discarded by the bound that their sizes give: percent * (a + b) <= (100 + percent) * overlap."""
    order = np.argsort(group["doc_id"].to_numpy(), kind="stable")
    docs, side = group["doc_id"].to_numpy()[order], group["side"].to_numpy()[order]
    shingles, texts = Shingles(width), group["text"].to_pylist()
    sets = [shingles.of(texts[i]) for i in order]
    sizes = np.array([len(s) for s in sets], np.float64)
    linked = (100 + percent) * overlaps(sets).astype(np.float64) >= percent * (sizes[:, None] + sizes)
    if side.any():
        linked &= side[:, None] != side
    np.fill_diagonal(linked, False)
    a, b = forest(linked)
    return pa.table({"a": docs[a], "b": docs[b]})


def equal_sets(signed: DataFrame) -> DataFrame:
    """(doc_id, root) of documents whose set a document with a smaller id also has."""
    sets = signed.where("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("root"), F.max("doc_id").alias("last")).where("root < last")
    sets = materialize(sets.select(F.struct("n", "h1", "h2").alias("key"), "root"), "sets")
    return materialize(hot_join(signed.select("doc_id", F.struct("n", "h1", "h2").alias("key")), sets, "key").where("doc_id > root").select("doc_id", "root"), "equal-sets")


def incidence(rest: DataFrame, percent: int) -> DataFrame:
    """(gram, doc_id, n, hub, docs, often, need): the matrix of rare n-grams that occur in several documents. often: how
    many of the document's are frequent; need: how many a linked document shares. Documents with fewer have no link."""
    entries = rest.select("doc_id", "n", F.explode("prefix").alias("gram"))
    hubs = entries.groupBy("gram").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("docs")).where("docs > 1")
    hubs = materialize(hubs, "grams")
    shared = hot_join(entries, hubs, "gram", few=is_small(hubs, rows=2_000_000))  # three numbers a row
    own = Window.partitionBy("doc_id")  # a document's rare n-grams
    need = F.least(F.lit(SHARED), F.ceil(F.col("n") * percent / 100))
    shared = shared.withColumns({
        "all": F.count(F.lit(1)).over(own),
        "often": F.count(F.when(F.col("docs") > PAIRED, 1)).over(own),
        "need": need,
    })
    return materialize(shared.where(F.col("all") >= F.col("need")).drop("all"), "incidence")


def candidate_edges(matrix: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs by the overlap counts on n-grams of PAIRED documents at most, and a star for each more frequent one."""
    few = matrix.where(F.col("docs") <= PAIRED).select("gram", "doc_id", "n", "often", "need")
    x, y = few.alias("x"), few.alias("y")
    fits = (F.col("x.doc_id") < F.col("y.doc_id")) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    least = [F.least(f"x.{c}", f"y.{c}").alias(c) for c in ("often", "need")]
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & fits).groupBy(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), *least)
    close = pairs.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") + F.col("often") >= F.col("need")).select("a", "b")
    stars = matrix.where(F.col("docs") > PAIRED).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    return materialize(close.unionAll(stars).distinct(), "candidates")


def placed_in_blocks(matrix: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(doc_id, cluster, alone, band, chunk): the block of each document of a cluster. Clusters of one block are `alone`;
    the others are cut by the size of the sets (a link's sizes are in the same band or neighbours), and bands into chunks."""
    sized = matrix.select("doc_id", "n").distinct().join(members.withColumnsRenamed({"id": "doc_id", "component": "cluster"}), "doc_id")
    band = F.floor(F.log("n") / F.lit(float(np.log(100 / percent))) + 1e-9)
    sized = materialize(sized.select("doc_id", "n", F.struct("cluster", band.alias("band")).alias("key")), "clustered")
    bands = sized.groupBy("key").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("n"))
    parts = lambda d, n: F.greatest(F.ceil(d / BLOCK_DOCS), F.ceil(n / BLOCK_GRAMS))
    whole = bands.groupBy("key.cluster").agg(parts(F.sum("d"), F.sum("n")).alias("whole"))
    cut = bands.select("key", "key.cluster", parts(F.col("d"), F.col("n")).alias("parts")).join(whole, "cluster")
    cut = materialize(cut.select("key", (F.col("whole") == 1).alias("alone"), "parts"), "cut")
    cell = lambda x: F.when(F.col("alone"), F.lit(0).cast("long")).otherwise(x)
    chunk = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    placed = hot_join(sized.select("doc_id", "key"), cut, "key").select("doc_id", "key.cluster", "alone", cell(F.col("key.band")).alias("band"), cell(chunk).alias("chunk"))
    return materialize(placed, "placed")


def block_links(known: DataFrame, matrix: DataFrame, placed: DataFrame, same: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): a forest of all links within clusters and between equal sets.

    First the blocks themselves, and each large cluster's other blocks with its first one; then the other pairs of blocks
    that share a rare n-gram and whose sizes may fit, but for those that already are one component in whole. So a group of
    k near copies costs k / BLOCK_DOCS products, not the square of that."""

    def products(cells: DataFrame) -> DataFrame:
        rows = known.join(small(materialize(cells, "assigned")), "doc_id").select("cell", "doc_id", "side", "text")
        return materialize(rows.groupBy("cell").applyInArrow(lambda t: block_product(t, width, percent), "a long, b long"), "links")

    block = F.struct("cluster", "band", "chunk").alias("k")
    inside = placed.select("doc_id", F.xxhash64("cluster", "band", "chunk").alias("cell"), F.lit(0).alias("side"))
    many = placed.where("not alone")
    if many.isEmpty():
        return products(inside).unionAll(same)
    spread = matrix.join(small(many), "doc_id").select("gram", block).distinct()
    pair = spread.alias("x").join(spread.alias("y"), "gram").where("x.k < y.k and x.k.cluster = y.k.cluster and y.k.band - x.k.band <= 1")
    pair = materialize(pair.select(F.col("x.k").alias("p"), F.col("y.k").alias("q")).distinct(), "block-pairs")
    first = materialize(pair.groupBy("p.cluster").agg(F.min("p").alias("p")), "first-blocks")

    def sides(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("p", "q", F.xxhash64("p", "q").alias("cell"))
        ends = pairs.select(F.col("p").alias("k"), "cell", F.lit(0).alias("side")).unionAll(pairs.select(F.col("q").alias("k"), "cell", F.lit(1).alias("side")))
        return many.select("doc_id", block).join(ends, "k").select("doc_id", "cell", "side")

    stars = pair.join(small(first.select("p")), "p", "left_semi")
    links = products(inside.unionAll(sides(stars))).unionAll(same)
    found = components(links, "first-components").withColumnsRenamed({"id": "doc_id"})
    ends = many.join(found, "doc_id", "left").select(block, F.coalesce("component", "doc_id").alias("c"))
    ends = materialize(ends.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")), "block-components")
    rest = pair.join(small(first.select("p")), "p", "left_anti")
    rest = rest.join(ends.select(F.col("k").alias("p"), F.col("lo").alias("a"), F.col("hi").alias("b")), "p").join(ends.withColumnRenamed("k", "q"), "q")
    rest = materialize(rest.where("a < b or lo < hi or a <> lo").select("p", "q"), "other-pairs")
    return links if rest.isEmpty() else links.unionAll(products(sides(rest)))


def jaccard_groups(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: components of the links between documents whose sets of distinct
    `width`-word shingles (A-Z lower-cased) have a Jaccard similarity of percent / 100 or more.

    1. Exact copies, and documents with equal sets, join their smallest document at once.
    2. A fixed-size table counts n-grams by hash bucket over all documents; each document's rarest n-grams are its row in
       a small incidence matrix: so many that linked documents have SHARED of them in common. Overlaps on n-grams of
       PAIRED documents at most are counted pair by pair, and pairs whose sizes don't fit or whose count (with all that
       more frequent n-grams could add) is too low are dropped. What is left, and documents that share a more frequent
       n-gram, form clusters: no link leaves one.
    3. Clusters are cut into blocks of bounded size, by size of the sets; each block, and each pair of blocks that isn't
       known to be one component, is a task's sparse matrix product with its transpose. It returns no pairs but a forest
       with the same components (`block_links`).

    Null or empty text, or one without words: n_shingles 0, linked with nothing. Null doc_id: its own row with null
    component_id. Repeated rows give the same result each. A doc_id with several texts is one document that links by
    any of them; each row has the n_shingles of its own text. Only doc_id and text are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    rows, copied, several = own_texts(docs)
    rows = rows.where("doc_id is not null")
    once = copied.select(F.col("vid").alias("doc_id"))
    known = rows.where("length(text) > 0").select(F.col("vid").alias("doc_id"), "text").join(small(once), "doc_id", "left_anti")
    shared = docs.sparkSession.sparkContext.broadcast(frequency_table(known, width))
    kinds = "doc_id long, n long, h1 long, h2 long, prefix array<bigint>"
    signed = known.mapInArrow(partial(signatures, width=width, percent=percent, table_of=shared), kinds)
    signed = materialize(signed.dropDuplicates(["doc_id"]), "signatures")

    same = equal_sets(signed)
    matrix = incidence(signed.join(small(same.select("doc_id")), "doc_id", "left_anti"), percent)
    members = components(candidate_edges(matrix, percent), "clusters")
    placed = placed_in_blocks(matrix, members, percent)
    links = block_links(known, matrix, placed, same.toDF("a", "b"), width, percent)

    # the texts of one document are linked, too
    if several is not None:
        reps = several.join(copied, "vid", "left").select("doc_id", F.coalesce("rep", "vid").alias("b"))
        links = links.unionAll(reps.join(reps.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").select("a", "b"))
    joined = components(links, "components")

    facts = signed.select(F.col("doc_id").alias("vid"), "n").join(joined.withColumnRenamed("id", "vid"), "vid", "full").select("vid", "n", F.coalesce("component", "vid").alias("component"))
    facts = materialize(facts, "facts")
    of_reps = materialize(facts.withColumnRenamed("vid", "rep").join(copied.select("rep").distinct(), "rep", "left_semi"), "facts-of-copied")
    facts = facts.unionAll(hot_join(copied, of_reps, "rep").select("vid", "n", "component"))
    out = rows.select("doc_id", "vid").join(facts, "vid", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.coalesce("component", "vid").alias("component_id"))
    if several is not None:  # a component's name is a doc_id again
        least = materialize(out.groupBy("component_id").agg(F.min("doc_id").alias("least")), "least")
        out = hot_join(out, least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    lost = docs.where("doc_id is null").mapInArrow(partial(signatures, width=width, percent=percent), kinds)
    return out.unionAll(lost.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))
