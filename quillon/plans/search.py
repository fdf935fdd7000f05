"""Ranked full-text search: BM25 over an inverted index as DataFrames."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import ascii_lower
from ..functions.terms import UnsupportedQuery, count_stems, post, query_terms, tokens, unblock

K1, B = 1.2, 0.75
#: Files of a saved index are grouped into so many buckets of terms: a search reads only those of its terms.
TERM_BUCKETS = 64


class InvalidFilter(ValueError):
    pass


class ColumnNotFound(ValueError):
    pass


def blocks(docs: DataFrame, key: str, columns: Sequence[str], stem: str = "none", mode: str = "ascii") -> DataFrame:
    """(term, col, keys, tf, positions): the postings of a term in many documents in one row. A document's words are grouped
    where it is read, without a row for each word and without a shuffle."""
    rows = docs.select(key, *[tokens(F.col(c), mode).alias(f"_{i}") for i, c in enumerate(columns)])
    numbers = T.ArrayType(T.IntegerType())
    kinds = T.StructType().add("term", "string").add("col", "integer").add("keys", T.ArrayType(rows.schema[0].dataType)).add("tf", numbers).add("positions", numbers)
    return rows.mapInArrow(lambda it: post(it, stem), kinds)


def postings(docs: DataFrame, key: str, columns: Sequence[str], stem: str = "none", mode: str = "ascii") -> DataFrame:
    """(term, key, col, tf, positions). One row for each document (each row of docs), column and term."""
    kinds = T.StructType().add("term", "string").add(key, docs.schema[key].dataType).add("col", "integer").add("tf", "long").add("positions", T.ArrayType(T.IntegerType()))
    return blocks(docs, key, columns, stem, mode).mapInArrow(lambda it: unblock(it, key), kinds)


def lengths(docs: DataFrame, key: str, columns: Sequence[str], mode: str = "ascii") -> DataFrame:
    """(key, doc_len): tokens of all columns."""
    return docs.select(key, reduce(lambda a, b: a + b, [F.size(tokens(F.col(c), mode)) for c in columns]).cast("long").alias("doc_len"))


def save_index(docs: DataFrame, key: str, columns: Sequence[str], path: str, stem: str = "none", mode: str = "ascii") -> None:
    """Postings in blocks and lengths as Parquet; postings by bucket of the term, so that a search prunes to its terms'
    buckets. The blocks are the only shuffle."""
    bucket = F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int").alias("bucket")
    p = blocks(docs, key, columns, stem, mode).select("*", bucket)
    p.repartition("bucket", F.pmod(F.xxhash64(F.col("keys")[0]), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths(docs, key, columns, mode).write.mode("overwrite").parquet(f"{path}/lengths")
    totals(docs.sparkSession.read.parquet(f"{path}/lengths")).write.mode("overwrite").parquet(f"{path}/totals")


def totals(sizes: DataFrame) -> DataFrame:
    """One row: n, avg_len."""
    return sizes.agg(F.count(F.lit(1)).alias("n"), (F.sum("doc_len") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("avg_len"))


def saved_hits(spark, path: str, key: str, terms: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The terms' postings (term, key, col, tf), all lengths and their totals, from a saved index."""
    p = spark.read.parquet(f"{path}/postings")
    buckets = spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(TERM_BUCKETS)).cast("int") for t in terms]).first()
    own = p.where(F.col("bucket").isin(*set(buckets)) & F.col("term").isin(*set(terms))).select("term", "col", F.explode(F.arrays_zip("keys", "tf")).alias("p"))
    return own.select("term", F.col("p.keys").alias(key), "col", F.col("p.tf").cast("long").alias("tf")), spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/totals")


def counted(docs: DataFrame, key: str, columns: Sequence[str], terms: Sequence[str], mode: str, keep: Column, stem: str = "none") -> DataFrame:
    """(key, keep, doc_len, tf): each row is tokenised once, and only counts leave it; tf has an array of a count for each
    column for each different term. A stem is a beginning of its words, so only the words that begin with a term are
    stemmed."""
    rows = docs.select(key, keep.alias("keep"), *[tokens(F.col(c), mode).alias(f"_{i}") for i, c in enumerate(columns)])
    own, different = [F.col(f"_{i}") for i in range(len(columns))], list(dict.fromkeys(terms))
    sized = rows.select("*", reduce(lambda a, b: a + b, map(F.size, own)).cast("long").alias("doc_len"))
    if stem == "light":
        begins = lambda x: reduce(lambda a, b: a | b, [x.startswith(w) for w in different])
        few = sized.select(key, "keep", "doc_len", F.array(*[F.filter(t, begins) for t in own]).alias("words"))
        kinds = T.StructType([*few.schema.fields[:-1], T.StructField("tf", T.ArrayType(T.ArrayType(T.LongType())))])
        return few.mapInArrow(lambda it: count_stems(it, different), kinds)
    is_word = lambda w: lambda x: x == w
    tf = [F.array(*[F.size(F.filter(t, is_word(w))).cast("long") for t in own]) for w in different]
    return sized.select(key, "keep", "doc_len", F.array(*tf).alias("tf"))


def total_of(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def scored_rows(rows: DataFrame, key: str, terms: Sequence[str], weights: Sequence[float], n_columns: int) -> DataFrame:
    """As `scored`, from `counted` rows: one aggregate for the statistics, and one pass that scores each row by itself; no
    shuffle but for the best ones."""
    often = Counter(terms)
    weight = [float(weights[i]) if i < len(weights) else 1.0 for i in range(n_columns)]
    has = [total_of(F.col("tf")[k]) > 0 for k in range(len(often))]
    n_t = [F.count(F.when(h, 1)).alias(f"n{k}") for k, h in enumerate(has)]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), (F.sum("doc_len") / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("avg_len"), *n_t)
    found = rows.where(reduce(lambda a, b: a & b, has) & F.col("keep") & F.col(key).isNotNull()).crossJoin(F.broadcast(stats))  # one row
    score = [bm25(F.col("n"), F.col(f"n{k}"), reduce(lambda a, b: a + b, [F.col("tf")[k][i] * w for i, w in enumerate(weight)]), F.col("doc_len"), F.col("avg_len")) * m for k, m in enumerate(often.values())]
    by_column = [reduce(lambda a, b: a + b, [F.col("tf")[k][i] * m for k, m in enumerate(often.values())]) for i in range(n_columns)]
    out = found.select(key, reduce(lambda a, b: a + b, score).alias("score"), "doc_len", F.array(*by_column).alias("column_hits"))
    return out.select(key, "score", total_of(F.col("column_hits")).alias("hits"), "doc_len", "column_hits")


def bm25(n: Column, n_t: Column, tf: Column, doc_len: Column, avg_len: Column) -> Column:
    """The score of one term, more negative for a better hit."""
    idf = F.log((n - F.least(n_t, n) + 0.5) / (F.least(n_t, n) + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
    score = -idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))
    return F.when((tf > 0) & (avg_len > 0) & (n > 0), score).otherwise(F.lit(0.0))


def scored(hits: DataFrame, sizes: DataFrame, stats: DataFrame, key: str, terms: Sequence[str], weights: Sequence[float], n_columns: int) -> DataFrame:
    """(key, score, hits, doc_len, column_hits) of documents that have all terms; repeated terms count as often."""
    often = Counter(terms)
    times = F.create_map(*[F.lit(x) for t, n in often.items() for x in (t, n)])
    weight = F.element_at(F.array(*[F.lit(float(weights[i]) if i < len(weights) else 1.0) for i in range(n_columns)]), F.col("col") + 1)
    by_term = hits.groupBy(key, "term").agg(F.sum(F.col("tf") * weight).alias("w"), F.sum("tf").alias("tf"), *[F.sum(F.when(F.col("col") == i, F.col("tf")).otherwise(0)).alias(f"_c{i}") for i in range(n_columns)])
    df = by_term.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))  # a row for each term of the query
    rows = by_term.join(F.broadcast(df), "term").join(sizes, key).crossJoin(F.broadcast(stats)).withColumn("m", F.element_at(times, F.col("term")))
    score = bm25(F.col("n"), F.col("n_t"), F.col("w"), F.col("doc_len"), F.col("avg_len"))
    out = rows.groupBy(key, "doc_len").agg(F.sum(score * F.col("m")).alias("score"), F.sum(F.col("tf") * F.col("m")).alias("hits"), F.array(*[F.sum(F.col(f"_c{i}") * F.col("m")) for i in range(n_columns)]).alias("column_hits"), F.count(F.lit(1)).alias("_terms"))
    return out.where(F.col("_terms") == len(often)).select(key, "score", "hits", "doc_len", "column_hits")


def parse_filter(text: str, df: DataFrame) -> Column:
    """col~=text (contains, ASCII case folded), col>=v, col<=v, col=v; one pair of quotes around v is dropped."""
    op = next((o for o in ("~=", ">=", "<=", "=") if o in text), None)
    if op is None:
        raise InvalidFilter(text)
    name, value = (x.strip() for x in text.split(op, 1))
    if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
        value = value[1:-1]
    kind = next((t for c, t in df.dtypes if c.lower() == name.lower()), None)
    if kind is None:
        raise InvalidFilter(text)
    c = F.col(name)
    if op == "~=":
        return F.contains(ascii_lower(c), ascii_lower(F.lit(value))) if kind == "string" else F.lit(False)
    other = F.lit(value) if kind == "string" else F.lit(value).try_cast("double") if kind in ("double", "float") or "." in value else F.lit(value).try_cast(kind)
    return F.coalesce({"=": c == other, ">=": c >= other, "<=": c <= other}[op], F.lit(False))


def search(docs: DataFrame, key: str, columns: Sequence[str], query: str, limit: int | None = 10, weights: Sequence[float] = (), filters: Sequence[str] = (), stem: str = "none", mode: str = "ascii", index: str | None = None) -> DataFrame:
    """The best `limit` documents that have all words of the query: (key, score, hits, doc_len, column_hits), best first,
    ties by key. Filters choose among the scored documents and don't change the statistics."""
    terms = query_terms(query, stem)
    if not terms:
        raise UnsupportedQuery(query)
    keep = reduce(lambda a, b: a & b, [parse_filter(f, docs) for f in filters], F.lit(True))
    if index:
        out = scored(*saved_hits(docs.sparkSession, index, key, terms), key, terms, weights, len(columns))
        out = out.join(docs.where(keep).select(key), key, "left_semi") if filters else out
    else:
        out = scored_rows(counted(docs, key, columns, terms, mode, keep, stem), key, terms, weights, len(columns))
    out = out.orderBy("score", key)
    return out if limit is None else out.limit(limit)


def search_stats(docs: DataFrame, key: str, columns: Sequence[str], query: str, stem: str = "none", mode: str = "ascii") -> DataFrame:
    """One row: total_rows, rows_with_term (rows that have all terms), total_hits, avg_doc_len."""
    terms = query_terms(query, stem)
    rows_with_term, total_hits = F.count(F.lit(1)).alias("rows_with_term"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits")
    rows = counted(docs, key, columns, terms, mode, F.lit(True), stem)
    n = F.count(F.lit(1))
    a = rows.agg(n.alias("total_rows"), F.round(F.sum("doc_len") / F.nullif(n, F.lit(0)), 3).alias("avg_doc_len"))
    found = scored_rows(rows, key, terms, (), len(columns))
    return a.crossJoin(F.broadcast(found.agg(rows_with_term, total_hits)))


def hydrate(found: DataFrame, content: DataFrame, key: str, columns: Sequence[str] = ()) -> DataFrame:
    """Hits with the columns of their rows. Without a hint: all hits of a search without limit may be many."""
    chosen = [c for c in (columns or content.columns) if c != key]
    return content.select(key, *chosen).join(found, key).orderBy("score", key)


def chosen_columns(text: str, content: DataFrame) -> list[str]:
    """A comma-separated list of columns; empty, * or - stand for all."""
    if text.strip() in ("", "*", "-"):
        return content.columns
    known = {c.lower(): c for c in content.columns}
    out = [x.strip() for x in text.split(",") if x.strip()]
    if unknown := [x for x in out if x.lower() not in known]:
        raise ColumnNotFound(", ".join(unknown))
    return [known[x.lower()] for x in out]


def column_weights(text: str) -> list[float]:
    """Comma-separated weights of the searched columns; empty or - stand for none."""
    return [] if text.strip() in ("", "-") else [float(x) for x in text.split(",")]


def hits_text(found: DataFrame, key: str, limit: int = 1000) -> str:
    """A line for each of the best `limit` hits, for people: key|score|hits=|doc_len=|c0=, ..."""
    return "\n".join("|".join([str(r[key]), f"{r.score:.15f}", f"hits={r.hits}", f"doc_len={r.doc_len}", *(f"c{i}={n}" for i, n in enumerate(r.column_hits))]) for r in found.orderBy("score", key).take(limit))


def hydrated_json(found: DataFrame, content: DataFrame, key: str, columns: Sequence[str] = (), digits: int = 15) -> DataFrame:
    """(rowid, rank_score, json) of each hit; binary columns are null and control characters spaces."""
    rows = with_result(found, content, key, columns, digits)
    return rows.select(F.col(key).alias("rowid"), F.col("score").alias("rank_score"), F.to_json("result", {"ignoreNullFields": "false"}).alias("json"))


def envelope(docs: DataFrame, key: str, search_columns: Sequence[str], query: str, name: str, limit: int = 10, columns: Sequence[str] = (), digits: int = 15, **how) -> DataFrame:
    """One row with the whole answer as JSON: statistics of the query and the best `limit` rows, best first."""
    found = with_result(search(docs, key, search_columns, query, limit, **how), docs, key, columns, digits)
    best = found.agg(F.sort_array(F.collect_list(F.struct("score", key, "result"))).alias("best"))  # limit rows
    stats = search_stats(docs, key, search_columns, query, how.get("stem", "none"), how.get("mode", "ascii"))
    fields = [F.lit("ok").alias("status"), F.lit(name).alias("table"), F.lit(query).alias("query"), "total_rows", "rows_with_term", "total_hits", "avg_doc_len"]
    fields += [F.transform("best", lambda x: x["result"]).alias("results"), F.size("best").alias("count")]
    return stats.crossJoin(F.broadcast(best)).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))


def with_result(found: DataFrame, content: DataFrame, key: str, columns: Sequence[str], digits: int) -> DataFrame:
    rows = hydrate(found, content, key, columns)
    kinds = dict(content.dtypes)
    shown = [F.lit(None).cast("string").alias(c) if kinds[c] == "binary" else F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ").alias(c) if kinds[c] == "string" else F.col(c) for c in (columns or content.columns)]
    fields = F.struct(F.col(key).alias("rowid"), F.round("score", digits).alias("rank_score"), "hits", "doc_len", "column_hits", F.struct(*shown).alias("columns"))
    return rows.select(key, "score", fields.alias("result"))


# richer queries: sets of keys from positions


def phrase(docs: DataFrame, key: str, columns: Sequence[str], words: str, gap: int = 0, mode: str = "ascii") -> DataFrame:
    """Keys of documents with the words next to each other in one column (with gap: in order, each at most gap words on)."""
    terms = query_terms(words)
    own = F.lit(False)
    for c in columns:
        t = tokens(F.col(c), mode)
        line = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
        if gap == 0:
            own = own | line.contains(" " + " ".join(terms) + " ")
        else:
            between = rf"(?: [^ ]+){{0,{gap}}} "
            own = own | line.rlike(" " + between.join(map(re.escape, terms)) + " ")
    return docs.where(own).select(key)


def near(docs: DataFrame, key: str, columns: Sequence[str], words: str, gap: int = 10, mode: str = "ascii") -> DataFrame:
    """Keys of documents that have the words in one column in any order, with at most `gap` words between the first and the
    last of them. One walk over a column's words keeps where each word was seen last."""
    terms = list(dict.fromkeys(query_terms(words)))
    never = F.array(*[F.lit(-(1 << 40)) for _ in terms])
    start = F.struct(F.lit(0).cast("long").alias("at"), never.alias("last"), F.lit(False).alias("ok"))

    def walk(state: Column, word: Column) -> Column:
        last = F.array(*[F.when(word == t, state["at"]).otherwise(state["last"][k]) for k, t in enumerate(terms)])
        close = state["at"] - F.array_min(last) <= gap + 1
        return F.struct((state["at"] + 1).alias("at"), last.alias("last"), (state["ok"] | close).alias("ok"))

    own = F.lit(False)
    for c in columns:
        own = own | F.aggregate(tokens(F.col(c), mode), start, walk, lambda state: state["ok"])
    return docs.where(own).select(key)


def snippets(found: DataFrame, content: DataFrame, key: str, column: str, query: str, size: int = 32, marks: tuple[str, str] = ("[", "]"), more: str = "...") -> DataFrame:
    """(key, snippet) of hits: the `size` words of a column, from a hit on, with the most hits (the first such), as they are
    written, hits between marks, and `more` where text is left out. Without a hit in this column: its first words."""
    terms = F.array(*[F.lit(t) for t in dict.fromkeys(query_terms(query))])
    part = r"([A-Za-z0-9]+)([^A-Za-z0-9]*)"  # a word, and what follows it
    word, rest = (lambda x: F.regexp_extract(x, part, 1)), (lambda x: F.regexp_extract(x, part, 2))
    rows = content.join(found.select(key), key, "left_semi").select(key, F.coalesce(F.col(column), F.lit("")).alias("text"))
    rows = rows.withColumn("parts", F.regexp_extract_all("text", F.lit(part), 0))
    is_hit = F.transform("parts", lambda x: F.array_contains(terms, F.lower(word(x))))
    rows = rows.withColumn("hit", is_hit).withColumn("at", F.filter(F.transform("hit", lambda x, i: F.when(x, i)), lambda i: i.isNotNull()))
    # at most `size` hits lie in a window
    inside = F.transform("at", lambda p, k: F.struct(F.size(F.filter(F.slice(F.col("at"), k + 1, size), lambda q: q < p + size)).alias("n"), (-p).alias("before")))
    rows = rows.withColumn("start", F.coalesce(-F.array_max(inside)["before"], F.lit(0)))
    cut = F.size("parts") > F.col("start") + size
    name = lambda x, i: F.when(F.col("hit")[F.col("start") + i], F.concat(F.lit(marks[0]), word(x), F.lit(marks[1]))).otherwise(word(x))
    shown = F.transform(F.slice("parts", F.col("start") + 1, size), lambda x, i: F.concat(name(x, i), F.when(cut & (i == size - 1), "").otherwise(rest(x))))
    before = F.when(F.col("start") > 0, F.lit(more)).otherwise(F.regexp_extract("text", "^[^A-Za-z0-9]*", 0))
    return rows.select(key, F.concat(before, F.concat_ws("", shown), F.when(cut, more).otherwise("")).alias("snippet"))


def prefix(docs: DataFrame, key: str, columns: Sequence[str], start: str, mode: str = "ascii") -> DataFrame:
    """Keys of documents that have a word with this beginning."""
    own = F.lit(False)
    for c in columns:
        own = own | F.exists(tokens(F.col(c), mode), lambda t: t.startswith(start.lower()))
    return docs.where(own).select(key)


def boolean(docs: DataFrame, key: str, columns: Sequence[str], all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = (), mode: str = "ascii") -> DataFrame:
    """Keys of documents by AND, OR and NOT of words, in one scan."""
    words = F.concat(*[tokens(F.col(c), mode) for c in columns])
    has = lambda w: F.array_contains(words, w.lower())
    own = F.lit(True)
    for w in all_of:
        own = own & has(w)
    for w in none_of:
        own = own & ~has(w)
    if any_of:
        own = own & reduce(lambda a, b: a | b, map(has, any_of))
    return docs.where(own).select(key)
