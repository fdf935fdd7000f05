"""The engine's queries over the tables, each with the SQL that a reference engine runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import Expressions
from ..functions.terms import SUFFIXES
from ..operators import dml
from ..operators import relational as R
from ..sources.tables import KEYS, describe, scratch, table
from . import search as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _where(name: str, source: str, columns: str, sql: str, build) -> None:
    """A filter query: some columns of the rows that a predicate keeps."""
    cols = columns.split(", ")
    query(name, f"SELECT {columns} FROM {source} WHERE {sql}")(lambda spark, d: (t := table(spark, d, source)).where(build(Expressions(t))).select(*cols))


C = F.col

# scans and projections
query("scan_star", "SELECT * FROM orders")(lambda s, d: table(s, d, "orders"))
query("project_columns", "SELECT l_orderkey, l_extendedprice FROM lineitem")(lambda s, d: R.project(table(s, d, "lineitem"), "l_orderkey", "l_extendedprice"))
query("project_alias", "SELECT c_custkey AS id, c_name AS name FROM customer")(lambda s, d: R.project(table(s, d, "customer"), (C("c_custkey"), "id"), (C("c_name"), "name")))
query("project_rowid", "SELECT o_orderkey AS rowid, o_orderkey, o_totalprice FROM orders")(lambda s, d: R.project(table(s, d, "orders"), (C(KEYS["orders"]), "rowid"), "o_orderkey", "o_totalprice"))
query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")(lambda s, d: R.point_lookup(table(s, d, "orders"), "o_orderkey", 77))
query("key_exists", "SELECT CAST(least(count(*), 1) AS BIGINT) AS found FROM orders WHERE o_orderkey = 77")(lambda s, d: R.key_exists(table(s, d, "orders"), "o_orderkey", 77))
query("key_edge_max", "SELECT max(o_orderkey) AS edge FROM orders")(lambda s, d: R.key_edge(table(s, d, "orders"), "o_orderkey", True))
query("key_edge_min", "SELECT min(o_orderkey) AS edge FROM orders")(lambda s, d: R.key_edge(table(s, d, "orders"), "o_orderkey", False))
query("index_scan", "SELECT o_custkey, o_orderkey FROM orders ORDER BY o_custkey NULLS FIRST, o_orderkey")(lambda s, d: R.index_scan(table(s, d, "orders"), "o_custkey", "o_orderkey"))
query("describe_tables", """
SELECT table_name, CAST(column_index - 1 AS INTEGER) AS position, column_name,
       CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp' END AS column_type
FROM duckdb_columns() WHERE table_name IN ('customer', 'orders') AND NOT internal""")(lambda s, d: describe(table(s, d, "customer"), "customer").unionAll(describe(table(s, d, "orders").withColumn("o_orderdate", C("o_orderdate").cast("timestamp")), "orders")))

# predicates
for op, n in (("=", "eq"), ("!=", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):
    _where(f"filter_{n}", "customer", "c_custkey, c_nationkey", f"c_nationkey {op} 7", lambda e, op=op: e.compare(C("c_nationkey"), op, 7))
_where("filter_text_eq", "customer", "c_custkey, c_mktsegment", "c_mktsegment = 'BUILDING'", lambda e: e.compare(C("c_mktsegment"), "=", "BUILDING"))
_where("filter_mixed_class", "customer", "c_custkey", "false", lambda e: e.compare(C("c_name"), "=", 5))
_where("filter_timestamp", "orders", "o_orderkey", "o_orderdate >= TIMESTAMP '1996-01-01'", lambda e: e.compare(C("o_orderdate"), ">=", "1996-01-01"))
_where("filter_and_or_not", "orders", "o_orderkey", "(o_orderstatus = 'F' AND o_totalprice > 100000) OR NOT (o_custkey < 500)", lambda e: (e.compare(C("o_orderstatus"), "=", "F") & e.compare(C("o_totalprice"), ">", 100000)) | e.negate(e.compare(C("o_custkey"), "<", 500), C("o_custkey")))
_where("filter_between", "lineitem", "l_orderkey, l_extendedprice", "l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')", lambda e: e.between(C("l_quantity"), 10, 20) & e.within(C("l_returnflag"), ["A", "R"]))
_where("filter_not_between", "part", "p_partkey, p_size", "p_size NOT BETWEEN 10 AND 40", lambda e: e.between(C("p_size"), 10, 40, negated=True))
_where("filter_in", "customer", "c_custkey, c_nationkey", "c_nationkey IN (1, 2, 3)", lambda e: e.within(C("c_nationkey"), [1, 2, 3, 3, None]))
_where("filter_not_in", "customer", "c_custkey, c_nationkey", "c_nationkey NOT IN (1, 2, 3)", lambda e: e.within(C("c_nationkey"), [1, 2, 3], negated=True))
_where("filter_in_empty", "customer", "c_custkey", "false", lambda e: e.within(C("c_nationkey"), []))
_where("filter_like", "part", "p_partkey, p_name", "p_name ILIKE '%A_%e%'", lambda e: e.like(C("p_name"), "%A_%e%"))
_where("filter_not_like", "part", "p_partkey, p_type", "p_type NOT ILIKE '%s%'", lambda e: e.like(C("p_type"), "%s%", negated=True))
_where("filter_is_null", "events", "event_id", "value IS NULL", lambda e: C("value").isNull())
_where("filter_is_not_null", "events", "event_id", "value IS NOT NULL", lambda e: C("value").isNotNull())
_where("filter_truthy", "lineitem", "l_orderkey, l_linenumber", "l_discount <> 0 AND length(l_returnflag) > 0", lambda e: e.truthy(C("l_discount")) & e.truthy(C("l_returnflag")))

# expressions


@query("expr_arith", "SELECT o_orderkey, CAST(o_orderkey + o_custkey AS BIGINT) AS a, CAST(o_orderkey - o_custkey AS BIGINT) AS s, CAST(o_orderkey * 3 AS BIGINT) AS m, o_totalprice / 4 AS r, o_orderkey // nullif(o_custkey % 5, 0) AS q, o_orderkey % nullif(o_custkey % 5, 0) AS x FROM orders")
def expr_arith(spark, d):
    t = table(spark, d, "orders")
    e = Expressions(t)
    five = e.arith(C("o_custkey"), "%", 5)
    return t.select("o_orderkey", e.arith(C("o_orderkey"), "+", C("o_custkey")).alias("a"), e.arith(C("o_orderkey"), "-", C("o_custkey")).alias("s"), e.arith(C("o_orderkey"), "*", 3).alias("m"), e.arith(C("o_totalprice"), "/", 4).alias("r"), e.arith(C("o_orderkey"), "/", five).alias("q"), e.arith(C("o_orderkey"), "%", five).alias("x"))


@query("expr_real_mod", "SELECT c_custkey, c_acctbal - 7.0::DOUBLE * floor(c_acctbal / 7.0::DOUBLE) AS m, -c_custkey AS n FROM customer")
def expr_real_mod(spark, d):
    t = table(spark, d, "customer")
    e = Expressions(t)
    return t.select("c_custkey", e.arith(C("c_acctbal"), "%", 7.0).alias("m"), e.minus(C("c_custkey")).alias("n"))


@query("expr_concat", "SELECT c_custkey, c_name || '-' || CAST(c_nationkey AS VARCHAR) AS v FROM customer")
def expr_concat(spark, d):
    t = table(spark, d, "customer")
    return t.select("c_custkey", Expressions(t).concat(C("c_name"), "-", C("c_nationkey")).alias("v"))


@query("expr_predicate_value", "SELECT o_orderkey, CAST(o_totalprice > 150000 AS BIGINT) AS big, CAST(o_orderstatus <> 'F' AS BIGINT) AS is_open FROM orders")
def expr_predicate_value(spark, d):
    t = table(spark, d, "orders")
    e = Expressions(t)
    return t.select("o_orderkey", e.value(e.compare(C("o_totalprice"), ">", 150000)).alias("big"), e.value(e.compare(C("o_orderstatus"), "!=", "F")).alias("is_open"))


# aggregates
query("agg_count_star", 'SELECT count(*) AS "COUNT(*)" FROM lineitem')(lambda s, d: R.count_rows(table(s, d, "lineitem")))
query("agg_all", 'SELECT count(l_tax) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem')(
    lambda s, d: R.aggregate(table(s, d, "lineitem"), ("count", "l_tax", "n"), ("sum", "l_linenumber", "s"), ("sum", "l_quantity", "q"), ("avg", "l_discount", "a"), ("min", "l_shipdate", "lo"), ("max", "l_shipdate", "hi")).withColumns({"q": F.round("q", 2), "a": F.round("a", 6)})
)
query("agg_min_max_text", 'SELECT min(c_name) AS "MIN", max(c_mktsegment) AS "MAX" FROM customer')(lambda s, d: R.aggregate(table(s, d, "customer"), ("min", "c_name"), ("max", "c_mktsegment")))
query("agg_empty", 'SELECT count(*) AS "COUNT(*)", count(o_custkey) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo FROM orders WHERE o_orderkey < -1')(
    lambda s, d: R.aggregate(table(s, d, "orders").where("o_orderkey < -1"), ("count", "*"), ("count", "o_custkey", "n"), ("sum", "o_totalprice", "s"), ("avg", "o_totalprice", "a"), ("min", "o_orderkey", "lo"))
)
query("agg_count_range", 'SELECT count(*) AS "COUNT(*)" FROM orders WHERE o_custkey BETWEEN 20 AND 220')(lambda s, d: R.count_rows((t := table(s, d, "orders")).where(Expressions(t).between(C("o_custkey"), 20, 220))))
query("agg_count_in_dup", 'SELECT count(*) AS "COUNT(*)" FROM orders WHERE o_custkey IN (20, 21, 21, 24)')(lambda s, d: R.count_rows((t := table(s, d, "orders")).where(Expressions(t).within(C("o_custkey"), [20, 21, 21, 24]))))

# order
query("topk_asc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice NULLS FIRST, o_orderkey LIMIT 100")(lambda s, d: R.ordered(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", limit=100, ties=["o_orderkey"]))
query("topk_desc", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey LIMIT 100")(lambda s, d: R.ordered(table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", True, 100, ["o_orderkey"]))
query("natural_order_limit", "SELECT * FROM customer ORDER BY c_custkey LIMIT 50")(lambda s, d: R.ordered(table(s, d, "customer"), None, limit=50, ties=["c_custkey"]))
query("limit_zero", "SELECT c_custkey FROM customer LIMIT 0")(lambda s, d: R.ordered(table(s, d, "customer").select("c_custkey"), None, limit=0))

# joins
query("join_equi", "SELECT o_orderkey, c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")(lambda s, d: R.inner_join(("o", table(s, d, "orders")), ("c", table(s, d, "customer"), C("o.o_custkey") == C("c.c_custkey"))).select("o_orderkey", "c_name"))
query("join_three_way", "SELECT l_orderkey, l_linenumber, l_extendedprice, c_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000")(
    lambda s, d: R.inner_join(("l", table(s, d, "lineitem")), ("o", table(s, d, "orders"), C("l_orderkey") == C("o_orderkey")), ("c", table(s, d, "customer"), C("o_custkey") == C("c_custkey"))).where("o_totalprice > 200000").select("l_orderkey", "l_linenumber", "l_extendedprice", "c_name")
)
query("join_theta", "SELECT a.n_name AS a, b.r_name AS b FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")(lambda s, d: R.inner_join(("a", table(s, d, "nation")), ("b", table(s, d, "region"), C("a.n_regionkey") < C("b.r_regionkey"))).select(C("a.n_name").alias("a"), C("b.r_name").alias("b")))
query("join_self", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")(lambda s, d: R.inner_join(("a", table(s, d, "nation")), ("b", table(s, d, "nation"), C("a.n_regionkey") == C("b.n_regionkey"))).select(C("a.n_nationkey").alias("x"), C("b.n_nationkey").alias("y")))
query("join_star", "SELECT a.n_nationkey AS a_n_nationkey, a.n_name AS a_n_name, a.n_regionkey AS a_n_regionkey, b.n_nationkey AS b_n_nationkey, b.n_name AS b_n_name, b.n_regionkey AS b_n_regionkey, r_regionkey, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region r ON b.n_regionkey = r.r_regionkey")(
    lambda s, d: R.inner_join(("a", n := table(s, d, "nation")), ("b", n, C("a.n_regionkey") == C("b.n_regionkey")), ("r", r := table(s, d, "region"), C("b.n_regionkey") == C("r.r_regionkey"))).select(*R.star(("a", n), ("b", n), ("r", r)))
)
query("join_cross", "SELECT n_nationkey, r_regionkey FROM nation CROSS JOIN region")(lambda s, d: R.inner_join(("n", table(s, d, "nation")), ("r", table(s, d, "region"), True)).select("n_nationkey", "r_regionkey"))
query("join_agg", 'SELECT count(*) AS "COUNT(*)", round(sum(l_quantity), 2) AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10')(
    lambda s, d: R.aggregate(R.inner_join(("l", table(s, d, "lineitem")), ("p", table(s, d, "part"), C("l_partkey") == C("p_partkey"))).where("p_size < 10"), ("count", "*"), ("sum", "l_quantity", "q")).withColumn("q", F.round("q", 2))
)
query("keys_in_all", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_discount = 0)")(
    lambda s, d: R.keys_in_all(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", (l := table(s, d, "lineitem")).where("l_quantity > 45").select("l_orderkey"), l.where("l_discount = 0").select("l_orderkey"))
)

# full-text search


def fts_sql(terms: list[str], columns: list[str], weights: list[float], where: str = "true", limit: int | None = 10, select: str = "doc_id, round(score, 9) AS score, hits, doc_len", order: str = "ORDER BY exact, doc_id", term: str = "term") -> str:
    """`term`: the SQL of a term of the index. The order is by the exact score, not by the rounded one that is shown."""
    toks = " UNION ALL ".join(f"SELECT doc_id, {i} AS col, unnest(regexp_split_to_array(lower({c}), '[^a-z0-9]+')) AS term FROM documents" for i, c in enumerate(columns))
    w = "1.0::DOUBLE" if not weights else "CASE col " + " ".join(f"WHEN {i} THEN {float(x)}::DOUBLE" for i, x in enumerate(weights)) + " ELSE 1.0::DOUBLE END"
    n = len(set(terms))
    return f"""
WITH tok AS (SELECT doc_id, col, {term} AS term FROM ({toks}) WHERE term <> ''),
len AS (SELECT d.doc_id, count(t.term) AS doc_len FROM documents d LEFT JOIN tok t ON t.doc_id = d.doc_id GROUP BY d.doc_id),
st AS (SELECT count(*) AS n, sum(doc_len)::DOUBLE / count(*) AS avg_len FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf, sum({w}) AS w FROM tok WHERE term IN ({", ".join(f"'{t}'" for t in terms)}) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS n_t FROM tf GROUP BY term),
s AS (SELECT tf.doc_id, len.doc_len, tf.tf,
        -(CASE WHEN ln((n - n_t + 0.5::DOUBLE) / (n_t + 0.5::DOUBLE)) > 0 THEN ln((n - n_t + 0.5::DOUBLE) / (n_t + 0.5::DOUBLE)) ELSE 1e-6::DOUBLE END)
        * w * 2.2::DOUBLE / (w + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avg_len)) AS score
      FROM tf JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN st),
r AS (SELECT doc_id, doc_len, sum(score) AS score, CAST(sum(tf) AS BIGINT) AS hits FROM s GROUP BY doc_id, doc_len HAVING count(*) = {n})
SELECT {select} FROM (SELECT r.*, r.score AS exact, source, lang FROM r JOIN documents USING (doc_id) WHERE {where}) {order} {'' if limit is None else f'LIMIT {limit}'}"""


def _fts(name: str, query_text: str, columns: list[str], weights: tuple = (), filters: tuple = (), where: str = "true", limit: int | None = 10) -> None:
    query(name, fts_sql(query_text.split(), columns, list(weights), where, limit))(
        lambda s, d: S.search(table(s, d, "documents"), "doc_id", columns, query_text, limit, weights, filters).select("doc_id", F.round("score", 9).alias("score"), "hits", "doc_len")
    )


_fts("fts_single", "anea", ["text"], limit=20)
_fts("fts_multi_and", "tion the", ["text"])
_fts("fts_weighted", "src3 the", ["source", "text"], weights=(5.0, 1.0))
_fts("fts_filtered_eq", "tion", ["text"], filters=("lang=en",), where="lang = 'en'")
_fts("fts_filtered_contains", "thor", ["text"], filters=("source~=SRC1",), where="lower(source) LIKE '%src1%'")
_fts("fts_filtered_range", "thin", ["text"], filters=("n_chars>=500", "n_chars<='2000'"), where="n_chars >= 500 AND n_chars <= 2000")
_fts("fts_all_hits", "the of", ["text"], limit=None)
query("fts_stats", fts_sql(["tion", "the"], ["text"], [], limit=None, select="""(SELECT count(*) FROM documents) AS total_rows, (SELECT round(avg_len, 3) FROM st) AS avg_doc_len, count(*) AS rows_with_term, CAST(coalesce(sum(hits), 0) AS BIGINT) AS total_hits""", order=""))(lambda s, d: S.search_stats(table(s, d, "documents"), "doc_id", ["text"], "tion the"))
query("fts_hydrated", fts_sql(["ther"], ["text"], [], select="doc_id, round(score, 9) AS score, hits, source"))(
    lambda s, d: S.hydrate(S.search(t := table(s, d, "documents"), "doc_id", ["text"], "ther"), t, "doc_id", ["source"]).select("doc_id", F.round("score", 9).alias("score"), "hits", "source")
)
RESULT = "json_object('rowid', doc_id, 'rank_score', round(score, 6), 'hits', hits, 'doc_len', doc_len, 'column_hits', [hits], 'columns', json_object('source', source, 'lang', lang))"
query("fts_json", fts_sql(["thre"], ["text"], [], select=f"doc_id AS rowid, round(score, 9) AS rank_score, CAST({RESULT} AS VARCHAR) AS json"))(
    lambda s, d: S.hydrated_json(S.search(t := table(s, d, "documents"), "doc_id", ["text"], "thre"), t, "doc_id", ["source", "lang"], digits=6).withColumn("rank_score", F.round("rank_score", 9))
)
query("fts_envelope", "WITH hit AS (" + fts_sql(["eren"], ["text"], [], select=f"{RESULT} AS result, exact, doc_id", limit=5) + "), stat AS (" + fts_sql(["eren"], ["text"], [], limit=None, order="", select="""
  (SELECT count(*) FROM documents) AS total_rows, (SELECT round(avg_len, 3) FROM st) AS avg_doc_len, count(*) AS rows_with_term, CAST(coalesce(sum(hits), 0) AS BIGINT) AS total_hits""") + """)
SELECT CAST(json_object('status', 'ok', 'table', 'documents', 'query', 'eren', 'total_rows', total_rows, 'rows_with_term', rows_with_term, 'total_hits', total_hits, 'avg_doc_len', avg_doc_len,
  'results', (SELECT coalesce(to_json(list(result ORDER BY exact, doc_id)), '[]'::JSON) FROM hit), 'count', (SELECT count(*) FROM hit)) AS VARCHAR) AS json FROM stat""")(
    lambda s, d: S.envelope(table(s, d, "documents"), "doc_id", ["text"], "eren", "documents", 5, ["source", "lang"], digits=6)
)


@query("fts_indexed", fts_sql(["src3", "than"], ["source", "text"], [2.0, 1.0]))
def fts_indexed(spark, d):
    """A search over a saved index: only the buckets of its two terms are read."""
    t, path = table(spark, d, "documents"), f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    S.save_index(t, "doc_id", ["source", "text"], path)
    return S.search(t, "doc_id", ["source", "text"], "src3 than", weights=(2.0, 1.0), index=path).select("doc_id", F.round("score", 9).alias("score"), "hits", "doc_len")


def stem_sql(w: str) -> str:
    """The light stemmer's three steps in SQL, the same at index and query time."""
    ends = lambda s, *suffixes: "(" + " OR ".join(f"suffix({s}, '{x}')" for x in suffixes) + ")"
    drop = lambda s, n: f"left({s}, length({s}) - {n})"
    voiced = lambda s, n: f"regexp_matches({drop(s, n)}, '[aeiou]')"
    one = f"(CASE WHEN {ends(w, 'sses', 'ies')} THEN {drop(w, 2)} WHEN {ends(w, 's')} AND NOT {ends(w, 'ss')} AND {voiced(w, 1)} THEN {drop(w, 1)} ELSE {w} END)"
    two = f"(SELECT CASE WHEN length(a) > 5 AND {ends('a', 'ing')} AND {voiced('a', 3)} THEN {drop('a', 3)} WHEN length(a) > 4 AND {ends('a', 'ed')} AND {voiced('a', 2)} THEN {drop('a', 2)} ELSE a END FROM (SELECT {one} AS a))"
    rest = " ".join(f"WHEN {ends('b', s)} AND length(b) > {len(s) + 2} THEN {drop('b', len(s))}" for s in SUFFIXES)
    return f"(CASE WHEN length({w}) <= 2 THEN {w} ELSE (SELECT CASE {rest} ELSE b END FROM (SELECT {two} AS b)) END)"


query("fts_stemmed", fts_sql(["tion", "eren"], ["text"], [], term=stem_sql("term")))(lambda s, d: S.search(table(s, d, "documents"), "doc_id", ["text"], "tions erens", stem="light").select("doc_id", F.round("score", 9).alias("score"), "hits", "doc_len"))
LINE = "' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), ' ') || ' '"
query("fts_phrase", f"SELECT doc_id FROM documents WHERE contains({LINE}, ' of the ')")(lambda s, d: S.phrase(table(s, d, "documents"), "doc_id", ["text"], "of the"))
query("fts_near", f"SELECT doc_id FROM documents WHERE regexp_matches({LINE}, ' for(?: [^ ]+){{0,2}} the ')")(lambda s, d: S.phrase(table(s, d, "documents"), "doc_id", ["text"], "for the", gap=2))
query("fts_near_any_order", f"SELECT doc_id FROM documents WHERE regexp_matches({LINE}, ' tion(?: [^ ]+){{0,4}} the ') OR regexp_matches({LINE}, ' the(?: [^ ]+){{0,4}} tion ')")(lambda s, d: S.near(table(s, d, "documents"), "doc_id", ["text"], "tion the", gap=4))
query("fts_snippet", "WITH best AS (" + fts_sql(["ther"], ["text"], [], select="doc_id") + """),
p AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9]+[^A-Za-z0-9]*') AS parts FROM documents WHERE doc_id IN (SELECT doc_id FROM best)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM p) WHERE lower(regexp_extract(parts[i + 1], '^[A-Za-z0-9]+')) = 'ther'),
w AS (SELECT a.doc_id, a.i, count(*) AS n FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + 8 GROUP BY a.doc_id, a.i),
f AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1),
m AS (SELECT doc_id, i, text, len(parts) > i + 8 AS cut, list_transform(parts[i + 1 : i + 8], lambda x, k: CASE WHEN lower(regexp_extract(x, '^[A-Za-z0-9]+')) = 'ther' THEN '[' || regexp_extract(x, '^[A-Za-z0-9]+') || ']' ELSE regexp_extract(x, '^[A-Za-z0-9]+') END
        || CASE WHEN len(parts) > i + 8 AND k = 8 THEN '' ELSE regexp_extract(x, '^[A-Za-z0-9]+([^A-Za-z0-9]*)', 1) END) AS shown FROM p JOIN f USING (doc_id))
SELECT doc_id, CASE WHEN i > 0 THEN '...' ELSE regexp_extract(text, '^[^A-Za-z0-9]*') END || array_to_string(shown, '') || CASE WHEN cut THEN '...' ELSE '' END AS snippet FROM m""")(
    lambda s, d: S.snippets(S.search(t := table(s, d, "documents"), "doc_id", ["text"], "ther"), t, "doc_id", "text", "ther", size=8)
)
query("fts_prefix", f"SELECT doc_id FROM documents WHERE contains({LINE}, ' erea')")(lambda s, d: S.prefix(table(s, d, "documents"), "doc_id", ["text"], "erea"))
query("fts_boolean", f"SELECT doc_id FROM documents WHERE contains({LINE}, ' the ') AND (contains({LINE}, ' ereat ') OR contains({LINE}, ' tion ')) AND NOT contains({LINE}, ' with ')")(
    lambda s, d: S.boolean(table(s, d, "documents"), "doc_id", ["text"], all_of=["the"], any_of=["ereat", "tion"], none_of=["with"])
)

# changes: the table after a statement
query("dml_insert", "SELECT * FROM region UNION ALL SELECT 9, 'NEW'")(lambda s, d: dml.insert_row(table(s, d, "region"), (9, "NEW"), "r_regionkey"))
query("dml_insert_null_key", "SELECT * FROM nation UNION ALL SELECT CAST(max(n_nationkey) + 1 AS INTEGER), 'NEW', 1 FROM nation")(lambda s, d: dml.insert_row(table(s, d, "nation"), (None, "NEW", 1), "n_nationkey"))
query("dml_update", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey = 7 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")(lambda s, d: dml.update_where(table(s, d, "customer"), "c_mktsegment", "MOVED", "c_nationkey", 7, "c_custkey"))
query("dml_delete", "SELECT * FROM customer WHERE c_nationkey <> 7")(lambda s, d: dml.delete_where(table(s, d, "customer"), "c_nationkey", 7))
query("dml_update_count", "SELECT count(*) AS changes FROM customer WHERE c_nationkey = 7")(lambda s, d: dml.changes(table(s, d, "customer"), "c_nationkey", 7))
query("dml_delete_count", "SELECT count(*) AS changes FROM customer WHERE c_mktsegment = 'BUILDING'")(lambda s, d: dml.changes(table(s, d, "customer"), "c_mktsegment", "BUILDING"))
query("dml_batch", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_nationkey = 7 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 999999999, 'NEW', 3, 0.5, 'NONE'")(
    lambda s, d: dml.batch(
        table(s, d, "customer"), lambda t: dml.delete_where(t, "c_mktsegment", "BUILDING"),
        lambda t: dml.update_where(t, "c_mktsegment", "MOVED", "c_nationkey", 7, "c_custkey"), lambda t: dml.insert_row(t, (999999999, "NEW", 3, 0.5, "NONE"), "c_custkey"),
    )
)
query("ddl_add_column", "SELECT *, CAST(NULL AS VARCHAR) AS email FROM supplier")(lambda s, d: dml.add_column(table(s, d, "supplier"), "email", "string"))
query("ddl_rename", "SELECT r_regionkey AS key, r_name FROM region")(lambda s, d: table(s, d, "region").withColumnRenamed("r_regionkey", "key"))


@query("ddl_rename_table", "SELECT * FROM supplier")
def ddl_rename_table(spark, d):
    """A catalog name of its own, renamed: the new name reads the table, the old one is gone."""
    old, new = (f"suppliers_{x}_{uuid.uuid4().hex}" for x in ("old", "new"))
    table(spark, d, "supplier").createOrReplaceTempView(old)
    dml.rename_table(spark, old, new)
    assert not spark.catalog.tableExists(old)
    return spark.table(new)


@query("expr_wrapping", "SELECT o_orderkey, CAST(-9223372036854775808::HUGEINT + o_orderkey AS BIGINT) AS a, CAST(9223372036854775807::HUGEINT - o_orderkey AS BIGINT) AS s, CAST(((o_orderkey::HUGEINT * 4611686018427387904::HUGEINT) % 18446744073709551616::HUGEINT + 27670116110564327424::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT) AS m FROM orders")
def expr_wrapping(spark, d):
    """Sums, differences and products beyond 64 bits wrap around: 2^63 - 1 + 1 + k, -2^63 - (k + 1) and k * 2^62."""
    t = table(spark, d, "orders")
    e, k = Expressions(t), C("o_orderkey").cast("bigint")
    return t.select("o_orderkey", e.arith(F.lit((1 << 63) - 1), "+", k + 1).alias("a"), e.arith(F.lit(-(1 << 63)), "-", k + 1).alias("s"), e.arith(k, "*", F.lit(1 << 62)).alias("m"))


@query("agg_sum_wraps", "SELECT CAST((s % 18446744073709551616::HUGEINT + 27670116110564327424::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT) AS s FROM (SELECT sum(9223372036854775807::HUGEINT - o_orderkey) AS s FROM orders)")
def agg_sum_wraps(spark, d):
    return R.aggregate(table(spark, d, "orders").select((F.lit((1 << 63) - 1) - C("o_orderkey")).alias("v")), ("sum", "v", "s"))


@query("log_replay", """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 3 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 10 <> 4
UNION ALL SELECT -1 - o_orderkey, o_custkey, 'N' FROM orders WHERE o_orderkey % 10 = 5""")
def log_replay(spark, d):
    """Updates, deletes and inserts of whole rows, all twice: a replay changes nothing more."""
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    k = F.col("o_orderkey") % 10
    log = t.where(k.isin(3, 4, 5)).select(F.col("o_orderkey").alias("lsn"), F.when(k == 3, "update").when(k == 4, "delete").otherwise("insert").alias("op"), F.when(k == 5, -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", F.when(k == 3, "U").when(k == 5, "N").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return dml.apply_log(t, log.unionAll(log), "o_orderkey")
