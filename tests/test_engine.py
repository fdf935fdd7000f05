"""Semantics that the driver's tables don't show: nulls, LIKE, arithmetic, ranking, changes, logs, sources."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quillon.functions.dialect import Expressions
from quillon.functions.terms import UnsupportedQuery, light_stem, query_terms
from quillon.operators import dml
from quillon.operators import relational as R
from quillon.plans import search as S
from quillon.sources.tables import affinity, as_text, json_error, with_rowid
from quillon.streaming import replay

C = F.col


@pytest.fixture(scope="module")
def n(spark):
    return spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, -7)], "id long, x long")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_two_valued_logic(n):
    e, ansi = Expressions(n), Expressions(n, "ansi")
    x = C("x")
    for p, two, three in (
        (lambda e: e.negate(e.compare(x, "=", 5), x), [2, 3, 4], [3, 4]), (lambda e: e.within(x, [5], negated=True), [2, 3, 4], [3, 4]),
        (lambda e: e.between(x, -9, 1, negated=True), [1, 2], [1]), (lambda e: e.compare(x, "!=", 5), [3, 4], [3, 4]), (lambda e: e.compare(x, "=", None), [], []),
        (lambda e: e.within(x, []), [], []), (lambda e: e.within(x, [5, 5, None, "5"]), [1], [1]), (lambda e: e.truthy(x), [1, 4], [1, 4]),
    ):
        assert ids(n.where(p(e))) == two and ids(n.where(p(ansi))) == three
    assert [r[0] for r in n.select(e.value(e.compare(x, ">", 0))).collect()] == [1, 0, 0, 0]


def test_pushdown(spark, sf):
    t = spark.read.parquet(f"{sf}/orders.parquet")
    e = Expressions(t)
    plan = t.where(e.negate(e.compare(C("o_custkey"), ">", 5), C("o_custkey"))).select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(o_custkey),LessThanOrEqual(o_custkey,5))]" in plan and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_like(spark):
    t = spark.createDataFrame([(i, v) for i, v in enumerate(["Abc", "ABC", "a%c", "a_c", "a\\b", "É", "", None])], "id int, v string")
    e = Expressions(t)
    for pattern, want in (("abc", [0, 1]), ("A%", [0, 1, 2, 3, 4]), ("a_c", [0, 1, 2, 3]), ("a\\b", [4]), ("é", []), ("É", [5]), ("", [6]), ("%", list(range(7)))):
        assert ids(t.where(e.like(C("v"), pattern))) == want
        assert ids(t.where(e.like(C("v"), pattern, negated=True))) == [i for i in range(8) if i not in want]
    assert ids(t.where(e.like(C("id"), "%"))) == [] and ids(t.where(e.truthy(C("v")))) == [0, 1, 2, 3, 4, 5]


def test_arithmetic(spark):
    t = spark.createDataFrame([(7, -2, 7.5, "t"), (-7, 2, -7.5, "t"), (1, 0, 1.0, "t")], "a int, b int, r double, s string")
    e = Expressions(t)
    got = lambda c: [r[0] for r in t.select(c).collect()]
    assert got(e.arith(C("a"), "/", C("b"))) == [-3, -3, None] and got(e.arith(C("a"), "%", C("b"))) == [1, -1, None]
    assert got(e.arith(C("r"), "%", C("b"))) == [-0.5, 0.5, None] and got(e.arith(C("r"), "/", C("b"))) == [-3.75, -3.75, None]
    assert got(e.arith(C("s"), "+", 1)) == [None] * 3 and got(e.minus(C("s"))) == [None] * 3 and got(e.concat(C("s"), C("a"))) == ["t7", "t-7", "t1"]
    big = spark.createDataFrame([(2**53 + 1,)], "x long")
    assert big.where(Expressions(big).compare(C("x"), "=", 2**53)).count() == 0


def test_aggregate_and_order(n, spark):
    r = R.aggregate(n, ("count", "*"), ("count", "x", "c"), ("sum", "x"), ("avg", "x"), ("min", "x"), ("max", "x")).first()
    assert r.asDict() == {"COUNT(*)": 4, "c": 3, "SUM": -2, "AVG": -2 / 3, "MIN": -7, "MAX": 5}
    assert R.aggregate(n.limit(0), ("count", "x"), ("sum", "x")).first().asDict() == {"COUNT": 0, "SUM": None}
    order = lambda *a, **k: [x.id for x in R.ordered(n, *a, ties=["id"], **k).collect()]
    assert order("x") == [2, 4, 3, 1] and order("x", True) == [1, 3, 4, 2] and order("x", limit=0) == [] and order(None, limit=2) == [1, 2]
    for bad in (lambda: R.aggregate(n, ("sum", "*")), lambda: R.aggregate(n, ("median", "x")), lambda: R.ordered(n, "x", limit=-1)):
        with pytest.raises(R.UnsupportedOperation):
            bad()


DOCS = [(1, "contract law", "negligence claims running"), (2, "law", "parties contracts contract"), (3, "other", "nothing here"), (4, "x", "y z"), (5, "q", "w e")]


def test_bm25_against_sqlite(spark, tmp_path):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(a, b)")
    con.executemany("INSERT INTO f(rowid, a, b) VALUES (?, ?, ?)", DOCS)
    t = spark.createDataFrame(DOCS, "id long, a string, b string")
    S.save_index(t, "id", ["a", "b"], str(tmp_path / "index"))
    for q, w in (("contract", ()), ("contract law", (5.0, 1.0)), ("law", (1.0, 2.0))):
        want = con.execute(f"SELECT rowid, bm25(f{''.join(f', {x}' for x in w)}) s FROM f WHERE f MATCH ? ORDER BY s, rowid", (q,)).fetchall()
        for index in (None, str(tmp_path / "index")):
            got = [(r.id, r.score) for r in S.search(t, "id", ["a", "b"], q, weights=w, index=index).collect()]
            assert [x[0] for x in got] == [x[0] for x in want] and all(abs(a[1] - b[1]) < 1e-12 for a, b in zip(got, want, strict=True))
    assert S.search(t, "id", ["a", "b"], "law absent").collect() == []
    assert [r.id for r in S.search(t, "id", ["a", "b"], "contract", stem="light").collect()] == [2, 1]
    assert json.loads(S.hydrated_json(S.search(t, "id", ["a", "b"], "here"), t, "id").first().json)["columns"] == {"id": 3, "a": "other", "b": "nothing here"}


def test_near_and_snippet(spark):
    """NEAR in any order as the embedded engine has it; snippets of hits."""
    texts = ["a b c d", "d x a", "a x x x d", "D, x; x, a x", "a", "", None, "d x x x x x a x d a"]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t)")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(texts)))
    t = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for words in ("a d", "d a b", "a", "a a", "x d"):
        for gap in (0, 1, 2, 3):
            want = [r[0] for r in con.execute(f"SELECT rowid FROM f WHERE f MATCH 'NEAR({words}, {gap})' ORDER BY rowid")]
            assert sorted(r.id for r in S.near(t, "id", ["t"], words, gap).collect()) == want, (words, gap)
    cut = lambda q, **k: {r.id: r.snippet for r in S.snippets(t.where("id < 6"), t, "id", "t", q, **k).collect()}
    assert cut("a", size=2) == {0: "[a] b...", 1: "...[a]", 2: "[a] x...", 3: "...[a] x", 4: "[a]", 5: ""}
    assert cut("d x", size=3)[3] == "[D], [x]; [x]..." and cut("nobody", size=2)[3] == "D, x..."


def test_batch(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    put, cut = (lambda x: dml.insert_row(x, (None, "c"), "id")), (lambda x: dml.delete_where(x, "v", "c"))
    assert ids(dml.batch(t, put, put)) == [1, 2, 3, 4] and ids(dml.batch(t, put, cut)) == [1, 2] == ids(dml.batch(t))
    for error, bad in ((dml.SchemaChangeInBatch, lambda x: dml.add_column(x, "e", "int")), (dml.DuplicateRowid, lambda x: dml.insert_row(x, (3, "d"), "id"))):
        with pytest.raises(error):
            dml.batch(t, put, bad)
    assert ids(t) == [1, 2]


def test_terms_and_filters(spark):
    assert light_stem("negligence") == "neglig" and light_stem("classes") == "class" and light_stem("running") == "runn" and light_stem("is") == "is"
    assert query_terms("Contract  law") == ["contract", "law"] and query_terms("negligence", "light") == ["neglig"]
    for bad in ("contract AND law", 'a "b"', "a*"):
        with pytest.raises(UnsupportedQuery):
            query_terms(bad)
    t = spark.createDataFrame([(1, "Mr Desmond Lee", 2023)], "id long, speaker string, year int")
    for text, want in (("speaker~='desmond'", 1), ("year>=2020", 1), ("year<=2022", 0), ("year=2023", 1), ("year>=x", 0), ("year~=2", 0)):
        assert t.where(S.parse_filter(text, t)).count() == want
    with pytest.raises(S.InvalidFilter):
        S.parse_filter("nobody=1", t)


def test_changes(spark):
    t = spark.createDataFrame([(1, "alice", 30), (2, "bob", None)], "id long, name string, age int")
    more = dml.insert_row(t, (None, "cy", 50), "id")
    assert ids(more) == [1, 2, 3] and ids(dml.delete_where(more, "age", None)) == [1, 3] and ids(dml.delete_where(more, "age", "30")) == [1, 2, 3]
    assert {r.id: r.age for r in dml.update_where(more, "age", 31, "name", "alice", "id").collect()} == {1: 31, 2: None, 3: 50}
    assert [r.email for r in dml.add_column(t, "email", "string").collect()] == [None, None]
    for error, bad in ((dml.DuplicateRowid, lambda: dml.insert_row(t, (1, "x", 1), "id")), (dml.UnsupportedRowid, lambda: dml.insert_row(t, (0, "x", 1), "id")), (dml.ColumnCountMismatch, lambda: dml.insert_row(t, (1,), "id")),
                       (dml.RowidUpdateUnsupported, lambda: dml.update_where(t, "id", 1, "name", "x", "id")), (dml.ColumnAlreadyExists, lambda: dml.add_column(t, "NAME", "string"))):
        with pytest.raises(error):
            bad()


def test_log_stream(spark, tmp_path):
    """Every prefix of the log gives the table after those commits, and a replayed batch changes nothing."""
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    snap = replay.Snapshots(spark, str(tmp_path / "t"))
    snap.commit(t, 0, -1)
    changes = [("insert", 3, "c"), ("update", 1, "A"), ("delete", 2, None), ("insert", 1, "ignored"), ("insert", 2, "again")]
    states = [{1: "a", 2: "b"}, {1: "a", 2: "b", 3: "c"}, {1: "A", 2: "b", 3: "c"}, {1: "A", 3: "c"}, {1: "A", 3: "c"}, {1: "A", 3: "c", 2: "again"}]
    log = spark.createDataFrame([(i, *c) for i, c in enumerate(changes)], "lsn long, op string, id long, v string")
    for k in range(len(changes) + 1):
        got = replay.recover(t, log.where(C("lsn") < k), "id")
        assert {r.id: r.v for r in got.collect()} == states[k]
    assert {r.op: (r.n, r.max_lsn, r.unapplied) for r in replay.status(log, 2).collect()} == {"insert": (3, 4, 2), "update": (1, 1, 0), "delete": (1, 2, 0)}
    for at in (0, 3):
        part = log.where((C("lsn") >= at) & (C("lsn") < at + 3)).select((C("lsn") - at).alias("seq"), "op", "id", "v")
        replay.append(part, str(tmp_path / "log"), at)
        replay.follow(spark, str(tmp_path / "log"), "op string, id long, v string, lsn long", snap, "id", str(tmp_path / "ck")).awaitTermination()
        now, version, lsn = snap.last()
        assert {r.id: r.v for r in now.collect()} == states[min(at + 3, 5)]
    assert version == 2 and lsn == 4


def test_sources(spark):
    t = spark.createDataFrame([(7, "n7", bytearray(b"\x01"))], "id long, name string, b binary")
    assert [affinity(x) for x in ("BIGINT", "varchar(3)", "", "BLOB", "FLOAT", "DECIMAL")] == ["bigint", "string", "binary", "binary", "double", "double"]
    assert as_text(t, "t", "id") == "table: t\ncolumns: [id, name, b]\nrows: 1\n7: [id=7, name='n7', b=<blob 1 bytes>]"
    assert "rows: 30, the first 20 shown" in as_text(spark.range(30).toDF("id"), "t", "id", limit=20)
    assert json.loads(json_error("X", "y"))["count"] == 0
    rows = with_rowid(spark.createDataFrame([(x,) for x in (3, 1, 2, 9, 8, 7)], "x int").repartition(3), ["x"]).orderBy("_rowid").collect()
    assert [tuple(r) for r in rows] == list(enumerate([1, 2, 3, 7, 8, 9], 1))


def test_wrapping(spark):
    """64-bit results wrap around, in expressions and in sums."""
    lo, hi = -(1 << 63), (1 << 63) - 1
    rows = [(lo, 1), (hi, 1), (hi, hi), (lo, lo), (lo, -1), (hi, -1), (1 << 62, 4), (5, None), (-7, 2), (hi, 0)]
    t = spark.createDataFrame(rows, "a long, b long")
    e, wrap = Expressions(t), lambda x: (x - lo) % (1 << 64) + lo
    got = t.select(*[e.arith(C("a"), o, C("b")).alias(n) for o, n in zip("+-*/", "pmtd", strict=True)], e.minus(C("a")).alias("n")).collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert r.n == wrap(-a)
        assert (r.p, r.m, r.t) == ((None,) * 3 if b is None else (wrap(a + b), wrap(a - b), wrap(a * b)))
        assert r.d == (None if not b else wrap((abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)))
    assert R.aggregate(t, ("sum", "a"), ("sum", "b", "b")).first()[:] == (wrap(sum(a for a, _ in rows)), wrap(sum(b or 0 for _, b in rows)))
    assert R.aggregate(t.where("a = 6"), ("sum", "a")).first()[0] is None


def test_lists_and_text(spark):
    t = spark.createDataFrame(DOCS, "id long, a string, b string")
    for text in ("", " * ", "-"):
        assert S.chosen_columns(text, t) == ["id", "a", "b"]
    assert S.chosen_columns(" B, id ", t) == ["b", "id"] and S.column_weights("5, 1.5") == [5.0, 1.5] and S.column_weights("-") == S.column_weights("") == []
    with pytest.raises(S.ColumnNotFound):
        S.chosen_columns("a, nobody", t)
    assert S.hits_text(S.search(t, "id", ["a", "b"], "here"), "id").split("|")[2:] == ["hits=1", "doc_len=3", "c0=0", "c1=1"]
    assert S.search(t.limit(0), "id", ["a", "b"], "here").collect() == []
    found = json.loads(S.envelope(t, "id", ["a", "b"], "contract", "t").first().json)
    assert found["count"] == 2 and [x["rowid"] for x in found["results"]] == [2, 1] and found["total_rows"] == 5 and found["total_hits"] == 2
    assert json.loads(S.envelope(t, "id", ["a", "b"], "absent", "t").first().json)["results"] == []


def test_rename_table(spark):
    spark.range(3).createOrReplaceTempView("scratch_one")
    spark.range(2).createOrReplaceTempView("scratch_two")
    for error, names in ((dml.TableAlreadyExists, ("scratch_one", "scratch_two")), (dml.NoSuchTable, ("nobody", "x"))):
        with pytest.raises(error):
            dml.rename_table(spark, *names)
    dml.rename_table(spark, "scratch_one", "scratch_three")
    assert spark.table("scratch_three").count() == 3 and not spark.catalog.tableExists("scratch_one")
    assert dml.changes(spark.table("scratch_three"), "id", 1).first().changes == 1
