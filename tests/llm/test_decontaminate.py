import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm.decontaminate import Item, best_match, find_leaks, lcs, op1_decontaminate, words


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=9), st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=9))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    assert lcs(tuple(a), b) == t[-1][-1]


def test_planted(spark):
    """Word-for-word leaks and paraphrases (a word in six replaced or dropped) are found, clean documents left alone."""
    rng = random.Random(4)
    common = [f"the{i}" for i in range(30)]
    rare = [f"r{i}x" for i in range(6000)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n)]
    items = [(i, text(rng.randint(12, 60))) for i in range(60)]
    docs, want = [], set()
    for d in range(500):
        w = text(rng.randint(0, 400))
        if d % 4 == 0:
            i, own = rng.choice(items)
            own = list(own)
            if d % 8 == 0:
                for at in rng.sample(range(len(own)), len(own) // 6):
                    own[at] = rng.choice(["", rng.choice(common)])
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in own]
            want.add((d, i))
        docs.append((d, " ".join(w)))
    docs += [(900, docs[4][1]), (900, docs[4][1]), (None, docs[4][1]), (901, None), (902, "")]
    want |= {(900, i) for d, i in want if d == 4}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(None, "x y"), (77, None), (78, "")], "item_id long, text string")
    out = find_leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in out}
    assert len(got) == len(out) and not got - want and len(got & want) >= 0.97 * len(want)
    assert find_leaks(df.limit(0), bench).collect() == [] and find_leaks(df, bench.limit(0)).collect() == []


def test_word_for_word_leaks_without_the_latent_search(spark):
    """With a cosine that nothing reaches, anchors alone still find all word-for-word leaks, also of one word, and in each
    of a doc_id's texts."""
    items = [(1, "serendipity"), (2, "the quick brown fox"), (3, " ".join(f"q{i}" for i in range(150)))]
    filler = " ".join(f"w{i}" for i in range(90))
    docs = [(1, f"a happy Serendipity, {filler}"), (2, filler), (3, f"{filler} The quick (brown) fox"), (4, f"{filler} {items[2][1]} {filler}"), (5, "serendipity"), (5, f"x {items[1][1]}")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in find_leaks(df, bench, cosine=2.0).collect()}
    assert set(got) == {(1, 1), (3, 2), (4, 3), (5, 1), (5, 2)} and all(r.lcs == 1 and r.cosine is None for r in got.values())


def test_changed_words_without_the_latent_search(spark):
    """Three anchors that don't overlap: two changed words, wherever they are, leave one of them."""
    own = [f"q{i}" for i in range(12)]
    changed = [[w for k, w in enumerate(own) if k != a] for a in range(12)]
    changed += [["other" if k in (a, b) else w for k, w in enumerate(own)] for a in range(12) for b in range(a)]
    filler = [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([*filler, *x, *filler])) for i, x in enumerate(changed)] + [(1000, " ".join(filler))]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")
    assert {r.doc_id for r in find_leaks(df, bench, cosine=2.0, max_df=1.0).collect()} == set(range(len(changed)))


def test_recall_of_paraphrases_among_many_items(spark):
    """1,000 items of 8 to 60 words, far more than the rank, with up to a fifth of the words replaced or dropped: at least
    0.95 of the pairs that the check on words accepts anywhere in the text are found, in each class of length."""
    rng = random.Random(11)
    vocabulary, weights = [f"w{i}" for i in range(20000)], [1 / (i + 5) for i in range(20000)]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [text(rng.randint(8, 60)) for _ in range(1000)]
    docs, planted = [], []
    for i, x in enumerate(items):
        own, w = list(x), text(rng.randint(30, 200))
        for at in rng.sample(range(len(own)), len(own) * (i % 5) // 20):
            own[at] = rng.choice(["", rng.choice(vocabulary)])
        at = rng.randrange(len(w) + 1)
        w[at:at] = [x for x in own if x]
        docs.append((i, " ".join(w)))
        words_of = tuple(y.encode() for y in x)
        share = best_match(Item(i, words_of, frozenset(), frozenset(words_of)), words(docs[-1][1].encode()), 0, len(w), 0.8)[0]
        planted += [(i, len(x) > 15)] if share >= 0.8 else []
    got = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")).collect()}
    assert len(planted) > 900 and got <= {(i, i) for i in range(1000)}
    for long in (False, True):
        want = [i for i, n in planted if n == long]
        assert sum((i, i) in got for i in want) >= 0.95 * len(want)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: b" " + b" ".join(words(r.text.encode())) + b" " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(i, k) for i, t in docs.items() for k, x in items.items() if x in b" " + b" ".join(words(t.encode())) + b" "}
    got = {(r.doc_id, r.item_id): r.lcs for r in op1_decontaminate(spark, sf).collect()}
    assert want <= set(got) and all(x >= 0.6 for x in got.values())
