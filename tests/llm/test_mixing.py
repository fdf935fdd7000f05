import hashlib
import random
import re
from fractions import Fraction

import pytest

from quillon.llm.mixing import mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    """(size, source_size, target, taken) by the contract: sources filled by weight, cut at twice their size, thresholds by
    the order of the hashes; the last hash is taken if that comes closer."""
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size(r[2]) for r in rows if r[1] == s) for s in names}
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target = set(names), {}
    while left:
        rest = share * sum(total.values()) - sum(target.values())
        above = {s for s in left if rest * w[s] / sum(w[x] for x in left) >= cap * total[s]}
        target |= {s: Fraction(cap * total[s]) for s in above} or {s: rest * w[s] / sum(w[x] for x in left) for s in left}
        left -= set(target)
    place = lambda i: int(hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:9], 16)
    out = []
    for s in names:
        whole = target[s] // total[s] if total[s] else 0
        extra, run, taken = target[s] - whole * total[s], 0, set()
        for h in sorted({place(r[0]) for r in rows if r[1] == s}):
            n = sum(size(r[2]) for r in rows if r[1] == s and place(r[0]) == h)
            if run + n > extra:
                if (extra - run) * 2 > n:
                    taken.add(h)
                break
            run += n
            taken.add(h)
        out += [(r[0], size(r[2]), total[s], float(target[s]), size(r[2]) * int(whole + (place(r[0]) in taken))) for r in rows if r[1] == s]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in mix_sources(df).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "a", "b", "C", "é", "zz", None]), " ".join(["w"] * rng.randint(0, 60))) for i in range(300)]
    rows += [(900, "a", None), (901, "a", ""), (902, "b", " \x0b\t"), (None, "a", "x y"), (5, "a", "once more"), (5, "a", "once more")]
    g = got(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4))
    assert g == brute(rows)
    for source_size, target in {(r[2], r[3]) for r in g}:
        assert target <= 2 * source_size


def test_hot_source_and_far_texts(spark):
    """One source with nearly all words, one with a single very long text."""
    rows = [(i, "hot", "w " * 200) for i in range(200)] + [(1000, "long", "w " * 30_000), (1001, "tiny", "w")]
    g = got(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert g == brute(rows) and all(r[4] <= 2 * r[1] for r in g)
    near = sum(r[4] for r in g if r[2] == 40_000)
    assert abs(near - next(r[3] for r in g if r[2] == 40_000)) <= 100  # half of the last document


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, "mine")], "doc_id long, source string, text string, _h string")
    assert [tuple(r) for r in mix_sources(df).collect()] == [(1, None, None, "mine", 0, 0, 0.0, 0, 0)]
    assert mix_sources(df.limit(0)).collect() == []
    again = df.withColumnRenamed("_h", "target")
    assert [r.target for r in mix_sources(again).collect()] == [0.0]  # of the same name: replaced
