import random

import pytest

from quillon.llm import line_dedup
from quillon.llm.line_dedup import drop_boilerplate_lines


def brute(rows, ratio=0.1, least=5):
    pages, out = {}, []
    for _, host, text in rows:
        if text is not None:
            pages.setdefault(host or "", set()).add(text)
    trim = lambda x: x.strip(" ")
    bad = {}
    for host, texts in pages.items():
        n = {}
        for t in texts:
            for line in {trim(x) for x in t.split("\n")} - {""}:
                n[line] = n.get(line, 0) + 1
        bad[host] = {x for x, k in n.items() if k >= least and k > ratio * len(texts)}
    for i, host, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if trim(x) not in bad[host or ""]]
        full = lambda x: sum(trim(y) != "" for y in x)
        out.append((i, "\n".join(kept), full(lines), full(lines) - full(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in drop_boilerplate_lines(df).collect()), key=str)


def made():
    rng = random.Random(2)
    menu = {h: [f"{h} menu {i}" for i in range(6)] for h in "abc"}
    rows = []
    for i in range(400):
        h = rng.choice("aaaaabc")
        lines = [f"own {i} {k}" for k in range(rng.randint(0, 5))] + rng.sample(menu[h], rng.randint(0, 6)) + rng.choice([[], [" "], ["", f"  {menu['a'][0]} "]])
        rng.shuffle(lines)
        rows.append((i, h, "\n".join(lines)))
    rows += [(1000 + i, "a", "copied page\nits own line") for i in range(300)]  # copies count once
    rows += [(2000 + i, None, f"no host\n{i}") for i in range(6)]
    return rows + [(3000, "a", None), (3001, "a", ""), (3002, "a", "\n\n"), (None, "a", menu["a"][0]), (1, "a", "again\n" + menu["a"][1]), (1, "a", "again\n" + menu["a"][1])]


@pytest.mark.parametrize("rows", [line_dedup.BROADCAST_ROWS, 0])
def test_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    data = made()
    assert got(spark.createDataFrame(data, "doc_id long, source string, text string").repartition(5)) == brute(data)


def test_edges(spark):
    df = spark.createDataFrame([(i, "a", "same\n" + "x" * i, "mine") for i in range(20)], "doc_id long, source string, text string, _bad string")
    out = drop_boilerplate_lines(df).collect()
    assert all(r._bad == "mine" and r.text == "x" * r.doc_id and r.n_dropped == 1 for r in out) and len(out) == 20
    assert drop_boilerplate_lines(df.limit(0)).collect() == []
    assert [r.n_lines for r in drop_boilerplate_lines(df.withColumnRenamed("_bad", "n_lines")).collect() if r.doc_id == 0] == [1]
