import html
import itertools
import re
from math import isclose, prod

import pytest

from quillon.llm.html_text import default_model, extract_text, features, labelled_pages, main_text, op4_html_text, parse


@pytest.fixture(scope="module")
def model(spark):
    return default_model(spark)


def test_held_out_accuracy(model):
    right = total = 0
    for page in labelled_pages(300, seed=99):
        nodes, blocks = parse(page)
        truth = ["data-y" in x.hints for x in nodes]
        for x in nodes:
            x.hints = x.hints.replace("data-y", "")
        p = model.marginals(nodes)
        right += sum((p[i] >= 0.5) == truth[i] for i, _ in blocks)
        total += len(blocks)
    assert right / total > 0.985


def test_sum_product_is_exact(model):
    """Marginals against the sum over all assignments."""
    for page in ("<body><nav><ul><li><a>x</a></li></ul></nav><article><p>Some words. More.</p></article></body>", "<div class=ad>a b c</div><div><p>x</p><p>y z</p></div>"):
        nodes, _ = parse(page)
        weights = {}
        for states in itertools.product((0, 1), repeat=len(nodes)):
            w = model.root[states[0]]
            for i, (x, s) in enumerate(zip(nodes, states, strict=True)):
                f = features(x)
                w *= prod(model.emit.get(v, (1, 1))[s] for v in f)
                if i:
                    w *= model.move.get(f[0], model.move["any"])[states[x.parent]][s]
            weights[states] = w
        for i, p in enumerate(model.marginals(nodes)):
            assert isclose(p, sum(w for s, w in weights.items() if s[i]) / sum(weights.values()), rel_tol=1e-6, abs_tol=1e-12)


def test_blocks():
    texts = lambda x: [t for _, t in parse(x)[1]]
    assert texts("<p>a &amp; b<p><b>c\n d&nbsp; e<br>f<p>g") == ["a & b", "c d e f", "g"]
    assert texts("<script>x='</p><p>no'</script><style>p{}</style><!-- <p>no</p> --><p title='>'>yes</p><select><option>no</select>") == ["yes"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>text") == ["a", "b", "c", "d", "text"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table><pre>x  y</pre></div>z") == ["a", "b", "c", "x y", "z"]
    assert texts("") == texts("<") [:0] == [] and texts("1 < 2 & 3") == ["1 < 2 & 3"] and texts("<script>never closed") == []
    assert len(parse("<div>" * 20_000 + "x")[0]) == 20_001


def test_open_head_and_slashes(model):
    texts = lambda x: [t for _, t in parse(x)[1]]
    assert texts("<html><head><title>t</title><body><article><p>a</p></article></body>") == ["a"]
    assert texts("<head><meta charset=utf-8><link rel=x><script>1</script><p>a<p>b") == texts("<head><title>t</title></head><p>a<p>b") == ["a", "b"]
    assert texts("<head><title>t</title> \n plain <b>text</b>") == ["plain text"]
    assert texts("<head><noscript><img src=x><p>no</p></noscript><style>x</style></head><p>a") == texts("<head><noscript><body><p>a") == ["a"]
    assert texts("<head><template><p>no</p></template><title>t</title><div>a</div>") == ["a"]
    assert texts("<p>a <svg width='1' />b</p><p>c") == ["a b", "c"] and texts("<div>a<math/>b</div>") == ["ab"]
    assert texts("<p>a<svg><title/><style/><g><path d='z'/></g><text>no</text></svg>b<p>c") == ["a", "b", "c"]
    assert texts("<svg><foreignObject><script/>no</script></foreignObject></svg>a<div/>b") == ["a", "b"]
    page = "<html><head><title>t</title>{}<body><nav><a>x</a></nav><article><p>Some words here that go on for a while. More of them, and more.</p></article></body></html>"
    assert main_text(page.format(""), model) == main_text(page.format("</head>"), model) != ""


def test_query(spark, sf, model):
    rows = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op4_html_text(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", rows[r.page_id].html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text) and r.url == rows[r.page_id].url


def test_edges(spark, model):
    rows = [(1, None, None, 1), (2, "u", "", 1), (None, "u", "plain words only", 1), (3, "u", "<div>" * 3000 + "deep", 1), (3, "u", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = extract_text(df, model).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out) and main_text(None, model) == ""
    assert extract_text(df.limit(0), model).collect() == []


def test_forms(model):
    """A form's text goes, also within the article; an article in a form that wraps the page stays."""
    said = "".join(f"<p>Sentence number {i} is written here. It has words and ends.</p>" for i in range(8))
    want = re.sub(r"</?p>", "\n", said).replace("\n\n", "\n").strip()
    small = "<form><p>Join our list of readers today. It is free.</p><input></form>"
    assert main_text(f"<body><form><ul><li><a href=1>Home</a></li></ul><article>{said}</article></form></body>", model) == want
    assert main_text(f"<body><article>{said}{small}</article></body>", model) == want
    assert main_text(f"<body>{small}<article>{said}</article></body>", model) == want
