"""HTML extraction by a tree-structured graphical model over DOM nodes."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SILENT = frozenset("head script style template noscript svg math canvas object audio video iframe button select textarea option datalist input dialog title xmp noembed noframes".split())
#: A start tag of these ends an open p.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Start tags that leave an open head open; any other, and text, end it.
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements whose content isn't HTML: a slash closes them and those in them; and those in them that hold HTML again.
FOREIGN, HTML_AGAIN = frozenset("svg math".split()), frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
#: A start tag of the key ends an open element of the values, up to the border.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role that tell what a part is.
SIDE = frozenset("ad ads advert advertisement adsense aside banner breadcrumb breadcrumbs byline cookie cookies comment comments consent disqus footer form header legal links login masthead menu meta modal nav navbar navigation newsletter notice pagination pager popup promo promoted related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe tags toolbar topbar widget alert warning contentinfo complementary search".split())
MAIN = frozenset("article articlebody body content entry main maincontent post story text".split())
KINDS = {t: t for t in "nav header footer aside article main section div p li ul ol table td blockquote pre figure figcaption dl form body html".split()} | {f"h{i}": "h" for i in range(1, 7)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.DOTALL)
HINT = re.compile(r"(?:class|id|role|data-y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)


@dataclass(slots=True)
class Node:
    """A block-level element."""

    tag: str
    parent: int
    hints: str
    words: int = 0
    linked: int = 0
    stops: int = 0
    #: Whether it lies in a form: 0 no, 1 yes, 2 in one that holds most of the page's words.
    form: int = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block-level nodes, parents first, and the blocks of text in page order as (node, text)."""
    nodes, blocks = [Node("html", -1, "")], []
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # open elements: name, node, silent
    links, foreign, at, part = 0, 0, 0, []

    def end_block() -> None:
        nonlocal part
        if part:
            # references are decoded before white space is counted: &nbsp; is white space
            if text := " ".join(html.unescape("".join(x for x, _ in part)).split()):
                node = nodes[stack[-1][1]]
                n = text.count(" ") + 1
                linked = sum(len(x.split()) for x, a in part if a)
                node.words, node.linked, node.stops = node.words + n, node.linked + min(n, linked), node.stops + sum(map(text.count, ".!?。"))
                blocks.append((stack[-1][1], text))
            part = []

    def close(to: int) -> None:
        nonlocal links, foreign
        for name, _, _ in stack[to:]:
            links -= name == "a"
            foreign -= name in FOREIGN
        if any(name not in INLINE for name, _, _ in stack[to:]):
            end_block()
        del stack[to:]

    def say(text: str) -> None:
        if stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if text and not stack[-1][2]:
            part.append((text, links > 0))

    while True:
        m = TOKEN.search(page, at)
        say(page[at : m.start() if m else len(page)])
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    close(i)
                    break
                if name in INLINE and stack[i][0] not in INLINE:
                    break  # an inline end tag doesn't leave its block
            continue
        if stack[-1][0] == "head" and name not in IN_HEAD:
            close(len(stack) - 1)
        elif name == "body" and stack[-1][2]:  # in something of the head that was left open
            names = [x for x, _, _ in stack]
            if "head" in names and "template" not in names:
                close(names.index("head"))
        if m[3].endswith("/") and (name in FOREIGN or (foreign and next(x for x, _, _ in reversed(stack) if x in FOREIGN or x in HTML_AGAIN) in FOREIGN)):
            continue
        if name == "br":
            say(" ")
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            continue
        if name in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if name in SIBLINGS:
            ends, border = SIBLINGS[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    close(i)
                    if name in ("li", "dt", "dd", "option", "td", "th"):
                        break
                elif stack[i][0] in border:
                    break
        silent = stack[-1][2] or name in SILENT
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in INLINE or silent:
            if name not in INLINE:
                end_block()
            links += name == "a"
            foreign += name in FOREIGN
            stack.append((name, stack[-1][1], silent))
        elif name == "html":
            continue
        else:
            end_block()
            nodes.append(Node(name, stack[-1][1], m[3]))
            stack.append((name, len(nodes) - 1, False))
    close(1)
    end_block()
    mark_forms(nodes)
    return nodes, blocks


def mark_forms(nodes: list[Node]) -> None:
    """Forms aren't content, but some sites wrap the whole page in one: the model sees which it is."""
    if not any(x.tag == "form" for x in nodes):
        return
    total = [x.words for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    for i, x in enumerate(nodes[1:], 1):
        x.form = (2 if 2 * total[i] > total[0] else 1) if x.tag == "form" and nodes[x.parent].form != 1 else nodes[x.parent].form


def features(node: Node) -> tuple[str, ...]:
    """What the model sees of a node itself."""
    names = {w for x in HINT.findall(node.hints) for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())} if node.hints else ()
    side, main = not SIDE.isdisjoint(names), not MAIN.isdisjoint(names)
    size = next(i for i, n in enumerate((0, 3, 9, 24, 60, 1 << 60)) if node.words <= n)
    share = node.linked / node.words if node.words else 0
    return (
        "tag:" + KINDS.get(node.tag, "other"),
        "name:" + ("side" if side else "main" if main else "none"),
        f"size:{size}",
        f"link:{0 if not node.words else 1 if share == 0 else 2 if share < 0.4 else 3}",
        f"stop:{min(2, node.stops)}" if node.words else "stop:none",
        f"form:{node.form}",
    )


@dataclass(frozen=True)
class TreeModel:
    """Emissions P(feature | state) and transitions P(state | parent's state, tag), states 0 (other) and 1 (content)."""

    emit: dict[str, tuple[float, float]]
    move: dict[str, tuple[tuple[float, float], tuple[float, float]]]
    root: tuple[float, float]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """P(content) of each node by sum-product: messages from the leaves up, then from the root down."""
        n = len(nodes)
        own, moves = [[1.0, 1.0] for _ in range(n)], [None] * n
        for i, node in enumerate(nodes):
            f = features(node)
            a = b = 1.0
            for x in f:
                p, q = self.emit.get(x, (1.0, 1.0))
                a, b = a * p, b * q
            own[i][0], own[i][1] = a / (a + b), b / (a + b)
            moves[i] = self.move.get(f[0], self.move["any"])
        up: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            a, b = own[i]
            (p00, p01), (p10, p11) = moves[i]
            x, y = p00 * a + p01 * b, p10 * a + p11 * b
            up[i] = (x / (x + y), y / (x + y))
            parent = own[nodes[i].parent]
            x, y = parent[0] * up[i][0], parent[1] * up[i][1]
            parent[0], parent[1] = x / (x + y), y / (x + y)
        belief = [(0.0, 0.0)] * n
        a, b = own[0][0] * self.root[0], own[0][1] * self.root[1]
        belief[0] = (a / (a + b), b / (a + b))
        for i in range(1, n):
            # what the parent believes without this child
            a, b = (p / max(m, 1e-300) for p, m in zip(belief[nodes[i].parent], up[i], strict=True))
            (p00, p01), (p10, p11) = moves[i]
            x, y = (a * p00 + b * p10) * own[i][0], (a * p01 + b * p11) * own[i][1]
            belief[i] = (x / (x + y), y / (x + y)) if x + y > 0 else (1.0, 0.0)
        return [y for _, y in belief]


def labelled_pages(n: int, seed: int = 3) -> list[str]:
    """Labelled training pages: layouts drawn from a grammar of common site parts, data-y="1" on the nodes of the content."""
    rng = random.Random(seed)
    words = lambda a, b: " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))
    said = lambda a, b: ". ".join(words(4, 18).capitalize() for _ in range(rng.randint(a, b))) + "."
    link = lambda: f'<a href="/{words(1, 1)}">{words(1, 4)}</a>'
    items = lambda k: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, k))) + "</ul>"
    y = ' data-y="1"'

    def part(tag: str, name: str, inside: str) -> str:
        if rng.random() < 0.5:
            return f"<{tag}>{inside}</{tag}>"
        return f'<{rng.choice(["div", "section", tag])} {rng.choice(["class", "id"])}="{name}">{inside}</{"x"}>'.replace("</x>", "</div>")

    def form() -> str:
        said_in = rng.choice(["", f"<p>{said(1, 3)}</p>", f"<h3>{words(1, 4)}</h3><p>{words(3, 12)}</p>", f"<div>{said(1, 2)}</div>"])
        return f'<form{rng.choice(["", " class=signup", " id=f"])}>{said_in}<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button></form>'

    def side(place: str) -> str:
        out = []
        if place == "top":
            out += [part("header", "header", f"<h1>{words(1, 3)}</h1>" if rng.random() < 0.4 else f"<p>{words(1, 4)}</p>")] if rng.random() < 0.6 else []
            out += [part("nav", rng.choice(["nav", "menu", "navbar"]), items(9))] if rng.random() < 0.9 else []
            out += [f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "consent"])}"><p>{said(1, 2)}</p></div>'] if rng.random() < 0.3 else []
        else:
            out += [part("aside", rng.choice(["sidebar", "related", "widget"]), f"<h3>{words(1, 3)}</h3>" + rng.choice([items(6), f"<p>{said(1, 2)}</p>"]))] if rng.random() < 0.5 else []
            out += [f'<{(t := rng.choice(["section", "div"]))} {rng.choice(["class", "id"])}="{rng.choice(["comments", "comment-list", "replies"])}"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="{rng.choice(["comment", "reply"])}"><p>{said(1, 4)}</p></div>' for _ in range(rng.randint(1, 5))) + f"</{t}>"] if rng.random() < 0.5 else []
            out += [part("footer", "footer", rng.choice([f"&copy; {words(1, 3)} &middot; {said(1, 3)}", f"<p>{said(1, 2)}</p>" + items(5)]))] if rng.random() < 0.9 else []
        if rng.random() < 0.3:
            out.insert(rng.randrange(len(out) + 1), form())
        if rng.random() < 0.5:
            out.insert(rng.randrange(len(out) + 1), f'<div class="{rng.choice(["ad", "ads", "advert", "banner", "promo", "sponsored"])}">{rng.choice([said(1, 2), words(2, 9), link(), f"<p>{said(1, 3)}</p>"])}</div>')
        return "".join(out)

    def content() -> str:
        out = [f"<h1{y}>{words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.75:
                p = said(1, 6) if rng.random() < 0.85 else words(1, 6)
                out.append(f"<p{y}>{p}{' ' + link() if rng.random() < 0.2 else ''}</p>")
            elif kind < 0.83:
                out.append(f"<h2{y}>{words(1, 6)}</h2>")
            elif kind < 0.9:
                out.append(f"<ul{y}>" + "".join(f"<li{y}>{words(2, 14)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>")
            elif kind < 0.95:
                out.append(f"<blockquote{y}><p{y}>{said(1, 2)}</p></blockquote>")
            else:
                out.append(f"<table{y}>" + "".join(f"<tr{y}><td{y}>{words(1, 3)}</td><td{y}>{words(1, 3)}</td></tr>" for _ in range(2)) + "</table>")
        if rng.random() < 0.25:
            out.insert(rng.randrange(1, len(out) + 1), rng.choice([f'<div class="{rng.choice(["share", "social", "ad", "related", "newsletter"])}">{rng.choice([items(4), words(2, 8), said(1, 2)])}</div>', f"<aside><p>{said(1, 2)}</p></aside>"]))
        if rng.random() < 0.1:
            out.insert(rng.randrange(len(out) + 1), form())
        return "".join(out)

    pages = []
    for _ in range(n):
        tag, name = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", ' class="content"'), ("div", ' id="post"'), ("div", ' class="entry"'), ("section", ' class="story"'), ("div", "")])
        body = side("top") + f"<{tag}{name}{y}>{content()}</{tag}>" + side("end")
        around = rng.choice(["form", "form", *["div"] * 8, *[""] * 10])  # some pages are one form
        pages.append(f"<html><head><title>{words(1, 5)}</title></head><body>{f'<{around}>{body}</{around}>' if around else body}</body></html>")
    return pages


def count_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, state, parent's state) counts of a labelled page's nodes."""
    for b in batches:
        seen: dict[tuple[str, int, int], int] = {}
        for page in b["html"].to_pylist():
            nodes, _ = parse(page or "")
            state = [int("data-y" in x.hints) for x in nodes]
            for i, x in enumerate(nodes):
                x.hints = x.hints.replace("data-y", "")
                above = state[x.parent] if i else -1
                f = features(x)
                for key in (*(("emit " + v, state[i], -1) for v in f), ("move " + f[0], state[i], above), ("move any", state[i], above)):
                    seen[key] = seen.get(key, 0) + 1
        rows = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.int32()), pa.array([k[2] for k in rows], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["key", "state", "above", "n"])


def fit_tree(labelled: DataFrame) -> TreeModel:
    """Maximum likelihood with add-one smoothing from labelled(html): content nodes carry data-y. The counts are summed on
    Spark; their number is bounded by the features, not by the pages."""
    rows = labelled.select("html").mapInArrow(count_labels, "key string, state int, above int, n long").groupBy("key", "state", "above").agg(F.sum("n").alias("n")).collect()
    n = {(r.key, r.state, r.above): r.n for r in rows}
    total = [1 + sum(v for (k, s, _), v in n.items() if k.startswith("emit tag:") and s == state) for state in (0, 1)]
    emit = {k[5:]: tuple((n.get((k, s, -1), 0) + 1) / (total[s] + 20) for s in (0, 1)) for k in {k for k, _, _ in n} if k.startswith("emit ")}
    move = {}
    for k in {k for k, _, _ in n if k.startswith("move ")} | {"move any"}:
        rows = [[n.get((k, s, a), 0) + 0.5 for s in (0, 1)] for a in (0, 1)]
        move[k[5:]] = tuple((x / (x + y), y / (x + y)) for x, y in rows)
    return TreeModel(emit, move, (0.999, 0.001))


def main_text(page: str | None, model: TreeModel, least: float = 0.5) -> str:
    nodes, blocks = parse(page or "")
    if not blocks:
        return ""
    p = model.marginals(nodes)
    return "\n".join(text for i, text in blocks if p[i] >= least)


def extract_text(pages: DataFrame, model: TreeModel, least: float = 0.5) -> DataFrame:
    """(page_id, url, text, n_chars) of each page: the blocks whose node is content with a probability of `least` or more.

    Each page by itself, no shuffle. Null, empty and tagless html give the text that a parser finds (often none). Any
    depth of nesting is worked off without recursion. Null ids and urls are kept, as are repeated rows."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [main_text(x, model, least) for x in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(batches, "page_id long, url string, text string, n_chars long")


def default_model(spark: SparkSession, pages: int = 1500) -> TreeModel:
    return fit_tree(spark.createDataFrame([(x,) for x in labelled_pages(pages)], "html string").repartition(4))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), default_model(spark))
