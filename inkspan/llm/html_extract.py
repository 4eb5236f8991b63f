"""Main-text extraction by a tree-structured graphical model over the DOM.

Every block element is a binary variable, content or not. Its own potential is
log-linear in features of its tag, names, length and links; parent and child
share a potential. Sum-product messages pass from the leaves to the root and
back, giving each element's content marginal. Weights are fitted on labelled
pages by the exact gradient of the likelihood, whose expectations are the same
marginals.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Element kinds of HTML, and words that names of boilerplate and of content use.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head title script style noscript template iframe".split())
RAW = set("title script style noscript template iframe textarea".split())
INLINE = set("a abbr b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
BOILERPLATE = set(
    "ad ads adbox advert adverts advertisement banner bar breadcrumb breadcrumbs byline comment comments consent contact cookie cookies copyright disclaimer discussion disqus dropdown footer form gdpr header legal links login masthead menu meta modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup privacy promo promoted rail reactions recommended related replies reply respond search share sharing side sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar widget widgets".split()
)
CONTENT = set("article body content entry main page post story text".split())
ROLES = set("alert banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
TAGS = "article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header html legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
# Which open elements a start tag ends, and the elements that hold that back.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
GROUPS = [pair for i, pair in enumerate(IMPLIED.values()) if pair not in list(IMPLIED.values())[:i]]
ENDING = {t: [g for g, (ends, _) in enumerate(GROUPS) if t in ends] for t in {x for ends, _ in GROUPS for x in ends}}
HOLDING = {t: [g for g, (_, stops) in enumerate(GROUPS) if t in stops] for t in {x for _, stops in GROUPS for x in stops}}
#: Elements that hold running text; a name on one of them says less than on one that holds blocks.
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption".split())
#: Buckets of hashed words of names.
NAME_BUCKETS = 1024

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


class Node:
    __slots__ = ("parent", "tag", "attrs", "runs", "links", "shown")

    def __init__(self, parent: int, tag: str, attrs: dict[str, str], shown: bool):
        self.parent, self.tag, self.attrs, self.shown = parent, tag, attrs, shown
        self.runs: list[int] = []
        self.links = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements, parents first, and the text runs in page order as (element, text)."""
    nodes = [Node(-1, "html", {}, True)]
    runs: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements with the block each belongs to
    parts: list[str] = []
    opened: dict[str, int] = {}  # open elements by tag
    ends_open = [[0] for _ in GROUPS]  # by group of implied ends: how many could be ended, in each element that holds them back
    inline: list[dict[str, int]] = [{}]  # inline ones since each open block, so that an end tag without its start costs no walk
    at, pos, size, in_link = 0, 0, len(page), 0

    def end_run() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            nodes[at].runs.append(len(runs))
            runs.append((at, text))

    def close(depth: int) -> None:
        nonlocal at, in_link
        while len(stack) > depth:
            tag, block = stack.pop()
            opened[tag] -= 1
            for g in HOLDING.get(tag, ()):
                ends_open[g].pop()
            for g in ENDING.get(tag, ()):
                ends_open[g][-1] -= 1
            if tag in INLINE:
                inline[-1][tag] -= 1
            else:
                inline.pop()
            if tag == "a":
                in_link = max(0, in_link - 1)
            if block != (stack[-1][1] if stack else 0):
                end_run()
            at = stack[-1][1] if stack else 0

    def opening(tag: str, block: int) -> None:
        stack.append((tag, block))
        opened[tag] = opened.get(tag, 0) + 1
        for g in ENDING.get(tag, ()):
            ends_open[g][-1] += 1
        for g in HOLDING.get(tag, ()):
            ends_open[g].append(0)
        if tag in INLINE:
            inline[-1][tag] = inline[-1].get(tag, 0) + 1
        else:
            inline.append({})

    def text(value: str) -> None:
        if value and nodes[at].shown:
            value = entities.unescape(value)
            parts.append(value)
            if in_link:
                nodes[at].links += len(value.strip())

    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            text(page[pos:])
            break
        text(page[pos:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            pos = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[lt : lt + 3]):
                end = page.find(">", lt)
                pos = size if end < 0 else end + 1
            else:
                text("<")
                pos = lt + 1
            continue
        pos, tag = m.end(), m.group(2).lower()
        if m.group(1):
            if not (inline[-1] if tag in INLINE else opened).get(tag):
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE:
                        end_run()
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag == "br" or tag == "hr":
            parts.append(" ")
        if tag in VOID:
            continue
        if tag in CLOSES_P and opened.get("p"):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] not in INLINE:
                    break
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            if ends_open[GROUPS.index((ends, stops))][-1]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ends))
        if tag in INLINE:  # part of its block's text, whatever its attributes
            opening(tag, at)
        else:
            attrs = {k.lower(): entities.unescape(a or b or c) for k, a, b, c in _ATTR.findall(m.group(3))}
            end_run()
            nodes.append(Node(at, tag, attrs, nodes[at].shown and tag not in UNSEEN))
            at = len(nodes) - 1
            opening(tag, at)
        if tag == "a":
            in_link += 1
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>|</{re.escape(tag)}\s", re.I).search(page, pos)
            text(page[pos : end.start() if end else size])
            pos = end.start() if end else size
    close(0)
    end_run()
    return nodes, runs


def features(nodes: list[Node], runs: list[tuple[int, str]]) -> list[list[str]]:
    """Names of the features of each element."""
    found = []
    for node in nodes:
        own = ["bias", "tag:" + (node.tag if node.tag in TAGS else "other")]
        for k in ("class", "id"):
            names = {w.lower() for w in _NAMES.findall(node.attrs.get(k, ""))}
            kind = f"{k} of text" if node.tag in TEXT_TAGS else "name of block"
            if names & BOILERPLATE:
                own.append(f"boilerplate {kind}")
            elif names & CONTENT:
                own.append(f"content {kind}")
            own += [f"{kind} {zlib.crc32(w.encode()) % NAME_BUCKETS}" for w in sorted(names)]
        if node.attrs.get("role", "").lower() in ROLES:
            own.append("boilerplate role")
        if node.attrs.get("aria-hidden") == "true" or "hidden" in node.attrs or "display:none" in node.attrs.get("style", "").replace(" ", "").lower():
            own.append("hidden")
        text = [runs[r][1] for r in node.runs]
        length = sum(map(len, text))
        if length:
            own.append("short" if length < 25 else "middle" if length < 80 else "long")
            own.append("mostly links" if node.links * 2 > length else "some links" if node.links else "no links")
            if text[-1][-1:] in ".!?…:;":
                own.append("sentence end")
        found.append(own)
    return found


def _both(a: float, b: float) -> float:
    high = a if a > b else b
    return high + math.log1p(math.exp(-abs(a - b)))


def marginals(parents: list[int], unary: list[float], pair: list[list[float]]) -> tuple[list[float], list[list[float]]]:
    """Content marginal of each element, and the expected counts of (parent, child) labels, by sum-product.

    ``unary`` is the log-odds of content; parents come before children.
    """
    n = len(parents)
    up = [[0.0, u] for u in unary]
    sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):
        a, b = up[i]
        sent[i] = (_both(a + pair[0][0], b + pair[0][1]), _both(a + pair[1][0], b + pair[1][1]))
        parent = up[parents[i]]
        parent[0] += sent[i][0]
        parent[1] += sent[i][1]
    down = [(0.0, 0.0)] * n
    found, edges = [0.0] * n, [[0.0, 0.0], [0.0, 0.0]]
    for i in range(n):
        if i:
            p = parents[i]
            c0 = up[p][0] + down[p][0] - sent[i][0]
            c1 = up[p][1] + down[p][1] - sent[i][1]
            down[i] = (_both(c0 + pair[0][0], c1 + pair[1][0]), _both(c0 + pair[0][1], c1 + pair[1][1]))
            cells = [[c + pair[s][t] + up[i][t] for t in (0, 1)] for s, c in ((0, c0), (1, c1))]
            high = max(max(cells[0]), max(cells[1]))
            cells = [[math.exp(x - high) for x in row] for row in cells]
            total = sum(cells[0]) + sum(cells[1])
            for s in (0, 1):
                for t in (0, 1):
                    edges[s][t] += cells[s][t] / total
        a, b = up[i][0] + down[i][0], up[i][1] + down[i][1]
        found[i] = 1 / (1 + math.exp(max(-700.0, min(700.0, a - b))))
    return found, edges


class Model:
    def __init__(self, weights: dict[str, float], pair: list[list[float]]):
        self.weights, self.pair = weights, pair

    def extract(self, page: str | None) -> str:
        """Text of the elements that are rather content than not, in page order; empty if there is none."""
        nodes, runs = parse(page or "")
        if not runs:
            return ""
        unary = [sum(self.weights.get(f, 0.0) for f in own) for own in features(nodes, runs)]
        content, _ = marginals([n.parent for n in nodes], unary, self.pair)
        return " ".join(text for at, text in runs if content[at] >= 0.5)


def labelled_pages(count: int = 240, seed: int = 7) -> list[str]:
    """Pages built by rule, whose elements carry ``data-label`` 1 (content or around it) or 0."""
    rng = random.Random(seed)
    syllables = "ka lo mi ren sta vo ter nu shi bel dor an".split()

    def words(lo: int, hi: int) -> str:
        made = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(lo, hi)))
        return made.capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def el(tag: str, label: int, inner: str, names: str = "", by: str = "") -> str:
        attr = f' {by or rng.choice(["class", "id"])}="{names}"' if names else ""
        if not label and rng.random() < 0.15:
            attr += rng.choice([f' role="{rng.choice(sorted(ROLES))}"', " hidden", ' aria-hidden="true"', ' style="display: none"'])
        elif label and rng.random() < 0.05:
            attr += rng.choice([' role="main"', ' role="article"', ' lang="en"'])
        return f'<{tag}{attr} data-label="{label}">{inner}</{tag}>'

    def token() -> str:
        return "".join(rng.choices(syllables, k=2))

    def slug() -> str:
        """A name as paragraphs and headings carry it: any words, those of boilerplate among them."""
        return rng.choice(["", "", "", "", token(), rng.choice(sorted(BOILERPLATE)), token() + "-" + rng.choice(sorted(BOILERPLATE | CONTENT))])

    def links(n: int) -> str:
        return el("ul", 0, "".join(el("li", 0, f'<a href="/{i}">{words(1, 3)}</a>') for i in range(n)))

    def junk(inside: bool) -> str:
        name = rng.choice(sorted(BOILERPLATE)) if rng.random() < 0.9 else token()
        kind = rng.randint(0, 8)
        if kind == 8:
            return el(rng.choice(["p", "p", "h3", "h4"]), 0, words(2, 20), name if name in BOILERPLATE else "ad", "class")
        if kind == 0:
            return el("nav", 0, links(rng.randint(2, 8)), rng.choice(["", name]))
        if kind == 1:
            return el("aside", 0, el("p", 0, words(3, 40)) + (links(3) if rng.random() < 0.5 else ""), rng.choice(["", name]))
        if kind == 2:
            return el("form", 0, el("label", 0, words(1, 3)) + '<input name="q">' + el("button", 0, words(1, 2)), rng.choice(["", name]))
        if kind == 3 and not inside:
            return el(rng.choice(["header", "footer"]), 0, rng.choice([words(2, 25), el("p", 0, words(2, 40)), links(3)]), rng.choice(["", name]))
        if kind == 4:
            return el("section", 0, el("h3", 0, words(1, 3)) + "".join(el("div", 0, el("p", 0, words(2, 40)), "comment") for _ in range(rng.randint(1, 4))), rng.choice(["comments", "replies", "respond", name]))
        return el(rng.choice(["div", "div", "section", "ul"]), 0, rng.choice([words(2, 60), el("p", 0, words(2, 60)), links(3), el("div", 0, el("span", 0, words(1, 12)))]), name)

    def prose() -> str:
        kind = rng.randint(0, 11)
        if kind < 7:
            text = words(1, 60)
            if rng.random() < 0.15:
                text += f' <a href="/x">{words(1, 8)}</a>'
            return el("p", 1, text, slug(), "id")
        if kind == 7:
            return el(rng.choice(["h2", "h3"]), 1, words(1, 6), slug(), "id")
        if kind == 8:
            return el(rng.choice(["ul", "ol"]), 1, "".join(el("li", 1, words(1, 12)) for _ in range(rng.randint(1, 5))))
        if kind == 9:
            return el("blockquote", 1, el("p", 1, words(5, 40)))
        if kind == 10:
            return el("pre", 1, words(3, 20))
        return el("table", 1, el("tr", 1, el("td", 1, words(1, 5)) + el("td", 1, words(1, 5))))

    pages = []
    for _ in range(count):
        body = [el("h1", 1, words(2, 10))] + [prose() for _ in range(rng.randint(1, 12))]
        for _ in range(rng.randint(0, 2)):
            body.insert(rng.randint(1, len(body)), junk(True))
        shape = rng.randint(0, 5)
        inner = "".join(body)
        if shape < 2:
            main = el("article", 1, inner)
        elif shape == 2:
            main = el("main", 1, el("article", 1, inner))
        elif shape == 3:
            main = el("div", 1, el("div", 1, inner, rng.choice(sorted(CONTENT))))
        elif shape == 4:
            main = el("section", 1, inner, rng.choice(["", *sorted(CONTENT)]))
        else:
            main = inner
        around = [junk(False) for _ in range(rng.randint(1, 5))]
        cut = rng.randint(0, len(around))
        page = "".join(around[:cut]) + main + "".join(around[cut:])
        if rng.random() < 0.4:
            page = el("div", 1, page, rng.choice(["", "wrapper", "container"]))
        pages.append(f'<html data-label="1"><body data-label="1">{page}</body></html>')
    return pages


def fit(pages: list[str], passes: int = 12, rate: float = 0.3, decay: float = 1e-3) -> Model:
    """Weights by stochastic gradient ascent on the likelihood of the labelled elements."""
    data = []
    for page in pages:
        nodes, runs = parse(page)
        labels = [int(n.attrs.get("data-label", "1")) for n in nodes]
        data.append(([n.parent for n in nodes], features(nodes, runs), labels))
    weights: dict[str, float] = {}
    pair = [[0.0, 0.0], [0.0, 0.0]]
    for step in range(passes):
        pace = rate / (1 + 0.3 * step)
        for parents, feats, labels in data:
            content, edges = marginals(parents, [sum(weights.get(f, 0.0) for f in own) for own in feats], pair)
            for own, y, p in zip(feats, labels, content):
                if abs(y - p) > 1e-4:
                    for f in own:
                        weights[f] = weights.get(f, 0.0) + pace * (y - p)
            for i, p in enumerate(parents):
                if i:
                    edges[labels[p]][labels[i]] -= 1
            for s in (0, 1):
                for t in (0, 1):
                    pair[s][t] -= 0.3 * pace * edges[s][t] + decay * pace * pair[s][t]
            for f in weights:
                weights[f] -= decay * pace * weights[f]
    return Model(weights, pair)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_pages())


def extract_text(pages: DataFrame, model: Model | None = None, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text string`` (main text) and ``n_chars long`` (its code points).

    White space inside a block becomes one space; blocks are joined in page order
    by one space. A null or empty page, or one without content, has empty text.
    Rows are kept one to one. Input columns named like an output are replaced by
    it. Pages are worked on whole, each by itself, without a shuffle.
    """
    model = model or default_model()
    pages = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars") and c != html_col])
    at = pages.columns.index(html_col)
    kept = [i for i, c in enumerate(pages.columns) if c != html_col or c.lower() not in ("text", "n_chars")]

    def extracted(batches):
        for batch in batches:
            texts = [model.extract(h.as_py()) for h in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in kept], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*[batch.schema.names[i] for i in kept], "text", "n_chars"],
            )

    fields = [pages.schema.fields[i] for i in kept]
    return pages.mapInArrow(extracted, StructType([*fields, *StructType.fromDDL("text string, n_chars long").fields]))


