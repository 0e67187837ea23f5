"""HTML extraction: gradient-boosted trees over DOM nodes, decoded down the tree.

A page becomes a tree of block elements. Each has features of its own and its subtree
(tag, attribute words, depth, text density, share of link text, marks), of its ancestors
and of its siblings. Boosted trees give each node the log-odds of being main text, and the
decoding picks the best labelling in which a kept element is kept whole and a dropped one
dropped whole; elements that hold both are split among their children. So a paragraph is
never kept out of a dropped sidebar.

The classifier is fitted on a bounded sample, SAMPLE pages of the input chosen by a hash of
their id: main text is what stands in article or main there, the rest is not. As the pages
of one site look alike, each sampled page is also set anew in layouts built from labelled
parts: menus, headers, footers, sidebars, notices, adverts, forms and reader comments.

Every page is read whole. Text: character references decoded, white space inside a block
is one space, blocks joined by a line feed in page order; a br is white space.

Defined cases: null and empty html gives an empty text; a page without elements is one
block; broken nesting closes as browsers close it; null or repeated ids are fine; an empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 150
LAYOUTS = 5
TREES, DEPTH, RATE = 60, 4, 0.2

#: Where a comment, tag or declaration may begin.
OPENING = re.compile(r"<(?:!--|/?[a-zA-Z]|[!?])")
#: A tag; a quote opens a value only behind =, and one that is never closed is a character. It never backtracks.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?)*+)>")
ATTRIBUTE = re.compile(r"(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"\bdata-y=(\d)")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page: what browsers don't show, and controls; a button only in a form.
SILENT = frozenset("script style noscript template head title iframe select option textarea button canvas audio video annotation annotation-xml desc metadata".split())
SHOWN_BUTTON = "button outside a form"
#: What may stand in a head; anything else, text too, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var nobr object".split())
#: Formulas and drawings, whose text runs on in the line.
INLINE |= frozenset("math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE |= frozenset("svg circle clippath defs ellipse filter g line lineargradient marker mask path pattern polygon polyline radialgradient rect stop switch symbol text textpath tspan use".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}

TAGS = ["article main", "nav menu", "header", "footer", "aside", "form fieldset", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "li", "ul ol dl dd dt", "table tbody thead tr td th", "blockquote pre figure figcaption"]
TAG_AT = {t: i for i, names in enumerate(TAGS) for t in names.split()}
#: Words of class, id and role, by what they tell of.
WORDS = {
    "content": "article articlebody body content entry main post story text prose page",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc topbar tabs pagination pager",
    "side": "aside sidebar side widget rail related recommended popular trending complementary",
    "foot": "footer foot copyright legal colophon contentinfo bottom credits",
    "head": "header head masthead banner hero logo branding top",
    "advert": "ad ads adv advert advertisement adsense sponsor sponsored promo promotion promoted affiliate",
    "comment": "comment comments commentlist disqus reply replies respond discussion reader feedback reviews thread",
    "notice": "cookie cookies consent notice alert gdpr modal popup overlay toast message warning dialog",
    "form": "form search login signup subscribe newsletter register signin contact",
    "share": "share sharing social follow like tweet byline meta tags author",
}
WORD_AT = {w: i for i, names in enumerate(WORDS.values()) for w in names.split()}
N_FEATURES = len(TAGS) + 2 * len(WORDS) + 17


class Node:
    __slots__ = ("tag", "parent", "words", "label", "kids", "items", "chars", "link", "marks", "tags", "depth", "inputs")

    def __init__(self, tag: str, parent: int, words: int, depth: int, label: int):
        self.tag, self.parent, self.words, self.depth, self.label = tag, parent, words, depth, label
        self.kids: list[int] = []
        self.items: list[tuple[int, str]] = []  # blocks of its own: order on the page, text
        self.chars = self.link = self.marks = self.tags = self.inputs = 0


def _attribute_words(attributes: str) -> int:
    """A bit for each kind of word."""
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        for w in WORD.findall(CAMEL.sub(" ", m[1] or m[2] or m[3] or "").lower()):
            if (k := WORD_AT.get(w)) is not None:
                found |= 1 << k
    return found


def tokens(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, tag) of the comments (no tag), declarations and tags of a page, in linear time.

    A caller may send where to go on. A tag that the page ends in is text, with all behind it.
    """
    at = 0
    while m := OPENING.search(page, at):
        start, tag = m.start(), None
        if m[0] == "<!--":
            end = page.find("-->", start + 4)
            end = len(page) if end < 0 else end + 3
        elif m[0][-1] in "!?":
            end = page.find(">", start) + 1
        else:
            tag = TAG.match(page, start)
            end = tag.end() if tag else 0
        if not end:
            return
        at = (yield start, end, tag) or end


def parse(page: str) -> list[Node]:
    """The block elements of a page in the order they open; the first is the page itself."""
    nodes = [Node("page", -1, 0, 0, -1)]
    stack: list[tuple[str, int]] = [("page", 0)]  # open elements with the block that holds their text
    text: list[str] = []
    open_ = Counter()  # of each tag
    blocks = silent = links = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal blocks
        if text:
            shown = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if shown:
                node = nodes[stack[-1][1]]
                node.items.append((blocks, shown))
                node.chars += len(shown)
                node.marks += sum(map(shown.count, ".,;:!?"))
                blocks += 1

    def close(to: int) -> None:
        nonlocal silent, links
        for tag, _ in stack[to:]:
            open_[tag] -= 1
            silent -= tag in SILENT
            links -= tag == "a"
        if any(tag not in INLINE and tag != SHOWN_BUTTON for tag, _ in stack[to:]):
            flush()
        del stack[to:]

    def opened(tag: str, node: int) -> None:
        stack.append((tag, node))
        open_[tag] += 1

    found, go_on = tokens(page), None
    while at < end:
        try:
            stop, after, m = found.send(go_on)
        except StopIteration:
            stop, after, m = end, end, None
        go_on = None
        if stop > at and stack[-1][0] == "head" and not page[at:stop].isspace():
            close(len(stack) - 1)
        if stop > at and not silent:
            piece = page[at:stop]
            text.append(piece)
            if links:
                nodes[stack[-1][1]].link += len(piece.strip())
        at = after
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] or tag == "button" and open_[SHOWN_BUTTON] else ():
                if stack[k][0] == tag or tag == "button" and stack[k][0] == SHOWN_BUTTON:
                    close(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            close(len(stack) - 1)
        if tag == "head" and any(x.tag != "html" for x in nodes[1:3]):
            continue  # only the first, before the body, is one
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID or m[3].endswith("/") and tag not in CLOSES_P:
            nodes[stack[-1][1]].inputs += tag == "input"
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1) if open_["p"] else ():
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in SIBLINGS:
            same, within = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in same.split()) else ():
                if stack[k][0] in same.split():
                    close(k)
                    break
                if stack[k][0] in within:
                    break
        if tag in INLINE or tag == "button" and not open_["form"]:
            nodes[stack[-1][1]].tags += tag != "button"
            nodes[stack[-1][1]].inputs += tag == "button"
            if tag in ("button", "mtd", "text"):
                text.append(" ")
            opened(SHOWN_BUTTON if tag == "button" else tag, stack[-1][1])
            links += tag == "a"
            continue
        if tag in SILENT:
            nodes[stack[-1][1]].inputs += tag in ("select", "textarea", "button")
            opened(tag, stack[-1][1])
            silent += 1
            if tag in RAW:
                close_at = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                close(len(stack) - 1)
                go_on = at = close_at.end() if close_at else end
            continue
        flush()
        parent = stack[-1][1]
        label = LABEL.search(m[3])
        nodes.append(Node(tag, parent, _attribute_words(m[3]), nodes[parent].depth + 1, int(label[1]) if label else nodes[parent].label))
        nodes[parent].kids.append(len(nodes) - 1)
        opened(tag, len(nodes) - 1)
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    parent = np.array([max(x.parent, 0) for x in nodes])
    own = np.array([(x.chars, x.link, x.marks, x.tags + 1, x.inputs, len(x.items)) for x in nodes], np.float64)
    tree = own.copy()
    for i in range(n - 1, 0, -1):
        tree[parent[i]] += tree[i]
    bits = (np.array([x.words for x in nodes])[:, None] >> np.arange(len(WORDS))) & 1
    tag = np.zeros((n, len(TAGS)))
    for i, x in enumerate(nodes):
        if (k := TAG_AT.get(x.tag)) is not None:
            tag[i, k] = 1
    above = np.zeros((n, len(WORDS)))  # how near the nearest ancestor with such a word is
    inside = np.zeros((n, 4))  # article or main, nav, aside or footer or header, form
    inside_of = {"article": 0, "main": 0, "nav": 1, "menu": 1, "aside": 2, "footer": 2, "header": 2, "form": 3}
    for i in range(1, n):
        p = parent[i]
        above[i] = np.maximum(above[p] * 0.8, bits[p])
        inside[i] = inside[p]
        if (k := inside_of.get(nodes[i].tag)) is not None:
            inside[i, k] = 1
    n_kids = np.array([len(x.kids) for x in nodes])
    place = np.zeros(n)
    for x in nodes:
        for k, i in enumerate(x.kids):
            place[i] = (k + 1) / len(x.kids)
    chars, link, marks, tags, inputs, blocks = tree.T
    siblings = np.maximum(n_kids[parent], 1)
    mates = np.maximum((chars[parent] - own[parent, 0]) / siblings, 1)  # mean text of the siblings
    rest = np.stack(
        [
            np.array([x.depth for x in nodes]),
            np.log1p(chars),
            link / np.maximum(chars, 1),
            np.log1p(tags),
            chars / tags,
            marks / np.maximum(chars, 1),
            chars / np.maximum(chars[0], 1),
            np.log1p(own[:, 0]),
            inputs,
            chars / np.maximum(blocks, 1),
            np.log1p(siblings),
            place,
            np.log(np.maximum(chars, 1) / mates),
        ],
        1,
    )
    return np.concatenate([tag, bits, above, rest, inside], 1).astype(np.float32)


class BoostedTrees:
    """Logistic boosting with histogram splits; each tree is full to its depth."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = 32, least: float = 4.0):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        mean = np.clip(y.mean(), 0.01, 0.99)
        self.start = float(np.log(mean / (1 - mean)))
        score, inner = np.full(len(y), self.start), 2**self.depth - 1
        self.feature, self.cut, self.leaf = np.zeros((self.n, inner), np.int64), np.full((self.n, inner), np.inf, np.float32), np.zeros((self.n, inner + 1))
        for t in range(self.n):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                base, width = 2**level - 1, 2**level
                best = np.full(width, 1e-6)
                total_g, total_h = (np.bincount(at - base, v, width) for v in (grad, hess))
                chosen = np.full((width, 2), -1)
                for j, e in enumerate(edges):
                    size = len(e) + 1
                    if size == 1:
                        continue
                    key = (at - base) * size + binned[:, j]
                    g, h = (np.cumsum(np.bincount(key, v, width * size).reshape(width, size), 1)[:, :-1] for v in (grad, hess))
                    left = g**2 / (h + 1) + (total_g[:, None] - g) ** 2 / (total_h[:, None] - h + 1) - (total_g**2 / (total_h + 1))[:, None]
                    left[(h < self.least / 4) | (total_h[:, None] - h < self.least / 4)] = 0
                    k = np.argmax(left, 1)
                    gain = left[np.arange(width), k]
                    better = gain > best
                    best[better] = gain[better]
                    chosen[better] = np.stack([np.full(width, j), k], 1)[better]
                for w in range(width):
                    if chosen[w, 0] >= 0:
                        self.feature[t, base + w] = chosen[w, 0]
                        self.cut[t, base + w] = edges[chosen[w, 0]][chosen[w, 1]]
                at = 2 * at + 1 + (x[np.arange(len(y)), self.feature[t, at]] > self.cut[t, at])
            leaf = at - inner
            g, h = (np.bincount(leaf, v, inner + 1) for v in (grad, hess))
            self.leaf[t] = self.rate * g / (h + 1)
            score += self.leaf[t, leaf]
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(self.n):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, self.feature[t, at]] > self.cut[t, at])
            out += self.leaf[t, at - (2**self.depth - 1)]
        return out


def decode(nodes: list[Node], logits: np.ndarray, split_cost: float = 1.0) -> list[str]:
    """The kept blocks: the best labelling without contradictions between a node and what it holds."""
    n = len(nodes)
    e = np.clip(logits, -6, 6).tolist()
    keep, drop, mixed = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        own = e[i] if x.chars else 0.25 * e[i]
        keep[i], drop[i] = own + sum(keep[k] for k in x.kids), -own + sum(drop[k] for k in x.kids)
        mixed[i] = (abs(own) if x.items else 0.0) + sum(max(keep[k], drop[k], mixed[k]) for k in x.kids) - split_cost
    state, found = [0] * n, []
    for i, x in enumerate(nodes):
        above = state[x.parent] if i else 2
        if above == 2:
            best = max(keep[i], drop[i], mixed[i])
            state[i] = 2 if i == 0 or best == mixed[i] else 1 if best == keep[i] else 0
        else:
            state[i] = above
        if state[i] == 1 or state[i] == 2 and e[i] > 0:
            found += x.items
    return [t for _, t in sorted(found)]


def _layout(rng: random.Random, title: str, paragraphs: list[str], chatter: list[str]) -> str:
    """A labelled page: paragraphs as the main text among parts made of chatter."""
    pick = lambda *xs: rng.choice(xs)
    words = lambda a, b: " ".join(rng.choice(chatter) for _ in range(rng.randint(a, b)))
    tidy = html.escape

    def part(kind: str) -> str:
        if kind == "menu":
            links = "".join(f"<li><a href='#'>{tidy(words(1, 3))}</a></li>" for _ in range(rng.randint(3, 9)))
            return pick(f"<nav data-y=0><ul>{links}</ul></nav>", f"<div data-y=0 class='{pick('menu', 'navbar', 'main-navigation', 'breadcrumbs')}'><ul>{links}</ul></div>", f"<ul data-y=0 id='nav'>{links}</ul>", f"<div data-y=0><ul>{links}</ul></div>")
        if kind == "head":
            return pick(f"<header data-y=0><div>{tidy(words(1, 4))}</div></header>", f"<div data-y=0 id='{pick('header', 'masthead')}'><h1>{tidy(words(1, 3))}</h1><p>{tidy(words(3, 8))}</p></div>")
        if kind == "foot":
            return pick("<footer data-y=0>{}</footer>", "<div data-y=0 class='footer'><p>{}</p></div>", "<div data-y=0 id='site-footer'>{}</div>").format(f"&copy; {tidy(words(4, 20))}")
        if kind == "side":
            items = "".join(f"<li><a href='#'>{tidy(words(2, 6))}</a></li>" for _ in range(rng.randint(2, 6)))
            return pick("<aside data-y=0>{}</aside>", "<div data-y=0 class='sidebar'>{}</div>", "<div data-y=0 class='related-posts'>{}</div>", "<div data-y=0 id='right-rail' class='widget'>{}</div>").format(f"<h3>{tidy(words(1, 3))}</h3>" + pick(f"<ul>{items}</ul>", f"<p>{tidy(words(8, 40))}</p>"))
        if kind == "notice":
            return pick("<div data-y=0 class='cookie-notice'>{}</div>", "<div data-y=0 role='alert'>{}</div>", "<div data-y=0 id='consent-banner'>{}</div>").format(pick("{}", "<p>{}</p>").format(tidy(words(8, 30))) + pick("", "<button>OK</button>"))
        if kind == "advert":
            return pick("<div data-y=0 class='ad'>{}</div>", "<div data-y=0 class='sponsored'><p>{}</p></div>", "<section data-y=0 class='promo advertisement'>{}</section>", "<aside data-y=0 class='ads'>{}</aside>").format(tidy(words(5, 30)))
        if kind == "form":
            return f"<form data-y=0 {pick('', 'class=search', 'id=newsletter')}><p>{tidy(words(2, 12))}</p><label>{tidy(words(1, 2))}</label><input><button>{tidy(words(1, 1))}</button></form>"
        said = "".join(f"<{t} class='comment'><b>{tidy(words(1, 2))}</b><p>{tidy(rng.choice(paragraphs + [words(10, 40)]))}</p></{t}>" for t in [pick("div", "li", "article")] for _ in range(rng.randint(1, 5)))
        return pick("<section data-y=0 id='comments'><h2>{}</h2>{}</section>", "<div data-y=0 class='comments'><h3>{}</h3>{}</div>", "<div data-y=0 class='discussion reader-comments'><h3>{}</h3><ul>{}</ul></div>").format(tidy(words(1, 3)), said)

    body = [f"<{pick('h1', 'h2')}>{tidy(title)}</h1>" if title else ""]
    for p in paragraphs:
        body.append(pick("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<div>{}</div>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</li></ul>", "<h2>" + tidy(" ".join(p.split()[:4])) + "</h2><p>{}</p>").format(tidy(p)))
        if rng.random() < 0.08:
            body.append(part(pick("advert", "side", "notice", "form")))
    main = pick("<article data-y=1>{}</article>", "<main data-y=1>{}</main>", "<div data-y=1 class='post-content'>{}</div>", "<div data-y=1 id='content'>{}</div>", "<div data-y=1 class='entry'>{}</div>", "<div data-y=1>{}</div>", "<section data-y=1>{}</section>", "<main><article data-y=1>{}</article></main>").format("".join(body))
    before = [part(k) for k in ("head", "menu", "notice", "advert", "side", "form") if rng.random() < 0.5]
    after = [part(k) for k in ("side", "comment", "comment", "advert", "form", "menu", "foot") if rng.random() < 0.55]
    rng.shuffle(before)
    wrap = pick("{}", "<div class='wrapper'>{}</div>", "<div id='page'><div>{}</div></div>")
    return f"<html><body data-y=0>{wrap.format(''.join(before) + main + ''.join(after))}</body></html>"


def train(pages: list[tuple[int, str]], seed: int = 7) -> BoostedTrees:
    """Fit on the given pages, by their article or main element, and on layouts made of their texts."""
    rng, xs, ys = random.Random(seed), [], []
    for _, page in pages:
        nodes = parse(page)
        main = [False] * len(nodes)
        for i, x in enumerate(nodes):
            main[i] = x.tag in ("article", "main") or i > 0 and main[x.parent] and x.tag not in ("nav", "aside", "footer", "form")
        inside = [t for i, x in enumerate(nodes) if main[i] or not any(main) and x.tag == "p" for _, t in x.items]
        chatter = [w for i, x in enumerate(nodes) if not main[i] for _, t in x.items for w in t.split()] or ["about", "more", "home"]
        if any(main):
            xs.append(features(nodes)[1:])
            ys.append(np.array(main[1:], np.float64))
        paragraphs = inside or ["more"]
        for _ in range(LAYOUTS):
            some = paragraphs[: rng.randint(1, max(1, min(len(paragraphs), 30)))]
            nodes = parse(_layout(rng, " ".join(some[0].split()[: rng.randint(3, 9)]), some, chatter))
            y = np.array([x.label for x in nodes], np.float64)
            xs.append(features(nodes)[y >= 0])
            ys.append(y[y >= 0])
    return BoostedTrees().fit(np.concatenate(xs), np.concatenate(ys))


def main_texts(pages: list[str], model: BoostedTrees) -> list[str]:
    parsed = [parse(p) for p in pages]
    logits = model.logits(np.concatenate([features(x) for x in parsed]))
    out, at = [], 0
    for nodes in parsed:
        out.append("\n".join(decode(nodes, logits[at : at + len(nodes)])))
        at += len(nodes)
    return out


def _extracted(model: BoostedTrees, group: int = 200):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, group):
                part = batch.slice(lo, group)
                texts = main_texts([p or "" for p in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, url, text) of every page, by a classifier fitted on at most `sample` of them."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    # about four times the sample by a bound on the hash, so that no task returns a sample of its own
    share = min(1.0, 4 * sample / max(1, rows.count()))
    hashed = F.xxhash64("page_id")
    chosen = rows.where("html is not null").where(F.shiftrightunsigned(hashed, 11) <= int(share * 2**53)).orderBy(hashed, "page_id").limit(sample)
    examples = [(r["page_id"], r["html"]) for r in chosen.collect()]
    kind = rows.schema["page_id"].dataType.simpleString()
    model = train(examples or [(0, "<article><p>none</p></article>")])
    return rows.mapInArrow(_extracted(model), f"page_id {kind}, url string, text string")


def extraction_report(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
