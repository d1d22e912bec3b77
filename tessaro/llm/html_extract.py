"""Main text of web pages by the maximum-scoring subsequence of tokens.

A page is a sequence of words and tags. Words score positive or negative by
their block, tags score negative, and one linear scan finds the contiguous run
of tokens with the largest sum. The weights of blocks are those of a logistic
model of where a block stands (its elements' names, the classes of containers
around it, links, repeated containers, inside or outside of the article) and of
its shape (element, length, punctuation), fitted on labelled pages of many
layouts (``labelled_pages``). Blocks inside the run that would not be content
even if they had the shape of a paragraph, such as an advert between two
paragraphs, are left out.

Names decide nothing on their own: only containers' class words are looked at,
never those of headings, paragraphs or list items, and not those of containers
that hold the article itself.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import pick

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s>/]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)",
    re.S | re.I,
)
# Elements whose inside is no text of the page, and those of them that a missing end tag leaves open up to the end of the page.
OPAQUE = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in "script style noscript template svg iframe textarea select object".split()}
RAW = frozenset("script style textarea".split())
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

# Elements that begin and end a block; void ones; those that HTML gives a meaning of place; containers whose classes are looked at.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PLACES = {"nav": "nav", "menu": "nav", "aside": "aside", "footer": "footer", "form": "form", "button": "form", "fieldset": "form", "head": "head", "title": "head", "dialog": "dialog", "header": "header", "article": "article", "main": "main"}
CONTAINERS = frozenset("div section aside ul ol dl table form nav header footer article details".split())
PROSE = frozenset("h1 h2 h3 p blockquote pre".split())
IN_HEAD = frozenset("title meta link base style script noscript template head html".split())
#: Elements whose end tag may be missing; the next of these names ends them.
OPEN_ENDED = {"p": BLOCKS, **{x: frozenset(y.split()) for x, y in {"li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option", "td": "td th tr", "th": "td th tr", "tr": "tr"}.items()}}


#: Letters that class words of the same beginning share: comments, commentlist.
STEM = 6


class Node:
    """An open or closed element of a page, as far as places need it."""

    __slots__ = ("name", "parent", "words", "classes", "hidden", "features", "article", "nested", "holds")

    def __init__(self, name: str, parent: Node | None, attributes: str):
        self.name, self.parent, self.words, self.holds = name, parent, 0, False
        self.hidden = bool(attributes and HIDDEN.search(attributes))
        self.classes: tuple[str, ...] = ()
        if attributes and name in CONTAINERS:
            values = " ".join(m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes))
            words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", values).lower()))
            self.classes = tuple(sorted(words | {w[:STEM] + "~" for w in words if len(w) >= STEM}))
        inside = parent.article if parent else None
        self.nested = bool(parent and parent.nested) or (name == "article" and inside is not None)
        self.article = inside if inside is not None or name != "article" else self


class Block:
    __slots__ = ("node", "words", "links", "tags", "said", "early")

    def __init__(self, node: Node):
        self.node, self.words, self.links, self.tags = node, 0, 0, 0
        self.said: list[str] = []


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, those without words too; tags: how many tags come before or in a block."""
    root = Node("html", None, "")
    stack, open_, nodes = [root], Counter(), [root]
    block, out = Block(root), []
    out.append(block)
    at, links = 0, 0
    apart = True  # a word goes on after an inline tag unless white space stands between
    endless = set()  # opaque elements without an end tag in the rest of the page

    def pop() -> str:
        name = stack.pop().name
        open_[name] -= 1
        return name

    while True:
        m = TOKEN.search(page, at)
        if text := page[at : m.start() if m else len(page)]:
            text = html.unescape(text)
            if stack[-1] is not block.node:  # after the end of an inner element
                block = Block(stack[-1])
                out.append(block)
                apart = True
            for k, word in enumerate(text.split()):
                if k == 0 and block.said and not apart and not text[0].isspace():
                    block.said[-1] += word
                else:
                    block.said.append(word)
                    block.words += 1
                    block.links += links
                apart = False
            apart = apart or text[-1].isspace()
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        block.tags += 1
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in OPAQUE and not closing:
            if not attributes.endswith("/"):
                end = None if name in endless else OPAQUE[name].search(page, m.end(2) if m[2] else m.end(5))
                if end:
                    at = end.end()
                elif name in RAW:
                    at = len(page)
                else:
                    endless.add(name)
            continue
        if name == "br":
            apart = True
        if name == "a":
            links = 0 if closing else 1  # links don't nest
        empty = name in VOID or attributes.endswith("/")
        if closing:
            if open_[name]:
                while pop() != name:
                    pass
            elif name not in BLOCKS:
                continue
        else:
            if open_["head"] and name in BLOCKS and name not in IN_HEAD:
                while pop() != "head":
                    pass
            if name in BLOCKS:
                while stack[-1].name in OPEN_ENDED and name in OPEN_ENDED[stack[-1].name]:
                    pop()
            hidden = name not in BLOCKS and not empty and HIDDEN.search(attributes)
            if hidden or (name in BLOCKS and not empty and name not in ("html", "body")):
                stack.append(Node(name, stack[-1], attributes))
                open_[name] += 1
                nodes.append(stack[-1])
            elif name not in BLOCKS:
                continue
        if name in BLOCKS:
            links = 0 if name != "a" and not closing else links
        if block.words or block.tags > 64:
            block = Block(stack[-1])
            out.append(block)
        else:
            block.node = stack[-1]
        apart = True
    _place(nodes, out)
    return out


def _place(nodes: list[Node], blocks: list[Block]) -> None:
    """Sets the features of all nodes; linear in nodes, as features are those of the parent and a bounded number of others."""
    for b in blocks:
        b.node.words += b.words
    for n in reversed(nodes[1:]):
        n.parent.words += n.words
    bad = frozenset(("nav", "aside", "footer", "form", "dialog", "head", "hidden"))
    rough: dict[int, bool] = {id(nodes[0]): False}
    for n in nodes[1:]:
        rough[id(n)] = rough[id(n.parent)] or n.hidden or PLACES.get(n.name) in bad
    articles = [n for n in nodes if n.article is n and not rough[id(n)]]
    best = max(articles, key=lambda n: n.words, default=None)
    heads = [n for n in nodes if n.name == "h1" and not rough[id(n)]]
    texts = [not rough[id(b.node)] and bool(b.words) and (b.node.name in PROSE or (b.words >= LONG and 2 * b.links < b.words)) for b in blocks]
    if best and all(n.article is None for n in heads):  # the articles may be teasers of others
        first = next((i for i, b in enumerate(blocks) if b.words and b.node.article is not None), len(blocks))
        upto = len(blocks) if heads else first  # without a heading comments after an article say nothing
        free = sum(b.words for b, is_text in zip(blocks[:upto], texts) if is_text and b.node.article is None)
        second = max((n.words for n in articles if n is not best and not n.nested), default=0)
        alike = 2 * second > best.words and (bool(heads) or free >= best.words)
        best = best if not alike and 2 * best.words >= free else None
    mains = [n for n in nodes if n.name == "main" and not rough[id(n)]]
    box = None if best or mains or not heads else heads[0].parent
    while box is not None and box.name in ("header", "hgroup"):
        box = box.parent
    if box is nodes[0] or (box is not None and 2 * box.words < sum(b.words for b in blocks if b.node.name in PROSE and not rough[id(b.node)])):
        box = None  # the heading stands apart from what it is the heading of
    for n in ([best] if best else mains[:1] or heads[:1]) + mains[:1]:
        while n is not None and not n.holds:
            n.holds = True
            n = n.parent
    if not (best or mains or heads):  # what holds nearly all of the page holds the article
        for n in nodes:
            n.holds = n.words >= 0.8 * nodes[0].words
    early = any(texts)
    for b, is_text in zip(blocks, texts):
        early = early and not is_text
        b.early = early
    often = Counter((n.name, n.classes) for n in nodes if n.classes)
    nodes[0].features = frozenset(["outside article"] * bool(best) + ["outside main"] * bool(mains) + ["outside heading's element"] * bool(box))
    for n in nodes[1:]:
        own = set()
        if n.hidden:
            own.add("hidden")
        place = PLACES.get(n.name)
        if place == "header" and ("article" in n.parent.features or "main" in n.parent.features):
            place = None  # the heading of an article
        if place:
            own.add(place)
        if n.nested:
            own.add("nested article")
        elif n.article is not None and n.article is not best:
            own.add("lesser article")
        if not n.holds:
            own.update("." + c for c in n.classes)
            if n.classes and often[n.name, n.classes] > 2:
                own.add("repeated")
        gone = {"outside article"} if n.article is not None and n.article is best else set()
        gone |= {"outside main"} if n.name == "main" else set()
        gone |= {"outside heading's element"} if n is box else set()
        n.features = n.parent.features if own <= n.parent.features and not gone & n.parent.features else (n.parent.features | own) - gone


ENDS = frozenset(".!?…:;\"”»。！？")
SHAPES = ("links", "length", "ends", "heading", "p", "li", "other", "early")


def shape(b: Block) -> list[float]:
    """The values of ``SHAPES``; what a paragraph would have is :data:`PARAGRAPH`."""
    name = b.node.name
    kind = [name in ("h1", "h2", "h3"), name in ("p", "blockquote", "pre", "figcaption"), name in ("li", "dd", "dt", "td", "th")]
    return [b.links / b.words, math.log1p(min(b.words, 60)), float(b.said[-1][-1] in ENDS), *map(float, kind), float(not any(kind)), float(b.early)]


#: Words of a block that is text in whatever element it stands.
LONG = 15
PARAGRAPH = [math.log1p(30), 1.0, 0.0, 1.0, 0.0, 0.0, 0.0]


#: Labelled pages that a feature must be on to have a weight.
LEAST_PAGES = 4


class Weights:
    """The logistic model of blocks, and the scores of tags, -0.02 at most."""

    def __init__(self, names: dict[str, float], shapes: list[float], bias: float, tag: float):
        self.names, self.shapes, self.bias, self.tag = names, shapes, bias, tag

    def place(self, b: Block) -> float:
        return self.bias + sum(self.names.get(f, 0.0) for f in b.node.features)

    def odds(self, b: Block) -> tuple[float, float]:
        """Log odds of content, as it is and with the shape of a paragraph."""
        place, own = self.place(b), shape(b)
        links = self.shapes[0] * own[0]
        return place + links + sum(w * x for w, x in zip(self.shapes[1:], own[1:])), place + links + sum(w * x for w, x in zip(self.shapes[1:], PARAGRAPH))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.clip(np.linalg.solve(h, x.T @ (p - y) + ridge * w), -5, 5)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_weights(pages: list[tuple[str, list[bool]]], ridge: float = 0.5, steps: int = 25) -> Weights:
    """A model of (html, whether each block with words is content) pages, by Newton steps."""
    rows, y, inside, outside = [], [], [0, 0], [0, 0]
    seen: Counter = Counter()
    for page, content in pages:
        blocks = blocks_of(page)
        full = [b for b in blocks if b.words]
        assert len(full) == len(content)
        good = [b for b, c in zip(full, content) if c]
        lo, hi = blocks.index(good[0]), blocks.index(good[-1])
        for i, b in enumerate(blocks):
            count = inside if lo <= i <= hi else outside
            count[0] += b.tags
            count[1] += b.words
        seen.update({f for b in full for f in b.node.features})
        rows += full
        y += content
    names = sorted(f for f, k in seen.items() if k >= LEAST_PAGES)
    k = 1 + len(SHAPES)
    index = {f: i + k for i, f in enumerate(names)}
    x = np.zeros((len(rows), k + len(names)))
    x[:, 0] = 1
    for i, b in enumerate(rows):
        x[i, 1:k] = shape(b)
        x[i, [index[f] for f in b.node.features if f in index]] = 1
    target = np.array(y, float)
    w = _logistic(x, target, ridge, steps)
    # Class words only tell against a block: what stands in a container of good name is judged by itself.
    stay = [i for i, f in enumerate(names) if not (f[0] == "." and w[k + i] > 0)]
    names = [names[i] for i in stay]
    w = _logistic(x[:, [*range(k), *(k + i for i in stay)]], target, ridge, steps)
    # Tags are denser outside of content than inside; the log of that is what a tag costs.
    tag = math.log(((inside[0] + 1) / (inside[1] + 1)) / ((outside[0] + 1) / (outside[1] + 1))) / 10
    return Weights(dict(zip(names, w[k:].tolist())), w[1:k].tolist(), float(w[0]), min(-0.02, max(-0.3, tag)))


#: A block that is no content costs the run as much as so many words at most; so do all blocks together that are left out between two others.
MOST_LOST = 6
#: What tells that a block is not in the element of the article.
OUTSIDE = frozenset(("outside article", "outside main", "outside heading's element"))


def main_text(page: str, weights: Weights) -> str:
    """The blocks of the best run of tokens, joined by two line ends."""
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    lost = 0
    blocks = blocks_of(page)
    keep = [False] * len(blocks)
    apart = any(b.node.features & OUTSIDE for b in blocks)  # the article's element is known
    for i, b in enumerate(blocks):
        if total <= 0:
            total, start = 0.0, i
        odds, as_paragraph = weights.odds(b) if b.words else (0.0, 0.0)
        keep[i] = as_paragraph > 0
        if apart and b.words and not keep[i] and not b.node.features & OUTSIDE:
            continue  # an insertion in the article ends nothing
        total += weights.tag * b.tags
        if b.words:
            score = math.tanh(odds / 2)
            if keep[i]:
                lost = 0
                total += score * (b.words if score > 0 else min(b.words, MOST_LOST))
            else:
                words = min(b.words, MOST_LOST - lost)
                lost += words
                total += min(score, -0.1) * words
        if total > best:
            best, span = total, (start, i + 1)
    return "\n\n".join(" ".join(b.said) for b, k in zip(blocks[span[0] : span[1]], keep[span[0] : span[1]]) if k)


# Class words of the labelled pages, by what they mark.
CLASSES = {
    "ad": "ad ads advert advertisement sponsor sponsored promo banner adsense",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "aside": "sidebar aside related recommended widget share social rail trending popular tags complementary",
    "comment": "comment comments reply replies respond disqus discussion responses",
    "notice": "notice cookie consent gdpr newsletter subscribe popup modal overlay paywall disclaimer alert dialog",
    "footer": "footer copyright colophon legal contentinfo",
    "header": "masthead topbar header logo",
    "form": "login search signup contact",
    "content": "content post entry story article text body main page single container responsive wrapper",
}


def labelled_pages(n: int = 1200, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts: (html, whether each block with words is content).

    Half of the containers have class words of their kind, the others words that
    mean nothing; a quarter of the articles stand in no element of that name, a
    fifth have no heading, and some stand in the cell of a table.
    """
    rng = random.Random(seed)

    def name(k: int = 0) -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k or rng.randint(1, 9)))

    def say(k: int, end: str = "") -> str:
        return " ".join(name() for _ in range(k)).capitalize() + end

    def attribute(kind: str, inside: bool = False) -> str:
        x = rng.random()
        if x < 0.1 and not inside:
            return ""
        word = rng.choice(CLASSES[kind].split()) if x < 0.65 or inside else name(6)
        word += rng.choice(["", "", "-" + name(4), "-box", " " + name(5)])
        return f' {rng.choice(["class", "class", "id"])}="{word}"'

    out = []
    for _ in range(n):
        parts: list[tuple[str, bool | None]] = []  # markup, and content for a block's text

        def tag(markup: str) -> None:
            parts.append((markup, None))

        def text(words: str, content: bool) -> None:
            parts.append((words, content))

        def links(k: int, list_: bool, linked: bool) -> None:
            tag(rng.choice(["<ul>", "<ol>", "<ul class='%s'>" % name(5)]) if list_ else "<div>")
            for _ in range(k):
                words = say(rng.randint(1, 3))
                tag("<li>" if list_ else "<div>")
                text(f"<a href='/x'>{words}</a>" if linked else words, False)
                tag("</li>" if list_ else "</div>")
            tag("</ul>" if list_ else "</div>")

        plain = rng.choice(["div", "td"]) if rng.random() < 0.2 else ""  # paragraphs are in elements of no meaning

        def paragraphs(k: int, content: bool) -> None:
            for _ in range(k):
                x = rng.random()
                if x < 0.12:
                    tag(f"<h2{rng.choice(['', ' id=%s' % name(5)])}>")
                    text(say(rng.randint(1, 6)), content)
                    tag("</h2>")
                elif x < 0.24:
                    tag("<ul>")
                    for _ in range(rng.randint(2, 5)):
                        tag("<li>")
                        text(say(rng.randint(1, 14), rng.choice(["", "."])), content)
                        tag("</li>")
                    tag("</ul>")
                elif x < 0.3:
                    tag("<table><tr><td>")
                    text(say(rng.randint(1, 4)), content)
                    tag("</td><td>")
                    text(say(rng.randint(1, 4)), content)
                    tag("</td></tr></table>")
                else:
                    tag({"": "<p>", "div": "<div>", "td": "<table><tr><td>"}[plain])
                    words = say(rng.choice([3, 8, 20, 40, 80]), rng.choice([".", ".", ".", "!", ""]))
                    if rng.random() < 0.25:
                        words += f" <a href='/y'>{say(rng.randint(1, 4))}</a>."
                    text(words, content)
                    tag({"": "</p>", "div": "</div>", "td": "</td></tr></table>"}[plain])

        def aside(kind: str, inside: bool = False) -> None:
            element = rng.choice(["div", "div", "section", {"ad": "div", "aside": "aside", "notice": "div", "comment": "section", "form": "form"}[kind]])
            tag(f"<{element}{attribute(kind, inside) if element != 'aside' else ''}>")
            if kind == "comment":
                inner = rng.choice(["div", "article", "li"])
                mark = rng.choice([" class='%s'" % name(6), " class='comment'", " class='%s-item'" % name(4)])
                for _ in range(rng.randint(3, 7)):
                    tag(f"<{inner}{mark}><p>")
                    text(say(rng.randint(4, 60), "."), False)
                    tag(f"</p></{inner}>")
            elif kind == "form":
                tag("<label>")
                text(say(3), False)
                tag("</label><input><button>")
                text(say(1), False)
                tag("</button>")
            elif rng.random() < 0.5:
                inner = rng.choice(["p", "p", "div", "h3"])
                tag(f"<{inner}>")
                text(say(rng.randint(3, 40), rng.choice(["", ".", "."])), False)
                tag(f"</{inner}>")
            else:
                links(rng.randint(2, 6), True, True)
            tag(f"</{element}>")

        wrap = rng.random() < 0.5
        tag("<html><head><title>")
        text(say(6), False)
        tag("</title></head><body>" + (f"<div class='{rng.choice(['wrap', 'page has-sidebar', 'site with-nav', name(5)])}'>" if wrap else ""))
        if rng.random() < 0.6:
            element = rng.choice(["header", "div"])
            tag(f"<{element}{attribute('header')}><div>")
            text(say(rng.randint(1, 5)), False)
            tag(f"</div></{element}>")
        for _ in range(rng.randint(1, 2)):
            element = rng.choice(["nav", "nav", "div", ""])
            tag(f"<{element}{attribute('nav')}>" if element else "")
            links(rng.randint(3, 9), rng.random() < 0.8, bool(element) and rng.random() < 0.8)
            tag(f"</{element}>" if element else "")
        for kind in rng.sample(("ad", "notice", "aside"), rng.randint(0, 2)):
            aside(kind)
        main = rng.random() < 0.3
        tag("<main>" if main else "")
        element = rng.choice(["article", "article", "article", "div"]) if not main or rng.random() < 0.5 else ""
        tag(f"<{element}{attribute('content')}>" if element else "")
        head = rng.random() < 0.2
        if rng.random() < 0.8:
            tag("<header><h1>" if head else "<h1>")
            text(say(rng.randint(3, 12)), True)
            tag("</h1></header>" if head else "</h1>")
        paragraphs(rng.randint(2, 7), True)
        for _ in range(rng.choice([0, 0, 1, 2])):
            aside(rng.choice(["ad", "aside", "notice"]), True)
            paragraphs(rng.randint(1, 4), True)
        if element and rng.random() < 0.15:
            aside("comment", True)
        tag(f"</{element}>" if element else "")
        tag("</main>" if main and rng.random() < 0.7 else "")
        if rng.random() < 0.3:
            tag("<aside>" if rng.random() < 0.5 else "<section>")
            for _ in range(rng.randint(1, 3)):
                tag("<article><h3>")
                text(say(4), False)
                tag("</h3><p>")
                text(say(rng.randint(5, 30), "."), False)
                tag("</p></article>")
            tag("</aside></section>")
        for kind in rng.sample(("comment", "aside", "form", "ad"), rng.randint(0, 3)):
            aside(kind)
        element = rng.choice(["footer", "footer", "div"])
        tag(f"<{element}{attribute('footer')}><p>")
        text(say(rng.randint(4, 14), "."), False)
        tag(f"</p></{element}>" + ("</div>" if wrap else "") + "</body></html>")
        out.append(("".join(m for m, _ in parts), [c for _, c in parts if c is not None]))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row per row of ``pages``.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by two line ends; text is empty where no run of
    tokens scores above zero, as for null or empty html. Repeated rows and null
    ids are treated like others. Of runs with equal sums the first is taken. An
    empty table gives no rows; other columns are not looked at.
    """
    pages = pick(pages, page_id=id_col, url=url_col, html=html_col)
    weights = weights or fit_weights(labelled_pages())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kind, url = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return pages.mapInArrow(run, f"page_id {kind}, url {url}, text string, n_chars long")
