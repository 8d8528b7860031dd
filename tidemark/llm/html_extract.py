"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed to its block elements. Each gets features of its subtree (text,
link, sign and tag density), its attribute tokens and those around it, its depth
and place, and its siblings. Boosted trees give each node the odds of being main
text. Decoding is hierarchical: a subtree is wholly in, wholly out, or divided among
its children, whichever its nodes' odds favour, so a node never contradicts what stands
above or below it.

No table holds labelled pages, so the trees are trained on pages that `sample_page`
writes: many layouts (with and without semantic tags and telling class names) whose main
text is known. `python -m tidemark.llm.html_extract` trains them from a fixed seed and stores
them in `html_trees.json`, which holds the seed and the number of pages too.

Defined cases: null, empty and wordless pages give an empty text; unclosed, stray and
wrongly nested tags are closed like browsers do for paragraphs, list items and cells;
text outside any element belongs to the page's body; repeated rows are alike; an empty
table gives no rows; other columns pass through (text and n_chars are replaced).
"""

from __future__ import annotations

import json
import math
import pkgutil
import random
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import boosting
from tidemark.llm.common import made, share

# Fixed values of HTML: elements without content, with raw content that is never text, with content that is never main text, inline ones, and those a sibling ends.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = set("noscript template svg select button object canvas audio video datalist".split())
MATH = set("math semantics mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom menclose mfenced mtable mtr mtd".split())
INLINE = MATH | set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small option optgroup span strike strong sub sup time tt u var img br wbr".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
#: Names whose open elements a scope's element hides from their siblings.
HIDES: dict[str, set[str]] = {}
for _name, _scopes in SCOPES.items():
    for _scope in _scopes:
        HIDES.setdefault(_scope, set()).add(_name)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
NAMED = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SIGNS = re.compile(r"[.,;:!?]")

#: Attribute tokens by meaning, matched at the start of a word.
TOKENS = {
    "body": "article content main post entry story text body prose",
    "menu": "nav menu breadcrumb toc pager pagination tabs skip",
    "head": "header masthead topbar logo brand",
    "foot": "footer foot colophon copyright legal",
    "side": "sidebar side aside widget rail related recommend teaser popular more",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner",
    "talk": "comment comments reply replies respond discussion disqus reader",
    "note": "cookie consent notice alert gdpr popup modal newsletter subscribe signup",
    "form": "form search login field",
    "share": "share social follow tags meta byline",
}
TAGS = ["article", "main", "section", "div", "p", "li", "ul", "ol", "table", "td", "h1", "h2", "h3", "nav", "aside", "header", "footer", "form", "blockquote", "pre", "figure", "figcaption", "dl", "body"]
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_MEANING = {w: i for i, k in enumerate(TOKENS) for w in TOKENS[k].split()}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ABOVE = ["nav", "aside", "header", "footer", "form", "article", "main"]
_ABOVE_AT = {t: i for i, t in enumerate(_ABOVE)}

#: Bits of the meanings, and of the tags above, that rather stand for other than main text.
_APART = sum(1 << i for i, k in enumerate(TOKENS) if k not in ("body", "head"))
_TAGS_APART = {"nav", "aside", "footer", "form"}
_UP_APART = sum(1 << _ABOVE_AT[t] for t in _TAGS_APART)
_UP_MAIN = 1 << _ABOVE_AT["article"] | 1 << _ABOVE_AT["main"]
N_FEATURES = 24 + len(TAGS) + 2 * len(TOKENS) + len(_ABOVE) + 4


@lru_cache(20_000)
def meanings(attributes: str) -> int:
    """Bits of the meanings that an element's attributes name."""
    bits = 0
    for m in NAMED.finditer(attributes):
        for word in _WORDS.findall(m[1] or m[2] or m[3] or ""):
            at = _MEANING.get(word.lower())
            if at is not None:
                bits |= 1 << at
    return bits


class Node:
    __slots__ = ("tag", "bits", "parent", "depth", "items", "index", "up_bits", "up_tags", "ends")

    def __init__(self, tag: str, bits: int, parent: "Node | None", index: int) -> None:
        self.tag, self.bits, self.parent, self.index = tag, bits, parent, index
        self.items: list = []  # texts (with whether they are in a link) and nodes, in order
        self.depth = parent.depth + 1 if parent else 0
        self.up_bits = parent.up_bits | parent.bits if parent else 0
        self.up_tags = parent.up_tags | (1 << _ABOVE_AT[parent.tag] if parent.tag in _ABOVE_AT else 0) if parent else 0
        # by name: the outermost open element that a start tag of this name ends
        self.ends: dict[str, Node] = parent.ends if parent else {}
        if tag in HIDES:
            self.ends = {k: v for k, v in self.ends.items() if k not in HIDES[tag]}
        if tag in ENDED_BY:
            self.ends = {k: self for k in ENDED_BY[tag] if k in SCOPES} | self.ends


def parse(html: str) -> list[Node]:
    """Block elements of a page, parents first; the first is the page. Linear in the page's length."""
    root = Node("body", 0, None, 0)
    nodes, at = [root], root
    inline: dict[str, int] = {}  # open inline elements of the node at hand
    opened: dict[str, int] = {}  # open block elements
    hidden: list[tuple[str, int]] = []  # open elements whose text is left out, and their node's depth
    places: dict[str, list[int]] = {}  # by name: where in hidden they are
    pos, last = 0, html.rfind(">") + 1

    def say(text: str) -> None:
        if text and not hidden:
            at.items.append((unescape(text) if "&" in text else text, inline.get("a", 0) > 0))

    def unhide(count: int) -> None:
        """Leaves the outermost `count` hidden elements open."""
        while len(hidden) > count:
            places[hidden.pop()[0]].pop()

    def close_to(node: Node) -> None:
        """Makes node the innermost open one."""
        nonlocal at
        inline.clear()
        while at is not node:
            opened[at.tag] -= 1
            at = at.parent
        while hidden and hidden[-1][1] > at.depth:
            unhide(len(hidden) - 1)

    while pos < last:
        m = TOKEN.search(html, pos, last)
        if not m:
            break
        if m.start() > pos:
            say(html[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                return nodes
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if name in INLINE:
                inline[name] = max(0, inline.get(name, 0) - 1)
            elif name in HIDDEN:
                if places.get(name):
                    unhide(places[name][-1])
            elif opened.get(name):
                up = at
                while up.tag != name:
                    up = up.parent
                close_to(up.parent)
            elif name == "p":
                at.items.append(None)
            continue
        if name in RAW:  # nothing but its end tag ends it
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, pos)
            if not end:
                return nodes
            pos = end.end()
            at.items.append((" ", False))
        elif name in HIDDEN:
            at.items.append((" ", False))
            if name != "svg" or not attributes.endswith("/"):
                places.setdefault(name, []).append(len(hidden))
                hidden.append((name, at.depth))
        elif name in VOID:
            at.items.append((" ", False) if name != "hr" else None)
        elif name in INLINE:
            inline[name] = inline.get(name, 0) + 1
        elif name in ("html", "body", "head"):
            root.bits |= meanings(attributes) if attributes and name == "body" else 0
        else:
            inline.clear()
            if at.tag == "p":  # a block ends an open paragraph
                close_to(at.parent)
            if name in at.ends:
                close_to(at.ends[name].parent)
            at = Node(name, meanings(attributes) if attributes else 0, at, len(nodes))
            opened[name] = opened.get(name, 0) + 1
            nodes.append(at)
            at.parent.items.append(at)
    say(html[pos:].partition("<!--")[0])
    return nodes


def features(nodes: list[Node]) -> list[list[float]]:
    """A row for each node."""
    n = len(nodes)
    chars, linked, signs, words, blocks, direct, start = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n, [0] * n, [0] * n
    upto = 0
    for i in range(n - 1, -1, -1):
        for item in nodes[i].items:
            if item.__class__ is tuple:
                text, link = item
                k = len(text) - text.count(" ")
                chars[i] += k
                direct[i] += k
                if link:
                    linked[i] += k
                signs[i] += len(SIGNS.findall(text))
                words[i] += text.count(" ") + 1
            elif item is not None:
                j = item.index
                chars[i] += chars[j]
                linked[i] += linked[j]
                signs[i] += signs[j]
                words[i] += words[j]
                blocks[i] += blocks[j]
    for i in range(1, n):  # text before each node: parents first, then siblings in order
        start[i] = start[nodes[i].parent.index]
    for i in range(n):
        upto = start[i]
        for item in nodes[i].items:
            if item.__class__ is tuple:
                upto += len(item[0]) - item[0].count(" ")
            elif item is not None:
                start[item.index] = upto
                upto += chars[item.index]
    total = chars[0] + 1
    rows = []
    place, count, same = [0] * n, [1] * n, [1] * n
    before, after = [-1] * n, [-1] * n
    longest = [0] * n
    for node in nodes:
        kids = [x for x in node.items if x is not None and x.__class__ is not tuple]
        tags: dict[str, int] = {}
        for x in kids:
            tags[x.tag] = tags.get(x.tag, 0) + 1
        most = max((chars[x.index] for x in kids), default=0)
        for k, x in enumerate(kids):
            place[x.index], count[x.index], same[x.index], longest[x.index] = k, len(kids), tags[x.tag], most
            if k:
                before[x.index] = kids[k - 1].index
                after[kids[k - 1].index] = x.index
    log = math.log1p
    n_tags, n_tokens = len(TAGS), len(TOKENS)
    for i, node in enumerate(nodes):
        c, up = chars[i], chars[node.parent.index] if node.parent else chars[i]
        b, a = before[i], after[i]
        row = [0.0] * N_FEATURES
        row[:24] = [
            log(c), log(direct[i]), linked[i] / (c + 1), signs[i] / (words[i] + 1), c / (words[i] + 1), c / blocks[i], log(blocks[i]), direct[i] / (c + 1),
            node.depth, place[i], count[i], same[i] / count[i], place[i] / count[i], c / (up + 1), c / total, c / (longest[i] + 1),
            start[i] / total, (start[i] + c) / total,
            log(chars[b]) if b >= 0 else -1, linked[b] / (chars[b] + 1) if b >= 0 else -1, log(chars[a]) if a >= 0 else -1, linked[a] / (chars[a] + 1) if a >= 0 else -1,
            signs[i] / (blocks[i]), linked[0] / total,
        ]
        t = _TAG_AT.get(node.tag)
        if t is not None:
            row[24 + t] = 1.0
        for k in range(n_tokens):
            if node.bits >> k & 1:
                row[24 + n_tags + k] = 1.0
            if node.up_bits >> k & 1:
                row[24 + n_tags + n_tokens + k] = 1.0
        for k in range(len(_ABOVE)):
            if node.up_tags >> k & 1:
                row[24 + n_tags + 2 * n_tokens + k] = 1.0
        row[-4:] = [
            float(node.tag in _TAGS_APART or bool(node.bits & _APART)), float(bool(node.up_bits & _APART or node.up_tags & _UP_APART)),
            float(node.tag in ("article", "main") or bool(node.bits & 1)), float(bool(node.up_bits & 1 or node.up_tags & _UP_MAIN)),
        ]
        rows.append(row)
    return rows


def decode(nodes: list[Node], odds: list[float], division: float = 0.3) -> list[bool]:
    """Whether each node's own text is in. division: what it costs to divide a subtree."""
    n = len(nodes)
    plus, minus, best, how = [0.0] * n, [0.0] * n, [0.0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        x = max(-6.0, min(6.0, odds[i]))
        yes = -math.log1p(math.exp(-x))
        no = yes - x
        kids = [k.index for k in nodes[i].items if k is not None and k.__class__ is not tuple]
        plus[i] = yes + sum(plus[k] for k in kids)
        minus[i] = no + sum(minus[k] for k in kids)
        own = any(k.__class__ is tuple and not k[0].isspace() for k in nodes[i].items)
        divided = sum(best[k] for k in kids) - division + (max(yes, no) if own else max(yes, no, -0.2)) if kids else -math.inf
        best[i] = max(plus[i], minus[i], divided)
        how[i] = 1 if best[i] == plus[i] else 0 if best[i] == minus[i] else 2
    kept = [False] * n
    for i in range(n):
        up = nodes[i].parent
        state = how[up.index] if up else 2
        if state != 2:
            how[i] = state
        kept[i] = how[i] == 1 or how[i] == 2 and odds[i] > 0
    return kept


def blocks_of(nodes: list[Node], kept: list[bool]) -> list[str]:
    """Texts of the kept nodes in page order, one for each block."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    stack = [(nodes[0], iter(nodes[0].items))]
    while stack:
        node, items = stack[-1]
        for item in items:
            if item.__class__ is tuple:
                if kept[node.index]:
                    run.append(item[0])
            elif item is None:
                close()
            else:
                close()
                stack.append((item, iter(item.items)))
                break
        else:
            close()
            stack.pop()
    return out


# Pages to learn from -------------------------------------------------------------------------

MARK = ""  # stands before each word of main text


def sample_page(rng: random.Random, half: int | None = None) -> str:
    """A page in a random layout; the words of its main text carry MARK. half: only use the first (0) or second (1) half of the names and frames."""

    def words(n: int) -> list[str]:
        return ["".join(rng.choice(("an", "er", "lo", "mi", "sta", "te", "ro", "que", "ü", "den", "ou", "ci")) for _ in range(rng.randint(1, 4))) for _ in range(n)]

    def sentence(low: int, high: int) -> str:
        return " ".join(words(rng.randint(low, high))).capitalize() + rng.choice(".......!?,")

    def prose(n: int) -> str:
        return " ".join(sentence(2, 14) for _ in range(n))

    def mark(text: str) -> str:
        return " ".join(MARK + w for w in text.split())

    def link(text: str) -> str:
        return f'<a href="/{rng.randint(0, 9999)}">{text}</a>'

    def named(tag: str, names: str, text: str) -> str:
        name = rng.choice(names.split() if half is None else names.split()[half::2])
        extra = rng.choice(("", "", f"-{rng.choice(('wrap', 'box', 'inner', '1'))}"))
        return f'<{tag} {rng.choice(("class", "id"))}="{name}{extra}">{text}</{tag}>'

    def links(n: int) -> str:
        shape = rng.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{link(' '.join(words(rng.randint(1, 3))))}" + ("</li>" if shape < 0.5 else "") for _ in range(n)) + "</ul>"
        return " ".join(link(" ".join(words(rng.randint(1, 3)))) for _ in range(n))

    def menu() -> str:
        return f"<nav>{links(rng.randint(2, 9))}</nav>" if rng.random() < 0.6 else named("div", "nav menu navbar breadcrumb toc", links(rng.randint(2, 9)))

    def head() -> str:
        inner = rng.choice((f"<h1>{prose(1)}</h1>", link(prose(1)), f"<p>{prose(1)}</p>", "")) + (menu() if rng.random() < 0.5 else "")
        return f"<header>{inner}</header>" if rng.random() < 0.6 else named("div", "header masthead topbar logo", inner)

    def foot() -> str:
        inner = f"&copy; {' '.join(words(2))} &middot; {prose(rng.randint(1, 3))}" + rng.choice(("", links(4)))
        inner = rng.choice((inner, f"<p>{inner}</p>"))
        return f"<footer>{inner}</footer>" if rng.random() < 0.7 else named("div", "footer foot colophon legal copyright", inner)

    def advert() -> str:
        inner = rng.choice((prose(rng.randint(1, 3)), f"<p>{prose(rng.randint(1, 3))}</p>", link(prose(1))))
        return named(rng.choice(("div", "div", "aside", "section")), "ad ads advert advertisement sponsored promo banner ad-slot", inner)

    def side() -> str:
        inner = "".join(rng.choice((f"<h3>{' '.join(words(2))}</h3>", f"<p>{prose(rng.randint(1, 4))}</p>", links(rng.randint(2, 6)), advert())) for _ in range(rng.randint(1, 4)))
        return f"<aside>{inner}</aside>" if rng.random() < 0.5 else named("div", "sidebar side widget rail related recommended popular", inner)

    def note() -> str:
        return named(rng.choice(("div", "section", "aside")), "cookie cookie-consent notice alert gdpr-banner newsletter subscribe popup", rng.choice((prose(rng.randint(1, 3)), f"<p>{prose(rng.randint(1, 3))}</p>")) + rng.choice(("", "<button>OK</button>")))

    def form() -> str:
        return f'<form action="/s"{rng.choice(("", " class=search"))}><label>{" ".join(words(2))}</label><input name="q"><p>{prose(1)}</p><button>Go</button></form>'

    def talk() -> str:
        one = rng.choice(("<div class=comment>{}</div>", "<li><p>{}</p></li>", "<p>{}</p>", "<article class='comment'><p>{}</p></article>"))
        inner = rng.choice(("", f"<h2>{' '.join(words(2))}</h2>")) + "".join(one.format(prose(rng.randint(1, 6))) for _ in range(rng.randint(1, 6)))
        return named(rng.choice(("section", "div", "div", "ol", "aside")), "comments comment-list replies respond discussion reader-comments", inner)

    def social() -> str:
        return named("div", "share social tags byline meta follow", rng.choice((links(4), " ".join(words(4)))))

    def body() -> str:
        parts = [f"<h1>{mark(prose(1)[: rng.randint(20, 90)])}</h1>"] if rng.random() < 0.85 else []
        if rng.random() < 0.2:
            parts = [f"<header>{''.join(parts)}{rng.choice(('', f'<p>{mark(prose(1))}</p>'))}</header>"]
        for _ in range(rng.choice((1, 1, 1, 2, 3, 4, 6, 8, 12, 20))):
            kind = rng.random()
            text = mark(prose(rng.choice((1, 1, 2, 3, 5, 8, 20))))
            if rng.random() < 0.2:
                text += f" {link(mark(' '.join(words(2))))} {mark(sentence(1, 6))}"
            if kind < 0.7:
                parts.append(rng.choice((f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>", f"<p><em>{text}</em></p>")))
            elif kind < 0.76:
                parts.append(f"<h2>{mark(' '.join(words(3)))}</h2>")
            elif kind < 0.83:
                parts.append("<ul>" + "".join(f"<li>{mark(sentence(2, 12))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.87:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.9:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{mark(' '.join(words(2)))}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                parts.append(f"<div>{text}</div>")
            elif kind < 0.97:
                parts.append(f"<pre>{text}</pre>")
            else:
                parts.append(rng.choice((advert, social, note, side))())
        if rng.random() < 0.12:
            parts.append(talk())
        return "".join(parts)

    text = body()
    shape = rng.random() if half is None else 0.8 * rng.random() ** 2 if half == 0 else 0.45 + 0.5 * rng.random()
    if shape < 0.45:
        text = f"<article>{text}</article>"
    elif shape < 0.6:
        text = f"<main>{text}</main>"
    elif shape < 0.8:
        text = named("div", "article content main post entry story text post-body", text)
    elif shape < 0.9:
        text = f"<div>{text}</div>"
    if rng.random() < 0.3:
        text = f"<main>{text}</main>" if rng.random() < 0.5 else f"<div>{text}{rng.choice(('', side()))}</div>"
    above = [f() for f in (head, menu, note, advert, form, side) if rng.random() < 0.4]
    below = [f() for f in (talk, side, advert, social, note, form) if rng.random() < 0.3]
    rng.shuffle(above)
    if rng.random() < 0.8:
        below.append(foot())
    return f"<!DOCTYPE html><html><head><title>{prose(1)}</title><style>p{{}}</style></head><body>{''.join(above)}{text}{''.join(below)}</body></html>"


PAGES, SEED = 1000, 20240611


def train(pages: int = PAGES, seed: int = SEED, trees: int = 60, depth: int = 4, half: int | None = None) -> boosting.Trees:
    rng = random.Random(seed)
    x, y, weight = [], [], []
    for _ in range(pages):
        nodes = parse(sample_page(rng, half))
        true, all_ = [0] * len(nodes), [0] * len(nodes)
        for i in range(len(nodes) - 1, -1, -1):
            for k, item in enumerate(nodes[i].items):
                if item.__class__ is tuple:
                    true[i] += item[0].count(MARK)
                    all_[i] += len(item[0].split())
                    nodes[i].items[k] = (item[0].replace(MARK, ""), item[1])
                elif item is not None:
                    true[i] += true[item.index]
                    all_[i] += all_[item.index]
        for row, a, b in zip(features(nodes), true, all_):
            if b:
                x.append(row)
                y.append(float(a / b > 0.5))
                weight.append(abs(2 * a / b - 1) + 0.05)
    return boosting.fit(np.array(x), np.array(y), np.array(weight), trees, depth)


STORED = "html_trees.json"


@lru_cache(1)
def stored() -> boosting.Trees:
    """The trees that come with the package."""
    raw = json.loads(pkgutil.get_data(__package__, STORED))
    return boosting.Trees(raw["depth"], np.array(raw["features"]), np.array([[np.inf if x is None else x for x in row] for row in raw["limits"]]), np.array(raw["leaves"]), raw["base"])


def store(path: str, trees: boosting.Trees, pages: int = PAGES, seed: int = SEED) -> None:
    limits = [[None if np.isinf(x) else x for x in row] for row in trees.limits.tolist()]
    with open(path, "w") as f:
        json.dump({"pages": pages, "seed": seed, "depth": trees.depth, "base": trees.base, "features": trees.features.tolist(), "limits": limits, "leaves": trees.leaves.tolist()}, f)
        f.write("\n")


def main_texts(pages: list[str | None], trees: boosting.Trees) -> list[str]:
    """Main text of each page."""
    parsed = [parse(p) if p else [] for p in pages]
    rows = [r for nodes in parsed if nodes for r in features(nodes)]
    odds = trees.log_odds(np.array(rows)).tolist() if rows else []
    out, at = [], 0
    for nodes in parsed:
        out.append("\n\n".join(blocks_of(nodes, decode(nodes, odds[at : at + len(nodes)]))) if nodes else "")
        at += len(nodes)
    return out


def extract(pages: DataFrame, html: str = "html", trees: boosting.Trees | None = None) -> DataFrame:
    """pages with text (its main text) and n_chars. trees: others than the stored ones."""
    shared = share(pages.sparkSession, trees or stored())

    @F.arrow_udf("string")
    def of(column: pa.Array) -> pa.Array:
        model, found = made(shared, lambda t: t), []
        for at in range(0, len(column), 200):
            found += main_texts(column.slice(at, 200).to_pylist(), model)
        return pa.array(found, pa.string())

    return pages.withColumn("text", of(F.col(html))).withColumn("n_chars", F.char_length("text").cast("long"))


if __name__ == "__main__":
    from pathlib import Path

    store(str(Path(__file__).with_name(STORED)), train())
