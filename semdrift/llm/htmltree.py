"""Main text of web pages by a tree-structured graphical model.

Every block element of a page, and every run of text between block boundaries,
is a variable: content or not. Each has a potential from what it is (tag, words
of its class and id, length, links, place), and each pair of parent and child
one that depends on the child's tag. Messages are summed upward from the leaves
and then downward from the root, which gives the exact marginal of every
variable; runs of text whose marginal is one half or more are the main text.

The weights are learned by gradient ascent on the likelihood of labelled pages.
The given tables have no labels for pages, so they are made from the pages
themselves: a bounded sample of them, whose ``article`` elements say what the
content is, and the same texts set anew into page layouts with other names for
menus, notices, sidebars, adverts, forms and comments, where the place of each
text is known.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semdrift.llm.buffers import mixed
from semdrift.llm.common import MODEL, Adam, batch, pack_arrays, sigmoid, unpack_arrays
from semdrift.session import ship_package

#: Pages that the weights are fitted on, at most; each also gives ``LAYOUTS`` pages in other layouts.
TRAIN_PAGES, LAYOUTS = 150, 4
#: A sample page longer than this in characters is not drawn.
TRAIN_CHARS = 20_000
NAME_ROWS = 2048
ROUNDS, RATE, DECAY = 150, 0.08, 2e-3
#: Pages whose trees are worked off at once.
PAGES = 256

# Elements by their part in a page.
TAGS = (
    "html head body title article main section div header footer nav aside form table tr td th ul ol li dl dt dd p h1 h2 h3 "
    "h4 h5 h6 blockquote pre figure figcaption address details summary fieldset hr dialog menu center caption"
).split()
SILENT = "script style noscript template svg iframe object textarea select option button canvas".split()
#: Silent elements whose content is text by the rules of HTML: tags in them end nothing.
RAW = {"script", "style", "textarea", "iframe"}
VOID = "area base br col embed hr img input link meta param source track wbr".split()
CLOSES_P = set(TAGS) - {"html", "head", "body", "title", "caption", "td", "th", "tr"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "p": {"p"}}

TAG_NO = {t: i for i, t in enumerate(TAGS)}
LEAF, OTHER = len(TAGS), len(TAGS) + 1
KINDS = len(TAGS) + 2
NUMBERS = 14
WIDTH = KINDS + KINDS + NUMBERS  # own kind, parent's kind, numbers

_NAME = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Tree:
    """The variables of one page, parents before children."""

    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)  # characters inside links

    def add(self, parent: int, kind: int, names: tuple[str, ...] = (), text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


#: Blocks nested deeper than this hang on the block at this depth.
MOST_DEEP = 512

_TAG = re.compile(r"[a-zA-Z][^\t\n\r\f />\x00]*+")
_GAP = re.compile(r"[\s/]*+")
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:'([^']*+)'|"([^"]*+)"|(?!['"])([^>\s]*+))?+)?+""")
_COMMENT_END = re.compile(r"--!?\s*+>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}


class Builder:
    """Builds the tree; inline elements belong to the run of text around them.

    A page is read once from left to right, however malformed it is. A comment or
    a tag that never ends takes the rest of the page with it, as HTML has it; a declaration that never ends is text.
    """

    def __init__(self) -> None:
        self.tree = Tree()
        self.open: list[tuple[str, int]] = [("", self.tree.add(-1, OTHER))]
        self.count: Counter = Counter()  # open blocks by name
        self.parts: list[str] = []
        self.links = self.linked = 0
        self.mute: list[str] = []
        self.inside: list[str] = []  # blocks opened in the silence
        self.inside_count: Counter = Counter()

    # -------------------------------------------------- from signs to tags

    def feed(self, html: str) -> None:
        absent: set[str] = set()  # ends that the rest of the page does not have
        at = look = 0  # text from ``at`` on is not handed out yet; the next tag is looked for from ``look`` on
        end = len(html)
        while at < end:
            low = html.find("<", look)
            if low < 0:
                break
            sign = html[low + 1:low + 2]
            if not (sign.isascii() and sign.isalpha()) and sign not in ("/", "!", "?"):
                look = low + 1
                continue
            self._text(html[at:low])
            if sign.isalpha():
                at = self._start(html, low + 1)
            elif sign == "/":
                at = self._end(html, low + 2)
            elif html.startswith("<!--", low):
                close = low + 4 if html.startswith((">", "->"), low + 4) else None
                found = _COMMENT_END.search(html, low + 4) if close is None else None
                at = html.find(">", close) + 1 if close else found.end() if found else end
            else:
                mark = "]]>" if html[low:low + 9].lower() == "<![cdata[" else ">"
                close = -1 if mark in absent else html.find(mark, low)
                if close < 0:  # no declaration after all: its signs are text
                    absent.add(mark)
                    at, look = low, low + 1
                    continue
                at = close + len(mark)
            look = at
        self._text(html[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and not self.mute:
            data = unescape(raw)
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def _start(self, html: str, at: int) -> int:
        """Read a start tag whose name begins at ``at``; gives the place after it."""
        found = _TAG.match(html, at)
        tag, at = found.group().lower(), found.end()
        attrs: list[tuple[str, str | None]] = []
        while True:
            at = _GAP.match(html, at).end()
            if at >= len(html):
                return at
            if html[at] == ">":
                break
            found = _ATTRIBUTE.match(html, at)
            value = next((v for v in found.groups()[1:] if v is not None), None)
            attrs.append((found.group(1).lower(), None if value is None else unescape(value)))
            at = found.end()
        if html[at - 1] == "/":
            if tag not in SILENT:
                self.handle_starttag(tag, attrs)
            return at + 1
        self.handle_starttag(tag, attrs)
        if tag in _RAW_END:
            close = _RAW_END[tag].search(html, at + 1)
            return close.start() if close else len(html)
        return at + 1

    def _end(self, html: str, at: int) -> int:
        found = _TAG.match(html, at)
        close = html.find(">", at)
        if close < 0:
            return len(html)
        if found:
            self.handle_endtag(found.group().lower())
        return close + 1

    # -------------------------------------------------- from tags to blocks

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.tree.add(self._block(), LEAF, (), text, min(self.linked, len(text)))
            self.parts, self.linked = [], 0

    def _block(self) -> int:
        return self.open[min(len(self.open) - 1, MOST_DEEP)][1]

    def _cut(self, depth: int) -> None:
        for name, _ in self.open[depth:]:
            self.count[name] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.mute:
            if tag == self.mute[-1]:
                self.mute.append(tag)
            elif tag in TAG_NO and tag not in VOID:
                self.inside.append(tag)
                self.inside_count[tag] += 1
            return
        if tag in SILENT:
            if tag != "option":
                self.mute.append(tag)
            self.parts.append(" ")
        elif tag == "a":
            self.links += 1
        elif tag in TAG_NO:
            self._flush()
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i][0]
                if name in SAME_CLOSES.get(tag, ()) or (name == "p" and tag in CLOSES_P):
                    self._cut(i)
                elif name != "p":
                    break
            names: list[str] = []
            for key, value in attrs:
                if key in ("class", "id", "role", "itemprop", "aria-label") and value:
                    names += _NAME.findall(_HUMP.sub(" ", value).lower())
                elif key == "hidden" or (key == "style" and value and "none" in value):
                    names.append("hidden")
            node = self.tree.add(self._block(), TAG_NO[tag], tuple(dict.fromkeys(names)))
            if tag not in VOID:
                self.open.append((tag, node))
                self.count[tag] += 1
            self.links = 0
        elif tag in ("br", "img", "input"):
            self.parts.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if self.mute:
            if tag == self.mute[-1]:
                self.mute.pop()
                if not self.mute:
                    self._forget()
                return
            if self.mute[-1] in RAW or tag not in TAG_NO:
                return
            if self.inside_count[tag]:
                while (name := self.inside.pop()) != tag:
                    self.inside_count[name] -= 1
                self.inside_count[tag] -= 1
                return
            if not self.count[tag]:
                return
            # the end of a block around an element that was never closed
            self.mute.clear()
            self._forget()
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag in TAG_NO and self.count[tag]:
            i = len(self.open) - 1
            while self.open[i][0] != tag:
                i -= 1
            self._flush()
            self._cut(i)
            self.links = 0

    def _forget(self) -> None:
        self.inside.clear()
        self.inside_count.clear()


def tree_of(html: str) -> Tree:
    builder = Builder()
    builder.feed(html)
    return builder.tree


# ------------------------------------------------------------------ trees as arrays


@dataclass
class Forest:
    """The trees of several pages in a row."""

    parent: np.ndarray
    kind: np.ndarray
    dense: np.ndarray
    name_of: np.ndarray  # variable of each name
    name_row: np.ndarray
    levels: list[np.ndarray]  # variables by depth
    bounds: np.ndarray


def _row(name: str) -> int:
    raw = int.from_bytes(name.encode()[:16], "little")
    return int(mixed(np.array([(raw ^ (raw >> 64)) & (2**64 - 1)], np.uint64))[0] % np.uint64(NAME_ROWS))


_ROWS: dict[str, int] = {}


def forest(trees: list[Tree]) -> Forest:
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    shift = np.repeat(bounds[:-1], sizes)
    parent = np.array([p for t in trees for p in t.parent], np.int64)
    parent = np.where(parent < 0, -1, parent + shift)
    kind = np.array([k for t in trees for k in t.kind], np.int64)
    texts = [x for t in trees for x in t.text]
    n = len(parent)
    depth = np.zeros(n, np.int64)
    frontier, d, levels = np.flatnonzero(parent < 0), 0, []
    order = np.argsort(parent, kind="stable")
    sorted_parent = parent[order]
    while len(frontier):
        depth[frontier] = d
        levels.append(frontier)
        low, high = np.searchsorted(sorted_parent, frontier), np.searchsorted(sorted_parent, frontier, side="right")
        count = high - low
        frontier = order[np.repeat(low - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
        d += 1
    chars = np.array([len(x) for x in texts], np.float64)
    leaf = kind == LEAF
    stops = np.array([sum(map(x.count, ".!?,")) for x in texts], np.float64)
    words = np.array([x.count(" ") + 1 if x else 0 for x in texts], np.float64)
    linked = np.array([k for t in trees for k in t.linked], np.float64)
    sums = np.stack([chars, stops, words, linked, leaf.astype(np.float64)], axis=1)
    for level in reversed(levels[1:]):
        np.add.at(sums, parent[level], sums[level])
    at = np.arange(n) - shift
    page = sums[shift]
    share = at / np.maximum(1, np.repeat(sizes, sizes))
    before = np.cumsum(chars) - chars
    seen = (before - before[shift]) / np.maximum(1, page[:, 0])
    up = np.where(parent < 0, 0, parent)
    dense = np.zeros((n, WIDTH), np.float32)
    dense[np.arange(n), kind] = 1
    dense[np.arange(n), KINDS + kind[up]] = 1
    total, stop, word, link, leaves = sums.T
    dense[:, 2 * KINDS:] = np.stack([
        np.ones(n), np.log1p(word) / 4, np.log1p(total) / 6, link / np.maximum(1, total), stop / np.maximum(1, word),
        np.log1p(leaves) / 3, depth / 10, share, share * share, total / np.maximum(1, page[:, 0]),
        seen, word / np.maximum(1, leaves) / 40, (leaf & (word <= 3)).astype(float), (leaf & (stop > 1)).astype(float),
    ], axis=1)
    owner, rows = [], []
    i = 0
    for t in trees:
        for names in t.names:
            for name in names:
                if name not in _ROWS:
                    if len(_ROWS) > 100_000:
                        _ROWS.clear()
                    _ROWS[name] = _row(name)
                owner.append(i)
                rows.append(_ROWS[name])
            i += 1
    return Forest(parent, kind, dense, np.array(owner, np.int64), np.array(rows, np.int64), levels, bounds)


# ------------------------------------------------------------------ sum-product


def _local(m: dict[str, np.ndarray], f: Forest) -> np.ndarray:
    """How much each variable by itself leans towards content."""
    out = (f.dense @ m["w"]).astype(np.float64)
    np.add.at(out, f.name_of, m["names"][f.name_row])
    return out


def marginals(m: dict[str, np.ndarray], f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """(probability of content, joint probabilities (parent, own) with the parent) of every variable; exact."""
    n = len(f.parent)
    belief = np.zeros((n, 2))
    belief[:, 1] = _local(m, f)
    pair = m["pair"][f.kind].astype(np.float64)  # (variable, parent's value, own value)
    up = np.zeros((n, 2))
    for level in reversed(f.levels[1:]):
        up[level] = np.logaddexp.reduce(pair[level] + belief[level][:, None, :], axis=2)
        np.add.at(belief, f.parent[level], up[level])
    inward = belief.copy()  # what a variable and all below it say
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        above = belief[f.parent[level]] - up[level]
        both = pair[level] + above[:, :, None] + inward[level][:, None, :]
        belief[level] = inward[level] + np.logaddexp.reduce(pair[level] + above[:, :, None], axis=1)
        both -= np.logaddexp.reduce(both.reshape(-1, 4), axis=1)[:, None, None]
        joint[level] = np.exp(both)
    return sigmoid(belief[:, 1] - belief[:, 0]), joint


def learn(f: Forest, truth: np.ndarray) -> dict[str, np.ndarray]:
    """Weights of the greatest likelihood, with a little decay."""
    m = {
        "w": np.zeros(WIDTH, np.float32), "names": np.zeros(NAME_ROWS, np.float32), "pair": np.zeros((KINDS, 2, 2), np.float32),
    }
    adam = Adam(m, RATE)
    child = f.parent >= 0
    seen = np.zeros((len(truth), 2, 2))
    seen[child, truth[f.parent[child]], truth[child]] = 1
    pages = max(1, len(f.bounds) - 1)
    for _ in range(ROUNDS):
        p, joint = marginals(m, f)
        miss = p - truth
        pair = np.zeros((KINDS, 2, 2))
        np.add.at(pair, f.kind[child], (joint - seen)[child])
        adam.move({
            "w": (f.dense.T @ miss) / pages + DECAY * m["w"],
            "names": np.bincount(f.name_row, weights=miss[f.name_of], minlength=NAME_ROWS) / pages + DECAY * m["names"],
            "pair": pair / pages + DECAY * m["pair"],
        })
    return m


# ------------------------------------------------------------------ labelled pages

# Names that pages give to their parts.
NAMES = {
    "content": "article content post entry story main body text single page blog news detail copy prose".split(),
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs topnav tabs toc links pagination pager".split(),
    "header": "header masthead banner top branding logo site hero topbar".split(),
    "footer": "footer bottom copyright colophon legal foot credits sitemap".split(),
    "side": "sidebar side aside widget related recommended popular trending archive tags rail".split(),
    "advert": "ad ads advert advertisement promo sponsor sponsored adsense promotion commercial".split(),
    "notice": "notice cookie consent alert gdpr popup modal overlay message privacy disclaimer".split(),
    "form": "form search subscribe newsletter signup login contact register".split(),
    "comments": "comment comments reply replies discussion disqus responses reader feedback thread".split(),
    "share": "share social sharing follow meta byline author toolbar buttons".split(),
}
ROLE_TAGS = {
    "menu": ["nav", "div", "ul", "menu", "section"], "header": ["header", "div", "section"], "footer": ["footer", "div", "section"],
    "side": ["aside", "div", "section", "ul"], "advert": ["div", "aside", "section", "ins"],
    "notice": ["div", "section", "dialog", "aside"], "form": ["form", "div"], "comments": ["section", "div", "ol", "ul", "aside"],
    "share": ["div", "ul", "p"],
}


class Layout:
    """Writes one page of known labels: content runs and others, in page order."""

    def __init__(self, rng: random.Random, content: list[str], other: list[str]) -> None:
        self.rng, self.content, self.other = rng, content, other
        self.html: list[str] = []

    def some(self, low: int, high: int) -> str:
        words = self.rng.choice(self.other).split()
        at = self.rng.randrange(max(1, len(words)))
        return escape(" ".join(words[at:at + self.rng.randint(low, high)])) or "x"

    def attr(self, role: str, chance: float = 0.85) -> str:
        if self.rng.random() > chance:
            return ""
        name = self.rng.choice(NAMES[role])
        if self.rng.random() < 0.4:
            name += self.rng.choice(["-", "_", " "]) + self.rng.choice(["box", "wrap", "area", "block", "list", "inner", "1", *NAMES[role]])
        return f' {self.rng.choice(["class", "class", "id"])}="{name}"'

    def part(self, role: str) -> None:
        """A part that is not content."""
        tag = self.rng.choice(ROLE_TAGS[role])
        sure = tag in ("nav", "header", "footer", "aside", "form", "dialog", "menu")
        self.html.append(f"<{tag}{self.attr(role, 0.5 if sure else 1.0)}>")
        if role in ("menu", "share") or (role == "side" and self.rng.random() < 0.6):
            items = [f'<li><a href="/x">{self.some(1, 4)}</a></li>' for _ in range(self.rng.randint(2, 8))]
            self.html.append("".join(items) if tag in ("ul", "menu") else "<ul>" + "".join(items) + "</ul>")
        elif role == "comments":
            self.html.append(f"<h3>{self.some(1, 3)}</h3>")
            for _ in range(self.rng.randint(1, 6)):
                inner = self.rng.choice(["div", "li", "article", "p"])
                body = f"<p>{self.some(5, 80)}</p>" if inner != "p" else self.some(5, 80)
                self.html.append(f"<{inner}{self.attr('comments')}>{body}</{inner}>")
        elif role == "form":
            self.html.append(f'<label>{self.some(1, 4)}</label><input type="text"><button>{self.some(1, 2)}</button>')
        else:
            for _ in range(self.rng.randint(1, 3)):
                inner = self.rng.choice(["p", "div", "h3", ""])
                text = self.some(2, 30)
                if self.rng.random() < 0.3:
                    text = f'<a href="/y">{text}</a>'
                self.html.append(f"<{inner}>{text}</{inner}>" if inner else text)
        self.html.append(f"</{tag}>")

    def body(self) -> None:
        """The content, its runs marked by a sign that no page has, with a few parts in between."""
        tag = self.rng.choice(["article", "article", "main", "div", "div", "section", "td"])
        self.html.append(f"<{tag}{self.attr('content', 0.6 if tag in ('article', 'main') else 1.0)}>")
        for i, text in enumerate(self.content):
            marked = "\x01" + escape(text)
            if i == 0 and self.rng.random() < 0.8:
                self.html.append(f"<h1>{marked}</h1>")
                if self.rng.random() < 0.3:
                    self.part("share")
                continue
            kind = self.rng.random()
            if kind < 0.82:
                self.html.append(f"<p>{marked}</p>")
            elif kind < 0.88:
                self.html.append(f"<ul><li>{marked}</li></ul>")
            elif kind < 0.92:
                self.html.append(f"<blockquote><p>{marked}</p></blockquote>")
            elif kind < 0.95:
                self.html.append(f"<h2>{marked}</h2>")
            else:
                self.html.append(f"<div>{marked}</div>")
            if self.rng.random() < 0.06:
                self.part(self.rng.choice(["advert", "form", "side", "notice"]))
        if self.rng.random() < 0.2:
            self.part("share")
        self.html.append(f"</{tag}>")

    def page(self) -> str:
        rng = self.rng
        self.html.append(f"<html><head><title>{self.some(2, 8)}</title></head><body>")
        wrap = rng.random() < 0.5
        if wrap:
            self.html.append(f'<div{rng.choice(["", " class=wrapper", " id=page", " class=container"])}>')
        for role, chance in (("notice", 0.3), ("header", 0.6), ("menu", 0.8), ("advert", 0.5), ("form", 0.2), ("side", 0.25)):
            if rng.random() < chance:
                self.part(role)
        self.body()
        for role, chance in (("share", 0.2), ("side", 0.35), ("comments", 0.45), ("advert", 0.2), ("form", 0.25), ("notice", 0.1), ("footer", 0.8)):
            if rng.random() < chance:
                self.part(role)
        self.html.append("</div></body></html>" if wrap else "</body></html>")
        return "".join(self.html)


def _content_by_article(t: Tree) -> np.ndarray:
    """Runs of text inside ``article`` elements, for pages that have one."""
    inside, article = np.zeros(len(t.parent), bool), TAG_NO["article"]
    for i, (p, k) in enumerate(zip(t.parent, t.kind)):
        inside[i] = k == article or (p >= 0 and inside[p])
    return inside & (np.array(t.kind) == LEAF)


def _truth(t: Tree, content: np.ndarray) -> np.ndarray:
    """A block is content if a run of text below it is."""
    out = content.copy()
    for i in range(len(t.parent) - 1, 0, -1):
        if out[i]:
            out[t.parent[i]] = True
    return out


def labelled(pages: list[str], seed: int = 5) -> tuple[list[Tree], list[np.ndarray]]:
    """Trees and truths: pages with an ``article``, and their texts in other layouts."""
    rng = random.Random(seed)
    trees, truths, contents, others = [], [], [], []
    for html in pages:
        t = tree_of(html)
        content = _content_by_article(t)
        if not content.any():
            continue
        trees.append(t)
        truths.append(_truth(t, content))
        contents.append([t.text[i] for i in np.flatnonzero(content)])
        others += [t.text[i] for i in np.flatnonzero(content)[:3]]
    for content in contents:
        for _ in range(LAYOUTS):
            t = tree_of(Layout(rng, content[: rng.randint(1, 12)], others).page())
            marked = np.array([x.startswith("\x01") for x in t.text])
            t.text = [x.lstrip("\x01") for x in t.text]
            trees.append(t)
            truths.append(_truth(t, marked))
    return trees, truths


def train(pages: list[str]) -> bytes:
    """The weights as bytes; without any labelled page all weights are zero and every run of text is content."""
    trees, truths = labelled(pages)
    if not trees:
        return pack_arrays({"w": np.zeros(WIDTH, np.float32), "names": np.zeros(NAME_ROWS, np.float32), "pair": np.zeros((KINDS, 2, 2), np.float32)})
    return pack_arrays(learn(forest(trees), np.concatenate(truths).astype(np.int64)))


def main_texts(m: dict[str, np.ndarray], pages: list[str]) -> list[str]:
    """The main text of each page: its runs of content, joined by two line feeds."""
    out = []
    for at in range(0, len(pages), PAGES):
        trees = [tree_of(p) for p in pages[at:at + PAGES]]
        f = forest(trees)
        keep = (marginals(m, f)[0] >= 0.5) & (f.kind == LEAF)
        for t, low, high in zip(trees, f.bounds.tolist(), f.bounds[1:].tolist()):
            out.append("\n\n".join([t.text[i] for i in np.flatnonzero(keep[low:high]).tolist()]))
    return out


# ------------------------------------------------------------------ Spark stages

_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def fit(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> bytes:
    """Weights learned in one task from at most ``TRAIN_PAGES`` pages, those with the smallest id hashes."""
    ship_package(pages.sparkSession)
    drawn = pages.filter(F.length(html).between(1, TRAIN_CHARS)).select(F.col(page_id).alias("page_id")).distinct()
    drawn = drawn.orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES)
    sample = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).filter(F.length("html") <= TRAIN_CHARS)
    sample = sample.join(F.broadcast(drawn), "page_id").select(F.col("page_id").cast("string"), "html")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i or "", h) for b in batches for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield batch(MODEL, model=[train([h for _, h in rows])])

    found = sample.repartition(1).mapInArrow(once, "model binary").collect()
    return bytes(found[0]["model"]) if found else train([])


def extract(pages: DataFrame, model: bytes, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of ``pages``.

    ``text`` is the whole main text: character references decoded, white
    space inside a run of text turned into one space, runs joined in page
    order by two line feeds; empty where a page has none, and for a null or
    empty page. ``n_chars`` counts code points. Repeated rows are extracted
    alike; other columns are not read.
    """
    ship_package(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unpack_arrays(shipped.value)
        for b in batches:
            for at in range(0, b.num_rows, PAGES):
                part = b.slice(at, PAGES)
                found = main_texts(m, [h or "" for h in part.column(2).to_pylist()])
                yield batch(
                    _TEXTS, page_id=part.column(0).cast(pa.int64()), url=part.column(1).cast(pa.string()),
                    text=found, n_chars=[len(x) for x in found],
                )

    rows = pages.select(F.col(page_id).cast("long"), F.col(url).cast("string"), F.col(html).cast("string"))
    return rows.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
