"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags, with their chain of open
ancestors). Features of a block are its ancestors' tags and the words in their class, id and role,
and the shape of its text; transitions are learned apart for neighbours within one container and
across containers. The weights are trained on labelled pages, written by ``labelled_page`` in many
layouts, by batch gradient on the log-likelihood; the best labelling is found by Viterbi.

Inside a block character references are decoded and any white space becomes one space; blocks
labelled as text are joined by newlines in page order.

A page is read in time in proportion to its length, however its markup is broken, and its elements
share what they inherit, so deep nesting takes no more memory than its elements.

Defined cases: null and empty pages, and pages without text, give the empty text; a comment or a
script that is never closed ends with the page, a tag that is never closed is text; of labellings
with equal scores the one that leaves a block out is taken; very long pages are read whole; repeated
rows each give a row; further columns are carried in ``row``, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_left
from collections.abc import Container, Iterable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may begin markup: comments, elements whose content is not text, tags, declarations.
OPENING = re.compile(
    r"<(?:(?P<note>!--)|(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select)(?![a-z0-9:._-])|(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)|[!?/])",
    re.I,
)
ATTRS = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>")
RAW_END = {t: re.compile(rf"</{t}\s*+>", re.I) for t in "script style noscript template textarea title iframe svg select".split()}
#: Of these the ones that hold elements: unclosed, they hide nothing but their tag; svg may also end in its tag.
HOLDERS = frozenset(["noscript", "template", "svg", "select"])
#: Numeric references so long name no character.
LONG_REFERENCE = re.compile(r"&#[0-9]{8,}")
ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag closes these open tags, up to the first of the second set.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
}
PHRASES = re.compile(
    r"cookie|subscri|sign up|newsletter|advert|sponsor|share|©|copyright|all rights|privacy|terms|comment|repl(?:y|ies)|log ?in|related|read more|follow us|search|e-?mail|password|menu",
    re.I,
)


class Node:
    """An open element. ``feats``: features of it and its ancestors; ``key``: equal for equal chains of elements."""

    __slots__ = ("feats", "inside", "key", "parent", "tag")

    def __init__(self, tag: str, parent: Node | None, key: int, feats: frozenset[str]):
        self.tag, self.parent, self.key, self.feats = tag, parent, key, feats
        self.inside = tag in ("article", "main") or parent is not None and parent.inside


class Block:
    """A leaf block: its text, the innermost open element (None: none) and how many characters are linked."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked

    @property
    def container(self) -> int:
        """Equal for blocks whose elements have equal chains above them; -2 without an element."""
        return -2 if self.node is None else -1 if self.node.parent is None else self.node.parent.key


def _names(attrs: str) -> tuple[str, ...]:
    return tuple(sorted({p.lower() for m in ATTR.finditer(attrs) for p in PART.findall(m[1] or m[2] or m[3] or "")}))


def _ends(page: str) -> dict[int, int]:
    """For each ``>`` and quote of a page: where a tag ends that stands outside quotes there (-1: nowhere).

    A tag that is scanned to the page's end in vain would make many such tags quadratic.
    """
    marks = [m.start() for m in re.finditer("[>\"']", page)]
    out: dict[int, int] = {}
    # the next mark of each kind to the right, and of any kind
    after: dict[str, int] = {}
    following: dict[int, int] = {}
    for k in range(len(marks) - 1, -1, -1):
        at = marks[k]
        c = page[at]
        following[at] = marks[k + 1] if k + 1 < len(marks) else -1
        if c == ">":
            out[at] = at + 1
        else:
            close = after.get(c, -1)
            beyond = following[close] if close >= 0 else -1
            out[at] = out[beyond] if beyond >= 0 else -1
        after[c] = at
    return out


class _Tags:
    """Ends of tags. Linear over a page: what a scan in vain has read is not scanned again."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.ends: dict[int, int] | None = None
        self.marks: list[int] = []

    def end(self, at: int) -> int:
        """Position behind the tag whose attributes begin at ``at``; -1 if it never ends."""
        if at > self.last:
            return -1
        if self.ends is None:
            m = ATTRS.match(self.page, at)
            if m:
                return m.end()
            self.ends = _ends(self.page)
            self.marks = sorted(self.ends)
        k = bisect_left(self.marks, at)
        return self.ends[self.marks[k]] if k < len(self.marks) else -1


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    try:
        return entities.unescape(text)
    except ValueError:
        return entities.unescape(LONG_REFERENCE.sub("&#9999999", text))


def blocks(page: str | None, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks of a page. ``known``: the ancestor features that matter (None: all)."""
    page = page or ""
    out: list[Block] = []
    stack: list[Node] = []
    depths: dict[str, list[int]] = {}  # where in the stack each tag is open
    chains: dict[tuple, int] = {}
    held: list[str] = []
    linked, in_link, at = 0, 0, 0
    none: frozenset[str] = frozenset()

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(_decoded("".join(held)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, linked))
            held.clear()
        linked = 0

    def cut(k: int) -> None:
        while len(stack) > k:
            depths[stack.pop().tag].pop()

    def deepest(tags: Iterable[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    def push(tag: str, names: tuple[str, ...]) -> None:
        parent = stack[-1] if stack else None
        key = chains.setdefault((parent.key if parent else -1, tag, names), len(chains))
        feats = parent.feats if parent else none
        own = ["tag:" + tag, *("name:" + x for x in names)]
        own = [f for f in own if f not in feats and (known is None or f in known)]
        depths.setdefault(tag, []).append(len(stack))
        # without a feature of its own it shares its parent's set
        stack.append(Node(tag, parent, key, feats.union(own) if own else feats))

    tags = _Tags(page)
    lost: set[str] = set()
    search = OPENING.search
    m = search(page)
    while m:
        begin, tag = m.start(), m["tag"]
        if m["note"]:
            end = page.find("-->", m.end())
            end = len(page) if end < 0 else end + 3
        elif m["raw"]:
            kind = m["raw"].lower()
            own = tags.end(m.end())
            empty = kind == "svg" and own > 1 and page[own - 2] == "/"
            close = None if empty or kind in lost else RAW_END[kind].search(page, m.end())
            if not empty and close is None:
                lost.add(kind)  # nor does a later one end
            end = close.end() if close else own if empty or kind in HOLDERS else len(page)
        elif tag:
            end = tags.end(m.end())
        else:
            end = page.find(">", m.end()) + 1 if m.end() <= tags.last else -1
        if end < 0:  # no markup
            m = search(page, begin + 1)
            continue
        if begin > at:
            piece = page[at:begin]
            held.append(piece)
            linked += len(piece) * bool(in_link)
        at = end
        if not m["raw"] and tag:
            tag = tag.lower()
            if tag in INLINE:
                if tag == "a":
                    in_link = 0 if m["end"] else 1
                elif tag == "br":
                    held.append("\n")
            else:
                flush()
                in_link = 0
                if m["end"]:
                    if depths.get(tag):
                        cut(depths[tag][-1])
                else:
                    if stack and stack[-1].tag == "p":
                        cut(len(stack) - 1)
                    if tag in CLOSES:
                        these, until = CLOSES[tag]
                        k = deepest(these)
                        if k >= 0 and k > deepest(until):
                            cut(k)
                    attrs = page[m.end() : end - 1]
                    if tag not in VOID and not attrs.endswith("/"):
                        push(tag, _names(attrs) if attrs else ())
        m = search(page, at)
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


def features(b: Block, k: int, n: int) -> list[str]:
    text = b.text
    words = text.count(" ") + 1
    out = ["bias", f"words{min(words.bit_length(), 7)}", f"place{0 if k == 0 else 2 if k == n - 1 else 1}"]
    out.append("own:" + (b.node.tag if b.node else ""))
    if b.node:
        out += b.node.feats
    share = b.linked / max(1, len(text))
    out.append(f"link{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3}")
    out.append("stop" if text[-1] in ".!?…:;\"”»" else "nostop")
    if words >= 12 and share == 0:
        out.append("prose")
    if b.node and b.node.inside:
        out.append("inside")
    if words < 25 and (m := PHRASES.search(text)):
        out.append("phrase:" + m[0].lower())
    return out


# --- labelled pages -------------------------------------------------------------------------

SYLLABLES = "an be con da de el en er es ge ha in is ka la le lo ma men ne no on or pa ra re ri sa se so sta ta te ti to tra un ver wa we".split()


def _prose(r: random.Random, words: int) -> str:
    w = ["".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(words)]
    for k in range(len(w)):
        if r.random() < 0.1:
            w[k] += r.choice([",", ".", ",", " &amp;", "***", "%%%"])
    return (" ".join(w)).capitalize() + r.choice([".", ".", ".", "", "!"])


def labelled_page(r: random.Random) -> tuple[str, list[str]]:
    """A page and its article's blocks."""
    texts: list[str] = []
    title = _prose(r, r.randint(2, 10))

    def plain(t: str) -> str:
        return " ".join(entities.unescape(t).split())

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{k}">{_prose(r, r.randint(1, 3))}</a></li>' for k in range(n))

    def box(tag: str, names: list[str], body: str) -> str:
        kind = r.choice(["class", "class", "id"])
        name = r.choice(names)
        return f'<{tag} {kind}="{name}{r.choice(["", "-box", "-inner", "_wrap", " clearfix", "-1"])}">{body}</{tag}>'

    def menu() -> str:
        body = f"<ul>{links(r.randint(2, 8))}</ul>"
        return r.choice([f"<nav>{body}</nav>", box("div", ["nav", "menu", "navbar", "breadcrumb"], body), box("nav", ["main-nav", "top"], body)])

    def header() -> str:
        body = f"<p>{_prose(r, r.randint(1, 5))}</p>" + (menu() if r.random() < 0.4 else "")
        return r.choice([f"<header>{body}</header>", box("div", ["header", "masthead", "site-header", "topbar"], body)])

    def notice() -> str:
        t = r.choice(["We use cookies. ", "Subscribe to our newsletter. ", "Please log in. ", ""]) + _prose(r, r.randint(3, 30))
        return box(r.choice(["div", "section", "p"]), ["notice", "cookie", "alert", "consent", "newsletter", "banner", "popup", "warning", "message", "newsletter-signup", "subscribe"], t if r.random() < 0.5 else f"<span>{t}</span>")

    def advert() -> str:
        t = _prose(r, r.randint(2, 40))
        return box(r.choice(["div", "aside", "section"]), ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "sponsor", "banner-ad", "adsense", "ad-slot", "google-ads"], r.choice([t, f"<p>{t}</p>"]))

    def sidebar() -> str:
        body = f"<h3>{_prose(r, 2)}</h3>" + r.choice([f"<ul>{links(r.randint(2, 6))}</ul>", f"<p>{_prose(r, r.randint(5, 40))}</p>", f"<p>{_prose(r, r.randint(5, 20))}</p><p>{_prose(r, r.randint(5, 20))}</p>"])
        return r.choice([f"<aside>{body}</aside>", box("div", ["sidebar", "side", "related", "widget", "recommended", "more", "related-links", "see-also", "secondary"], body), box("aside", ["sidebar", "related"], body)])

    def form() -> str:
        return f'<form action="/q"><label>{_prose(r, 2)}</label><input name="q"><p>{_prose(r, r.randint(2, 12))}</p><button>{_prose(r, 1)}</button></form>'

    def comments() -> str:
        one = r.choice(["li", "div", "article", "p"])
        body = "".join(f'<{one} class="{r.choice(["comment", "reply", "user-comment", "post-comment"])}"><p>{_prose(r, r.randint(3, 40))}</p></{one}>' if one != "p" else f"<p>{_prose(r, r.randint(3, 40))}</p>" for _ in range(r.randint(1, 5)))
        head = r.choice(["", f"<h2>{r.choice(['Comments', 'Reader comments', 'Replies', _prose(r, 2)])}</h2>"])
        return box(r.choice(["section", "div", "ol", "ul"]), ["comments", "comment-list", "responses", "discussion", "reader-comments", "replies", "disqus"], head + body)

    def footer() -> str:
        body = r.choice(["&copy; 2020 ", "", "Copyright "]) + _prose(r, r.randint(2, 20))
        body = r.choice([body, f"<p>{body}</p>", f"<ul>{links(3)}</ul><p>{body}</p>"])
        return r.choice([f"<footer>{body}</footer>", box("div", ["footer", "site-footer", "bottom", "copyright"], body)])

    def share() -> str:
        return box(r.choice(["div", "p", "ul"]), ["share", "social", "tags", "meta-links", "pager"], r.choice([links(3), f"<a href='#'>{_prose(r, 2)}</a>"]))

    def content() -> str:
        parts = []
        if r.random() < 0.9:
            texts.append(plain(title))
            h = f"<h1>{title}</h1>"
            parts.append(f"<header>{h}</header>" if r.random() < 0.15 else h)
        for _ in range(r.randint(1, 12) if r.random() < 0.9 else 0):
            kind = r.random()
            t = _prose(r, r.choice([1, 2, 4, 8, 15, 30, 60, 100]))
            if kind < 0.62:
                texts.append(plain(t))
                parts.append(r.choice([f"<p>{t}</p>", f"<p>{t}</p>\n", f"<p>{t}", f"<p><b>{t}<br>", f"<p class='{r.choice(['lead', 'intro', 'x'])}'>{t}</p>"]))
            elif kind < 0.7:
                texts.append(plain(t))
                parts.append(f"<h{r.randint(2, 4)}>{t}</h{2}>" if r.random() < 0.1 else f"<h2>{t}</h2>")
            elif kind < 0.78:
                items = [_prose(r, r.randint(1, 15)) for _ in range(r.randint(1, 4))]
                texts.extend(map(plain, items))
                parts.append("<ul>" + "".join(f"<li>{x}</li>" if r.random() < 0.8 else f"<li>{x}" for x in items) + "</ul>")
            elif kind < 0.83:
                texts.append(plain(t))
                parts.append(r.choice([f"<blockquote>{t}</blockquote>", f"<pre>{t}</pre>", f"<blockquote><p>{t}</p></blockquote>", f"<div>{t}</div>", f"<figure><figcaption>{t}</figcaption></figure>", f"<section><p>{t}</p></section>"]))
            elif kind < 0.87:
                a, b = _prose(r, 3), _prose(r, 4)
                texts.extend([plain(a), plain(b)])
                parts.append(f"<table><tr><td>{a}</td><td>{b}</td></tr></table>")
            elif kind < 0.9:
                texts.append(plain(t + " x y"))
                parts.append(f"<p>{t} <a href='/z'>x</a> y</p>")
            else:
                parts.append(r.choice([advert, share, notice, sidebar, form])())
        body = "".join(parts)
        if r.random() < 0.1:
            body += comments()
        shell = r.random()
        named = lambda names: f' {r.choice(["class", "id"])}="{r.choice(names)}"' if r.random() < 0.4 else ""
        article = named(["post", "entry", "hentry", "story", "article-body"])
        main = named(["main", "content", "main-content", "primary"])
        if shell < 0.4:
            return f"<article{article}>{body}</article>"
        if shell < 0.52:
            return f"<main{main}>{body}</main>"
        if shell < 0.68:
            return f"<main{main}><article{article}>{body}</article></main>"
        if shell < 0.74:
            cell = lambda name, x: f'<td class="{name}">{x}</td>'
            side = cell(r.choice(["menu", "nav", "left", "sidebar"]), links(2).replace("li>", "p>"))
            low = cell(r.choice(["footer", "copyright", "bottom"]), r.choice(["&copy; ", "Copyright "]) + _prose(r, 3))
            return f'<table><tr>{side}{cell(r.choice(["content", "main", "text"]), body)}</tr><tr>{low}</tr></table>'
        return box("div", ["content", "article", "post", "entry", "story", "main", "body", "text", "page-content"], body)

    around = [header, menu, notice, advert, sidebar, form]
    before = "".join(r.choice(around)() for _ in range(r.randint(0, 4)))
    middle = content()
    after = "".join(f() for f in (sidebar, comments, advert, form, share, notice, footer) if r.random() < 0.4)
    shell = r.random()
    body = before + middle + after
    if shell < 0.3:
        body = f'<div class="{r.choice(["page", "wrapper", "container", "layout"])}">{body}</div>'
    return f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script></head><body>{body}</body></html>', texts


# --- the model ------------------------------------------------------------------------------


class Crf:
    """Weights of (feature, label) and transitions; labels 0 (left out) and 1 (text)."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves: list[list[list[float]]]):
        self.weights, self.moves = weights, moves

    def label(self, page: list[Block]) -> list[int]:
        """Viterbi."""
        if not page:
            return []
        w, n = self.weights, len(page)
        best: list[float] = []
        back: list[tuple[int, int]] = []
        for k, b in enumerate(page):
            s0 = s1 = 0.0
            for f in features(b, k, n):
                if f in w:
                    x, y = w[f]
                    s0 += x
                    s1 += y
            if k:
                m = self.moves[page[k - 1].container == b.container]
                a0, a1 = best[0] + m[0][0], best[1] + m[1][0]
                b0, b1 = best[0] + m[0][1], best[1] + m[1][1]
                back.append((int(a1 > a0), int(b1 > b0)))
                best = [max(a0, a1) + s0, max(b0, b1) + s1]
            else:
                best = [s0, s1]
        at = int(best[1] > best[0])
        out = [at]
        for p in reversed(back):
            at = p[at]
            out.append(at)
        return out[::-1]


class Chains:
    """Labelled pages as arrays, with the log-likelihood of their labels and its gradient."""

    def __init__(self, pages: list[tuple[str, list[str]]], ridge: float):
        self.index: dict[str, int] = {}
        self.ridge = ridge
        rows, cols, gold, same, lengths = [], [], [], [], []
        n = 0
        for page, texts in pages:
            bs = blocks(page)
            if not bs:
                continue
            at = 0
            for k, b in enumerate(bs):
                y = at < len(texts) and b.text == texts[at]
                at += y
                gold.append(int(y))
                same.append(int(k > 0 and bs[k - 1].container == b.container))
                for f in features(b, k, len(bs)):
                    rows.append(n)
                    cols.append(self.index.setdefault(f, len(self.index)))
                n += 1
            lengths.append(len(bs))
        self.n, self.rows, self.cols, self.gold, self.same = n, *map(np.array, (rows, cols, gold, same))
        t = max(lengths)
        self.start = np.cumsum([0, *lengths[:-1]])
        self.grid = np.minimum(self.start[:, None] + np.arange(t), n - 1)
        self.alive = np.arange(t) < np.array(lengths)[:, None]

    def gradient(self, w: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of a page with a ridge, and its gradient, by forward-backward over all pages at once."""

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            m = x.max(axis=axis, keepdims=True)
            return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)

        n, y, alive, same = self.n, self.gold, self.alive, self.same
        p, t = alive.shape
        unary = np.stack([np.bincount(self.rows, w[self.cols, c], n) for c in (0, 1)], 1)
        u, s = unary[self.grid], same[self.grid]
        fwd, bwd = np.zeros((p, t, 2)), np.zeros((p, t, 2))
        fwd[:, 0] = u[:, 0]
        for k in range(1, t):
            fwd[:, k] = np.where(alive[:, k, None], lse(fwd[:, k - 1][:, :, None] + moves[s[:, k]], 1) + u[:, k], fwd[:, k - 1])
        z = lse(fwd[:, -1], 1)
        dm = np.zeros_like(moves)
        for k in range(t - 1, 0, -1):
            joint = moves[s[:, k]] + (u[:, k] + bwd[:, k])[:, None, :]
            pair = np.exp(fwd[:, k - 1][:, :, None] + joint - z[:, None, None]) * alive[:, k, None, None]
            for c in (0, 1):
                dm[c] += pair[s[:, k] == c].sum(0)
            bwd[:, k - 1] = np.where(alive[:, k, None], lse(joint, 2), 0)
        prob = np.zeros((n, 2))
        prob[self.grid[alive]] = np.exp(fwd + bwd - z[:, None, None])[alive]
        prob[np.arange(n), y] -= 1
        first = np.zeros(n, bool)
        first[self.start] = True
        k = np.flatnonzero(~first)
        gold = unary[np.arange(n), y].sum() + moves[same[k], y[k - 1], y[k]].sum()
        np.subtract.at(dm, (same[k], y[k - 1], y[k]), 1)
        dw = np.stack([np.bincount(self.cols, prob[self.rows, c], len(self.index)) for c in (0, 1)], 1)
        loss = (z.sum() - gold) / p + self.ridge / 2 * ((w * w).sum() + (moves * moves).sum())
        return float(loss), dw / p + self.ridge * w, dm / p + self.ridge * moves


def train(pages: list[tuple[str, list[str]]], rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Crf:
    """Batch gradient (Adam) on the log-likelihood of labelled pages."""
    chains = Chains(pages, ridge)
    w, moves = np.zeros((len(chains.index), 2)), np.zeros((2, 2, 2))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(moves), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        _, dw, dm = chains.gradient(w, moves)
        for x, d, a, b in ((w, dw, state[0], state[1]), (moves, dm, state[2], state[3])):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Crf({f: (float(w[i, 0]), float(w[i, 1])) for f, i in chains.index.items()}, moves.tolist())


@cache
def default_model(pages: int = 500, seed: int = 5) -> Crf:
    r = random.Random(seed)
    return train([labelled_page(r) for _ in range(pages)])


def main_text(model: Crf, page: str | None) -> str:
    bs = blocks(page, model.weights)
    return "\n".join(b.text for b, y in zip(bs, model.label(bs), strict=True) if y)


def extract(pages: DataFrame, html_col: str = "html", model: Crf | None = None) -> DataFrame:
    """pages' other columns (as ``row``) and the main ``text``."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf(T.StringType())
    def text_of(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(sent.value, x) for x in page], dtype=object)

    others = [F.col(c) for c in pages.columns if c != html_col]
    return pages.select(F.struct(*others).alias("row"), text_of(F.col(html_col).cast("string")).alias("text"))
