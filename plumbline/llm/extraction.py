"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the nodes of a tree; each is content or not. Node
potentials are log-linear in local features (tag, words of class and id, share
of text in links, length, punctuation); parent-child potentials pull a child
towards its parent, by the child's kind of tag. Both are trained together from
labelled pages (``labelled_pages`` composes them by rule from labelled parts). Sum-product messages go up from the
leaves and down from the root and give every node's content marginal, exactly,
as the graph is a tree. The text of nodes from 0.5 on is the main text.

Pages are scanned where they are: no exchange, one page at a time.

Edge cases: null or empty html gives an empty text; unclosed tags, comments and
scripts end with the page (what follows an unclosed script is script);
unknown character references stay as they are; very long and very deep pages
are processed whole, without recursion; repeated rows give equal rows; an empty
table gives no rows; columns other than id, url and html are not read.
"""

from __future__ import annotations

import html
import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import arrow_schema, bounded_batches, required

_OPENS = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DATA = re.compile(r"data-label=\"(\w+)\"")
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "object", "canvas"}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i ins del kbd mark q s samp small span strike strong sub sup time tt u var label".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("article aside body div dl footer form header html main nav ol section table td th ul".split())

_KINDS = (
    ("head", "head"),
    ("root", "root html body"),
    ("article", "article main"),
    ("nav", "nav menu"),
    ("aside", "aside dialog"),
    ("footer", "footer"),
    ("header", "header"),
    ("form", "form fieldset button select option input"),
    ("text", "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption dd dt"),
    ("list", "ul ol dl li table tbody thead tr td th"),
)
_KIND = {t: i for i, (_, tags) in enumerate(_KINDS) for t in tags.split()}
_OTHER = len(_KINDS)
_CLASSES = (
    re.compile(r"^(?:ads?|advert\w*|adv|promo\w*|sponsor\w*|banner|dfp|adsense|adbox|adslot)$"),
    re.compile(r"^(?:nav\w*|menu\w*|breadcrumbs?|topbar|toolbar|pagination|pager|links?|toc)$"),
    re.compile(r"^(?:comments?|commentlist|reply|replies|respond|discuss\w*|disqus|reactions?|responses?)$"),
    re.compile(r"^(?:footer|foot|colophon|copyright|legal)$"),
    re.compile(r"^(?:header|masthead|branding|head|logo|hero)$"),
    re.compile(r"^(?:side\w*|related|recommended|widget\w*|complementary|trending|popular|recent)$"),
    re.compile(r"^(?:notice\w*|cookies?|consent|alert|popup|modal|overlay|gdpr|newsletter|subscribe|paywall|disclaimer|warning)$"),
    re.compile(r"^(?:share|sharing|social|follow|buttons?|form|search|login|signup|tags?|meta|byline)$"),
    re.compile(r"^(?:article|content|contents|post|entry|main|story|body|text|prose|articlebody)$"),
)
_LOCAL = 5


class Tree:
    """Blocks of a page (parents stand before children) and its text pieces in page order."""

    __slots__ = ("parent", "tag", "names", "label", "pieces", "n_text", "n_link", "stops")

    def __init__(self, page: str):
        self.parent, self.tag, self.names, self.label = [-1], ["root"], [""], [None]
        self.n_text, self.n_link, self.stops = [0], [0], [0]
        self.pieces: list[tuple[int, str]] = []
        self._read(page)

    def _add(self, block: int, text: str, link: bool) -> None:
        if text:
            size = len(text) - text.count(" ")
            self.pieces.append((block, text))
            self.n_text[block] += size
            self.n_link[block] += size * link
            self.stops[block] += text.count(".") + text.count("!") + text.count("?") + text.count(",")

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("root", 0)]  # open elements, each with its block
        open_count: dict[str, int] = {}
        at, last, tag = 0, page.rfind(">"), _TAG

        def pop_to(k: int) -> None:
            for t, _ in stack[k:]:
                open_count[t] -= 1
            del stack[k:]

        while at < len(page):
            m = _OPENS.search(page, at)
            stop = m.start() if m and m.start() < last else len(page)
            if m and stop == len(page) and page[m.start() + 1] in "!?":
                stop = m.start()  # an unclosed comment
            if stop > at:
                text = page[at:stop]
                self._add(stack[-1][1], html.unescape(text) if "&" in text else text, open_count.get("a", 0) > 0)
            if stop == len(page):
                return
            if page[stop + 1] in "!?":
                end = "-->" if page.startswith("<!--", stop) else ">"
                at = page.find(end, stop + 2)
                if at < 0:
                    return
                at += len(end)
                continue
            m = tag.match(page, stop)
            if not m:  # a quote that nothing closes: from here on tags end at the next bracket
                tag = _BROKEN
                m = tag.match(page, stop)
            at = m.end()
            name = m.group(2)
            name = name.lower()
            if m.group(1):
                if open_count.get(name):
                    k = len(stack) - 1
                    while stack[k][0] != name:
                        k -= 1
                    pop_to(k)
                continue
            if name in _RAW:
                if not m.group(3).rstrip().endswith("/") or name in ("script", "style"):
                    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            if name in _VOID:
                if name in ("br", "hr"):
                    self.pieces.append((stack[-1][1], " "))
                continue
            if name in _CLOSES_P and open_count.get("p"):
                self._close(stack, pop_to, ("p",))
            if name in _SAME and any(open_count.get(x) for x in _SAME[name]):
                self._close(stack, pop_to, _SAME[name])
            block = stack[-1][1]
            names = " ".join(x for g in _NAMES.findall(m.group(3)) for x in g[1:] if x).lower() if m.group(3) else ""
            if name not in _INLINE or names:
                label = _DATA.search(m.group(3)) if "data-label" in m.group(3) else None
                inline = name in _INLINE
                if not inline or any(c.match(t) for t in re.split(r"[\s_\-]+", names) for c in _CLASSES[:8]):
                    self.parent.append(block)
                    self.tag.append(name)
                    self.names.append(names)
                    self.label.append(label.group(1) if label else None)
                    self.n_text.append(0), self.n_link.append(0), self.stops.append(0)
                    block = len(self.parent) - 1
            if not m.group(3).endswith("/") or name not in _INLINE:
                stack.append((name, block))
                open_count[name] = open_count.get(name, 0) + 1

    @staticmethod
    def _close(stack, pop_to, names) -> None:
        k = len(stack) - 1
        while k > 0:
            if stack[k][0] in names:
                pop_to(k)
                return
            if stack[k][0] in _SCOPE:
                return
            k -= 1


@lru_cache(50_000)
def _named(tag: str, names: str) -> tuple[int, ...]:
    """Indices of the features that tag, class and id give."""
    found = [_KIND.get(tag, _OTHER)]
    tokens = [t for t in re.split(r"[\s_\-]+", names) if t]
    found += [_OTHER + 1 + c for c, pattern in enumerate(_CLASSES) if any(pattern.match(t) for t in tokens)]
    return tuple(found)


_SIZE = _OTHER + 1 + len(_CLASSES) + _LOCAL


def _features(tree: Tree, i: int) -> tuple[int, ...]:
    base = _OTHER + 1 + len(_CLASSES)
    n, link, stops = tree.n_text[i], tree.n_link[i], tree.stops[i]
    local = (base,) if not n else (base + 1,) if 2 * link > n else (base + 2,) if n < 30 else (base + 3,) if not stops else (base + 4,)
    return _named(tree.tag[i], tree.names[i]) + local


def _pulled(field, pull):
    """What a node with log odds ``field`` sends over an edge: log odds, in (-2 pull, 2 pull)."""
    return 2 * np.arctanh(np.clip(np.tanh(pull) * np.tanh(field / 2), -1 + 1e-12, 1 - 1e-12))


class Model:
    """Node weights (log odds of content) and pulls between parent and child, a conditional random field.

    The score of a labelling is the sum of the content nodes' weights and, for
    each edge, the pull of the child's kind of tag where the two agree and its
    negative where they don't. Weights and pulls maximise the likelihood of the
    labelled pages, which the same messages give: expected minus seen features
    are the gradient.
    """

    def __init__(self, pages: list[tuple[str, int]], ridge: float = 1.0, turns: int = 600):
        parents, found, kinds, states, depths = [], [], [], [], []
        for page, root in pages:
            t, base = Tree(page), len(parents)
            for i, p in enumerate(t.parent):
                parents.append(base + p if i else -1)
                depths.append(depths[base + p] + 1 if i else 0)
                found.append(_features(t, i))
                kinds.append(_KIND.get(t.tag[i], _OTHER))
                states.append({"content": 1, "other": 0, None: states[base + p] if i else root}[t.label[i]])
        parent, kind, y = np.array(parents), np.array(kinds), np.array(states, float)
        x = np.zeros((len(y), _SIZE + 1))
        for i, own in enumerate(found):
            x[i, list(own)] = 1
        x[:, _SIZE] = 1
        levels = [np.flatnonzero(np.array(depths) == d) for d in range(1, max(depths) + 1)]
        child = np.flatnonzero(parent >= 0)
        agree = np.where(y[child] == y[parent[child]], 1.0, -1.0)

        w, pull = np.zeros(_SIZE + 1), np.full(_OTHER + 1, 0.5)
        moments = [np.zeros((2, len(w))), np.zeros((2, len(pull)))]
        for turn in range(1, turns + 1):
            up, sent, c = x @ w, np.zeros(len(y)), pull[kind]
            for at in levels[::-1]:
                sent[at] = _pulled(up[at], c[at])
                np.add.at(up, parent[at], sent[at])
            belief, rest = up.copy(), np.zeros(len(y))
            for at in levels:
                rest[at] = belief[parent[at]] - sent[at]  # the parent's log odds without this child's message
                belief[at] = up[at] + _pulled(rest[at], c[at])
            same = self._agreement(rest[child], up[child], c[child])
            slopes = x.T @ (y - 1 / (1 + np.exp(-np.clip(belief, -40, 40)))) - ridge * w, np.bincount(kind[child], agree - same, minlength=len(pull)) - ridge * pull
            for value, slope, m in zip((w, pull), slopes, moments, strict=True):  # steps of about equal size (Adam)
                m[0] = 0.9 * m[0] + 0.1 * slope
                m[1] = 0.99 * m[1] + 0.01 * slope**2
                value += 0.05 * (m[0] / (1 - 0.9**turn)) / (np.sqrt(m[1] / (1 - 0.99**turn)) + 1e-8)
            pull[:] = np.maximum(pull, 0)
        self.bias, self.weights, self.pulls = float(w[_SIZE]), w[:_SIZE].tolist(), pull.tolist()

    @staticmethod
    def _agreement(a: np.ndarray, u: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Expected agreement (1 or -1) of two ends with log odds ``a`` and ``u``, pulled by ``c``."""
        t = np.tanh(a / 2) * np.tanh(u / 2)
        return (np.tanh(c) + t) / (1 + np.tanh(c) * t)

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of each node, by sum-product: messages up from the leaves, then down from the root."""
        n = len(tree.parent)
        up = [self.bias + sum(map(self.weights.__getitem__, _features(tree, i))) for i in range(n)]
        pulls = [math.tanh(self.pulls[_KIND.get(t, _OTHER)]) for t in tree.tag]
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            sent[i] = 2 * math.atanh(pulls[i] * math.tanh(up[i] / 2))
            up[tree.parent[i]] += sent[i]
        belief = up
        for i in range(1, n):
            belief[i] += 2 * math.atanh(pulls[i] * math.tanh((belief[tree.parent[i]] - sent[i]) / 2))
        return [1 / (1 + math.exp(-max(-40.0, min(40.0, b)))) for b in belief]

    def text(self, page: str) -> str:
        tree = Tree(page)
        content = self.marginals(tree)
        out, last = [], -1
        for block, piece in tree.pieces:
            if content[block] >= 0.5:
                if block != last:
                    out.append(" ")
                out.append(piece)
            last = block
        return " ".join("".join(out).split())


# ---------------------------------------------------------------- labelled pages


def labelled_pages() -> list[tuple[str, int]]:
    """Pages composed of labelled parts, each with the label of its root: with and without semantic tags
    or any wrapper, each kind of clutter before, inside and after the article."""
    prose = "Some words of an article, long enough to be a sentence of its own. It goes on, and ends."
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("home", "news", "sport", "about"))
    clutter = [
        f'<nav data-label="other"><ul>{links}</ul></nav>',
        f'<div class="menu" data-label="other"><ul>{links}</ul></div>',
        '<div class="ad" data-label="other">Buy this now, it is cheap.</div>',
        '<div class="advert" data-label="other"><p>Buy this now, it is cheap and good, and it will last for years.</p></div>',
        f'<aside data-label="other"><h3>Related</h3><p>{prose}</p></aside>',
        f'<div class="sidebar" data-label="other"><p>{prose}</p></div>',
        f'<div class="comments" data-label="other"><h3>Comments</h3><div class="comment"><p>{prose}</p></div></div>',
        f'<section id="comments" data-label="other"><p>{prose}</p></section>',
        '<div class="notice" data-label="other"><p>We use cookies, as all do. By reading on you agree.</p></div>',
        '<form data-label="other"><p>Your name, please.</p><button>Send</button></form>',
        '<div class="share" data-label="other">Share this</div>',
    ]
    bodies = [
        f'<article data-label="content"><h1>A title</h1><p>{prose}</p>@<p>{prose}</p><h2>More</h2><ul><li>One thing, said at length.</li></ul><div><p>{prose}</p></div><blockquote>{prose}</blockquote></article>',
        f'<main data-label="content"><h1>A title</h1><p>{prose}</p>@<p>{prose}</p><section><p>{prose}</p></section></main>',
        f'<div class="content" data-label="content"><h1>A title</h1><p>{prose}</p>@<p>{prose}</p><table><tr><td>A cell</td></tr></table></div>',
        f'<div class="post" data-label="content"><p>Short.</p>@<p>{prose}</p><p>{prose}</p></div>',
        f'<article data-label="content"><h1>A title</h1><p>{prose}<br>@<p>No stop here</p><p>It</p><section><h2>Part</h2><p>{prose}</p></section></article>',
        # text of little punctuation, as verse and tables have
        '<article data-label="content"><h1>A title</h1>@' + "".join(f"<p>line {i} of many that have no stop at all and go on</p><p>line {i}</p>" for i in range(12)) + "</article>",
        '<article data-label="content"><p>One</p>@<p>Two</p></article>',
        '<div id="main" data-label="content"><h1>Title</h1><p>One</p><p>Two, then.</p>@</div>',
    ]
    loose = [  # no wrapper: the page itself is the article
        f"<h1>A title</h1><p>{prose}</p>@<p>{prose}</p>",
        f"<p>{prose}</p>@<p>{prose}</p><ul><li>One thing, said at length.</li></ul><p>Short.</p>",
        f"<h2>A title</h2>{prose}<br>{prose}@<p>{prose}</p>",
        f"<div><div><h1>A title</h1><p>{prose}</p></div>@<div><p>{prose}</p><p>It</p></div></div>",
        f"<div><section><p>{prose}</p></section>@<div><p>{prose}</p></div></div>",
        f"<table><tr><td><h1>A title</h1><p>{prose}</p>@<p>{prose}</p></td></tr></table>",
    ]
    heads = ['<header data-label="other"><h1>Site</h1><p>The best site, by far.</p></header>', '<div class="header" data-label="other">Site name</div>']
    feet = ['<footer data-label="other"><p>Copyright, all rights reserved, and so on and on.</p></footer>', '<div class="footer" data-label="other">Imprint</div>']
    pages = []
    for i, (body, c, place) in enumerate(itertools.product(bodies, clutter, range(3))):
        other = clutter[(i + 3) % len(clutter)]
        inside, around = (c if place else ""), ("" if place == 1 else c)
        main = body.replace("@", inside)
        if i % 3 == 0:
            main = f'<div class="page">{main}</div>'
        pages.append((f'<html><head data-label="other"></head><body>{heads[i % 2]}{around}{main}{other}{feet[i // 2 % 2]}</body></html>', 0))
    for i, (body, c, place) in enumerate(itertools.product(loose, clutter, range(3))):
        main = body.replace("@", c if place else "")
        pages.append((f'<html><head data-label="other"></head><body>{heads[i % 2] if place != 1 else ""}{"" if place == 1 else c}{main}{feet[i % 2] if i % 3 else ""}</body></html>', 1))
    return [*pages, *((x, 1) for x in (prose, f"<p>{prose}</p>", f"{prose}<br>{prose}", "A line", "<p>A line</p>", f"<html><body>{prose}</body></html>"))]


@lru_cache(1)
def trained() -> Model:
    """The model, trained once a process (on the driver, in a second or two, and sent to the tasks)."""
    return Model(labelled_pages())


_TEXT = "page_id long, url string, text string, n_chars long"


def _extracted(model):
    out = arrow_schema(_TEXT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.value.text(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=out)

    return run


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of every page: id, url, text, n_chars (code points)."""
    bounded_batches(pages.sparkSession)
    rows = required(pages, **{id_col: "long", url_col: "string", html_col: "string"})
    return rows.mapInArrow(_extracted(pages.sparkSession.sparkContext.broadcast(trained())), _TEXT).select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
