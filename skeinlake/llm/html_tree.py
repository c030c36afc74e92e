"""HTML extraction by a tree-structured graphical model of the DOM.

Every block element of a page is a node with two states, content or not. A node's own potential is log-linear in what it is
like (tag, words of class, id and role, also of the elements around it, text and link lengths, share of the page's prose, place); each parent-child edge has a potential of both states,
by the kind of child. As the DOM is a tree, sum-product messages passed upward and downward once give exact content
marginals; blocks whose marginal reaches a half are kept, in page order. The pages of a batch are passed together, level by level.

The weights are trained here, by gradient ascent on the exact likelihood (expected counts come from the same messages), from
labelled pages which `training_pages` writes: articles in different wrappings, with headings, bylines and figures in headers of
their own or without, of one paragraph or many, in paragraphs or bare divisions, among menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, or with nothing around them.

Text of scripts, styles and other raw elements and comments never becomes a node's. Character references are decoded as HTML5 says.
White space within a block becomes one blank; blocks are joined by one blank.

Defined results: null, empty and tag-free pages: the text of a page without any tag is its own content; a page without content gives an empty text; equal
pages give equal texts; a very long page is one tree of its own, whole; elements
deeper than `DEEPEST` are siblings of one another, with all their text; repeated rows are extracted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_sizes

#: Elements that are nodes. Other elements are inline: their text belongs to the node around them.
BLOCKS = frozenset(
    "html head body title article section main div p h1 h2 h3 h4 h5 h6 ul ol menu li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption"
    " nav header footer aside form fieldset legend label button select option textarea details summary dialog address hgroup center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video noembed noframes".split())
#: What a start tag closes, up to the elements that hold such tags apart.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Elements open at once; deeper ones become siblings, so that no page costs more than in proportion to its length.
DEEPEST = 512
_HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
_KEEPS_P = frozenset("html head body title label button select option textarea legend caption thead tbody tfoot tr td th li dt dd summary figcaption".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_OPENS = re.compile(r"</?[a-zA-Z]")
#: These run to their end tag or the page's end, whatever slash their start tag ends in.
_SCRIPTS = frozenset(("script", "style"))
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_LINK = re.compile(r"\shref\b", re.IGNORECASE)
_HIDDEN = re.compile(r"\s(?:hidden\b|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.IGNORECASE)

#: Groups of words that names of classes, ids and roles are made of.
WORDS = {
    "advert": ("ad", "ads", "advert", "advertisement", "adsense", "adslot", "banner", "sponsor", "sponsored", "promo", "promotion"),
    "menu": ("nav", "navigation", "navbar", "menu", "breadcrumb", "breadcrumbs", "toc", "pagination", "pager", "tabs", "toolbar"),
    "head": ("header", "masthead", "topbar", "logo", "branding"),
    "foot": ("footer", "foot", "copyright", "colophon", "legal", "contentinfo"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "trending", "popular", "complementary", "rail"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "newsletter", "subscribe", "disclaimer"),
    "comment": ("comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "responses", "respond"),
    "form": ("form", "search", "login", "signup", "register", "contact", "subscription"),
    "share": ("share", "sharing", "social", "follow", "tags"),
    "byline": ("byline", "author", "meta", "date", "published", "dateline", "lead", "summary", "subtitle", "caption", "standfirst"),
    "content": ("article", "content", "post", "entry", "story", "body", "text", "main", "blog", "page", "prose"),
}
_WORD = {w: i for i, ws in enumerate(WORDS.values()) for w in ws}
_TAGS = ("html", "head", "title", "body", "article", "main", "section", "div", "p", "heading", "list", "li", "table", "quote", "nav", "header", "footer", "aside", "form", "control", "figure", "dialog", "other")
_TAG_GROUP = {t: t for t in _TAGS} | {f"h{i}": "heading" for i in range(1, 7)} | dict.fromkeys(("ul", "ol", "menu", "dl"), "list") | dict.fromkeys(("dt", "dd"), "li") | dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), "table") | dict.fromkeys(("blockquote", "pre"), "quote") | dict.fromkeys(("label", "button", "select", "option", "textarea", "fieldset", "legend"), "control") | {"figcaption": "figure"}
_TAG_NUMBER = {t: _TAGS.index(_TAG_GROUP.get(t, "other")) for t in BLOCKS}
#: Tags, words of names, then: own text, link share of own text, link share below, text below, sentence ends, depth, place, hidden, bias,
#: a heading before an article, characters below, those of them that are sentences, a main heading below, inside an article or main
#: element, a header or footer there.
_REST = 18
FEATURES = len(_TAGS) + 2 * len(WORDS) + _REST
_ARTICLES = tuple(_TAGS.index(t) for t in ("article", "main"))
_HEADING = _TAGS.index("heading")
_HEADER, _FOOTER = _TAGS.index("header"), _TAGS.index("footer")
#: Kinds of child for edge potentials: plain blocks, sections, page parts, headings and items, headers.
KINDS = 5
_KIND = {"p": 0, "quote": 0, "table": 0, "figure": 0, "article": 1, "main": 1, "section": 1, "div": 1, "body": 1, "html": 1, "nav": 2, "header": 4, "footer": 2, "aside": 2, "form": 2, "control": 2, "dialog": 2, "head": 2, "title": 2}
_KIND_NUMBER = [_KIND.get(t, 3) for t in _TAGS]


@dataclass
class Tree:
    """Nodes in page order (a parent before its children) and runs of text, each with its node."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[int] = field(default_factory=lambda: [_TAGS.index("other")])
    named: list[int] = field(default_factory=lambda: [0])  # bits of WORDS' groups
    hidden: list[bool] = field(default_factory=lambda: [False])
    main_heading: list[bool] = field(default_factory=lambda: [False])
    linked: list[int] = field(default_factory=lambda: [0])  # characters inside links
    runs: list[tuple[int, str]] = field(default_factory=list)
    marks: dict[int, str] = field(default_factory=dict)  # labels of training pages, by node


@lru_cache(maxsize=None)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE)


def _names(attributes: str) -> int:
    bits = 0
    for m in _NAMED.finditer(attributes):
        for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower()):
            if w in _WORD:
                bits |= 1 << _WORD[w]
    return bits


def parse(page: str, mark: str | None = None) -> Tree:
    """The page's block tree. mark: an attribute whose value is kept (training pages have their labels there)."""
    tree = Tree()
    stack: list[tuple[str, int]] = [("", 0)]
    pieces: list[str] = []
    links = at = 0
    end = len(page)
    endless: set[str] = set()  # raw elements that have no end tag any more

    def say(text: str) -> None:
        pieces.append(html.unescape(text) if "&" in text else text)
        if links:
            tree.linked[stack[-1][1]] += len(text)

    def cut() -> None:
        """A run ends where a block begins or ends."""
        if pieces:
            if text := " ".join("".join(pieces).split()):
                tree.runs.append((stack[-1][1], text))
            pieces.clear()

    def close(names: set[str], walls: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                cut()
                del stack[i:]
                return
            if stack[i][0] in walls:
                return

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            say(page[at:])
            break
        if lt > at:
            say(page[at:lt])
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = end if stop < 0 else stop + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            stop = page.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if _OPENS.match(page, lt):
                break  # a tag that the page's end cuts off
            if page.startswith("</", lt) and lt + 2 < end:
                # An end tag without a name is a comment up to the next '>'.
                stop = page.find(">", lt)
                at = end if stop < 0 else stop + 1
                continue
            say("<")
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name == "a":
                links = 0
            elif name in BLOCKS:
                # An end tag of any heading closes the heading that is open.
                ends = stack[-1][0] if name in _HEADINGS and stack[-1][0] in _HEADINGS else name
                if any(n == ends for n, _ in stack):
                    cut()
                    while stack.pop()[0] != ends:
                        pass
                    links = 0
            continue
        if name == "br" or name == "hr":
            pieces.append("\n")
        elif name == "a":
            links = int(bool(_LINK.search(m[3])))  # a link within a link ends it
        elif name in RAW:
            # Without an end tag, or closed by a slash, other raw elements hide nothing.
            closed = name in endless or m[3].endswith("/") and name not in _SCRIPTS
            if closing := None if closed else _raw_end(name).search(page, at):
                at = closing.end()
            elif name in _SCRIPTS:
                at = end
            elif not closed:
                endless.add(name)
        elif name in BLOCKS:
            if name not in _KEEPS_P:
                close({"p"}, {"td", "th", "li", "button", "body", "div", "article", "section", "blockquote"})
            if name in _CLOSES:
                close(*_CLOSES[name])
            cut()
            links = 0
            del stack[DEEPEST:]
            number = len(tree.parent)
            tree.parent.append(stack[-1][1])
            tree.tag.append(_TAG_NUMBER[name])
            tree.named.append(_names(m[3]) if m[3] else 0)
            tree.hidden.append(bool(m[3]) and bool(_HIDDEN.search(m[3])))
            tree.linked.append(0)
            tree.main_heading.append(name == "h1")
            if mark and (got := re.search(rf'{mark}="(\d)"', m[3])):
                tree.marks[number] = got[1]
            stack.append((name, number))
    cut()
    return tree


@dataclass
class Forest:
    """The trees of a batch as arrays; nodes are numbered through."""

    parent: np.ndarray
    kind: np.ndarray
    levels: list[np.ndarray]
    heads: list[tuple[np.ndarray, np.ndarray]]  # of each level: the nodes' parents, each once, and where its children begin
    x: np.ndarray
    first: np.ndarray


def forest_of(trees: list[Tree]) -> Forest:
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    first = np.append(0, np.cumsum(sizes))
    page = np.repeat(np.arange(len(trees)), sizes)
    parent = np.concatenate([np.array(t.parent, np.int64) for t in trees])
    parent = np.where(parent < 0, -1, parent + first[page])
    tag = np.concatenate([np.array(t.tag, np.int64) for t in trees])
    named = np.concatenate([np.array(t.named, np.int64) for t in trees])
    linked = np.concatenate([np.array(t.linked, float) for t in trees])
    hidden = np.concatenate([np.array(t.hidden, float) for t in trees])
    n = len(parent)
    headed = np.concatenate([np.array(t.main_heading, bool) for t in trees])
    own, ends, said, prose = np.zeros(n), np.zeros(n), np.ones(len(trees)), np.zeros(n)
    for i, t in enumerate(trees):
        at = 0
        for node, text in t.runs:
            k = node + first[i]
            own[k] += len(text)
            if text[-1] in ".!?…:":
                ends[k] += 1
                prose[k] += len(text)
            at += len(text)
        said[i] = max(1, at)
    depth = np.zeros(n, np.int64)
    levels = [np.flatnonzero(parent < 0)]
    heads = [(levels[0][:0], levels[0][:0])]
    # Parents come before children, so depths settle level by level.
    order = np.argsort(parent, kind="stable")
    sorted_parents = parent[order]
    while len(alive := levels[-1]):
        a, b = np.searchsorted(sorted_parents, alive), np.searchsorted(sorted_parents, alive, side="right")
        total = int((b - a).sum())
        if not total:
            break
        begin = np.append(0, np.cumsum(b - a)[:-1])
        heads.append((alive[b > a], begin[b > a]))
        starts = np.repeat(a - begin, b - a)
        children = order[starts + np.arange(total)]
        depth[children] = len(levels)
        levels.append(children)
    below, linked_below, prose_below = own.copy(), linked.copy(), prose * (linked <= own / 2)
    for level, (heads_of, begin) in zip(levels[:0:-1], heads[:0:-1], strict=True):
        for sums in (below, linked_below, prose_below):
            sums[heads_of] += np.add.reduceat(sums[level], begin)
        headed[heads_of] |= np.logical_or.reduceat(headed[level], begin)
    inside, above = np.isin(tag, _ARTICLES), np.zeros(n, np.int64)
    for level in levels[1:]:
        inside[level] |= inside[parent[level]]
        above[level] = named[parent[level]] | above[parent[level]]
    place = (np.arange(n) - first[page]) / np.maximum(1, sizes[page])
    x = np.zeros((n, FEATURES), np.float32)
    x[np.arange(n), tag] = 1
    for g in range(len(WORDS)):
        x[:, len(_TAGS) + g] = named >> g & 1
        x[:, len(_TAGS) + len(WORDS) + g] = above >> g & 1
    told = np.maximum(1, prose_below[first[:-1]])[page]  # prose of the whole page
    rest = (np.log1p(own) / 5, linked / np.maximum(1, own), linked_below / np.maximum(1, below), below / said[page], np.minimum(1, ends), np.minimum(depth, 12) / 6, place, hidden, np.ones(n))
    before = np.zeros(n, bool)  # a heading whose next sibling is an article or main element
    same = sorted_parents[1:] == sorted_parents[:-1]
    before[order[:-1][same]] = np.isin(tag[order[1:][same]], _ARTICLES)
    rest += (before & (tag == _HEADING), np.log1p(below) / 7, np.log1p(prose_below) / 7, prose_below / told, headed, inside, inside & headed, inside & (tag == _HEADER), inside & (tag == _FOOTER))
    x[:, -_REST:] = np.stack(rest, axis=1)
    return Forest(parent, np.array(_KIND_NUMBER)[tag], levels, heads, x, first)


@dataclass
class Model:
    unary: np.ndarray  # of FEATURES: for content against not
    edge: np.ndarray  # kind of child, state of parent, state of child


def sum_product(model: Model, f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log marginals of nodes (n, 2), of edges with the parent (n, 2, 2), and the log partition of all pages together."""
    phi = np.zeros((len(f.parent), 2))
    phi[:, 1] = f.x @ model.unary
    psi = model.edge[f.kind]  # of the edge above each node
    inward = phi.copy()
    sent = np.zeros_like(phi)
    for level, (heads, begin) in zip(f.levels[:0:-1], f.heads[:0:-1], strict=True):
        m = np.logaddexp(psi[level, :, 0] + inward[level, None, 0], psi[level, :, 1] + inward[level, None, 1])
        sent[level] = m
        inward[heads] += np.add.reduceat(m, begin)
    total = inward.copy()
    root = f.levels[0]
    z = np.logaddexp(total[root, 0], total[root, 1])
    edges = np.full((len(phi), 2, 2), -np.inf)
    for level in f.levels[1:]:
        p = f.parent[level]
        outside = total[p] - sent[level]
        edges[level] = outside[:, :, None] + psi[level] + inward[level][:, None, :]
        total[level] = inward[level] + np.logaddexp(outside[:, None, 0] + psi[level, 0, :], outside[:, None, 1] + psi[level, 1, :])
    nodes = total - np.logaddexp(total[:, 0], total[:, 1])[:, None]
    flat = edges.reshape(len(phi), 4)
    top = flat.max(axis=1, keepdims=True)
    with np.errstate(invalid="ignore"):
        norm = top + np.log(np.exp(flat - top).sum(axis=1, keepdims=True))
        edges = np.where(np.isfinite(norm), flat - norm, -np.inf).reshape(-1, 2, 2)
    return nodes, edges, z


def fit(trees: list[Tree], rounds: int = 200, rate: float = 0.15, l2: float = 1e-3) -> Model:
    """Gradient ascent (Adam) on the likelihood of the trees' labels; a node without a mark has its parent's."""
    f = forest_of(trees)
    y = np.zeros(len(f.parent), np.int64)
    for i, t in enumerate(trees):
        for k in range(1, len(t.parent)):
            y[f.first[i] + k] = int(t.marks[k]) if k in t.marks else y[f.first[i] + t.parent[k]]
    model = Model(np.zeros(FEATURES), np.zeros((KINDS, 2, 2)))
    child = np.flatnonzero(f.parent >= 0)
    seen_edges = np.zeros((KINDS, 2, 2))
    np.add.at(seen_edges, (f.kind[child], y[f.parent[child]], y[child]), 1)
    seen, kinds = f.x.T @ y, f.kind[child]
    n = len(trees)
    theta = np.zeros(FEATURES + 4 * KINDS)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        nodes, edges, _ = sum_product(model, f)
        want = np.zeros((KINDS, 2, 2))
        odds = np.exp(edges[child])
        for k in range(KINDS):
            want[k] = odds[kinds == k].sum(axis=0)
        g = np.append((seen - f.x.T @ np.exp(nodes[:, 1])) / n, ((seen_edges - want) / n).ravel()) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        model = Model(theta[:FEATURES].copy(), theta[FEATURES:].reshape(KINDS, 2, 2).copy())
    return model


def training_pages(n: int = 800, seed: int = 11) -> Iterator[str]:
    """Pages whose elements carry data-y="1" where content begins and data-y="0" where it ends; children inherit it."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwygpbvk"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(4000)]

    def pick(*options):
        return rng.choice(options)

    def maybe(p: float) -> bool:
        return rng.random() < p

    def words(a: int, b: int) -> str:
        return " ".join(rng.choices(vocabulary, k=rng.randint(a, b)))

    def sentence(a: int = 1, b: int = 25) -> str:
        return words(a, b).capitalize() + pick(".", ".", ".", "?", "!")

    def prose(most: int = 8) -> str:
        return " ".join(sentence() for _ in range(rng.randrange(1, most + 1)))

    def links(a: int, b: int) -> str:
        return "".join(f'<li><a href="/{words(1, 1)}">{words(1, 3)}</a></li>' for _ in range(rng.randrange(a, b + 1)))

    def name(group: str) -> str:
        w = pick(*WORDS[group])
        w = pick(w, w, f"{words(1, 1)}-{w}", f"{w}-{words(1, 1)}", f"{w}_{words(1, 1)}")
        return pick(f' class="{w}"', f' id="{w}"', f' class="{words(1, 1)} {w}"')

    def figure() -> str:
        caption = pick("", f"<figcaption>{pick(words(1, 8), sentence(2, 14))}</figcaption>")
        return f'<figure><img src="{words(1, 1)}.jpg">{caption}</figure>'

    def block(out: list[str], plain: str) -> None:
        """A piece of an article: sometimes unclosed, emphasised, or a list, table, quotation, figure, code or section."""
        k = rng.random()
        if k < 0.58:
            out.append(f"<{plain}>{prose()}" + (f"</{plain}>" if plain == "div" or maybe(0.85) else ""))
        elif k < 0.66:
            out.append(f"<p><b>{sentence()}" + ("</b></p>" if maybe(0.5) else "<br>"))
        elif k < 0.74:
            tag = pick("h2", "h3", "h4")
            out.append(f"<{tag}>{words(1, 8)}</{tag}>")
        elif k < 0.77:
            out.append(f"{pick('', f'<h2>{words(1, 4)}</h2>')}<{pick('ul', 'ol')}>{links(2, 6)}</ul>")  # a reading list
        elif k < 0.82:
            tag = pick("ul", "ul", "ol")
            item = pick(lambda: sentence(2, 14), lambda: words(1, 8))
            out.append(f"<{tag}>" + "".join(f"<li>{item()}</li>" for _ in range(rng.randrange(2, 6))) + f"</{tag}>")
        elif k < 0.85:
            out.append(f"<blockquote><p>{prose(3)}</p></blockquote>")
        elif k < 0.88:
            out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(rng.randrange(2, 5))) + "</table>")
        elif k < 0.91:
            out.append(figure())
        elif k < 0.93:
            out.append(f"<pre><code>{words(1, 12)}</code></pre>")
        elif k < 0.96:
            out.append(f"<section><h2>{words(1, 6)}</h2><p>{prose()}</p>{pick('', f'<p>{prose()}</p>')}</section>")
        else:
            out.append(f"<div>{prose()}</div>")

    def top() -> str:
        """How an article begins: its heading, alone or in a header of its own, with byline, date, lead or figure."""
        if maybe(0.35):
            return ""
        tag = pick("h1", "h1", "h1", "h2")
        heading = f"<{tag}>{words(1, 12)}</{tag}>"
        by = pick(f"<p{name('byline')}>{words(1, 5)}</p>", f"<div{name('byline')}>{words(1, 6)}</div>", f"<time>{words(1, 3)}</time>", f"<p>{words(1, 5)}</p>", f"<p{name('byline')}>{sentence(2, 20)}</p>")
        k = rng.random()
        if k < 0.45:
            return heading
        if k < 0.6:
            return f"<header>{heading}</header>"
        if k < 0.75:
            return f"<header{pick('', name('head'))}>{pick(heading + by, by + heading, heading + by + figure())}</header>"
        if k < 0.85:
            return f"<hgroup>{heading}<p>{words(2, 10)}</p></hgroup>"
        return heading + by

    def noise(inside: bool = False) -> str:
        k = rng.randrange(8)
        if k == 0:
            return f'<div data-y="0"{name("advert")}>{pick(prose(2), words(2, 6))}</div>'
        if k == 1:
            return f'<div data-y="0"{name("share")}><ul>{links(2, 5)}</ul></div>'
        if k == 2:
            tag = pick("div", "section", "aside")
            return f'<{tag} data-y="0"{name("notice")}><p>{prose(2)}</p><button>{words(1, 2)}</button></{tag}>'
        if k == 3:
            return f'<form data-y="0"{pick("", name("form"))}><label>{words(1, 3)}</label><input><button>{words(1, 2)}</button>{pick("", f"<p>{sentence()}</p>")}</form>'
        if k == 4:
            return f'<aside data-y="0"{pick("", name("side"), name("notice"))}>{pick("", f"<h3>{words(1, 4)}</h3>")}{pick(f"<ul>{links(2, 7)}</ul>", f"<p>{prose(3)}</p>", sentence())}</aside>'
        if k == 5:
            return f'<div data-y="0"{name("side")}><h4>{words(1, 3)}</h4><ul>{links(3, 7)}</ul></div>'
        if k == 6:
            return f'<section data-y="0"{name("side")}><h2>{words(1, 3)}</h2>' + "".join(f'<div><h3><a href="/{words(1, 1)}">{words(2, 8)}</a></h3></div>' for _ in range(rng.randrange(2, 5))) + "</section>"
        return "" if inside else f'<nav data-y="0"><ul>{links(3, 9)}</ul></nav>'

    def comments() -> str:
        each = "".join(pick(f'<div class="comment"><p>{prose(3)}</p></div>', f'<li class="comment"><b>{words(1, 2)}</b> {prose(3)}</li>', f"<article><p>{prose(3)}</p></article>", f"<li>{prose(3)}</li>") for _ in range(rng.randrange(1, 7)))
        tag = pick("section", "div", "div", "ol")
        if maybe(0.3):
            each = f"<{pick('ul', 'ol')}>{each}</ul>"
        return f'<{tag} data-y="0"{name("comment")}>{pick("", f"<h3>{words(1, 3)}</h3>")}{each}</{tag}>'

    #: Wrappings of an article; {y}: its label, {c}: a name that says so.
    wrappings = (
        ("<article{y}{c}>", "</article>"), ("<article{y}>", "</article>"), ("<article{y}>", "</article>"), ("<main{y}>", "</main>"), ("<main{y}{c}>", "</main>"), ("<div{y}{c}>", "</div>"), ("<div{y}>", "</div>"), ("<div{y}>", "</div>"), ("<div{y}>", "</div>"),
        ("<section{y}{c}>", "</section>"), ("<section{y}>", "</section>"), ("<section{y}>", "</section>"), ("<main{y}><article>", "</article></main>"), ("<main{y}><div{c}>", "</div></main>"), ("<div{c}><article{y}>", "</article></div>"), ("<div><div><main{y}>", "</main></div></div>"), ('<div role="main"{y}>', "</div>"),
    )
    for i in range(n):
        plain = "div" if maybe(0.3) else "p"
        brief = maybe(0.12)  # a paragraph or two, and nothing else
        article = [""] if brief else [top()]
        if not brief and maybe(0.15):
            article.append(pick(f"<p><b>{words(1, 12)}<br>", f"<p>{words(1, 12)}", f"<p>{sentence(1, 12)}</p>"))
        if brief or maybe(0.2):
            article.append("".join(f"<{plain}>{prose(3)}</{plain}>" for _ in range(1 + (brief and maybe(0.3)))))  # one paragraph, at most behind what precedes
        else:
            for _ in range(rng.randrange(1, 14) if article == [""] or maybe(0.9) else 0):
                block(article, plain)
                if maybe(0.06):
                    article.append(noise(inside=True))
        if maybe(0.1):
            article.append(f'<footer data-y="0">{pick(f"<ul>{links(1, 4)}</ul>", words(1, 6), sentence())}</footer>')
        opening, closing = wrappings[rng.randrange(len(wrappings))]
        body = opening.format(y=' data-y="1"', c=name("content")) + "".join(article)
        tail = comments() if maybe(0.35) else ""
        body += tail + closing if maybe(0.3) else closing + tail
        if not article[0] and opening.startswith(("<article", "<main")) and maybe(0.6):
            body = f'<h1 data-y="1">{words(1, 12)}</h1>' + body  # the heading stands before the article
        if maybe(0.2):  # nothing around it
            yield f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title></head><body>{body}</body></html>"
            continue
        before = [f'<nav data-y="0"{pick("", name("menu"))}><ul>{links(2, 9)}</ul></nav>'] if maybe(0.7) else []
        if maybe(0.5):
            tag = pick("h1", "div", "p")
            inner = f'<nav><ul>{links(2, 6)}</ul></nav>' if maybe(0.3) else ""
            before.insert(rng.randrange(len(before) + 1), f'<header data-y="0"{pick("", name("head"))}><{tag}>{words(1, 4)}</{tag}>{inner}</header>')
        elif maybe(0.4):
            before.append(f'<div data-y="0"{name(pick("menu", "head"))}>{pick(f"<ul>{links(2, 8)}</ul>", words(1, 6), f"<p>{sentence()}</p>")}</div>')
        if maybe(0.35):  # beside a column
            column = f'<{(tag := pick("aside", "div"))} data-y="0"{pick("", name("side"))}>{pick("", f"<h3>{words(1, 4)}</h3>")}{pick(f"<ul>{links(2, 7)}</ul>", f"<p>{prose(2)}</p><ul>{links(2, 5)}</ul>")}</{tag}>'
            body = f'<div class="{pick("row", "columns", "grid", words(1, 1))}">{pick(body + column, column + body)}</div>'
        before += [noise() for _ in range(rng.randrange(3))]
        after = [noise() for _ in range(rng.randrange(3))]
        if maybe(0.85):
            after.append(f'<footer data-y="0"{pick("", name("foot"))}>{pick(sentence(), f"<p>&copy; {words(2, 6)}</p>", f"<ul>{links(2, 6)}</ul>", f"<h4>{words(1, 3)}</h4><p>{prose(3)}</p><ul>{links(2, 5)}</ul>")}</footer>')
        elif maybe(0.7):
            after.append(f'<div data-y="0"{name("foot")}>{pick(sentence(), f"<ul>{links(2, 6)}</ul>")}</div>')
        middle = "".join(before) + body + "".join(after)
        if maybe(0.3):
            middle = f'<div class="{pick("wrapper", "container", "layout", "site", "page")}">{middle}</div>'
        end = "</body></html>" if maybe(0.9) else ""
        yield f"<!DOCTYPE html><html><head><title>{words(2, 9)}</title></head><body>{middle}{end}"


@lru_cache(maxsize=2)
def trained(n: int = 800, seed: int = 11) -> Model:
    return fit([parse(p, "data-y") for p in training_pages(n, seed)])


def contents(model: Model, pages: list[str], threshold: float = 0.5) -> list[list[str]]:
    """The content blocks of each page, in page order."""
    trees = [parse(p) for p in pages]
    f = forest_of(trees)
    marginal = np.exp(sum_product(model, f)[0][:, 1])
    out = []
    for i, t in enumerate(trees):
        good = marginal[f.first[i] : f.first[i + 1]] >= threshold
        plain = len(t.parent) == 1  # no tag at all
        out.append([text for node, text in t.runs if plain or good[node]])
    return out


def extract(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", content: str = "html", blocks: bool = False) -> DataFrame:
    """Each row of pages: key, url, text, n_chars (code points); with blocks also the array of kept blocks."""
    rows = pages.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").alias(url), F.coalesce(F.col(f"`{content}`"), F.lit("")).alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kinds = dict(rows.dtypes)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column("html")
            for a, b in slices(texts_sizes(source)):
                got = contents(shared.value, source.slice(a, b - a).to_pylist())
                texts = [" ".join(g) for g in got]
                out = {key: batch.column(key).slice(a, b - a), url: batch.column(url).slice(a, b - a), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                yield pa.record_batch(out | ({"blocks": pa.array(got, pa.list_(pa.string()))} if blocks else {}))

    return rows.mapInArrow(made, f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long" + ", blocks array<string>" * blocks)
