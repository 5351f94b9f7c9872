"""Operator 1: main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements, with the runs of text between block borders as leaves.  Each node is
content or not; its own features (tag, words of class and id, length, links) weigh for either, and every edge from
parent to child has a 2 x 2 table of its own kind.  Sum-product messages go up from the leaves and down from the root
and give each node's exact marginal; leaves at 1/2 or more are the text.  The weights maximise the likelihood of
labelled pages, whose nodes carry ``data-y``.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lodemill.llm.common import slices

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+))")
_ATTRS = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_NAMED = re.compile(r"""\b(class|id|role|itemprop|data-y)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title iframe".split())
#: Elements of ordinary markup that hold no text of the page: parts of forms, and what browsers don't show.
ASIDE = frozenset("noscript template select button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
INLINE |= frozenset("math semantics annotation annotation-xml mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose merror".split())
INLINE |= frozenset("object svg g text tspan textpath path rect circle ellipse line polyline polygon defs use symbol marker lineargradient radialgradient stop clippath mask pattern filter desc metadata foreignobject".split())
#: Start tags that end an element of ASIDE which has no end tag of its own.
BLOCK = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Which open elements a start tag ends: tag, then the tags it closes, then those beyond which it doesn't look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: The same for all other blocks: they end a paragraph.
P_ENDS = ({"p"}, {"td", "th", "li", "table", "body"})


class Tree:
    """Nodes in page order; parents come before children.  A leaf has tag ''."""

    __slots__ = ("parent", "tag", "attrs", "text", "linked")

    def __init__(self) -> None:
        self.parent, self.tag, self.attrs, self.text, self.linked = [-1], ["#root"], [""], [""], [0]

    def add(self, parent: int, tag: str, attrs: str, text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


class Tags:
    """The tags of a page, one after the other, in time proportional to its length.

    A quoted value may hold ``>``.  Where a quote has no partner the tag ends at the next ``>``, and so do all tags up to
    that quote: they aren't searched for partners again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.unquoted = page, page.rfind(">"), 0

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether an end tag, name in lower case, attributes) of the next one; comments and such have no name."""
        page = self.page
        while m := _OPEN.search(page, at):
            start, at = m.span()
            if m[1] or m[2]:
                end = page.find("-->" if m[1] else ">", at)
                return start, len(page) if end < 0 else end + (3 if m[1] else 1), False, "", ""
            if at > self.last:
                continue
            end = -1
            if start >= self.unquoted:
                stop = _ATTRS.match(page, at).end()
                if page.startswith(">", stop):
                    end = stop
                else:
                    self.unquoted = stop + 1
            if end < 0:
                end = page.find(">", at)
            return start, end + 1, bool(m[3]), m[4].lower(), page[at:end]
        return None


def _raw_end(page: str, tag: str, at: int) -> int:
    stop = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
    return stop.end() if stop else len(page)


def _aside_ends(page: str) -> dict[int, int]:
    """Start and end of every element of ASIDE.

    Its end tag ends it, nested ones of its kind counted; without one, the next block does, or the end tag of an element
    around it, or the end of the page.
    """
    out: dict[int, int] = {}
    stack: list[tuple[str, int]] = []  # open elements and where they start
    count: dict[str, int] = {}
    fresh: list[int] = []  # open elements of ASIDE without a block so far
    block: dict[int, int] = {}

    def pop(end: int) -> str:
        tag, start = stack.pop()
        count[tag] -= 1
        if tag in ASIDE:
            out[start] = block.get(start, end)
        return tag

    at, tags = 0, Tags(page)
    while found := tags.after(at):
        began, at, slash, tag, attrs = found
        if not tag or tag in INLINE or tag in VOID and tag not in BLOCK:
            continue
        if slash:
            if tag != "p" and count.get(tag):
                while stack[-1][0] != tag:
                    pop(began)
                start = stack[-1][1]
                pop(at)
                if tag in ASIDE:
                    out[start] = at
            continue
        if tag in BLOCK:
            for start in fresh:
                block[start] = began
            fresh.clear()
        if attrs.rstrip().endswith("/"):
            continue
        if tag in RAW:
            at = _raw_end(page, tag, at)
        elif tag not in VOID:
            if tag in ("button", "select") and count.get(tag):  # these don't nest
                while pop(began) != tag:
                    pass
            stack.append((tag, began))
            count[tag] = count.get(tag, 0) + 1
            if tag in ASIDE:
                fresh.append(began)
    while stack:
        pop(len(page))
    return out


class _Open:
    """The open block elements, with the places of each tag among them."""

    def __init__(self) -> None:
        self.blocks = [(0, "#root", "")]
        self.at: dict[str, list[int]] = {}

    def push(self, node: int, tag: str, attrs: str) -> None:
        self.at.setdefault(tag, []).append(len(self.blocks))
        self.blocks.append((node, tag, attrs))

    def cut(self, depth: int) -> None:
        while len(self.blocks) > depth:
            self.at[self.blocks.pop()[1]].pop()

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost one, 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)


def parse(page: str) -> Tree:
    """Tolerant of missing, misnested and unended tags; comments, scripts, styles, buttons and the like leave nothing.

    Only raw text (scripts and such) without an end tag goes to the end of the page.  Time and memory are proportional
    to the page's length, whatever is in it.
    """
    tree, open_, tags = Tree(), _Open(), Tags(page)
    blocks = open_.blocks
    inline: list[str] = []
    count: dict[str, int] = {}  # of the open inline elements
    run: list[str] = []
    run_linked = 0
    ends_at: dict[int, int] | None = None

    def flush() -> None:
        nonlocal run, run_linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                tree.add(blocks[-1][0], "", blocks[-1][2], text, min(run_linked, len(text)))
            run, run_linked = [], 0

    def say(raw: str) -> None:
        nonlocal run_linked
        text = html.unescape(raw) if "&" in raw else raw
        run.append(text)
        if count.get("a"):
            run_linked += len(text.strip())

    def close(depth: int) -> None:
        flush()
        open_.cut(depth)
        inline.clear()
        count.clear()

    at = 0
    while found := tags.after(at):
        start, end, slash, tag, attrs = found
        if start > at:
            say(page[at:start])
        at = end
        if not tag:
            continue
        if slash:
            if tag in INLINE:
                if count.get(tag):
                    while (gone := inline.pop()) != tag:
                        count[gone] -= 1
                    count[tag] -= 1
            elif k := open_.last((tag,)):
                close(k)
            else:
                flush()
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                at = _raw_end(page, tag, at)
            continue
        if tag in ASIDE:
            if not attrs.rstrip().endswith("/"):
                if ends_at is None:
                    ends_at = _aside_ends(page)
                at = ends_at.get(start, at)
            if tag in ("select", "button"):
                run.append(" ")
            continue
        if tag == "br":
            run.append("\n")
            continue
        if tag in INLINE:
            if not attrs.endswith("/") or tag == "a":
                inline.append(tag)
                count[tag] = count.get(tag, 0) + 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        flush()
        ends, beyond = ENDS.get(tag, P_ENDS)
        if (k := open_.last(ends)) > open_.last(beyond):
            close(k)
        inline.clear()
        count.clear()
        named = " ".join(f"{a.lower()}={v.strip(chr(34) + chr(39))}" for a, v in _NAMED.findall(attrs)) if "=" in attrs else ""
        n = tree.add(blocks[-1][0], tag, named)
        if not attrs.endswith("/"):
            open_.push(n, tag, named)
    if at < len(page):
        say(page[at:])
    flush()
    return tree


#: Kinds of edge, by the child: leaves by the tag above them, elements by their tag.
_LEAF_KINDS = ("p", "li", "div", "td", "h1", "h2", "h3", "article", "main", "section", "blockquote", "figcaption", "body")
_BLOCK_KINDS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "ul", "ol", "li", "p", "h1", "h2", "h3", "table", "body", "html", "blockquote", "figure", "head")
KINDS = {k: i for i, k in enumerate([*(f"leaf {t}" for t in _LEAF_KINDS), *_BLOCK_KINDS, "leaf", "other"])}


class Model:
    """Weights by feature name (log-odds of content) and, by kind of edge, a 2 x 2 table [parent][child] of factors."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = {"bias": 0.0}
        self.edge = [[[0.0, 0.0], [0.0, 0.0]] for _ in KINDS]
        self.seen: dict[tuple[str, str], tuple[list[str], int]] = {}

    def _named(self, tag: str, attrs: str) -> tuple[list[str], int]:
        found = self.seen.get((tag, attrs))
        if found is None:
            words = {w for v in re.findall(r"(?:class|id|role|itemprop)=([^=]*)(?=\s\S+=|$)", attrs) for w in _WORD.findall(v.lower())}
            found = ["bias", f"tag {tag}", *(f"word {w}" for w in sorted(words))], KINDS.get(tag, KINDS["other"])
            if len(self.seen) < 20_000:
                self.seen[tag, attrs] = found
        return found

    def features(self, t: Tree, k: int) -> tuple[list[str], int]:
        if t.tag[k]:
            return self._named(t.tag[k], t.attrs[k])
        text, above = t.text[k], t.tag[t.parent[k]]
        n = len(text)
        out = ["leaf", f"in {above}", f"length {min(8, n.bit_length())}", f"links {(3 * t.linked[k] + n - 1) // n}"]
        if text[-1] in ".!?…\"”":
            out.append("ends")
        if "©" in text or "opyright" in text:
            out.append("copyright")
        return out, KINDS.get(f"leaf {above}", KINDS["leaf"])

    def marginals(self, t: Tree, each=None) -> list[float]:
        """P(content) of every node.  ``each``: gets (k, features, kind, p, parent's and child's joint marginal)."""
        n = len(t.tag)
        weight, parent = self.weight.get, t.parent
        feats = [self.features(t, k) for k in range(n)]
        up0, up1 = [1.0] * n, [1.0] * n  # a node's own factor times its children's messages
        to0, to1 = [1.0] * n, [1.0] * n  # its message to the parent
        for k in range(n):
            s = 0.0
            for f in feats[k][0]:
                s += weight(f, 0.0)
            up1[k] = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, s))))
            up0[k] = 1.0 - up1[k]
        factor = self.factor
        for k in range(n - 1, 0, -1):
            (a, b), (c, d) = factor[feats[k][1]]
            x, y = up0[k], up1[k]
            m0, m1 = a * x + b * y, c * x + d * y
            z = m0 + m1
            to0[k], to1[k] = m0, m1 = m0 / z, m1 / z
            p = parent[k]
            x, y = up0[p] * m0, up1[p] * m1
            z = x + y
            if z < 1e-200:
                x, y, z = max(x, 1e-200), max(y, 1e-200), x + y + 2e-200
            up0[p], up1[p] = x / z, y / z
        out = [0.0] * n
        out[0] = up1[0] / (up0[0] + up1[0])
        for k in range(1, n):
            (a, b), (c, d) = factor[feats[k][1]]
            p1 = out[parent[k]]
            # What the parent believes without this child.
            q0, q1 = (1.0 - p1) / max(to0[k], 1e-300), p1 / max(to1[k], 1e-300)
            j = (q0 * a * up0[k], q0 * b * up1[k], q1 * c * up0[k], q1 * d * up1[k])
            z = sum(j) or 1.0
            out[k] = (j[1] + j[3]) / z
            if each:
                each(k, feats[k], out[k], [v / z for v in j])
        if each:
            each(0, feats[0], out[0], None)
        return out

    def freeze(self) -> None:
        self.factor = [[[math.exp(v) for v in row] for row in table] for table in self.edge]

    def text(self, page: str) -> str:
        t = parse(page)
        return "\n".join(x for x, tag, p in zip(t.text, t.tag, self.marginals(t), strict=True) if not tag and p >= 0.5)


def _labels(t: Tree) -> list[int]:
    """From ``data-y``; a node without one has its parent's."""
    y = [0]
    for k in range(1, len(t.tag)):
        m = re.search(r"data-y=([01])", t.attrs[k]) if t.tag[k] else None
        y.append(int(m[1]) if m else y[t.parent[k]])
    return y


def train(pages: list[str], rounds: int = 40, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Gradient ascent (AdaGrad) on the log-likelihood of the labelled pages; gradients are observed minus expected counts."""
    model, trees = Model(), [parse(p) for p in pages]
    labels = [_labels(t) for t in trees]
    size_w: dict[str, float] = {}
    size_e = [[[1e-6, 1e-6], [1e-6, 1e-6]] for _ in KINDS]
    for _ in range(rounds):
        grad_w: dict[str, float] = {}
        grad_e = [[[0.0, 0.0], [0.0, 0.0]] for _ in KINDS]
        model.freeze()
        for t, y in zip(trees, labels, strict=True):

            def each(k, feats, p, joint, t=t, y=y):
                for f in feats[0]:
                    grad_w[f] = grad_w.get(f, 0.0) + y[k] - p
                if joint:
                    g, seen = grad_e[feats[1]], 2 * y[t.parent[k]] + y[k]
                    for i in range(4):
                        g[i // 2][i % 2] += (i == seen) - joint[i]

            model.marginals(t, each)
        for f, g in grad_w.items():
            g = g / len(trees) - decay * model.weight.get(f, 0.0)
            size_w[f] = size_w.get(f, 1e-6) + g * g
            model.weight[f] = model.weight.get(f, 0.0) + rate * g / math.sqrt(size_w[f])
        for table, g4, s4 in zip(model.edge, grad_e, size_e, strict=True):
            for i in range(2):
                for j in range(2):
                    g = g4[i][j] / len(trees) - decay * table[i][j]
                    s4[i][j] += g * g
                    table[i][j] += rate * g / math.sqrt(s4[i][j])
    model.freeze()
    return model


def labelled_pages(n: int = 240, seed: int = 11) -> list[str]:
    """Pages of many layouts made here for training; ``data-y`` says what is content.

    The words are random syllables, so that the model learns structure, lengths and names, not a vocabulary.
    """
    rnd = random.Random(seed)
    syllables = ["".join(rnd.choice(x) for x in ("bdfgklmnprst", "aeiou", "nrst ")).strip() for _ in range(60)]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.choice((1, 1, 2, 2, 3))))

    def sentence(lo: int, hi: int) -> str:
        s = " ".join(word() for _ in range(rnd.randint(lo, hi))).capitalize()
        return s + rnd.choice((".", ".", ".", "", "!", "?"))

    def prose() -> str:
        s = " ".join(sentence(1, 14) for _ in range(rnd.choice((1, 1, 1, 2, 4, 8, 15))))
        if rnd.random() < 0.2:
            s = s.replace(" ", f' <a href="/{word()}">{word()}</a> ', 1)
        if rnd.random() < 0.2:
            s = f"<b>{s}" + rnd.choice(("</b>", "", "<br>"))
        return s

    def para() -> str:
        return rnd.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>")).format(prose())

    def body() -> str:
        out = [f"<h1>{sentence(2, 10)}</h1>"] if rnd.random() < 0.8 else []
        for _ in range(rnd.choice((1, 2, 3, 5, 8, 14))):
            r = rnd.random()
            if r < 0.78:
                out.append(para())
            elif r < 0.84:
                out.append(f"<h2>{sentence(1, 6)}</h2>")
            elif r < 0.89:
                out.append("<ul>" + "".join(f"<li>{sentence(1, 12)}" + rnd.choice(("</li>", "")) for _ in range(rnd.randint(2, 5))) + "</ul>")
            elif r < 0.93:
                out.append(f"<blockquote>{rnd.choice((para, prose))()}</blockquote>")
            elif r < 0.96:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{sentence(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>")
            else:
                out.append(f"<figure><img src=x><figcaption>{sentence(2, 8)}</figcaption></figure>")
        if rnd.random() < 0.25:
            out.insert(rnd.randint(0, len(out)), aside())
        return "".join(out)

    def link() -> str:
        return f'<a href="/{word()}">{word()}</a>'

    def links(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(2, 8))) + f"</{tag}>"

    def text() -> str:
        return rnd.choice((lambda: sentence(1, 12), lambda: sentence(1, 12), para, prose))()

    def named(names: str, tags: str = "div div section aside") -> str:
        """An element outside the text, known by its name."""
        tag, name = rnd.choice(tags.split()), rnd.choice(names.split())
        inner = rnd.choice((text, text, links, lambda: text() + links(), lambda: f"<h3>{sentence(1, 3)}</h3>" + para()))()
        return f'<{tag} data-y="0" {rnd.choice(("class", "class", "id"))}="{name}">{inner}</{tag}>'

    def comments() -> str:
        tag, name = rnd.choice(("div", "section", "ol", "aside")), rnd.choice("comments comment-list reader-comments responses discussion replies disqus".split())
        one = "li" if tag == "ol" else rnd.choice(("div", "article", "p"))
        return f'<{tag} data-y="0" {rnd.choice(("class", "id"))}="{name}">' + "".join(f'<{one} class="{rnd.choice(("comment", "reply", "response"))}">{prose() if one == "p" else text()}</{one}>' for _ in range(rnd.randint(1, 5))) + f"</{tag}>"

    def form() -> str:
        return f'<form data-y="0" action="/x"><label>{sentence(1, 4)}</label><input type=text><p>{sentence(2, 10)}</p><button>{word()}</button></form>'

    def ad() -> str:
        return named("ad ads ad-banner advert advertisement adbox promo promotion sponsored sponsor banner-ad")

    def notice() -> str:
        return named("notice cookie cookie-notice cookie-banner consent gdpr alert popup modal banner newsletter subscribe signup paywall disclaimer", "div div section aside p")

    def aside() -> str:
        return rnd.choice((ad, ad, notice, form, lambda: f'<aside data-y="0">{text()}</aside>', lambda: named("share social related related-posts recommended more tags author-box widget toc"), lambda: f'<nav data-y="0">{links()}</nav>'))()

    def head() -> str:
        return rnd.choice((lambda: f'<nav data-y="0">{links()}</nav>', lambda: f'<header data-y="0">{rnd.choice((f"<h1>{sentence(1, 4)}</h1>", text()))}{rnd.choice(("", links(), f"<nav>{links()}</nav>"))}</header>', lambda: named("header top masthead site-header nav menu navbar navigation breadcrumb breadcrumbs logo topbar")))()

    def side() -> str:
        return rnd.choice((lambda: named("sidebar side right-col widget related popular archive sidebar-left trending"), lambda: f'<aside data-y="0">{rnd.choice((text(), links(), f"<h3>{word()}</h3>{para()}"))}</aside>'))()

    def foot() -> str:
        inner = rnd.choice((f"&copy; {word()}.example &middot; {sentence(2, 12)}", sentence(2, 12), links(), f"<p>Copyright {word()}</p>", para()))
        return rnd.choice((f'<footer data-y="0">{inner}</footer>', f'<footer data-y="0">{inner}', f'<div data-y="0" class="{rnd.choice("footer site-footer bottom copyright legal".split())}">{inner}</div>'))

    out = []
    for _ in range(n):
        r = rnd.random()
        name = rnd.choice("content main-content article post post-content entry entry-content story body article-body text page-content".split())
        if r < 0.5:
            main = f'<article data-y="1">{body()}</article>'
        elif r < 0.65:
            main = f'<main data-y="1">{rnd.choice((body(), f"<article>{body()}</article>"))}</main>'
        elif r < 0.9:
            main = f'<{rnd.choice(("div", "div", "section"))} data-y="1" {rnd.choice(("class", "id"))}="{name}">{body()}</div>'
        else:
            main = f'<div data-y="1">{body()}</div>'
        before = [f() for f in (head, ad, notice, form, side) if rnd.random() < 0.4]
        after = [f() for f in (comments, side, ad, form, notice) if rnd.random() < 0.3] + [foot()] * (rnd.random() < 0.85)
        inner = "".join([head(), *before, main, *after])
        if rnd.random() < 0.3:
            inner = f'<div {rnd.choice(("class", "id"))}="{rnd.choice(("wrapper", "container", "page", "layout", "site"))}">{inner}</div>'
        out.append(f'<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{inner}' + rnd.choice(("</body></html>", "")))
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    """Trained on ``labelled_pages()``: the same weights in every process."""
    return train(labelled_pages())


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``.

    White space is what Unicode calls so, the no-break space included.  Null, empty and text-free pages have text ''
    and length 0.  Rows aren't moved, merged or cut, repeated ones neither; very long pages are parsed whole, in time
    and memory proportional to their length; an empty table gives no rows; other columns are not read.
    """
    trained = model or default_model()
    weights, edge = trained.weight, trained.edge

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model()
        m.weight, m.edge = weights, edge
        m.freeze()
        for b in slices(batches, 1024):
            texts = [m.text(p) if p else "" for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.selectExpr("cast(page_id as long) page_id", "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
