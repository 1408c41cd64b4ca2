"""Main text of web pages: flat text blocks, told apart by a decision tree.

A page becomes a flat list of text blocks. Each block is described by its words and link density, those of its
neighbours, whether these stand in the same element, and whether an element around it is marked; a decision tree, grown from a small
labelled table of pages, keeps the blocks of the article.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A comment, a tag or a declaration. A value in quotes starts behind an equals sign only; any other ends at white space.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_HINT = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content is not markup.
_RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Elements whose text is never part of a text.
_SILENT = frozenset("script style textarea title iframe noframes xmp head noscript template svg math canvas object select button option datalist".split())
#: Elements that hold blocks.
_HOLDERS = frozenset("html body div section article main nav header footer aside form fieldset ul ol dl table tbody thead tfoot figure dialog menu blockquote details center".split()) | (_SILENT - _RAW)
#: Elements that are a block.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre address figcaption caption summary hr legend label".split())
_CHROME = frozenset("nav footer aside menu dialog".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that class, id and role names are made of which stand for what surrounds an article, ...
_AROUND = frozenset(
    "ad ads adv advert advertisement adbox banner sponsor sponsored promo promotion sidebar aside nav navbar navigation menu breadcrumb breadcrumbs footer foot header masthead topbar "
    "cookie cookies consent gdpr notice alert warning popup modal overlay comment comments commentlist reply replies disqus respond share sharing social related recommended subscribe newsletter "
    "signup login form search tags pager pagination copyright legal disclaimer toolbar skip contentinfo complementary".split()
)
#: ... for the article, ...
_INSIDE = frozenset("article main content post entry story body text".split())
#: ... and for nothing by themselves. A name with any other word in it says nothing.
_PLAIN = frozenset("site page global top bottom left right inner outer box block wrapper wrap container area section list item items links bar widget widgets primary secondary the js user users reader readers visitor slot unit zone panel module row column group holder placeholder".split())

#: ``place``: -1 if an element around the block stands for what surrounds articles, 1 if one stands for an article, else 0.
#: ``with_before``, ``with_after``: whether the neighbour stands in the same element. ``page_share``: its part of the page's words.
FEATURES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "with_before", "with_after", "page_share", "place", "place_on_page", "heading", "item")


@cache
def _name(name: str) -> tuple[int, int]:
    """Whether a class, id or role name stands for what surrounds an article, and for an article."""
    words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()))
    around, inside = words & _AROUND, words & _INSIDE
    if words - around - inside - _PLAIN:
        return 0, 0
    return int(bool(around)), int(bool(inside) and not around)


#: An element that browsers don't show.
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|\S*)display\s*:\s*none", re.I)
_HREF = re.compile(r"(?:^|\s)href\s*=", re.I)
#: What an open link has shown: nothing yet, words of a block, or whole blocks that it stands around.
_NO_LINK, _FRESH, _INLINE, _AROUND_BLOCKS = range(4)


def _hints(tag: str, attributes: str) -> tuple[int, int]:
    around, inside = int(tag in _CHROME), int(tag in ("article", "main"))
    if "=" in attributes and tag not in ("html", "body"):
        for values in _HINT.findall(attributes):
            for name in "".join(values).split():
                own = _name(name)
                around |= own[0]
                inside |= own[1]
    return around, int(inside and not around)


def blocks(page: str) -> list[tuple[str, tuple]]:
    """The text blocks in page order, each with (words, link words, place, heading, item, holder)."""
    out: list[tuple[str, tuple]] = []
    # tag, around, forms, inside, silent (each summed up from the root) and number of each open element that holds blocks
    stack: list[tuple[str, int, int, int, int, int]] = [("", 0, 0, 0, 0, 0)]
    open_: Counter[str] = Counter()
    made = 0
    leaf = ("", 0)
    pieces: list[str] = []
    linked, breaks = 0, 0
    link, depth, mute = _NO_LINK, 0, False  # the open link, the elements around it, and whether this block is hidden

    def flush() -> None:
        nonlocal linked, breaks
        words = "".join(pieces).split()
        if words:
            _, around, forms, inside, _, holder = stack[-1]
            place = -1 if around or forms or leaf[1] else int(inside > 0)
            out.append((" ".join(words), (len(words), min(linked, len(words)), place, int(leaf[0] in _HEADINGS), int(leaf[0] in ("li", "td", "th", "dt", "dd")), holder)))
        pieces.clear()
        linked = breaks = 0

    def text(raw: str) -> None:
        nonlocal linked, breaks, link
        if raw and not stack[-1][4] and not mute:
            decoded = entities.unescape(raw) if "&" in raw else raw
            pieces.append(decoded)
            if link:
                linked += len(decoded.split())
                if link == _FRESH and not decoded.isspace():
                    link = _INLINE
            if breaks and not decoded.isspace():
                breaks = 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in _RAW and not m[1]:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
        elif tag == "a":
            link, depth = (_FRESH if not m[1] and _HREF.search(m[3]) else _NO_LINK), len(stack)
        elif tag == "br":
            pieces.append(" ")
            breaks += 1
            if breaks > 1:
                flush()
        elif tag in _HOLDERS:
            flush()
            leaf, mute = ("", 0), False
            link = _AROUND_BLOCKS if link == _AROUND_BLOCKS or link == _FRESH and not m[1] else _NO_LINK
            if not m[1]:
                _, around, forms, inside, silent, _ = stack[-1]
                own, article = _hints(tag, m[3])
                if tag == "header" or own and not around and inside and re.search("header", m[3], re.I):
                    own = int(not inside)  # the head of an article is its own
                forms = 0 if tag in ("article", "main") else forms + (tag in ("form", "fieldset"))  # some pages are one form
                made += 1
                stack.append((tag, around + own, forms, inside + article, silent + (tag in _SILENT or bool(_HIDDEN.search(m[3]))), made))
                open_[tag] += 1
            elif open_[tag]:
                while (gone := stack.pop()[0]) != tag:
                    open_[gone] -= 1
                open_[tag] -= 1
                link = link if len(stack) >= depth else _NO_LINK  # a link that was never closed ends with what holds it
        elif tag in _LEAVES:
            flush()
            link = _AROUND_BLOCKS if link == _AROUND_BLOCKS or link == _FRESH and not m[1] else _NO_LINK
            leaf, mute = (("", 0), False) if m[1] else ((tag, _hints(tag, m[3])[0]), bool(_HIDDEN.search(m[3])))
        elif tag in _SILENT:
            pieces.append(" ")
    flush()
    return out


def features(found: list[tuple[str, tuple]]) -> np.ndarray:
    """One row of FEATURES for each block."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    own = np.array([b[1] for b in found], dtype=float)
    words, density, holder = own[:, 0], own[:, 1] / np.maximum(own[:, 0], 1), own[:, 5]
    before = lambda x: np.concatenate(([0.0], x[:-1]))
    after = lambda x: np.concatenate((x[1:], [0.0]))
    same = np.append((holder[1:] == holder[:-1]).astype(float), 0.0)
    return np.column_stack((words, density, before(words), before(density), after(words), after(density), before(same), same, words / words.sum(), own[:, 2], np.full(len(own), own[:, 2].max()), own[:, 3:5]))


_VOCABULARY = "river night morning field farmer rain road small town said after water long year house people work found while under between market young school early first many bridge train paper window stone"


def labelled_page(seed: int) -> str:
    """A page of the labelled table. Texts start with + (article) or - (all else). Lengths, links, order and the use of names
    and article elements vary with the seed; there are as many pages with such marks as without."""
    rng = random.Random(f"page {seed}")
    vocabulary = _VOCABULARY.split()
    say = lambda least, most: " ".join(rng.choices(vocabulary, k=rng.randint(least, most)))
    link = lambda least, most: f"<a href='/x'>{say(least, most)}</a>"
    marked = rng.random() < 0.5
    named = lambda name: f" class='{name}'" if marked and rng.random() < 0.8 else ""

    def menu() -> str:
        links = [link(1, 3) for _ in range(rng.randint(3, 9))]
        if rng.random() < 0.4:
            return f"<ul{named('menu')}>" + "".join(f"<li>-{x}" for x in links) + "</ul>"
        if rng.random() < 0.5:
            return "<table>" + "".join(f"<tr><td>-{x}" for x in links) + "</table>"
        return f"<div{named('nav-links')}>-{' '.join(links)}</div>"

    brief = rng.random() < 0.35  # an article of a few short paragraphs

    def paragraph() -> str:
        size = rng.random() * (0.5 if brief else 1)
        if size < 0.2:
            return "<p>+" + say(1, 9)
        if size < 0.3:
            return f"<p>+{say(2, 12)} {link(1, 6)} {say(0, 9)}"
        if size < 0.33:
            return f"<p>+{link(2, 9)}"
        if brief:
            return f"<p>+{say(6, 35)}"
        return "<p>+" + say(10, 45) + (f" {link(1, 5)} {say(3, 20)}" if rng.random() < 0.25 else "") + (f" {say(20, 90)}" if rng.random() < 0.4 else "")

    def article() -> str:
        out = [f"<h1>+{say(2, 9)}</h1>"]
        for _ in range(rng.randint(2, 4) if brief else rng.randint(3, 9)):
            out.append(paragraph() + "</p>")
            if rng.random() < 0.12:
                out.append(f"<h2>+{say(1, 6)}</h2>{paragraph()}</p>")
            if rng.random() < 0.08:
                out.append("<ul>" + "".join(f"<li>+{say(2, 20)}" for _ in range(rng.randint(2, 5))) + "</ul>")
            if rng.random() < 0.06:
                out.append(f"<blockquote>+{say(8, 40)}</blockquote>")
        out.append(f"<p>+{say(12, 60)}</p>")
        text = "".join(out)
        if marked:
            return rng.choice(["<article>{}</article>", "<main>{}</main>", "<div class='post-content'>{}</div>", "<article><div>{}</div></article>"]).format(text)
        return text if rng.random() < 0.2 else f"<div>{text}</div>"

    advert = lambda: f"<div{named('ad')}>{'<p>' if rng.random() < 0.3 else ''}-{say(5, 50)}{' ' + link(1, 3) if rng.random() < 0.4 else ''}</div>"
    notice = lambda: f"<div{named('cookie-notice')}>-{say(8, 40)} {link(1, 3)}</div>"
    title = lambda: f"<div{named('header')}>{'<h1>' if rng.random() < 0.3 else ''}-{say(1, 4)}</div>"
    teasers = lambda: f"<div{named('related')}><h3>-{say(1, 3)}</h3>" + "".join(f"<p>-{link(3, 9)}{' ' + say(3, 14) if rng.random() < 0.3 else ''}</p>" for _ in range(rng.randint(2, 5))) + "</div>"
    share = lambda: "<div>-" + " ".join(link(1, 1) for _ in range(3)) + "</div>"
    footer = lambda: rng.choice([f"<div{named('footer')}>-{say(3, 25)}</div>", f"<div{named('footer')}>-{say(2, 6)} {link(1, 3)} {link(1, 3)}</div>", f"<footer>-{say(3, 40)}</footer>"])
    comments = lambda: "<section class='comments'>" + "".join(f"<p>-{say(2, 50)}</p>" for _ in range(rng.randint(1, 4))) + "</section>"
    inside = lambda: f"<div class='share'>-{link(1, 2)}</div>" if rng.random() < 0.5 else f"<aside>-{say(8, 50)}</aside>"

    if rng.random() < 0.12:  # a text and nothing else
        return "".join(f"<p>+{say(1, 60)}" for _ in range(rng.choice([1, 1, 1, 2, 3])))
    before = [f() for f in rng.sample([title, menu, advert, notice, share], rng.randint(1, 4))]
    after = [f() for f in rng.sample([share, teasers, advert, menu] + ([comments, comments] if marked else []), rng.randint(0, 3))]
    body = article()
    if marked and rng.random() < 0.4:
        cut = body.rindex("<p>+")
        body = body[:cut] + inside() + body[cut:]
    return "<body>" + "".join(before) + body + "".join(after) + (footer() if rng.random() < 0.8 else "") + "</body>"


#: The labelled table has so many pages.
LABELLED = 200


def labelled(pages: int = LABELLED, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: article) of the labelled table."""
    rows, labels = [], []
    for seed in range(first, first + pages):
        found = blocks(labelled_page(seed))
        rows.append(features(found))
        labels += [int(b[0][0] == "+") for b in found]
    return np.vstack(rows), np.array(labels)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4) -> tuple:
    """A tree of (feature, threshold, low, high) and leaves (share of 1,), by the Gini index; ties to the first."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return (share,)
    best, whole = None, len(y)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, ones = x[order, f], np.cumsum(y[order])
        n = np.flatnonzero(value[1:] > value[:-1]) + 1  # rows below each threshold
        n = n[(n >= least) & (n <= whole - least)]
        if len(n):
            p, q = ones[n - 1], ones[-1] - ones[n - 1]
            cost = p * (n - p) / n + q * (whole - n - q) / (whole - n)
            i = int(cost.argmin())
            if best is None or cost[i] < best[0] - 1e-12:
                best = (cost[i], f, (value[n[i] - 1] + value[n[i]]) / 2)
    if best is None or best[0] >= whole * share * (1 - share) - 1e-12:
        return (share,)
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


@cache
def tree() -> tuple:
    return grow(*labelled())


def decide(node: tuple, x: np.ndarray) -> np.ndarray:
    """Whether each row is article text."""
    if len(node) == 1:
        return np.full(len(x), node[0] >= 0.5)
    low = x[:, node[0]] <= node[1]
    out = np.empty(len(x), dtype=bool)
    out[low], out[~low] = decide(node[2], x[low]), decide(node[3], x[~low])
    return out


def main_text(page: str, node: tuple) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, decide(node, features(found))) if keep)


def main_text_column(page: Column) -> Column:
    node = tree()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p or "", node) for p in pages], dtype=object)

    return run(page)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with ``text_col``, the main text of each whole page; blocks are joined by \\n.

    Null and empty pages give an empty text, pages without an article too. Unclosed elements and comments end with the
    page; character references are decoded once. Elements may be nested to any depth, texts may be of any length. Rows are independent: nothing is shuffled, repeats come out as often
    as they are. A column named ``text_col`` is replaced, other columns pass through.
    """
    return pages.withColumn(text_col, main_text_column(F.col(html_col).cast("string")))
