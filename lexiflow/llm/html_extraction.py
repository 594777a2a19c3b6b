"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements from
the root to it. For each path, text length and punctuation are summed and
divided by its blocks; the two ratios are smoothed over the blocks in page
order, fused by their product, and smoothed down the paths: short blocks
(headings, list items) count with a share of what their container holds. Paths
that are mostly links score nothing, and what names itself as something else
(nav, footer, class="ad", ...) scores a fiftieth. Paths above a share of the
page's mean are content. The smallest element around nearly all content
text is the article; its blocks with content paths are the main text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm.common import read

#: Share of the page's mean score from which a path is content, and of a path's text from which links rule it out.
CONTENT, LINKS = 0.1, 0.6
#: What an element's name makes of the score of paths through it, and the share of a container's score that its children have.
OTHER, DOWNWARD = 0.02, 0.6
#: Share of the content text that a child must hold for the search of the article to go down to it.
DOWN = 0.85
#: Weights of a block's neighbours, nearest first, in smoothing.
KERNEL = (0.5, 0.25)

# Element names and words of class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
UNSEEN = frozenset("script style noscript template head title button select option textarea iframe svg canvas object audio video map".split())
OTHER_TAGS = frozenset("nav header footer aside form input label fieldset dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table tbody thead tfoot div article section main body html".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted popup modal overlay cookie cookies consent gdpr"
    " notice notices alert newsletter subscribe subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars aside widget"
    " related recommended recommendations share sharing social comment comments disqus reply replies respond footer header masthead copyright toolbar pagination pager"
    " search form skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_MARK = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？、]")


@dataclass
class Block:
    path: int
    element: int
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


@dataclass
class Page:
    """Blocks, and the trees of elements and of their tag paths: for each, its parent, which always comes before it."""

    blocks: list[Block] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])
    inside: list[bool] = field(default_factory=lambda: [False])  # an article or main, or within one
    path_parents: list[int] = field(default_factory=lambda: [0])
    weights: list[float] = field(default_factory=lambda: [1.0])  # of paths, by names


def _other(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element names itself as something else than content, and its class for the path."""
    if not attributes.strip():
        return False, ""
    named, css = False, ""
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            named = True
        elif name == "role":
            named |= value.lower() in ROLES
        elif name in ("class", "id"):
            css = css or (value if name == "class" else "#" + value)
            words = {w.lower() for w in _PARTS.findall(value)}
            named |= bool(words & (OTHER_WORDS - {"header"} if inside else OTHER_WORDS)) and tag not in ("html", "body", "article", "main")
    return named, css


def parse(page: str) -> Page:
    """The page's blocks of text in order, without text that is not seen. Each tag takes constant time, however deep it is."""
    out = Page()
    paths: dict[tuple[int, str], int] = {}
    stack = [("#root", 0, 0, False)]  # tag, element, path, unseen
    open_tags: Counter[str] = Counter()
    open_p: list[int] = []  # places of p in the stack
    stops: list[int] = []  # and of STOPS
    current: Block | None = None
    links = unseen = 0
    at, end = 0, len(page)

    def add(text: str) -> None:
        nonlocal current
        if unseen or not text:
            return
        if current is None:
            if not text.strip():
                return
            current = Block(stack[-1][2], stack[-1][1])
            out.blocks.append(current)
        current.parts.append(text)
        if links:
            current.link_chars += len(text)

    def pop_to(size: int) -> None:
        nonlocal unseen
        while len(stack) > size:
            tag, _, _, hidden = stack.pop()
            open_tags[tag] -= 1
            unseen -= hidden
            for places in (open_p, stops):
                if places and places[-1] == len(stack):
                    places.pop()

    while at < end:
        m = _TOKEN.search(page, at)
        add(entities.unescape(page[at : m.start() if m else end]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in INLINE:
            if tag == "br":
                add("\n")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        current, links = None, 0
        if closing:
            if open_tags[tag]:
                pop_to(max(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag) if stack[-1][0] != tag else len(stack) - 1)
            continue
        if tag in CLOSES_P and open_p and (not stops or stops[-1] < open_p[-1]):
            pop_to(open_p[-1])
        elif tag in SAME and any(open_tags[x] for x in SAME[tag]):
            for i in range(len(stack) - 1, stops[-1] if stops else 0, -1):
                if stack[i][0] in SAME[tag]:
                    pop_to(i)
                    break
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div", "article", "section"):
            continue
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = stop.start() if stop else end
        _, element, path, _ = stack[-1]
        inside = out.inside[element]
        named, css = _other(tag, m[3], inside)
        label = tag + (f".{css}" if css else "")
        known = paths.get((path, label))
        if known is None:
            known = paths[(path, label)] = len(out.path_parents)
            out.path_parents.append(path)
            out.weights.append(min(out.weights[path], OTHER if named or tag in OTHER_TAGS else 1.0))
        out.parents.append(element)
        out.inside.append(inside or tag in ("article", "main"))
        if tag == "p":
            open_p.append(len(stack))
        if tag in STOPS:
            stops.append(len(stack))
        open_tags[tag] += 1
        unseen += tag in UNSEEN
        stack.append((tag, len(out.parents) - 1, known, tag in UNSEEN))
    for b in out.blocks:
        b.text = " ".join("".join(b.parts).split())
    out.blocks = [b for b in out.blocks if b.text]
    return out


def content_paths(page: Page) -> set[int]:
    """Paths whose smoothed and fused ratios are content."""
    found, paths = page.blocks, len(page.path_parents)
    n, length, points, links = ([0] * paths for _ in range(4))
    for b in found:
        n[b.path] += 1
        length[b.path] += len(b.text)
        points[b.path] += len(_PUNCTUATION.findall(b.text))
        links[b.path] += b.link_chars

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i, v in enumerate(values):
            total, weight = v, 1.0
            for k, w in enumerate(KERNEL, 1):
                for j in (i - k, i + k):
                    if 0 <= j < len(values):
                        total, weight = total + w * values[j], weight + w
            out.append(total / weight)
        return out

    texts = smooth([length[b.path] / n[b.path] for b in found])
    marks = smooth([points[b.path] / n[b.path] for b in found])
    own = [0.0] * paths
    for b, t, m in zip(found, texts, marks, strict=True):
        own[b.path] += t * (1 + m) / n[b.path]
    own_paths = [p for p in range(paths) if n[p]]
    linked = {p for p in own_paths if links[p] > LINKS * length[p]}
    for p in range(paths - 1, 0, -1):  # sums of containers
        for sums in (n, length, points):
            sums[page.path_parents[p]] += sums[p]
    score = [0.0] * paths
    for p in range(paths):  # a container's share goes down to its children
        container = length[p] / n[p] * (1 + points[p] / n[p]) if n[p] else 0.0
        score[p] = max(own[p], container if p == 0 or not own[p] else 0.0, DOWNWARD * score[page.path_parents[p]])
    mean = sum(len(b.text) * score[b.path] for b in found) / sum(len(b.text) for b in found)
    return {p for p in own_paths if p not in linked and score[p] * page.weights[p] >= CONTENT * mean}


def main_text(html: str | None) -> str:
    """The article of a page; empty for null and empty pages and for pages without content."""
    page = parse(html or "")
    if not page.blocks:
        return ""
    content = content_paths(page)
    kept = [b for b in page.blocks if b.path in content]
    inside = [b for b in kept if page.inside[b.element]]  # an article or main, where it holds content, is where to look
    if sum(len(b.text) for b in inside) * 2 > sum(len(b.text) for b in kept):
        kept = inside
    held, total = [0] * len(page.parents), sum(len(b.text) for b in kept)
    for b in kept:  # for the elements around a block's own one
        held[page.parents[b.element]] += len(b.text)
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
    article = 0
    for e in range(1, len(held)):  # down to the smallest element around nearly all content
        if page.parents[e] == article and held[e] >= DOWN * total:
            article = e
    within = [e == article for e in range(len(held))]
    for e in range(1, len(held)):
        within[e] |= within[page.parents[e]]
    return " ".join(b.text for b in kept if within[b.element])


def extract(pages: DataFrame, html_col: str = "html", id_cols: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of ``pages``: id_cols, text, n_chars.

    Null and empty pages give an empty text, and so do pages without content.
    Null ids and repeated rows give a row each, an empty table an empty one;
    other columns, whatever their names, are ignored. Pages of any length and
    depth are read whole, in time that grows in proportion to them.
    """

    @F.pandas_udf("string")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(main_text, na_action=None)

    return pages.select(*id_cols, udf(F.coalesce(F.col(html_col), F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
