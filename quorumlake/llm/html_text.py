"""Main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each under its root-to-leaf path of block
tags. For every path the text length outside links and the punctuation marks per
block are summed up (text-to-path and punctuation-to-path ratios), smoothed along
the page, less so between paths that differ more, and fused by their geometric
mean. Paths above a threshold of the values' standard deviation and mean are content.

Content paths select the article: the article and main elements where they hold
half of the content, or else the smallest container of all content blocks, from the
headline before it. In it blocks under other paths stay if their tag is one of
running text and their path isn't made of links; what no path and no such tag
vouches for goes. Tags and roles that are no article go at once. Names that mark readers'
words, adverts and notices count unless their element is the page's wrapper. Names of menus, sidebars and the like mark an
element unless content says that it is a wrapper; weaker names only decide where the ratio is low.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTH = (0.054, 0.242, 0.399, 0.242, 0.054)
#: A neighbour counts so much less for every step between its path and a block's own.
STEP = 0.25
#: A path is content from so many standard deviations, and from so much of the mean by text length.
DEVIATIONS, MEAN_SHARE = 0.5, 0.5
#: A path whose text lies in links by this share is a list of links.
LINKED = 0.8
#: In an article, so many blocks under a path of links are a menu.
MENU_BLOCKS = 3
ARTICLE_TAGS = frozenset({"article", "main"})
#: Tags that hold the blocks of an article; lists, tables and the like are its parts.
CONTAINER_TAGS = ARTICLE_TAGS | {"html", "body", "section", "div", "center"}
#: Tags of running text.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th caption figcaption blockquote pre summary".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：·]")

#: Tags of HTML.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN_TAGS = frozenset("script style noscript template head title iframe object svg math canvas audio video map select datalist button textarea input".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of class names and ids that mark readers' words, adverts and notices.
FOREIGN_WORDS = frozenset(
    "comment comments commentlist respond replies disqus ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "cookie cookies consent gdpr popup newsletter subscribe subscription signup notice notices".split()
)
#: Those that mark menus, headers, footers, sidebars and forms, or a wrapper around the article beside such.
SIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer foot masthead topbar toolbar share sharing social related "
    "recommended recommendations pagination pager login modal".split()
)
#: Those that mark an element only where the ratio of its path is low.
WEAK_WORDS = frozenset("header form search banner overlay alert widget skip reply copyright legal disclaimer teaser".split())
#: Names of the article itself, beside which weak words mark nothing.
ARTICLE_WORDS = frozenset("article content entry post story main".split())
#: A start tag of the set closes an open tag of the key, if no other block lies between.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"body", "html", "option", "optgroup", "title"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
}
#: Words that a name's last part may be without telling what its element is.
GENERAL_WORDS = frozenset(
    "list lists box boxes area section sections container wrapper wrap block blocks banner bar item items body text slot unit top bottom left right inner outer thread "
    "count author meta content link links post posts article articles story stories news button buttons icon icons widget widgets panel panels title message messages "
    "info holder group row column col zone place placeholder space frame inline small large desktop mobile id".split()
)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

GONE, SIDE, WEAK, FOREIGN = 1, 2, 3, 4


def named(value: str) -> int:
    """What a class or id says: the last word of a compound that isn't a general one decides; listed words before it are a hint only."""
    found = 0
    for name in value.lower().split():
        words = [w for w in _WORD.findall(name) if len(w) > 1]
        telling = next((w for w in reversed(words) if w not in GENERAL_WORDS), "")
        if telling in FOREIGN_WORDS:
            return FOREIGN
        if telling in SIDE_WORDS:
            found = SIDE
        elif not found and set(words) & (FOREIGN_WORDS | SIDE_WORDS):
            found = WEAK
    return found


@dataclass(frozen=True)
class Block:
    """A stretch of text under one path: (tag, element's number) from the root, and the marks (number, SIDE or WEAK) on it."""

    path: tuple[tuple[str, int], ...]
    marks: tuple[tuple[int, int], ...]
    text: str
    linked: int

    @property
    def tags(self) -> tuple:
        """What makes two paths one: tags, and whether something is marked."""
        return (*(t for t, _ in self.path), bool(self.marks))

    @property
    def article(self) -> int | None:
        """The number of the outermost article or main element on the path."""
        return next((n for t, n in self.path if t in ARTICLE_TAGS), None)


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, int, int]] = [("", "", 0, 0)]  # tag, label, number, mark
        self.blocks: list[Block] = []
        self.text: list[str] = []
        self.linked = self.count = self.gone = self.links = 0

    def cut(self) -> None:
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                path = tuple((label, n) for _, label, n, _ in self.open if label)
                self.blocks.append(Block(path, tuple((n, m) for _, _, n, m in self.open if m), text, min(self.linked, len(text))))
            self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in VOID_TAGS and tag != "hr":
            return
        block = tag in BLOCK_TAGS
        if block:
            self.cut()
            for k in range(len(self.open) - 1, 0, -1):
                if tag in CLOSED_BY.get(self.open[k][0], ()):
                    self.close_to(k)
                    break
                if self.open[k][0] in BLOCK_TAGS:
                    break
        if tag == "hr":
            return
        self.count += 1
        mark = GONE if tag in UNSEEN_TAGS else self.mark(tag, attrs)
        if not block and mark in (SIDE, FOREIGN):
            mark = GONE
        elif not block and mark == WEAK:
            mark = 0
        self.gone += mark == GONE
        self.links += tag == "a"
        self.open.append((tag, tag if block else "", self.count, mark))

    def mark(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        inside = any(x[0] in ARTICLE_TAGS for x in self.open)
        if tag in BOILERPLATE_TAGS and not (tag == "header" and inside):
            return GONE
        if tag in ("html", "body", "article", "main", "h1"):
            return 0
        words: set[str] = set()
        found = 0
        for name, value in attrs:
            if value and name == "role" and value.lower() in BOILERPLATE_ROLES:
                return GONE
            if value and name in ("class", "id"):
                words.update(_WORD.findall(value.lower()))
                one = named(value)
                found = one if found != FOREIGN and (one in (FOREIGN, SIDE) or not found) else found
        if found in (FOREIGN, SIDE):
            return found
        weak = found == WEAK or (words & WEAK_WORDS and not words & ARTICLE_WORDS and not (tag == "header" and inside))
        return WEAK if weak else 0

    def close_to(self, k: int) -> None:
        self.gone -= sum(x[3] == GONE for x in self.open[k:])
        self.links -= sum(x[0] == "a" for x in self.open[k:])
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        block = tag in BLOCK_TAGS
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                if block:
                    self.cut()
                self.close_to(k)
                return
            if not block and self.open[k][0] in BLOCK_TAGS:
                return

    def handle_data(self, data: str) -> None:
        if not self.gone:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str) -> list[Block]:
    page = _Page()
    page.feed(html)
    page.close()
    page.cut()
    return page.blocks


def ratios(found: list[Block]) -> list[float]:
    """The fused, smoothed value of each block's path."""
    paths = [b.tags for b in found]
    length: dict[tuple, float] = defaultdict(float)
    marks: dict[tuple, float] = defaultdict(float)
    times: dict[tuple, int] = defaultdict(int)
    for path, b in zip(paths, found, strict=True):
        length[path] += len(b.text) - b.linked
        marks[path] += len(_PUNCTUATION.findall(b.text))
        times[path] += 1
    near: dict[tuple, float] = {}

    def closeness(x: tuple, y: tuple) -> float:
        if (x, y) not in near:
            same = next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
            near[x, y] = STEP ** (len(x) + len(y) - 2 * same)
        return near[x, y]

    half = len(SMOOTH) // 2

    def smoothed(values: list[float]) -> list[float]:
        return [
            v + sum(SMOOTH[j - i + half] * closeness(paths[i], paths[j]) * (values[j] - v) for j in range(max(0, i - half), min(len(values), i + half + 1)) if paths[i] != paths[j])
            for i, v in enumerate(values)
        ]

    texts, points = smoothed([length[p] / times[p] for p in paths]), smoothed([marks[p] / times[p] for p in paths])
    of_path: dict[tuple, float] = defaultdict(float)
    for path, x, y in zip(paths, texts, points, strict=True):
        of_path[path] += math.sqrt(x * (1 + y)) / times[path]
    return [of_path[p] for p in paths]


def content(found: list[Block]) -> list[bool]:
    """Whether each block's path is content; all are if none is."""
    values = ratios(found)
    weights = [len(b.text) for b in found]
    mean = sum(values) / len(values)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    least = max(DEVIATIONS * deviation, MEAN_SHARE * sum(v * w for v, w in zip(values, weights, strict=True)) / sum(weights))
    chosen = [v >= least and v > 0 for v in values]
    return chosen if any(chosen) else [True] * len(found)


def _before_main(b: Block, number: int) -> bool:
    """Whether the element of this number lies around the block's main element, if it has one."""
    return all(n > number for t, n in b.path if t == "main")


def _without_foreign(found: list[Block]) -> list[Block]:
    """The blocks outside readers' words, adverts and notices.

    An element that is named so is the page's wrapper if it holds the first
    headline or a main element, or, on a page with neither, if there is
    nothing but links and sidebars outside it.
    """
    foreign = {n for b in found for n, m in b.marks if m == FOREIGN}
    if not foreign:
        return found
    first = next((b for b in found if b.path and b.path[-1][0] == "h1"), None)
    heads = [b for b in found if b is first or any(t == "main" for t, _ in b.path)]
    if heads:
        wrappers = {n for b in heads for n, m in b.marks if m == FOREIGN and _before_main(b, n)}
    else:
        said = any(b.linked < LINKED * len(b.text) for b in found if not any(m in (FOREIGN, SIDE) for _, m in b.marks))
        wrappers = set() if said else foreign
    return [b for b in found if all(m != FOREIGN or n in wrappers for n, m in b.marks)]


def _unmarked(found: list[Block], chosen: list[bool]) -> list[bool]:
    """Which blocks no mark takes out: an element that holds most of the content is a wrapper, and a weak mark yields to a high ratio of its block or of most of its element.

    On a page with an article or main element only what lies around or inside one can be a wrapper.
    """
    total = sum(len(b.text) for b, c in zip(found, chosen, strict=True) if c)
    weight: dict[int, int] = defaultdict(int)
    size: dict[int, int] = defaultdict(int)
    related: set[int] = set()
    for b, c in zip(found, chosen, strict=True):
        for n, _ in b.marks:
            weight[n] += len(b.text) if c else 0
            size[n] += len(b.text)
            if b.article is not None:
                related.add(n)
    articles = any(b.article is not None for b in found)
    wrappers = {n for n, w in weight.items() if 2 * w > total and (not articles or n in related)}
    return [all(n in wrappers or m == FOREIGN or (m == WEAK and (c or 2 * weight[n] > size[n])) for n, m in b.marks) for b, c in zip(found, chosen, strict=True)]


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by empty lines; empty if there are none."""
    found = _without_foreign(blocks(html or ""))
    if not found:
        return ""
    keep = _unmarked(found, content(found))
    found = [b for b, k in zip(found, keep, strict=True) if k]
    if not found:
        return ""
    chosen = content(found)
    linked: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
    for b in found:
        one = linked[b.tags]
        one[0], one[1], one[2] = one[0] + b.linked, one[1] + len(b.text), one[2] + 1

    def menu(b: Block, least: int) -> bool:
        links, size, times = linked[b.tags]
        return links >= LINKED * size and times >= least

    seeds = [b for b, c in zip(found, chosen, strict=True) if c]
    if 2 * sum(len(b.text) for b in seeds if b.article is not None) >= sum(len(b.text) for b in seeds):
        kept, spoken = [], False
        for b, c in zip(found, chosen, strict=True):
            # A list of links belongs to the article once it has begun, as what a text refers to.
            if b.article is not None and (spoken or not menu(b, MENU_BLOCKS)):
                kept.append(b.text)
                spoken = spoken or c
        return "\n\n".join(kept)
    # The deepest container on the path of every seed.
    shared = list(seeds[0].path)
    for b in seeds:
        del shared[next((k for k, (x, y) in enumerate(zip(shared, b.path, strict=False)) if x != y), min(len(shared), len(b.path))) :]
    while shared and shared[-1][0] not in CONTAINER_TAGS:
        shared.pop()
    inside = [not shared or shared[-1] in b.path for b in found]
    begin, end = inside.index(True), len(inside) - inside[::-1].index(True)
    # A headline beside the container or one around it, and what lies between.
    heads = (k for k in range(begin) if found[k].path and found[k].path[-1][0] == "h1" and set(found[k].path[:-1]) <= set(shared))
    begin = max(heads, default=begin)
    vouched = [c or not b.path or (b.path[-1][0] in TEXT_TAGS and not menu(b, 1)) for b, c in zip(found, chosen, strict=True)]
    return "\n\n".join(found[k].text for k in range(begin, end) if vouched[k])


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The input's columns with text_col and n_chars_col in place of html_col.

    A null page is empty; an empty text has 0 code points. Every row is kept,
    repeated ones too, and a page is read whole, however long. Columns of the
    input that are named like the new ones are replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], text_col, n_chars_col])

    others = [c for c in pages.columns if c not in (html_col, text_col, n_chars_col)]
    kinds = pages.select(*others).schema
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds), f"`{text_col}` string", f"`{n_chars_col}` long"])
    return pages.select(*others, F.col(html_col).cast("string").alias("__html")).mapInArrow(run, out)
