"""Main text of web pages from a stream of parser events.

The standard library's parser sends events; they become lines, one per block element. A line's
ratio is its text outside links over its tags. Ratios are smoothed with a Gaussian kernel and
split at a threshold between their two clusters; lines above it are content. The regions that hold
content are the article: every article and main element with some where there is one, else the smallest element that
holds all lines of content, from its first such line to its last, without lines below the border that are mostly links; paragraphs
and headings beside a line of content count as well, and a first-level heading just before the region. Of an article's
header its headings and whole sentences stay. An article
is left out only if it is nested in another article of which it isn't the larger part. A class or id that names
page furniture doesn't count for a wrapper (an element with an article or most of the page's text inside), nor for headings;
a name that may be the text's topic (``share-price``) counts only with the shape of links or low ratios without a paragraph.
Every step is linear in the page: sums go from the elements to their parents once.

Defined results: null and empty pages, empty tables and pages with boilerplate only give an empty text or no rows. Markup that is
not closed is closed by the parser's end. Text without markup is its own article. Pages are judged alone, so
repeated rows give equal rows and ties can't arise; long and deep pages are read whole. Only ``id_cols`` are passed on, so other columns
may have any name but ``text``.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
RADIUS = 2

# Element names of HTML and words that name page furniture in ids and classes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object canvas svg math audio video head title".split())
FURNITURE = frozenset("nav footer aside form dialog menu button select option textarea input label fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar side footer header masthead topbar toolbar "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist reply replies respond disqus discussion responses "
    "share sharing social related recommended recommendations widget pagination pager search "
    "copyright legal disclaimer skip hidden".split()
)
# Those that may also stand for what a text is about: beside a word that isn't of layout they need the shape of links.
TOPICS = frozenset(
    "side share sharing social search legal notice alert banner menu header skip hidden comment comments reply replies respond "
    "responses discussion related recommended promotion login subscription disclaimer copyright".split()
)
LAYOUT = frozenset(
    "area article articles bar block bottom box button buttons col column container content entry fixed form global group holder "
    "icon icons inner item items left link links list main module outer page panel post posts primary right row secondary section "
    "site sticky top unit wrap wrapper zone".split()
)
# Those of the names above that stand for a list of other people's or other pages' pieces, which may be articles.
OTHERS = frozenset(
    "comment comments commentlist reply replies respond disqus discussion responses related recommended recommendations".split()
)
# Names that an article gives to the element around its own headline.
OWN_HEADER = frozenset(("header", "masthead"))
# How a line begins that states rights; such lines of low ratio at the end of a page without an article element go.
RIGHTS = re.compile(r"©|\(c\)|copyright\b|all rights reserved\b", re.IGNORECASE)
# What an article's own header may hold beside headings; paragraphs there are sentences.
IN_HEADER = frozenset("p div section header blockquote figure figcaption".split())
ENDS = ".!?…。।؟”»\"'"
CLOSES_P = BLOCKS - {"body", "html", "caption", "option", "optgroup", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
ITEM_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


def _furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is furniture by its tag, role or style."""
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    for name, value in attrs:
        v = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and v == "true":
            return True
        if name == "role" and v in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
            return True
    return False


def _named(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> tuple[bool, bool]:
    """Whether a class or id names an element as furniture for certain, or only if it has the shape of links.

    Headings have no such names, paragraphs only by their classes.
    """
    certain = maybe = False
    if tag in HEADINGS or tag in ("html", "body", "main", "article"):
        return certain, maybe
    for name, value in attrs:
        if name != "class" and (name != "id" or tag == "p"):
            continue
        for token in (value or "").lower().split():
            parts = set(re.split(r"[_-]+", token)) - (OWN_HEADER if in_article else set())
            found = parts & NAMES
            plain = all(w in NAMES or w in LAYOUT or not w.strip("0123456789") for w in parts)
            certain |= bool(found) and (plain or not found <= TOPICS)
            maybe |= bool(found)
    return certain, maybe and not certain


def _others(attrs: list[tuple[str, str | None]]) -> bool:
    return any(name in ("class", "id") and OTHERS & set(re.split(r"[\s_-]+", (value or "").lower())) for name, value in attrs)


class _Lines(HTMLParser):
    """Collects lines ``(words, tags, link characters, element, furniture)`` from parser events.

    ``furniture`` is by tag, role or style. Elements are numbered as they open; ``parents`` leads from each to the one around it.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.open: list[tuple[str, int, bool]] = []  # name, number, whether it or an element around it is furniture
        self.places: dict[str, list[int]] = {}  # positions of each name among the open elements
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.blocks: list[int] = []  # the nearest block element, itself included
        self.named: dict[int, bool] = {}  # elements named as furniture, and whether for a list of others' pieces
        self.doubtful: set[int] = set()
        low = html.lower()
        self.ends = {tag: low.count(f"</{tag}") for tag in RAW}  # a raw element without an end is passed over
        self.raw = 0
        self.skip_name = ""
        self.text: list[str] = []
        self.tags = self.link_chars = self.links = 0

    def flush(self) -> None:
        words = " ".join("".join(self.text).split())
        if words:
            number, furniture = (self.open[-1][1], self.open[-1][2]) if self.open else (-1, False)
            if number >= 0 and self.kinds[self.blocks[number]] == "p" and self.in_header() and words[-1] not in ENDS:
                furniture = True  # who wrote it and when
            self.lines.append((words, max(1, self.tags), min(self.link_chars, len(words)), number, furniture))
        self.text, self.tags, self.link_chars = [], 0, 0

    def push(self, tag: str, furniture: bool) -> int:
        number = len(self.kinds)
        around = self.open[-1][1] if self.open else -1
        self.kinds.append(tag)
        self.parents.append(around)
        self.blocks.append(number if tag in BLOCKS or around < 0 else self.blocks[around])
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, number, furniture))
        self.links += tag == "a"
        return number

    def pop(self) -> None:
        tag, _, _ = self.open.pop()
        self.places[tag].pop()
        self.links -= tag == "a"

    def close_to(self, at: int) -> None:
        self.flush()
        while len(self.open) > at:
            self.pop()

    def in_header(self) -> bool:
        """Whether the element now open is in a header of an article."""
        return self.last("header") >= 0 and (self.last("article") >= 0 or self.last("main") >= 0)

    def last(self, tag: str) -> int:
        return self.places[tag][-1] if self.places.get(tag) else -1

    def find(self, tag: str, stop: set[str]) -> int:
        at = self.last(tag)
        return at if at >= 0 and all(self.last(s) < at for s in stop) else -1

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.raw:
            self.raw += tag == self.skip_name
            return
        if tag in RAW:
            if tag != "head" and self.ends[tag] > 0:
                self.raw, self.skip_name = 1, tag
            return
        if tag == "br":
            self.text.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag in CLOSES_P and (at := self.find("p", {"table", "td", "button", "li", "div", "article", "section"})) >= 0:
            self.close_to(at)
        if tag in ITEM_ENDS and (at := self.find(tag, ITEM_ENDS[tag])) >= 0:
            self.close_to(at)
        if tag == "a" and self.open and self.open[-1][0] == "a":
            self.pop()
        if tag in BLOCKS:
            self.flush()
        inside = self.last("article") >= 0 or self.last("main") >= 0
        around = bool(self.open) and self.open[-1][2]
        own = _furniture(tag, attrs, inside)
        certain, maybe = _named(tag, attrs, inside)
        if inside and tag == "header":
            own = certain = maybe = False
        if self.in_header() and tag in BLOCKS and tag not in HEADINGS and tag not in IN_HEADER:
            own = True
        if tag in BLOCKS or own or certain or maybe or tag in ("a", "span"):
            if (own or certain or maybe) and tag not in BLOCKS:  # an inline piece of furniture ends the line before it
                self.flush()
            number = self.push(tag, around or own)
            if certain:
                self.named[number] = _others(attrs)
            elif maybe:
                self.doubtful.add(number)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in self.ends:
            self.ends[tag] -= 1
        if self.raw:
            self.raw -= tag == self.skip_name
            return
        if (at := self.last(tag)) < 0:
            return
        _, number, furniture = self.open[at]
        if tag in BLOCKS or number in self.named or number in self.doubtful or furniture and (at == 0 or not self.open[at - 1][2]):
            self.close_to(at)
        elif at == len(self.open) - 1:
            self.pop()

    def handle_data(self, data):
        if not self.raw:
            self.text.append(data)
            if self.links > 0:
                self.link_chars += len(data.strip())

    def finish(self) -> None:
        self.close()
        self.close_to(0)

    def sums(self, values: list[tuple[int, float]]) -> list[float]:
        """For each element the sum of the values in it; elements inside have larger numbers."""
        out = [0.0] * len(self.kinds)
        for number, value in values:
            if number >= 0:
                out[number] += value
        for number in range(len(out) - 1, -1, -1):
            if self.parents[number] >= 0:
                out[self.parents[number]] += out[number]
        return out

    def within(self, chosen) -> list[bool]:
        """For each element whether it or one around it is chosen; a last value for lines outside all elements."""
        out: list[bool] = []
        for number, parent in enumerate(self.parents):
            out.append(number in chosen or parent >= 0 and out[parent])
        return [*out, False]


def smooth(values: list[float], sigma: float, radius: int) -> list[float]:
    """Gaussian smoothing; the kernel is cut and normed at the ends."""
    kernel = [math.exp(-(j * j) / (2 * sigma * sigma)) for j in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for j in range(max(0, i - radius), min(len(values), i + radius + 1)):
            w = kernel[j - i + radius]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Border between the two clusters of the values: the fixed point of the mean of both means."""
    if not values:
        return 0.0
    t = sum(values) / len(values)
    for _ in range(50):
        low = [v for v in values if v < t]
        high = [v for v in values if v >= t]
        if not low or not high:
            return t if high else 0.0
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - t) < 1e-9:
            break
        t = new
    return t


def main_text(html: str | None, sigma: float = SIGMA, radius: int = RADIUS) -> str:
    """Lines of the article joined by a line feed."""
    if not html:
        return ""
    parser = _Lines(html)
    parser.feed(html)
    parser.finish()
    kinds, parents = parser.kinds, parser.parents
    gone = parser.within(_still_named(parser))
    lines = [(words, tags, linked, n, furniture or gone[n]) for words, tags, linked, n, furniture in parser.lines]
    smoothed, border = _scores(lines, sigma, radius)
    if doubted := _like_links(parser, lines, smoothed, border):
        gone = parser.within(doubted)
        lines = [(words, tags, linked, n, furniture or gone[n]) for words, tags, linked, n, furniture in lines]
        smoothed, border = _scores(lines, sigma, radius)
    content = [(n, len(words) - linked) for (words, _, linked, n, furniture), s in zip(lines, smoothed) if not furniture and s >= border]
    mass = parser.sums(content)
    holders = {n for n, m in enumerate(mass) if m and kinds[n] in ("article", "main")}
    if holders:
        return "\n".join(_of_articles(parser, lines, mass, holders))
    if not any(m for _, m in content):
        return ""
    holds = parser.sums([(n, 1) for n, _ in content])
    whole = [n for n, h in enumerate(holds) if h == len(content) and kinds[n] in ("div", "section", "td", "body", "html")]
    root = max(whole, default=-1)
    inside = parser.within({root}) if root >= 0 else [True] * (len(kinds) + 1)
    own = [i for i, line in enumerate(lines) if inside[line[3]]]
    above = [i for i in own if not lines[i][4] and smoothed[i] >= border]
    block = [parser.blocks[n] if n >= 0 else -1 for _, _, _, n, _ in lines]
    around = {parents[block[i]] for i in above if block[i] >= 0}
    part = [i for i in own if not lines[i][4] and (above[0] <= i <= above[-1] or _at_edge(kinds, parents, block[i], around))]
    between = [i for i in own if part[0] <= i <= part[-1] and not lines[i][4]]
    kept = [i for i in between if smoothed[i] >= border or 2 * lines[i][2] <= len(lines[i][0])]
    while len(kept) > 1 and RIGHTS.match(lines[kept[-1]][0]) and len(lines[kept[-1]][0]) < border * lines[kept[-1]][1]:
        kept.pop()
    return "\n".join(_headline(parser, lines, root, own) + [lines[i][0] for i in kept])


def _scores(lines: list[tuple[str, int, int, int, bool]], sigma: float, radius: int) -> tuple[list[float], float]:
    """Smoothed ratios of the lines and the border between their clusters; furniture counts 0."""
    smoothed = smooth([0.0 if furniture else (len(words) - linked) / tags for words, tags, linked, _, furniture in lines], sigma, radius)
    return smoothed, threshold(smoothed)


def _like_links(parser: _Lines, lines: list[tuple[str, int, int, int, bool]], smoothed: list[float], border: float) -> set[int]:
    """Elements of doubtful names that are mostly links, or hold low lines only and no paragraph or heading."""
    if not parser.doubtful:
        return set()
    seen = [(i, line) for i, line in enumerate(lines) if not line[4]]
    text = parser.sums([(n, len(words)) for _, (words, _, _, n, _) in seen])
    linked = parser.sums([(n, link) for _, (_, _, link, n, _) in seen])
    prose = parser.sums(
        [(n, 1) for i, (_, _, _, n, _) in seen if n >= 0 and (smoothed[i] >= border or parser.kinds[parser.blocks[n]] in {"p", *HEADINGS})]
    )
    return {n for n in parser.doubtful if 2 * linked[n] > text[n] or not prose[n]}


def _at_edge(kinds: list[str], parents: list[int], block: int, around: set[int]) -> bool:
    """Whether a line before the first or after the last line of content belongs to it: a paragraph or heading beside one."""
    return block < 0 or (kinds[block] in HEADINGS or kinds[block] in ("p", "blockquote", "pre")) and parents[block] in around


def _headline(parser: _Lines, lines: list[tuple[str, int, int, int, bool]], root: int, own: list[int]) -> list[str]:
    """The last first-level heading before the root and beside it, if the root has none."""
    if root < 0 or not own:
        return []
    level = lambda i: parser.kinds[parser.blocks[lines[i][3]]] if lines[i][3] >= 0 else ""
    if any(level(i) == "h1" and not lines[i][4] for i in own):
        return []
    beside = [
        lines[i][0]
        for i in range(own[0])
        if level(i) == "h1" and not lines[i][4] and parser.parents[parser.blocks[lines[i][3]]] == parser.parents[root]
    ]
    return beside[-1:]


def _still_named(parser: _Lines) -> set[int]:
    """The elements named as furniture that are not wrappers.

    A list of comments or related pages is a wrapper only if most of the page's text is inside and no article outside.
    """
    holders = {n for n, kind in enumerate(parser.kinds) if kind in ("article", "main")}
    in_holder = parser.within(holders)
    in_others = parser.within({n for n, others in parser.named.items() if others})
    seen = [(n, len(words) - linked) for words, _, linked, n, furniture in parser.lines if not furniture]
    inside, total = parser.sums(seen), sum(m for _, m in seen)
    loose = any(in_holder[n] and not in_others[n] for n, _ in seen)  # an article outside such lists has text
    wraps = parser.sums([(parser.parents[n], 1) for n in holders])
    out = set()
    for n, others in parser.named.items():
        most = 2 * inside[n] > total
        if not (most and not loose if others else most or wraps[n]):
            out.add(n)
    return out


def _of_articles(parser: _Lines, lines: list[tuple[str, int, int, int, bool]], mass: list[float], holders: set[int]) -> list[str]:
    """Lines in an article or main element with content, and not in an article within an article.

    An inner article with more than half of the outer one's content is its body, not a comment. A short article beside one
    with content belongs to the page's text unless it is mostly links.
    """
    kinds, parents = parser.kinds, parser.parents
    seen = [line for line in lines if not line[4]]
    text = parser.sums([(n, len(words)) for words, _, _, n, _ in seen])
    linked = parser.sums([(n, link) for _, _, link, n, _ in seen])
    beside = {parents[n] for n in holders if kinds[n] == "article"}
    short = {n for n, kind in enumerate(kinds) if kind == "article" and parents[n] in beside and 2 * linked[n] <= text[n]}
    found = parser.within(holders | short)
    outer: list[int] = []
    nested: list[bool] = []
    for n, (kind, parent) in enumerate(zip(kinds, parents)):
        before = outer[parent] if parent >= 0 else -1
        inner = kind == "article" and before >= 0 and 2 * mass[n] <= mass[before]
        nested.append(inner or parent >= 0 and nested[parent])
        outer.append(n if kind == "article" else before)
    return [words for words, _, _, n, furniture in lines if not furniture and n >= 0 and found[n] and not nested[n]]


def extract(pages: DataFrame, *, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``id_cols`` and ``text``, one row per page."""

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        return pd.Series([main_text(html) for html in column], dtype=object)

    return pages.select(*id_cols, text_of(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("text"))
