"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events of one page; block elements cut
them into lines, each with its text and the number of tags seen for it. The
ratio of text to tags per line is smoothed with a Gaussian, and the lines whose
smoothed ratio passes a threshold (the standard deviation) are the core of the
content. The core's text decides on the region: of the elements that hold
``SHARE`` of it, the outermost article, or else the outermost main element, or
else the innermost. The region is completed to its element, so that its short
lines stay; if no element below the body holds the core, the region runs from the
core's first line (and the headings right before it) to its last.

Never content are menus, footers, sidebars, forms, scripts, styles and other
elements of such a kind, elements with names that say so alone ("advert",
"comments", "cookie"), and headers, but for the headings in an article's header.
Names that may also be a subject ("related", "social") count as evidence only:
their elements are dropped if links make up ``LINKED`` of their text, or less
than half of it is core.

Defined results: null or empty html, and pages without content, give an empty
text and 0 characters; repeated rows are parsed each; malformed markup closes
elements as browsers do for the common cases, in time linear in the page however
deep it nests; an empty table gives an empty result; columns other than the named
ones are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellwright.llm.common import arrow_batches, spread

SIGMA = 1.5
#: Share of the core's text that the region holds; share of linked text at which an element with a doubtful name goes.
SHARE, LINKED = 0.9, 0.4

# Element names of HTML and common names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SECTION = frozenset("article main section div td body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("option legend caption summary".split())
NOT_CONTENT = frozenset(
    "nav footer aside form script style noscript template iframe svg object button select textarea input head title dialog menu canvas audio video map".split())
PART_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox adslot adunit adbanner sponsor sponsored cookie cookies consent gdpr notice notices sidebar"
    " menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus replies respond"
    " newsletter subscribe popup modal pagination pager toolbar".split())
DOUBTFUL_NAMES = frozenset(
    "promo promotion banner alert disclaimer side rail share sharing social related recommended subscription overlay widget login signup search skip copyright reply".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}

_SPLIT = re.compile(r"[\s_-]+")


class _Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters of links
    part: bool
    element: int  # closest sectioning element
    doubtful: int  # outermost element with a doubtful name, or 0
    heading: bool


class _Open(NamedTuple):
    """An open element, with what holds inside it."""

    tag: str = ""
    part: bool = False
    element: int = 0
    doubtful: int = 0
    heading: bool = False
    header: bool = False  # in the header of an article
    link: bool = False
    skip: bool = False  # a page part inside a line: its text goes, the line goes on
    block: int = 0  # place of the closest block element on the stack


class _Lines(HTMLParser):
    """Cuts a page into lines; ``parents`` and ``kinds`` describe the sectioning elements, numbered from 1 as they open."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[_Line] = []
        self.stack = [_Open()]
        self.places: dict[str, list[int]] = defaultdict(list)
        self.parents, self.kinds = [0], [""]
        self.names = 0
        self.text: list[str] = []
        self.tags = self.linked = 0

    def cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            at = self.stack[-1]
            self.lines.append(_Line(text, max(1, self.tags), self.linked, at.part or at.header and not at.heading, at.element, at.doubtful, at.heading))
            self.tags = 0
        self.text, self.linked = [], 0

    def pop_to(self, k: int) -> None:
        if self.stack[-1].block >= k and not self.stack[self.stack[-1].block].skip:
            self.cut()
        for x in self.stack[k:]:
            self.places[x.tag].pop()
        del self.stack[k:]

    def push(self, x: _Open) -> None:
        self.places[x.tag].append(len(self.stack))
        self.stack.append(x._replace(block=len(self.stack)) if x.tag in BLOCK else x)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.stack[-1].skip:
            if tag not in VOID:
                self.push(self.stack[-1]._replace(tag=tag))
            return
        if tag == "br":
            self.tags += 1
            self.text.append(" ")
            return
        if tag in CLOSES_P or tag in SAME_LEVEL:
            near = self.stack[-1].block  # every element that closes this way is a block
            open_tag = self.stack[near].tag
            if open_tag in SAME_LEVEL.get(tag, ()) or open_tag == "p" and tag in CLOSES_P:
                self.pop_to(near)
        if tag in BLOCK:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        at = self.stack[-1]
        inside = self.in_article()
        header = tag == "header" and inside
        part = at.part or tag in NOT_CONTENT or tag == "header" and not inside
        doubtful = at.doubtful
        if not part and tag not in ("html", "body", "article", "main"):
            for name, value in attrs:
                if name == "hidden":
                    part = True
                elif value and name == "role":
                    part = part or value.lower() in PART_ROLES
                elif value and name in ("class", "id"):
                    names = set(_SPLIT.split(value.lower()))
                    part = part or not PART_NAMES.isdisjoint(names) or "header" in names and not inside
                    header = header or "header" in names and inside
                    if not doubtful and not DOUBTFUL_NAMES.isdisjoint(names):
                        self.names += 1
                        doubtful = self.names
        element = at.element
        if tag in SECTION:
            self.parents.append(element)
            self.kinds.append(tag)
            element = len(self.parents) - 1
        self.push(_Open(tag, part, element, doubtful, at.heading or tag in HEADINGS, at.header or header, at.link or tag == "a", part and not at.part and tag not in BLOCK, at.block))

    def in_article(self) -> bool:
        return bool(self.places["article"] or self.places["main"])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "span", "a", "script", "style"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        places = self.places[tag]
        if places and (tag in BLOCK or places[-1] > self.stack[-1].block):  # an inline end tag doesn't close blocks
            self.pop_to(places[-1])
        elif tag in BLOCK:
            self.cut()

    def handle_data(self, data: str) -> None:
        if not self.stack[-1].skip:
            self.text.append(data)
            if self.stack[-1].link:
                self.linked += len(data)

    def end(self) -> list[_Line]:
        self.close()
        self.cut()
        return self.lines


def smoothed(ratios: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with weights normalised at the ends."""
    if sigma <= 0:
        return list(ratios)
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(len(ratios), i + reach + 1)):
            k = kernel[abs(i - j)]
            total += k * ratios[j]
            weight += k
        out.append(total / weight)
    return out


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article's blocks, one a line."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    lines = page.end()
    if not lines:
        return ""
    smooth = smoothed([len(x.text) / x.tags for x in lines], sigma)
    mean = sum(smooth) / len(smooth)
    threshold = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    # doubtful elements: characters, linked and core ones
    sums = defaultdict(lambda: [0, 0, 0])
    for x, y in zip(lines, smooth):
        if x.doubtful:
            s = sums[x.doubtful]
            s[0] += len(x.text)
            s[1] += x.linked
            s[2] += len(x.text) if y > threshold else 0
    gone = {k for k, (chars, linked, core) in sums.items() if linked >= LINKED * chars or 2 * core < chars}
    left = [i for i, x in enumerate(lines) if not x.part and x.doubtful not in gone]
    core = [i for i in left if smooth[i] > threshold]
    if not core:  # what page parts outweigh: the best of the rest
        top = max((smooth[i] for i in left), default=0.0)
        core = [i for i in left if top > 0 and smooth[i] >= top / 2]
    if not core:
        return ""
    mass = [0] * len(page.parents)
    for i in core:
        mass[lines[i].element] += len(lines[i].text)
    for k in range(len(mass) - 1, 0, -1):
        mass[page.parents[k]] += mass[k]
    chain = [k for k in range(1, len(mass)) if mass[k] >= SHARE * mass[0]]  # from the outside in
    region = next((k for kind in ("article", "main") for k in chain if page.kinds[k] == kind), chain[-1] if chain else 0)
    inside = [k == region for k in range(len(mass))]
    for k in range(1, len(mass)):
        inside[k] = inside[k] or inside[page.parents[k]]
    mine = [i for i in left if inside[lines[i].element]]
    if page.kinds[region] in ("", "html", "body"):
        first, last = core[0], core[-1]
        while (k := bisect_left(mine, first)) > 0 and lines[mine[k - 1]].heading:
            first = mine[k - 1]
        mine = [i for i in mine if first <= i <= last]
    return "\n".join(lines[i].text for i in mine)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.as_py()) for x in b.column(2)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    arrow_batches(pages.sparkSession)
    src = spread(pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")))
    return src.mapInArrow(_texts, "page_id bigint, url string, text string, n_chars bigint")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
