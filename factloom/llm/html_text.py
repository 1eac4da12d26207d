"""Main text of web pages: standard-library parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

The parser's events stream into blocks ("lines"): the text between two block-level tags, with the tags and link
characters seen on the way and the containers that were open. Containers that say what they are (nav, footer,
aside, form, script, style and the like, or such a word in class, id or role) take no part. Of the rest:

1. each block has the ratio of its characters outside links to its tags;
2. ratios are smoothed along the page with a Gaussian kernel;
3. blocks above the threshold (the smaller of the deviation and the mean of the smoothed ratios) form clusters;
4. the content is what is clustered, wherever it stands. An article or main element is evidence only: each one
   that holds clustered text, itself or in an element within, adds its other blocks, save those below the threshold
   that are mostly links; beside one, a block must reach the threshold by its own ratio too, not by smoothing alone.
   Outside such elements the span of the clusters counts, including headings directly above and short blocks of the
   same parent between them.

with_text() runs in Arrow batches, one pass, no shuffle; memory is one batch and one page's blocks.

Defined results: null, empty or text-free html gives the empty text; character references are decoded; white space
inside a block becomes one space; blocks are joined in page order by a blank line; unclosed and stray tags are
tolerated; very long pages are read whole; repeated rows give repeated results; further columns stay out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Element names and words by which markup names its parts.
SKIPPED = frozenset("script style noscript template title head svg math canvas object iframe select button textarea form nav aside footer dialog audio video map datalist menu".split())
CONTAINERS = frozenset("article main section div ul ol dl table tbody thead tr td th blockquote figure header body html fieldset details address center".split()) | SKIPPED
BLOCKS = CONTAINERS - frozenset("td th".split()) | frozenset("p li dt dd h1 h2 h3 h4 h5 h6 hr pre figcaption caption summary legend".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription "
    "signup login signin search menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside widget widgets footer related recommended recommendations share sharing social comment comments "
    "commentlist respond reply replies discussion disqus pager pagination toolbar skip copyright legal disclaimer teaser teasers masthead topbar".split()
)
#: Words that also name a part of an article (related work, a discussion): as an id, or with words that are not
#: names of boxes they do not tell that a part of the article is something else.
AMBIGUOUS = frozenset("related discussion search notice notices legal copyright banner top reply replies recommended recommendations promotion disclaimer share sharing social aside".split())
BOXES = frozenset("box block list links posts articles stories items item news section area wrap wrapper container inner outer content widget module panel bar buttons button icons thread form more also you may like by the and of a".split())
HEADERS = frozenset(["header", "site-header", "page-header", "top"])
#: Kernel of the smoothing, in blocks.
RADIUS, SIGMA = 2, 1.0
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Block:
    text: str
    tags: int
    link_chars: int
    heading: bool
    parent: int
    main: tuple[int, ...]  # the open article and main elements


@dataclass
class _Open:
    name: str
    skips: bool
    number: int
    main: tuple[int, ...]


def _named_boilerplate(name: str, attributes: list[tuple[str, str | None]], in_main: bool) -> bool:
    for key, value in attributes:
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in (value or "").replace(" ", "").lower()):
            return True
        if not value:
            continue
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id"):
            words = set(_SPLIT.split(_CAMEL.sub("-", value).lower())) - {""}
            named = words & WORDS
            if in_main and named <= AMBIGUOUS and (key == "id" or not words <= WORDS | BOXES):
                continue
            if named or (not in_main and value.lower() in HEADERS):
                return True
    return False


@dataclass
class _Lines(HTMLParser):
    """Collects blocks from parser events."""

    blocks: list[Block] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = []
        self.number, self.skipping, self.links, self.tags, self.link_chars = 0, 0, 0, 0, 0
        self.pieces: list[str] = []
        self.heading = self.hinted = False

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text and not self.hinted:
                top = self.open[-1] if self.open else None
                self.blocks.append(Block(text, self.tags, self.link_chars, self.heading, top.number if top else 0, top.main if top else ()))
            self.pieces = []
        self.tags = self.link_chars = 0
        self.heading = self.hinted = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "body" and self.open and self.open[-1].name == "head":
            self.handle_endtag("head")
        if tag in BLOCKS and not self.skipping:
            self.flush()
        if tag in CONTAINERS:
            main = self.open[-1].main if self.open else ()
            skips = bool(self.skipping)
            if not skips:
                skips = tag in SKIPPED or (tag == "header" and not main) or (tag not in ("body", "html") and bool(attrs) and _named_boilerplate(tag, attrs, bool(main)))
            self.number += 1
            if tag in MAIN and not skips:
                main = (*main, self.number)
            self.open.append(_Open(tag, skips, self.number, main))
            self.skipping += skips
        elif not self.skipping:
            if tag == "br" or tag in ("td", "th"):
                self.pieces.append(" ")
            elif tag == "a":
                self.links += 1
            elif tag in BLOCKS:
                self.heading = tag[0] == "h" and tag != "hr"
                self.hinted = bool(attrs) and _named_boilerplate(tag, attrs, bool(self.open and self.open[-1].main))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in CONTAINERS:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)
        # a container that closes itself holds nothing

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in CONTAINERS:
            for depth in range(len(self.open) - 1, -1, -1):
                at = self.open[depth]
                if at.name == tag:
                    if not self.skipping or not at.skips:
                        self.flush()
                    self.skipping -= sum(x.skips for x in self.open[depth:])
                    del self.open[depth:]
                    break
                if at.name in ("article", "main", "body", "td", "th") and tag in ("div", "section", "ul", "ol", "td", "th", "tr"):
                    break  # a stray end tag closes nothing beyond its cell or article
        elif not self.skipping:
            if tag == "a":
                self.links = max(0, self.links - 1)
            elif tag in BLOCKS:
                self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.pieces.append(data)
            if self.links:
                self.link_chars += len(data)


def lines(html: str) -> list[Block]:
    """The page's blocks in order, without what its markup names as something else than content."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.blocks


def smooth(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at both ends."""
    x = np.arange(-radius, radius + 1)
    kernel = np.exp(-(x**2) / (2 * sigma**2))
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def content(blocks: list[Block]) -> list[Block]:
    """The blocks of the content region."""
    if not blocks:
        return []
    ratios = np.array([max(0, len(b.text) - b.link_chars) / max(1, b.tags) for b in blocks], float)
    smoothed = smooth(ratios)
    threshold = min(smoothed.std(), smoothed.mean())
    above = smoothed >= threshold
    linked = np.array([b.link_chars > 0.5 * len(b.text) for b in blocks])
    inside = np.array([bool(b.main) for b in blocks])
    united = {m for b, a in zip(blocks, above, strict=True) if a for m in b.main}
    keep = above & ~linked & ~inside
    if united:
        keep &= ratios >= threshold
    region = [not united.isdisjoint(b.main) and bool(a or b.heading or not x) for b, a, x in zip(blocks, above, linked, strict=True)]
    if keep.any():
        first, last = int(keep.argmax()), len(keep) - 1 - int(keep[::-1].argmax())
        while first and blocks[first - 1].heading and not inside[first - 1]:
            first -= 1
        parents = {b.parent for b, k in zip(blocks, keep, strict=True) if k}
        for i in range(first, last + 1):
            region[i] = region[i] or bool(not inside[i] and (keep[i] or blocks[i].heading or blocks[i].parent in parents))
    return [b for b, r in zip(blocks, region, strict=True) if r]


def main_text(html: str | None) -> str:
    return "\n\n".join(b.text for b in content(lines(html))) if html else ""


def with_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """The columns of keep and the main text of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, html = batch.columns
            yield pa.RecordBatch.from_arrays([*kept, pa.array(map(main_text, html.to_pylist()), pa.string())], names=[*keep, "text"])

    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return pages.select(*(pages[c] for c in keep), pages[html_col]).mapInArrow(run, schema)
