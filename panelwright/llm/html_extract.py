"""Main text of web pages by tag-path ratios: text and punctuation per root-to-leaf path, smoothed, fused, thresholded."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import slices, tidied

# Element names of HTML by their part in the layout.
#: Elements that run inside a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img picture source".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noframes xmp iframe noembed".split())
#: Elements that never hold main text.
NEVER = frozenset("head script style noscript template nav footer aside form button select option textarea iframe noframes noembed object svg math canvas audio video dialog menu fieldset input title xmp datalist".split())
#: Elements that an opening tag of a block ends, if open in the same container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: Words of a class, identifier or role that mark page furniture and readers' comments.
FURNITURE = frozenset("ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split())
#: Words beside which those speak of the layout and not of the element.
LAYOUT = frozenset("has no with without".split())
#: Words of a class, identifier, role or itemprop that mark the article.
ARTICLE = frozenset("article articlebody main content story post entry".split())

#: Factor of a path's ratio that the article mark gives, at most.
MARK = 4.0

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*|[^>]*)(?:>|\Z)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…、。，]")
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary address".split())


@dataclass
class Node:
    """An open element: its tag, the number of its tag path and of the element around it, and what it or one around it is marked as."""

    tag: str
    path: int
    number: int
    furniture: bool
    marked: int


@dataclass
class Block:
    """A run of text that no block element interrupts: its path, text and linked characters.

    `path` and `above` number the tag path and the one around it, `leaf` is the innermost tag, `within` the number of the
    innermost element, `marked` that of the outermost element marked as the article, or -1.
    """

    path: int
    above: int
    leaf: str
    furniture: bool
    within: int
    marked: int
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _marks(attributes: str) -> tuple[str, bool, bool]:
    """The class that distinguishes a path, and whether attributes mark furniture or the article."""
    name, furniture, article = "", False, False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            furniture = True
            continue
        words = frozenset(_PARTS.findall(_CAMEL.sub(r"\1 \2", value).lower()))
        furniture |= bool(words & FURNITURE) and not words & LAYOUT
        article |= bool(words & ARTICLE) or value.lower() == "articlebody"
        if key == "class":
            name = f".{value}"
    return name, furniture and not (article and key == "itemprop"), article


def blocks(html: str) -> tuple[list[Block], list[int]]:
    """The text blocks of a page in order, and for each element's number that of the element around it, or -1.

    Unclosed elements end where HTML lets them end; an unfinished tag is dropped. The time is linear in the page, however
    deep it nests: paths are numbered, and the places of open elements are kept by tag.
    """
    stack = [Node("", 0, -1, False, -1)]
    places: dict[str, list[int]] = defaultdict(list)
    paths: dict[tuple[int, str], int] = {}
    above, around = [-1], []
    out: list[Block] = []
    current: Block | None = None
    links, at = 0, 0

    def add(raw: str) -> None:
        nonlocal current
        if not raw:
            return
        if current is None:
            top = stack[-1]
            current = Block(top.path, above[top.path], top.tag, top.furniture, top.number, top.marked)
            out.append(current)
        text = unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if links:
            current.linked += len(text.strip())

    def cut(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().tag].pop()

    while (m := _TOKEN.search(html, at)) is not None:
        add(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif tag == "a":
                links = 0 if m[1] else 1
            continue
        if tag in RAW and not m[1]:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = end.end() if end else len(html)
            add(" ")
            continue
        current, links = None, 0
        if m[1]:
            if places[tag]:
                cut(places[tag][-1])
            continue
        last = lambda tags: max((places[t][-1] for t in tags if places[t]), default=0)
        if tag not in ("option", "head", "body") and places["p"] and last(("table", "button")) < places["p"][0]:
            cut(places["p"][0])
        elif tag in ENDS:
            floor = last(("ul", "ol", "dl", "table", "div", "article", "section", "nav"))
            ended = [own[i] for own in map(places.__getitem__, ENDS[tag]) if (i := bisect_right(own, floor)) < len(own)]
            if ended:
                cut(min(ended))
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div"):
            continue
        name, furniture, article = _marks(m[3]) if m[3] else ("", False, False)
        top = stack[-1]
        if tag in ("article", "main"):
            article, furniture = True, False
        if tag in ("html", "body"):
            article = furniture = False
        if tag == "header":
            furniture |= top.marked < 0
        path = paths.setdefault((top.path, tag + name), len(above))
        if path == len(above):
            above.append(top.path)
        marked = top.marked if top.marked >= 0 else len(around) if article else -1
        places[tag].append(len(stack))
        stack.append(Node(tag, path, len(around), top.furniture or furniture or tag in NEVER, marked))
        around.append(top.number)
    add(html[at:])
    for b in out:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
    return [b for b in out if b.text], around


def _bonus(left: list[Block], around: list[int], plain: np.ndarray) -> np.ndarray:
    """Each block's factor for the article mark: 1 without it, else 1 to MARK by text.

    The unlinked characters of the marked element are weighed against those of the largest unmarked element that holds
    no marked one: cards beside a long unmarked body gain next to nothing, an article beside short boxes nearly MARK.
    """
    holds = [False] * len(around)
    for b in left:
        k = b.within if b.marked >= 0 else -1
        while k >= 0 and not holds[k]:
            holds[k], k = True, around[k]
    outer: list[int] = []  # the outermost element around each that holds no marked one
    for k, up in enumerate(around):
        outer.append(outer[up] if up >= 0 and outer[up] >= 0 else -1 if holds[k] else k)
    marked: dict[int, float] = defaultdict(float)
    others: dict[int, float] = defaultdict(float)
    for b, n in zip(left, plain.tolist(), strict=True):
        if b.marked >= 0:
            marked[b.marked] += n
        else:
            others[outer[b.within] if b.within >= 0 else -1] += n
    rival = max(others.values(), default=0.0)
    return np.array([1 + (MARK - 1) * marked[b.marked] / max(marked[b.marked] + rival, 1.0) if b.marked >= 0 else 1.0 for b in left])


def content(found: list[Block], around: list[int], threshold: float = 0.08) -> list[Block]:
    """The blocks of main text.

    Per path: unlinked characters and punctuation per node, damped by the share of linked text. Nodes' ratios are
    raised by a bounded bonus for the article mark, smoothed along the page and fused with their path's; a node is
    content if the fused ratio is at least `threshold` of the largest, whether marked or not. Blocks that lie directly
    in the container of the strongest path belong to it however short. Furniture never counts, nor do list items and
    boxes of a path whose text is links for the most part; a linked one among others of plain text does.
    """
    left = [b for b in found if not b.furniture]
    if not left:
        return []
    groups: dict[int, list[int]] = defaultdict(list)
    for i, b in enumerate(left):
        groups[b.path].append(i)
    length = np.array([len(b.text) for b in left], float)
    linked = np.minimum(length, [b.linked for b in left])
    marks = np.array([len(_MARKS.findall(b.text)) for b in left], float)
    ratio, share = np.zeros(len(left)), np.zeros(len(left))
    for own in groups.values():
        n, text = len(own), length[own].sum()
        share[own] = linked[own].sum() / text
        ratio[own] = (1 - share[own]) ** 2 * np.log1p(text / n) * np.log1p(text) * (1 + np.log1p(marks[own].sum() / n))
    ratio *= _bonus(left, around, length - linked)
    kernel = np.array([0.06, 0.24, 0.4, 0.24, 0.06])
    smooth = np.convolve(np.pad(ratio, 2, mode="edge"), kernel, mode="valid")
    fused = np.sqrt(ratio * smooth)
    best = left[int(fused.argmax())]
    container = best.above if best.leaf in _LEAVES else best.path
    limit = threshold * fused.max()
    chosen = []
    for i, b in enumerate(left):
        links = share[i] > 0.5 if b.marked >= 0 and b.leaf in ("li", "ul", "div") else linked[i] > 0.5 * length[i] and b.marked < 0
        direct = b.path == container or b.above == container and b.leaf in _LEAVES
        if not links and (direct or fused[i] >= limit):
            chosen.append(b)
    return chosen


def extract(html: str | None) -> str:
    return "\n".join(b.text for b in content(*blocks(html or "")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html; other columns are ignored).

    Blocks are joined by line feeds in page order; white space in a block is one space; character references are
    decoded. A null or empty html, or one without main text, gives an empty text. Null or repeated page_ids and urls
    are answered each; an empty table gives no rows. One pass without a shuffle; a task holds a slice of pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [extract(h) for h in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long"), pages["url"], pages["html"]).mapInArrow(tidied(run), "page_id long, url string, text string, n_chars long")
