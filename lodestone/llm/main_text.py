"""Main text of web pages by tag-path ratios.

A page is read once as a line of tags and texts. Every text belongs to a block, and every block to the path of tags (with the
words of their class and id) from the root to it. Per path, text length and punctuation are summed over its blocks: paragraphs of
an article share a path with much text and many marks a block, menus and lists of links have paths with little of both. The
two ratios of the blocks' paths are smoothed along the page, each by a Gaussian window, and fused into one score as their
product; what is linked counts against a path. Blocks whose paths reach a share of the scores' standard deviation are the content, and
with them the other blocks of the element that holds most of it (short headings, lists, quotes).

Elements that say by their tag, role, class or id that they are a menu, header, footer, sidebar, notice, advert, form or
comments are no candidates.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, release_memory

# Tags by their role in a page, and the words by which classes, ids and roles tell what an element is for.
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
NEVER = frozenset("head script style noscript template title nav header footer aside form button select textarea option iframe noembed noframes object applet canvas svg math audio video dialog menu xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()
)
CLOSES_SAME = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)), "option": (("option",), ("select",)), "body": (("head",), ()),
}
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager header masthead "
    "topbar toolbar footer bottombar colophon copyright sidebar sidebars aside complementary contentinfo widget widgets cookie cookies consent gdpr notice notices notification notifications alert disclaimer popup modal dialog overlay newsletter subscribe subscription signup "
    "login form search share sharing social related recommended recommendations teaser teasers comment comments commentlist disqus reply replies respond response responses discussion feedback hidden skip tags toc".split()
)
MAIN_WORDS = frozenset("article main story".split())
COMMENT_HEADING = re.compile(
    r"(?i)^\W*(?:\d+\s+)?(?:reader\s+|user\s+)?(?:comments?|responses?|replies|discussion|leave an? (?:comment|reply)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\W*$"
)
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")
# End of fixed values.

#: Share of the scores' standard deviation from which a path is content, half-width of the smoothing window in blocks, share of the content that the main element holds.
LAMBDA, RADIUS, HOLDS = 0.5, 2, 0.6
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S
)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Element:
    tag: str
    up: int  # the element around it
    path: int
    words: frozenset = frozenset()
    never: bool = False
    aside: bool = False
    main: bool = False
    told: bool = False  # inside article or main


@dataclass(slots=True)
class Block:
    element: int
    text: str
    linked: int
    marks: int


@dataclass
class Page:
    elements: list[Element] = field(default_factory=lambda: [Element("", -1, 0)])
    blocks: list[Block] = field(default_factory=list)


def _attributes(raw: str) -> tuple[frozenset, bool]:
    """The words of class, id and role, and whether the element is not shown."""
    words, hidden = set(), False
    for name, *values in ATTR.findall(raw):
        value, name = "".join(values), name.lower()
        if name in ("class", "id", "role"):
            words.update(w.lower() for w in WORD.findall(value))
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return frozenset(words), hidden


def read_page(source: str) -> Page:
    """Elements and blocks of a page; tags that are left open are closed as browsers do, inline tags end no block."""
    page, paths = Page(), {}
    elements, blocks = page.elements, page.blocks
    open_: list[int] = [0]
    inline: list[str] = []
    parts: list[str] = []
    held: Counter = Counter()  # open tags: most searches end here
    endless: set[str] = set()  # inline tags without an end further on
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(open_[-1], text, min(linked, len(text)), len(PUNCTUATION.findall(text))))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        flush()
        held.subtract(elements[k].tag for k in open_[depth:])
        del open_[depth:]

    def innermost(tags, stop=()) -> int:
        if not any(map(held.__getitem__, tags)):
            return 0
        for depth in range(len(open_) - 1, 0, -1):
            tag = elements[open_[depth]].tag
            if tag in tags:
                return depth
            if tag in stop:
                return 0
        return 0

    def opened(tag: str, raw: str) -> None:
        flush()
        if tag in CLOSES_P and (depth := innermost(("p",), ("table", "td", "th", "caption", "button", "object"))):
            pop_to(depth)
        same, within = CLOSES_SAME.get(tag, ((), ()))
        while same and (depth := innermost(same, within)):
            pop_to(depth)
        words, hidden = _attributes(raw) if raw else (frozenset(), False)
        step = (elements[open_[-1]].path, tag, words)
        path = paths.setdefault(step, len(paths) + 1)
        elements.append(Element(tag, open_[-1], path, words, hidden or tag in NEVER))
        open_.append(len(elements) - 1)
        held[tag] += 1

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.match(source, at)
        at = m.end()
        text = m["text"] or m["cdata"]
        if text:
            plain = html.unescape(text) if "&" in text else text
            parts.append(plain)
            if "a" in inline:
                linked += len(plain.strip())
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            if tag in INLINE:
                if tag in inline:
                    inline.reverse()
                    inline.remove(tag)
                    inline.reverse()
            elif tag == "br":
                parts.append(" ")
            elif depth := innermost((tag,)):
                pop_to(depth)
                inline = [x for x in inline if x != "a"]
            elif tag == "p":
                flush()
        elif tag == "br" or tag == "hr":
            parts.append(" ")
            if tag == "hr":
                flush()
        elif tag in VOID:
            continue
        elif tag in INLINE:
            words, hidden = _attributes(m["attrs"])
            if hidden or words & ASIDE_WORDS:  # an advert in a span is an element of its own
                opened(tag, m["attrs"])
                end = tag not in endless and re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                if end:
                    at = end.end()
                else:
                    endless.add(tag)
                pop_to(len(open_) - 1)
            else:
                inline.append(tag)
        else:
            opened(tag, m["attrs"])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else n
                pop_to(len(open_) - 1)
    flush()
    return page


def _mark_asides(page: Page, forms: bool = False) -> None:
    """Elements for something else than the article, by their tag and words, and all below them; an element around the page's main part is none.

    ``forms`` lets forms be content, for pages that stand in one as a whole.
    """
    elements = page.elements
    anchors = next((found for tag in ("main", "h1", "article") if (found := [k for k, e in enumerate(elements) if e.tag == tag and elements[e.up].tag != "header"])), [])
    holds = [0] * len(elements)
    for k in anchors:
        while k >= 0:
            holds[k] += 1
            k = elements[k].up
    for k in range(1, len(elements)):
        e, up = elements[k], elements[elements[k].up]
        around = bool(anchors) and holds[k] == len(anchors)
        named = not e.words.isdisjoint(ASIDE_WORDS) and e.tag not in ("html", "body", "main", "h1") and not around
        title = e.tag == "h1" and up.tag == "header" and up.told  # of the article, not of the site
        e.aside = (e.never and not (e.tag == "form" and (around or forms))) or named or (up.aside and not title)
        e.told = up.told or e.tag in ("article", "main")
        e.main = up.main or e.told or (not named and not e.words.isdisjoint(MAIN_WORDS))


def _last_below(page: Page) -> list[int]:
    """The last element inside of each one; elements are numbered as they open."""
    last = list(range(len(page.elements)))
    for k in range(len(last) - 1, 0, -1):
        up = page.elements[k].up
        last[up] = max(last[up], last[k])
    return last


def _without_discussions(page: Page, own: list[int], last: list[int]) -> list[int]:
    """Without the blocks that follow a heading such as "Comments" in the same element."""
    out, ended = [], []
    for k in own:
        b = page.blocks[k]
        e = page.elements[b.element]
        if any(x <= b.element <= last[x] for x in ended):
            continue
        if len(b.text) < 60 and e.tag in ("h2", "h3", "h4", "h5", "h6", "legend", "summary") and COMMENT_HEADING.match(b.text):
            ended.append(e.up)
            continue
        out.append(k)
    return out


def smoothed(values: list[float], radius: int) -> list[float]:
    """A Gaussian window of ``radius`` to either side, its weights summing to 1 within the line."""
    weights = [math.exp(-(d * d) / (2 * (radius / 2 or 1) ** 2)) for d in range(-radius, radius + 1)]
    n, out = len(values), []
    for k in range(n):
        lo, hi = max(0, k - radius), min(n, k + radius + 1)
        own = weights[lo - k + radius : hi - k + radius]
        out.append(sum(w * v for w, v in zip(own, values[lo:hi], strict=True)) / sum(own))
    return out


def content_blocks(page: Page, lam: float = LAMBDA, radius: int = RADIUS, holds: float = HOLDS) -> list[int]:
    """The numbers of a page's content blocks, in page order."""
    for forms in (False, True):
        _mark_asides(page, forms)
        own = [k for k, b in enumerate(page.blocks) if not page.elements[b.element].aside]
        if own or not any(e.tag == "form" for e in page.elements):
            break
    if any(page.elements[page.blocks[k].element].main for k in own):
        own = [k for k in own if page.elements[page.blocks[k].element].main]
    last = _last_below(page)
    own = _without_discussions(page, own, last)
    if not own:
        return []
    path = {k: page.elements[page.blocks[k].element].path for k in own}
    sums: dict[int, list[float]] = defaultdict(lambda: [0, 0, 0, 0])
    for k in own:
        b, s = page.blocks[k], sums[path[k]]
        s[0] += 1
        s[1] += len(b.text)
        s[2] += b.marks
        s[3] += b.linked
    unlinked = {p: 1 - linked / length for p, (_, length, _, linked) in sums.items()}
    by_text = smoothed([sums[path[k]][1] / sums[path[k]][0] * unlinked[path[k]] for k in own], radius)
    by_marks = smoothed([(1 + sums[path[k]][2]) / sums[path[k]][0] for k in own], radius)
    fused = dict(zip(own, (t * m for t, m in zip(by_text, by_marks, strict=True)), strict=True))
    mean = sum(fused.values()) / len(own)
    bar = lam * math.sqrt(sum((x - mean) ** 2 for x in fused.values()) / len(own))
    of_path: dict[int, list[float]] = defaultdict(list)
    for k in own:
        of_path[path[k]].append(fused[k])
    chosen = {p for p, xs in of_path.items() if sum(xs) / len(xs) >= bar and unlinked[p] > 0.5} or {max(of_path, key=lambda p: sum(of_path[p]))}
    mass = [0] * len(page.elements)  # of an element: the chosen text in and below it
    for k in own:
        if path[k] in chosen:
            mass[page.blocks[k].element] += len(page.blocks[k].text)
    for e in range(len(mass) - 1, 0, -1):
        mass[page.elements[e].up] += mass[e]
    centre = max(e for e in range(len(mass)) if mass[e] >= holds * mass[0])  # the deepest: of two that do not hold each other only one can have so much
    if page.elements[centre].tag in ("p", "li", "blockquote", "pre", "h1", "h2", "h3", "td"):
        centre = page.elements[centre].up
    within = range(centre, last[centre] + 1)
    plain = lambda b: 2 * b.linked <= len(b.text)
    return [k for k in own if path[k] in chosen or page.elements[page.blocks[k].element].told or (page.blocks[k].element in within and plain(page.blocks[k]))]


def main_text(source: str | None) -> str:
    """The content blocks of a page joined by one space."""
    if not source:
        return ""
    page = read_page(source)
    return " ".join(page.blocks[k].text for k in content_blocks(page))


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the source, with text (empty if none) and n_chars (code points); columns of these names give way.

    Defined cases: a null or empty source has an empty text, as has a page without content; a source without tags is its own text; other nulls are
    carried along; repeated rows repeat; an empty table gives an empty result. A page of any length is read whole by the task that holds it.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kept = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(html_col).cast("string").alias(src := free_name(pages.select(*[F.col(f"`{c}`") for c in rest]), "_source")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in piece.column(len(rest))]
                columns = [piece.column(k) for k in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*rest, "text", "n_chars"])
        release_memory()

    from pyspark.sql import types as T

    schema = T.StructType([f for f in kept.schema if f.name != src] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return kept.mapInArrow(run, schema)
