"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks at block-level tags. A linear classifier over a block's features (its words, its
links, what the elements around it are and are named) gives its costs of being content and of being boilerplate, which become
capacities to the two terminals; neighbours on the page and blocks of the same DOM parent are tied by smoothness
edges. What a name says of an element counts less than what is in it: it is void if the element holds the page's articles and
most of its prose, as a wrapper does; so is a form that does. Names that state how something is laid out (no-sidebar) say nothing. The minimum cut of that graph is the cheapest labelling; the blocks on the content
side, in page order, are the text. Pages are independent: one scan, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, table
from .textkit import text_slices

#: Weights of the classifier: a positive sum speaks for content.
BIAS, PER_LOG_WORD, LINKED, ARTICLE, CONTENT_NAME, HEADING, BOILER_TAG, BOILER_NAME, HIDDEN = -1.6, 0.8, -5.0, 3.0, 1.5, 0.8, -8.0, -7.0, -12.0
#: Words from which a block of few links is prose, and the share of a page's prose that makes an element its wrapper.
PROSE_WORDS, PROSE_LINKED, WRAPPER = 8, 0.3, 0.5
#: Smoothness between neighbours on the page, and between consecutive blocks of one DOM parent.
ADJACENT, SAME_PARENT = 0.4, 0.9

# Elements by their role in a page, and words in class, id and role that name a part.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())  # without markup inside, up to their end tag
UNENDED_RAW = frozenset("script style".split())  # without an end tag these run to the end of the page
SKIPPED = frozenset("noscript template svg object select option datalist canvas audio video".split())  # elements that show no text of the page
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul""".split())
BOILER_TAGS = frozenset("nav footer aside form button menu dialog fieldset label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag ends, unless an element of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "a": ({"a"}, BLOCK),
}
BOILER_NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs
 sidebar side aside widget related recommended header masthead topbar footer foot copyright colophon contentinfo complementary search form login signup subscribe
 newsletter cookie cookies consent gdpr notice notification alert popup modal overlay comment comments commentlist reply replies respond disqus discussion
 share sharing social pagination pager toolbar skip""".split())
#: Names that say little about an article or a part that is also named as content.
WEAK_NAMES = frozenset("search share sharing foot footer header banner notice alert skip promo discussion replies reply".split())
#: Words that make a name a statement about the page rather than the name of a part.
STATE_NAMES = frozenset("no not non has have having with without free open opened closed off on by is are enabled disabled allowed default layout".split())
CONTENT_NAMES = frozenset("article content post entry story main body text hentry maincontent".split())

# Quotes count right behind an equals sign only; a tag without an end runs to the page's end. What is matched isn't given back and
# no match fails behind a long reading, so no page takes more than a few passes.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
NAME = re.compile(r"[a-z0-9]+")
END_TAG = re.compile(r"</([a-zA-Z][^\s/<>]*+)(?=[\s/>])")
SLASH = re.compile(r"(?:^|[\s\"'])/\s*\Z")


@dataclass(slots=True)
class Element:
    tag: str
    number: int
    article: bool  # inside an article, or one
    skipped: bool  # its text isn't shown
    block: Element | None  # the nearest block-level element, itself included
    outer: int  # number of the block-level element around that one


@dataclass(slots=True)
class Evidence:
    """What an element says of the blocks inside: for good, and unless it turns out to be a wrapper."""

    up: int
    sure: float = 0.0
    name: float = 0.0
    form: float = 0.0
    main: bool = False  # it is the page's main part
    article: bool = False  # it is an article that no name makes boilerplate


@dataclass
class Block:
    text: str
    parent: int
    element: int
    linked: float
    heading: bool
    score: float = 0.0
    words: int = field(init=False)

    def __post_init__(self):
        self.words = self.text.count(" ") + 1

    def prose(self) -> int:
        return self.words if self.words >= PROSE_WORDS and self.linked < PROSE_LINKED else 0

    def cost(self) -> float:
        return BIAS + PER_LOG_WORD * float(np.log1p(self.words)) + LINKED * self.linked + self.score + (HEADING if self.heading else 0)


def _names(tag: str, named: str) -> tuple[bool, bool]:
    """(speaks for content, speaks for boilerplate) of an element's class, id and role."""
    content, boiler, plain = False, set(), False
    for token in named.lower().split():
        parts = set(NAME.findall(token))
        if parts & STATE_NAMES:
            continue
        found = parts & BOILER_NAMES
        content = content or bool(parts & CONTENT_NAMES) and not found - WEAK_NAMES
        boiler |= found
        plain = plain or bool(found - WEAK_NAMES) and (len(parts) == 1 or bool(parts & CONTENT_NAMES))
    if tag in ("article", "main") or content:
        boiler -= WEAK_NAMES
        if not plain:  # a compound beside a name of content tells where something else is
            boiler = set()
    return content, bool(boiler)


def _element(tag: str, attributes: str, number: int, above: Element | None) -> tuple[Element, Evidence]:
    article, skipped = (above.article, above.skipped) if above else (False, False)
    skipped = skipped or tag in SKIPPED
    says = Evidence(above.number if above else 0, main=tag == "main", article=tag == "article")
    if tag in ("article", "main") and not article:
        says.sure, article = ARTICLE, True
    if tag == "form":
        says.form = BOILER_TAG
    elif tag in BOILER_TAGS or (tag == "header" and not article):
        says.sure += BOILER_TAG
    if attributes and "=" in attributes or " hidden" in attributes:
        values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
        content, boiler = _names(tag, f"{values.get('class', '')} {values.get('id', '')} {values.get('role', '')}")
        if tag not in ("html", "body") and boiler:
            says.name, says.article, says.main = BOILER_NAME, False, False
        elif content and not article:
            says.sure += CONTENT_NAME
        style = values.get("style", "").replace(" ", "").lower()
        if "display:none" in style or "visibility:hidden" in style or values.get("aria-hidden") == "true" or "hidden" in values:
            says.sure += HIDDEN
            skipped = skipped or tag not in BLOCK
    element = Element(tag, number, article, skipped, above.block if above else None, above.outer if above else 0)
    if tag in BLOCK and not (above and above.skipped):
        element.outer, element.block = (above.block.number if above and above.block else 0), element
    return element, says


class Page:
    """Blocks of text of a page, in page order. Each token is handled in constant time, however deep tags are nested."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.stack: list[Element] = []
        self.where: defaultdict[str, list[int]] = defaultdict(list)  # tag -> places in the stack
        self.parts: list[str] = []
        self.linked = self.number = 0
        self.says = [Evidence(0)]  # by element; 0 is the page
        last_end = {m[1].lower(): m.start() for m in END_TAG.finditer(page)}
        at = 0
        while (m := TOKEN.search(page, at)) is not None:
            self.add(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            elif tag in RAW:
                if last_end.get(tag, -1) >= at:
                    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = found.end() if found else at
                elif tag in UNENDED_RAW:
                    at = len(page)
            else:
                self.start(tag, m[3], tag in SKIPPED and tag != "option" and last_end.get(tag, -1) < at)
        self.add(page[at:])
        self.flush()
        self.judge()

    def judge(self) -> None:
        """Scores of the blocks by the elements around them, names and forms void where they hold what the page is about."""
        n = len(self.says)
        prose, articles, main = [0] * n, [int(e.article) for e in self.says], [e.main for e in self.says]
        for b in self.blocks:
            prose[b.element] += b.prose()
        for i in range(n - 1, 0, -1):  # elements come behind those around them
            up = self.says[i].up
            prose[up] += prose[i]
            articles[up] += articles[i]
            main[up] = main[up] or main[i]
        score = [0.0] * n
        for i in range(1, n):
            e = self.says[i]
            most = prose[0] > 0 and prose[i] >= WRAPPER * prose[0]
            wraps = most and (main[i] and not e.main or articles[0] > 0 and articles[i] == articles[0] and not e.article)
            score[i] = score[e.up] + e.sure + (0.0 if wraps else e.name) + (0.0 if most else e.form)
        for b in self.blocks:
            b.score = score[b.element]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            top = self.stack[-1] if self.stack else None
            holder = top.block if top else None
            inside = (holder or top).number if top else 0
            self.blocks.append(Block(text, top.outer if top else 0, inside, min(1.0, self.linked / len(text)), bool(holder) and holder.tag in HEADINGS))
        self.parts.clear()
        self.linked = 0

    def add(self, text: str) -> None:
        if text and not self.skipping():
            text = html.unescape(text)
            self.parts.append(text)
            if self.where["a"]:
                self.linked += len(" ".join(text.split()))

    def skipping(self) -> bool:
        return bool(self.stack) and self.stack[-1].skipped

    def pop(self) -> None:
        self.where[self.stack.pop().tag].pop()

    def close(self, tag: str) -> None:
        """End the innermost element of this tag and all inside it."""
        if self.where[tag]:
            place = self.where[tag][-1]
            if self.stack[-1].block is not (self.stack[place - 1].block if place else None):
                self.flush()
            while len(self.stack) > place:
                self.pop()

    def end(self, tag: str) -> None:
        self.close(tag)
        if tag in BLOCK and not self.skipping():
            self.flush()

    def start(self, tag: str, attributes: str, unended: bool) -> None:
        if self.where["option"] and tag not in ("option", "optgroup") or tag == "option":
            self.close("option")
        if tag in ("br", "wbr"):
            if tag == "br":
                self.add(" ")
            return
        if tag in BLOCK:
            self.close("svg")  # such a tag ends foreign content
            if not self.skipping():
                self.flush()
                self.close("p")
        if tag in ENDS:
            own, between = ENDS[tag]
            place = max((self.where[t][-1] for t in own if self.where[t]), default=-1)
            if place >= 0 and not any(self.where[t] and self.where[t][-1] > place for t in between):
                self.close(self.stack[place].tag)
        # a slash ends an element only in foreign content, and only where it isn't part of a value
        if tag in VOID or unended or (tag in FOREIGN or self.where["svg"] or self.where["math"]) and SLASH.search(attributes):
            return
        self.number += 1
        self.where[tag].append(len(self.stack))
        element, says = _element(tag, attributes, self.number, self.stack[-1] if self.stack else None)
        self.stack.append(element)
        self.says.append(says)


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order."""
    return Page(page).blocks


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side: source capacity is a positive cost, sink capacity a negative one (Dinic)."""
    n = len(costs)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        join(source, i, c, 0.0) if c > 0 else join(i, sink, -c, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        cursor = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, a = [], source
                continue
            while cursor[a] < len(graph[a]):
                e = graph[a][cursor[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                cursor[a] += 1
            if cursor[a] < len(graph[a]):
                path.append(graph[a][cursor[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                cursor[a] += 1
            else:
                break


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    costs = [b.cost() for b in blocks]
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.parent in last:
            edges.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    if costs and min(costs) > 0:  # nothing to cut
        return "\n".join(b.text for b in blocks)
    return "\n".join(b.text for b, keep in zip(blocks, minimum_cut(costs, edges), strict=True) if keep)


def _extract(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(columns)
            for at, end, data, offsets in text_slices(batch, "_html"):
                raw = data.tobytes()
                texts = [main_text(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*kept.slice(at, end - at).columns, pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*columns, "text", "n_chars"])

    return run


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html, ...).

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined by one newline. Null or empty html, or a page without content, gives an
    empty text. Pages are taken whole at any length and depth; an element that is never ended takes nothing
    else with it, but for script and style, as in browsers. Any page_id and url may be null or repeated,
    and repeated rows get equal texts; other columns are ignored, so their names can't clash. An empty table
    gives an empty result.
    """
    bounded_batches(pages.sparkSession)
    kinds = dict(pages.dtypes)
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("_html"))
    return source.mapInArrow(_extract(["page_id", "url"]), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages (see extract_main_text)."""
    return extract_main_text(table(spark, sf_dir, "pages"))
