"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events; each block becomes a line (a page's own line ends mean nothing,
many pages have one) with its characters outside links, its tags and its container. The ratios of characters to tags are
smoothed with a Gaussian over the neighbouring lines, and a threshold at their standard deviation parts lines of content
from the rest. These vote for a region: from the body down, the container that holds most of what they say. Its lines are
the text, short ones too; what lies in marked regions (menus, headers, footers, sidebars, notices, adverts, forms, comments) is not."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import texts_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose contents are no text of a page.
SKIPPED = frozenset("script style noscript template title svg iframe object canvas audio video select textarea button option datalist dialog map".split())
BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary fieldset legend form nav header footer aside center hgroup search menu head".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements an element's start ends, and where the search for them stops.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table"), "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
SCOPES = frozenset(("table", "td", "th", "caption"))
#: Elements and words of class, id and role that mark a region as no part of the article.
MARKED_TAGS = frozenset("nav footer aside form menu search header".split())
MARKED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot banner promo promos promotion sponsor sponsored sponsors sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead toolbar topbar "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets pagination pager form search contentinfo complementary alertdialog dialog menubar".split()
)
#: A marked word after one of these tells of a page's layout.
LAYOUT = frozenset("has with no without".split())
WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
#: Least share of a container's content that a container within must hold to take its place.
SHARE, ARTICLE_SHARE = 0.8, 0.5


class Reader(HTMLParser):
    """Blocks of a page as lines, and the containers they lie in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: Containers: (parent, kind), kind "article", "main", "tag" or "word" (how it is marked), "header", or "".
        self.nodes: list[tuple[int, str]] = [(-1, "")]
        #: Lines: [text parts, characters in links, tags, container, heading].
        self.lines: list[list] = []
        self.stack: list[tuple[str, int, bool]] = []
        self.open: Counter = Counter()
        self.skipping, self.link = 0, -1
        self.parts: list[str] = []
        self.linked, self.tags, self.heading = 0, 0, False

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append([text, min(self.linked, len(text)), self.tags, self.stack[-1][1] if self.stack else 0, self.heading])
            self.tags = 0
        self.parts, self.linked = [], 0

    def kind_of(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in ("html", "body", "head"):
            return ""
        given = {k: v or "" for k, v in attrs}
        words = [w.lower() for k in ("class", "id", "role") for w in [*WORD.findall(given.get(k, "")), "."]]
        named = [w for before, w in zip(["", *words], words, strict=False) if w in MARKED_WORDS and before not in LAYOUT]
        hidden = "hidden" in given or given.get("aria-modal") == "true" or re.search(r"display\s*:\s*none", given.get("style", ""))
        if tag == "header" or named and set(named) <= {"header"}:
            return "header"
        if hidden or tag in MARKED_TAGS:
            return "tag"
        if named:
            return "word"
        if tag == "article" or given.get("itemprop") == "articleBody" or given.get("role") == "article":
            return "article"
        return "main" if tag == "main" or given.get("role") == "main" else ""

    def push(self, tag: str, node: int, skip: bool) -> None:
        self.stack.append((tag, node, skip))
        self.open[tag] += 1
        self.skipping += skip

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag, _, skip = self.stack.pop()
            self.open[tag] -= 1
            self.skipping -= skip
        if self.link > len(self.stack):
            self.link = -1

    def close_before(self, found: frozenset, stop: frozenset) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in found:
                self.pop(at)
            elif self.stack[at][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr" and not self.skipping:
                self.flush()
            elif tag in ("br", "img"):
                self.parts.append(" ")
            return
        if self.skipping:
            self.push(tag, self.stack[-1][1], False)
            return
        node = self.stack[-1][1] if self.stack else 0
        if tag in SKIPPED:
            self.push(tag, node, True)
        elif tag in BLOCKS:
            self.flush()
            if self.open["p"]:
                self.close_before(frozenset("p"), SCOPES)
            if tag in CLOSES:
                self.close_before(*CLOSES[tag])
            self.heading = tag in HEADINGS
            parent = self.stack[-1][1] if self.stack else 0
            self.nodes.append((parent, self.kind_of(tag, attrs)))
            self.push(tag, len(self.nodes) - 1, False)
        elif tag == "a":
            self.link = len(self.stack)
        elif attrs and self.kind_of(tag, attrs) in ("tag", "word"):
            self.push(tag, node, True)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS and not self.skipping and (self.open[tag] or tag == "p"):
            self.flush()
            self.heading = False
        if tag == "a" and not self.skipping:
            self.link = -1
        if self.open[tag]:
            for at in range(len(self.stack) - 1, -1, -1):
                if self.stack[at][0] == tag:
                    if tag in BLOCKS:
                        self.flush()
                    self.pop(at)
                    return
                if self.stack[at][0] in SCOPES and tag not in ("table", "tr", "body", "html", "thead", "tbody", "tfoot", "article", "main"):
                    return

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.parts.append(data)
            if self.link >= 0:
                self.linked += len(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Of `<![`, which pages hold in any form, the parser raises what isn't a declaration; it is a comment to browsers."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1


def smoothed(values: np.ndarray, radius: int = 2, sigma: float = 1.0) -> np.ndarray:
    """Values under a Gaussian window; beyond the ends counts nothing."""
    window = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    weight = np.convolve(np.ones(len(values)), window, "full")[radius:-radius]
    return np.convolve(values, window, "full")[radius:-radius] / weight


def content_lines(ratios: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """True for kept lines whose smoothed ratio is at least the standard deviation of the smoothed ratios."""
    smooth = smoothed(np.where(kept, ratios, 0.0))
    return kept & (smooth >= smooth.std()) & (ratios > 0)


def parsed(html: str) -> Reader:
    last = html.rfind("<")
    if last > html.rfind(">") and (html[last + 1 : last + 2].isalpha() or html[last + 1 : last + 2] in ("/", "!")):
        html = html[:last]  # a tag that the page's end cuts off
    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader


def unmarked(lines: list[list], nodes: list[tuple[int, str]]) -> np.ndarray:
    """True for the lines outside marked containers. A mark doesn't count where it holds an article or main element (pages
    wrapped in a form); an article's own header keeps its headings. If nothing is left, marks by words don't count."""
    holds = [kind in ("article", "main") for _, kind in nodes]
    for n in range(len(nodes) - 1, 0, -1):
        holds[nodes[n][0]] |= holds[n]
    inside, gone, by_tag, title = ([False] * len(nodes) for _ in range(4))
    for n in range(1, len(nodes)):
        parent, kind = nodes[n]
        inside[n] = inside[parent] or kind in ("article", "main")
        gone[n] = gone[parent] or not holds[n] and (kind in ("tag", "word") or kind == "header" and not inside[parent])
        by_tag[n] = by_tag[parent] or kind in ("tag", "header")
        title[n] = title[parent] or kind == "header" and inside[parent]
    kept = np.array([not gone[ln[3]] and (ln[4] or not title[ln[3]]) for ln in lines])
    return kept if kept.any() else np.array([not by_tag[ln[3]] for ln in lines])


def region_of(nodes: list[tuple[int, str]], mass: np.ndarray, chars: np.ndarray) -> int:
    """The container that the lines of content vote for. mass: their characters in each container, chars: those of all kept
    lines. An article or main element with half of the content, or the only article unless it is a tenth of the text at
    most; else from the body down while one container within holds most."""
    for kind in ("article", "main"):
        found = sorted((n for n in range(len(nodes)) if nodes[n][1] == kind), key=lambda n: (-mass[n], -chars[n], n))
        if found and (mass[found[0]] >= ARTICLE_SHARE * mass[0] or len(found) == 1 and chars[found[0]] > chars[0] / 10):
            return found[0]
    children: list[list[int]] = [[] for _ in nodes]
    for n in range(1, len(nodes)):
        children[nodes[n][0]].append(n)
    region = 0
    while True:
        down = max(children[region], key=lambda n: (mass[n], -n), default=None)
        if down is None or not children[down] or not mass[down] or mass[down] < SHARE * mass[region]:
            return region
        region = down


def main_text(html: str | None) -> str:
    """Blocks of a page's article, joined by two line ends; empty for null, and for a page without text."""
    reader = parsed(html or "")
    lines, nodes = reader.lines, reader.nodes
    if not lines:
        return ""
    kept = unmarked(lines, nodes)
    own = np.array([len(ln[0]) - ln[1] for ln in lines], float)
    content = content_lines(own / np.array([max(1, ln[2]) for ln in lines]), kept)
    if not content.any():
        content = kept & (own > 0) if (kept & (own > 0)).any() else kept
    mass, chars = np.zeros(len(nodes)), np.zeros(len(nodes))
    at = [ln[3] for ln in lines]
    np.add.at(mass, at, own * content)
    np.add.at(chars, at, own * kept)
    for n in range(len(nodes) - 1, 0, -1):
        mass[nodes[n][0]] += mass[n]
        chars[nodes[n][0]] += chars[n]
    region = region_of(nodes, mass, chars)
    part = [-1] * len(nodes)  # the container right in the region that holds a container
    for n, (parent, _) in enumerate(nodes):
        part[n] = n if n == region or parent == region else part[parent] if parent >= 0 else -1
    chosen = kept & np.array([part[n] >= 0 for n in at])
    if nodes[region][1] not in ("article", "main") and mass[0]:
        # Unmarked menus go: parts, or lines right in the region, without content that are mostly links.
        names = [part[n] if part[n] != region else (k,) for k, n in enumerate(at)]
        linked, size = Counter(), Counter()
        for name, ln in zip(names, lines, strict=True):
            linked[name] += ln[1]
            size[name] += len(ln[0])
        for k, name in enumerate(names):
            chosen[k] &= 2 * linked[name] <= size[name] or bool(content[k] if name == (k,) else mass[name])
        # A heading right before the region, in the container around it, is its title.
        k = int(np.argmax(chosen)) if chosen.any() else 0
        while k and region and lines[k - 1][4] and kept[k - 1] and nodes[lines[k - 1][3]][0] == nodes[region][0]:
            k -= 1
            chosen[k] = True
    return "\n\n".join(ln[0] for ln, c in zip(lines, chosen, strict=True) if c)


def extract_pages(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The columns of df but html_col, and text_col, the page's main text (empty where the page is null or has none).

    Pages of any length are read whole. Repeated rows stay, each with its text; an empty table gives an empty one. Columns may have any
    name but text_col, which is replaced. No shuffle: each page is read where it lies."""
    others = [c for c in df.columns if c not in (html_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = pa.array([main_text(h) for h in texts_of(part.column(part.num_columns - 1)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], schema=pa.schema([*list(part.schema)[:-1], pa.field("text", pa.string())]))

    schema = StructType([*(StructField(f"c{k}", df.schema[c].dataType) for k, c in enumerate(others)), StructField("text", StringType())])
    rows = df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)), F.col(html_col).alias("text"))
    return rows.mapInArrow(run, schema).toDF(*others, text_col)
