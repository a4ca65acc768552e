"""Main text of web pages: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters.

The standard library's parser feeds lines (one for each block element) with their text, their link text,
their tags and the element that holds them.  A line's ratio is its characters outside links over its tags,
doubled in `article` and `main` and halved in parts whose name speaks weakly against them; the ratios are
smoothed by a Gaussian, and lines above a threshold (the standard deviation of the smoothed ratios) form
clusters.  The clusters choose the region: the `article` or `main` with most clustered text if that is half
of it or more, else the deepest element that holds nine tenths of it.

- Names outside the region, and of elements around it, decide nothing: a form around the page is no form part.
- Parts that are never main text by element or role (navigation, footers, asides, forms, hidden ones) are left out.
- So are parts that a class or id names so (notices, adverts, comments, sidebars and the like), but a name is weaker than
  the clusters: a part with nine tenths of the clustered text, or with half of it and the page's `main` or only `h1`, is
  a wrapper and stays.  Names of a state (nav-open, has-sidebar, newsletter-on) name nothing.
- Parts with weaker names (headers, related, share, banners, widgets) stay as far as their own lines reach the
  threshold; of a header inside the article the headings stay.
- In a region that is no `article` or `main`, lines before the first and after the last cluster go if they are
  mostly links; if the region is the whole page, also if neither they stand in a text element (paragraph, heading,
  quotation) nor any clustered line stands in such an element as theirs.
All other lines of the region stay, short ones too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text.
NEVER = frozenset("head script style noscript template nav footer aside button select textarea iframe object svg math canvas audio video menu title".split())
#: Left out inside the region only.
INNER = frozenset("form dialog".split())
_UNWANTED_ROLES = frozenset("navigation contentinfo complementary search alert menu menubar".split())
_END = r"(?:$|[\s_-])"
_UNWANTED_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|gdpr|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo\w*|replies|respond|sidebar|side-bar|sponsor\w*|subscribe)" + _END,
    re.IGNORECASE,
)
_WEAK_WORDS = re.compile(r"(?:^|[\s_-])(?:banner|header|masthead|related|share|sharing|social|toolbar|widget)" + _END, re.IGNORECASE)
_HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|masthead)" + _END, re.IGNORECASE)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements made for text.
_TEXT = _HEADINGS | {"p", "blockquote", "pre", "figcaption"}
#: Names of a state of a part or of what stands elsewhere.
_STATE = re.compile(r"(?:has|no|with|without|is|show|hide)[_-].*|.*[_-](?:open|opened|closed|on|off|enabled|disabled|active|inactive|visible|hidden|collapsed|expanded|ready|loaded)", re.IGNORECASE)
#: What a holder says of its text; NAMED: unwanted by class or id alone.
PLAIN, UNWANTED, INSIDE, WEAK, HEADER, NAMED = range(6)
#: Tags that close an open paragraph.
_ENDS_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "title"}
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    linked: int  # characters of links, white space as written
    tags: int
    holder: int
    heading: bool


class Lines(HTMLParser):
    """Feeds `lines`, and `holders`: (name, number of the parent, what the name says) of each element, by number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.open: Counter[str] = Counter()
        self.holders: list[tuple[str, int, int]] = [("", 0, PLAIN)]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.muted = 0
        self.around: set[int] = set()

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text or self.tags:
            self.lines.append(Line(text, min(self.linked, len(text)), self.tags, self.stack[-1][1] if self.stack else 0, any(self.open[h] for h in _HEADINGS)))
        self.parts, self.tags, self.linked = [], 0, 0

    def cut(self, i: int) -> None:
        """End the elements from place i of the stack on."""
        for name, h in self.stack[i:]:
            self.open[name] -= 1
            self.muted -= self.mutes(h)
        del self.stack[i:]

    def mutes(self, h: int) -> bool:
        """Whether the element is part of a line and its text is left out of it."""
        name, _, says = self.holders[h]
        return (says == UNWANTED or says == NAMED and h not in self.around) and name not in BLOCKS

    def surround(self) -> None:
        """Inline elements with a mere name around a block are wrappers: their text is heard from here on."""
        for _, h in self.stack:
            if self.mutes(h) and self.holders[h][2] == NAMED:
                self.around.add(h)
                self.muted -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.muted:
                self.surround()
            if tag in _ENDS_P:
                self.end("p", {"article", "aside", "section", "div", "td", "th", "li", "blockquote", "main", "footer", "header", "nav", "form", "figure"})
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                self.end(tag, {"ul", "ol", "dl", "table", "select", *({"tr"} if tag in ("td", "th") else ())})
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        values = {k: v or "" for k, v in attrs}
        role, words, says = values.get("role", "").lower(), f"{values.get('class', '')} {values.get('id', '')}".split(), PLAIN
        if tag in NEVER or role in _UNWANTED_ROLES or "hidden" in values or values.get("aria-hidden") == "true":
            says = UNWANTED
        elif tag in INNER or role in INNER:
            says = INSIDE
        elif tag == "header" or role == "banner":
            says = HEADER
        elif words and tag not in ("html", "body", "article", "main"):
            names = " ".join(w for w in words if not _STATE.fullmatch(w))
            says = NAMED if _UNWANTED_WORDS.search(names) else HEADER if _HEADER_WORDS.search(names) else WEAK if _WEAK_WORDS.search(names) else PLAIN
        self.holders.append((tag, self.stack[-1][1] if self.stack else 0, says))
        self.stack.append((tag, len(self.holders) - 1))
        self.open[tag] += 1
        self.muted += self.mutes(len(self.holders) - 1)

    def end(self, tag: str, fence: set[str]) -> None:
        """End the innermost open `tag`, unless a fence stands before it."""
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.flush()
                self.cut(i)
                return
            if self.stack[i][0] in fence:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if not self.open[tag]:
            return
        i = next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag)
        if any(name in BLOCKS for name, _ in self.stack[i + (tag not in BLOCKS) :]):
            if tag not in BLOCKS:  # an inline element that was left open across blocks
                self.open[tag] -= 1
                self.muted -= self.mutes(self.stack[i][1])
                del self.stack[i]
                return
            self.flush()
        self.cut(i)

    def handle_data(self, data: str) -> None:
        if not self.muted:
            self.parts.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())

    def finish(self) -> list[Line]:
        if re.match("<[!/?a-zA-Z]", self.rawdata):  # markup that the page's end cuts off
            self.rawdata = ""
        super().close()
        self.flush()
        return self.lines

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """<![ ... ]> of any kind is a comment."""
        mark = "]]>" if self.rawdata.startswith("<![CDATA[", i) else ">"
        end = self.rawdata.find(mark, i + 3)
        return end + len(mark) if end >= 0 else -1


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigma and renewed at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        part = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(k * v for k, v in zip(part, values[lo:hi])) / sum(part))
    return out


def ratios_of(lines: list[Line], boost: list[float]) -> list[float]:
    """Text-to-tag ratios: characters outside links over tags, times what the names around a line say."""
    return [(len(x.text) - x.linked) / max(x.tags, 1) * boost[x.holder] for x in lines]


def clusters(own: list[float]) -> tuple[list[int], float]:
    """The places of lines whose smoothed ratio reaches the threshold, and the threshold."""
    ratios = smooth(own)
    mean = sum(ratios) / len(ratios)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))
    return [i for i, r in enumerate(ratios) if r >= threshold], threshold


def weights(lines: list[Line], clustered: list[int], holders: list[tuple[str, int, int]]) -> list[float]:
    """The clustered characters outside links in each holder."""
    weight = [0.0] * len(holders)
    for i in clustered:
        weight[lines[i].holder] += len(lines[i].text) - 0.99 * lines[i].linked
    for h in range(len(holders) - 1, 0, -1):
        weight[holders[h][1]] += weight[h]
    return weight


def heads_of(holders: list[tuple[str, int, int]]) -> list[bool]:
    """Whether a holder has the page's `main`, or its `h1` if there is but one."""
    counts = Counter(name for name, _, _ in holders)
    out = [name == "main" or name == "h1" and counts["h1"] == 1 for name, _, _ in holders]
    for h in range(len(holders) - 1, 0, -1):
        out[holders[h][1]] = out[holders[h][1]] or out[h]
    return out


def main_text(html: str | None) -> str:
    """The main text: blocks in page order, one line each; empty if there is none."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    found = page.finish()
    holders = page.holders
    gone, boost = [False] * len(holders), [1.0] * len(holders)
    for h in range(1, len(holders)):  # parents have lower numbers
        name, up, says = holders[h]
        gone[h] = gone[up] or says == UNWANTED
        boost[h] = max(boost[up], 2.0) if name in ("article", "main") else boost[up] * (0.5 if says in (WEAK, HEADER) else 1.0)
    named_parts = [h for h in range(1, len(holders)) if holders[h][2] == NAMED and not gone[h]]
    if named_parts:
        lines = [x for x in found if x.text and not gone[x.holder]]
        if lines:
            heavy = weights(lines, clusters(ratios_of(lines, boost))[0], holders)
            marks = heads_of(holders)
            for h in named_parts:
                if not (heavy[h] >= 0.9 * heavy[0] > 0 or heavy[h] >= 0.5 * heavy[0] > 0 and marks[h]):
                    gone[h] = True
            for h in range(1, len(holders)):
                gone[h] = gone[h] or gone[holders[h][1]]
    lines = [x for x in found if x.text and not gone[x.holder]]
    if not lines:
        return ""
    own = ratios_of(lines, boost)
    clustered, threshold = clusters(own)
    weight = weights(lines, clustered, holders)
    named = [h for h in range(1, len(holders)) if holders[h][0] in ("article", "main") and not gone[h] and weight[h] >= max(0.5 * weight[0], 1e-9)]
    if named:
        region = max(named, key=lambda h: (weight[h], holders[h][0] == "article", -h))
    else:  # the deepest holder of at least nine tenths of the clustered text that is not a mere paragraph
        region = max((h for h in range(1, len(holders)) if weight[h] >= max(0.9 * weight[0], 1e-9) and holders[h][0] in ("body", "html", "div", "section", "td", "table", "blockquote", "form", "header")), default=0)
    inside, part = [h == region for h in range(len(holders))], [PLAIN] * len(holders)
    for h in range(1, len(holders)):
        _, up, says = holders[h]
        if h != region and inside[up]:
            inside[h] = True
            part[h] = part[up] if part[up] in (INSIDE, HEADER) or says == PLAIN else says
    whole = holders[region][0] in ("", "html", "body")
    kinds = {holders[lines[i].holder][0] for i in clustered if 2 * lines[i].linked < len(lines[i].text) and own[i] >= threshold} | _TEXT
    edges = [i for i in clustered if inside[lines[i].holder] and 2 * lines[i].linked < len(lines[i].text) and (not whole or holders[lines[i].holder][0] in kinds)] if not named else []
    out = []
    for i, x in enumerate(lines):
        if not inside[x.holder] or part[x.holder] == INSIDE:
            continue
        linked = 2 * x.linked >= len(x.text)
        if part[x.holder] in (WEAK, HEADER) and (linked or own[i] < threshold) and not (part[x.holder] == HEADER and x.heading and not whole):
            continue
        if edges and not edges[0] <= i <= edges[-1] and (linked or whole and holders[x.holder][0] not in kinds):
            continue
        out.append(x.text)
    return "\n".join(out)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text for each row.  Null or empty html gives an empty text; rows with equal page_id each get a row; an empty table none."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                yield pa.record_batch([part.column(0), part.column(1), pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the main text of every page and its code points."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
