"""Operator 6: main text of HTML pages by text-to-tag ratios.

The page goes through the standard library's streaming parser.  Its events fill
lines (one per block of the page) with text and a count of tags; text inside
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments is dropped as it passes.  The ratio of text to tags per line is smoothed
with a Gaussian kernel and clustered into two by a threshold; lines above it mark
the content regions, and every region with such a line (an article, the main element, or
the container of such lines outside them) is taken whole, so that its short lines stay.
What only a class, id or role names as no content stays dropped unless it holds most of
the page's text; articles and the main element are never dropped by such a name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: elements whose text never belongs to the article
OUT = frozenset("""nav header footer aside form script style noscript template title head select button textarea
iframe object svg canvas menu dialog""".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: words of class, id or role that name such an element, alone or with others in one name
OUT_WORDS = re.compile(
    r"(?!(?:with|has|no)[_-])(?:\S*[_-])?(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|"
    r"cookie|cookies|consent|notice|notices|alert|popup|modal|overlay|nav|navbar|navigation|menu|breadcrumb|"
    r"breadcrumbs|sidebar|footer|masthead|topbar|comment|comments|disqus|replies|respond|discussion|share|sharing|"
    r"social|related|recommended|subscribe|newsletter|signup|login|search|pagination|pager|toolbar|widget|"
    r"contentinfo|complementary|dialog)(?:[_-]\S*)?|(?:site|page|main)[_-]header", re.I)
#: comments can be longer than what they comment on, so their length says nothing
COMMENT_WORDS = re.compile(r"(?:\S*[_-])?(?:comment|comments|disqus|replies|respond|discussion)(?:[_-]\S*)?", re.I)
CLOSES_P = BLOCKS - {"body", "html", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: an open element of the key is closed by a sibling of the value
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
REGIONS = frozenset(["article", "main"])
#: elements that hold blocks of text
CONTAINERS = frozenset("center details div fieldset section".split())


#: tags without attributes, outside the elements whose content is no markup
PLAIN_START = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)>")
PLAIN_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


class _Lines(HTMLParser):
    """Events -> lines of [texts, tags, region, characters in links, block, container, doubtful].

    Regions (an article, or the main element) are numbered from 1.  The last three are numbers of the
    innermost open elements of their kind (0: none); ``above`` has the next one around each.  Doubtful
    are elements that their names alone call no content.  A line costs the same however deep it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: the next block, container and doubtful element around an element of that kind
        self.above: tuple[dict[int, int], ...] = ({}, {}, {})
        self.inner = (0, 0, 0)
        self.lines: list[list] = [[[], 0, 0, 0, 0, 0, 0]]
        self.open: list[tuple] = []     #: (tag, whether its text is out, region and inner elements around it)
        self.places: dict[str, list[int]] = {}      #: where a tag stands among the open ones
        self.elements = 0
        self.links = 0
        self.out = 0
        self.region = 0
        self.regions = 0

    def updatepos(self, i, j):
        return j                    # nobody asks for line numbers

    def parse_starttag(self, i):
        m = PLAIN_START.match(self.rawdata, i)
        if m is None or (tag := m[1].lower()) in RAW:
            return super().parse_starttag(i)
        self.handle_starttag(tag, ())
        return m.end()

    def parse_endtag(self, i):
        m = PLAIN_END.match(self.rawdata, i)
        if m is None or self.cdata_elem is not None or (tag := m[1].lower()) in RAW:
            return super().parse_endtag(i)
        self.handle_endtag(tag)
        return m.end()

    def _break(self):
        line = self.lines[-1]
        if line[0]:
            self.lines.append([[], 0, self.region, 0, 0, 0, self.inner[2]])
        else:
            line[2], line[6] = self.region, self.inner[2]

    def _push(self, tag: str, out: int, kinds: tuple[bool, bool, bool]):
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, out, self.region, self.inner))
        for above, around, is_one in zip(self.above, self.inner, kinds):
            if is_one:
                above[self.elements] = around
        self.inner = tuple(self.elements if is_one else around for around, is_one in zip(self.inner, kinds))

    def _leaves(self, tag: str, attrs) -> tuple[bool, bool]:
        """Whether the text of an element is out, and whether only its length can save it."""
        if tag in OUT:
            return True, False
        if tag in ("body", "html"):
            return False, False
        named = []
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True, False
            if value and name in ("class", "id", "role"):
                named += [x for x in value.split() if OUT_WORDS.fullmatch(x)]
        if not named or tag in REGIONS:
            return False, False
        sure = tag not in BLOCKS or any(COMMENT_WORDS.fullmatch(x) for x in named)
        return sure, not sure

    def _pop(self, at: int):
        for tag, out, _, _ in self.open[at:]:
            self.out -= out
            self.links -= tag == "a"
            self.places[tag].pop()
        _, _, self.region, self.inner = self.open[at]
        del self.open[at:]

    def _close_implied(self, tag: str):
        if tag in BLOCKS and tag not in ("html", "head"):
            for i, x in enumerate(self.open[:2]):
                if x[0] == "head":          # a head that was never closed
                    self._pop(i)
                    break
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == "p" and tag in CLOSES_P or tag in CLOSED_BY.get(name, ()):
                self._break()
                self._pop(i)
                return
            if name in BLOCKS and name != "p" and (tag not in SCOPES or name in SCOPES[tag]):
                return

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCKS
        if block or tag in CLOSED_BY:
            self._close_implied(tag)
        if block:
            self._break()
        self.lines[-1][1] += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        out, doubtful = self._leaves(tag, attrs)
        self.elements += 1
        self.links += tag == "a"
        if self.out and tag in HEADINGS and self.region and self.open[-1][:2] == ("header", 1) and self.out == 1:
            # the heading of an article stays though it stands in the article's header
            self._push(tag, -1, (True, False, False))
            self.out -= 1
            return
        self._push(tag, int(out), (block, tag in CONTAINERS, doubtful))
        self.out += out
        if doubtful:
            self.lines[-1][6] = self.inner[2]
        if tag in REGIONS and not self.region and not self.out:
            self.regions += 1
            self.region = self.regions
            self.lines[-1][2] = self.region

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        at = self.places.get(tag)
        if not at:
            return
        around = max((self.places[x][-1] for x in REGIONS if self.places.get(x)), default=-1)
        if tag not in BLOCKS and around > at[-1]:
            return                      # an article is not closed by what stands in or around it
        if tag in BLOCKS:
            self._break()
        self.lines[-1][1] += 1
        self._pop(at[-1])
        if tag in BLOCKS:
            self.lines[-1][2], self.lines[-1][6] = self.region, self.inner[2]

    def handle_data(self, data):
        if not self.out:
            line = self.lines[-1]
            if not line[0] and not self.region:
                line[4], line[5] = self.inner[:2]
            line[0].append(data)
            if self.links:
                line[3] += len(data)


def ratios(lengths: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Text-to-tag ratio per line, smoothed by a Gaussian kernel that is as wide as two lines of each side."""
    raw = lengths / np.maximum(tags, 1)
    reach = np.arange(-2, 3)
    kernel = np.exp(-reach**2 / (2 * SIGMA**2))
    return np.convolve(raw, kernel / kernel.sum(), mode="full")[2:2 + len(raw)]


def threshold(values: np.ndarray) -> float:
    """Cut between two clusters of the values (two means on a line)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        below, above = values[values < cut], values[values >= cut]
        if not len(below) or not len(above):
            break
        now = float(below.mean()), float(above.mean())
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def _sums(above: dict[int, int], at: list[int], weights: np.ndarray) -> dict[int, float]:
    """Weight inside every element (and inside the page, 0): that of the lines in it, at any depth."""
    inside = dict.fromkeys(above, 0.0) | {0: 0.0}
    for e, w in zip(at, weights.tolist()):
        inside[e] += w
    for e in sorted(above, reverse=True):           # an element has a larger number than those around it
        inside[above[e]] += inside[e]
    return inside


def _around(above: dict[int, int], at: list[int]) -> int:
    """The innermost element around all of the lines."""
    inside = _sums(above, at, np.ones(len(at)))
    return max(e for e, n in inside.items() if n == len(at))


def _within(above: dict[int, int], roots: set[int]) -> set[int]:
    """The elements that are one of ``roots`` or stand in one."""
    found = {0} & roots
    for e in sorted(above):
        if e in roots or above[e] in found:
            found.add(e)
    return found


def _content(lines: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Length of each line, and whether its smoothed ratio is in the upper cluster."""
    lengths = np.array([len(x[0]) for x in lines], float)
    smooth = ratios(lengths, np.array([x[1] for x in lines], float))
    return lengths, smooth >= threshold(smooth)


def _without_doubtful(lines: list[tuple], above: dict[int, int]) -> list[tuple]:
    """The lines outside doubtful elements, and inside those that hold most of the text and of the
    content lines while no article elsewhere holds a content line or a line as long as one."""
    if not above:
        return lines
    lengths, content = _content(lines)
    told = (np.array([x[2] for x in lines]) > 0) & (content | (lengths >= threshold(lengths)))
    at = [x[6] for x in lines]
    text, main, articles = (_sums(above, at, w) for w in (lengths, lengths * content, told.astype(float)))
    kept = {0}
    for e in sorted(above):
        if above[e] in kept and 2 * text[e] > text[0] and 2 * main[e] > main[0] and articles[e] == articles[0]:
            kept.add(e)
    return [x for x in lines if x[6] in kept]


def extract(html: str) -> str:
    """Blocks of the content regions in page order, joined by an empty line."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    blocks, containers, doubtful = parser.above
    lines = [(" ".join("".join(x[0]).split()), *x[1:]) for x in parser.lines]
    lines = [x for x in lines if x[0]]
    lines = _without_doubtful(lines, doubtful) if lines else lines
    if not lines:
        return ""
    lengths, content = _content(lines)
    region = np.array([x[2] for x in lines])
    links = np.array([x[3] for x in lines]) > 0.5 * lengths
    if region.any():
        # whole articles with content lines, and whole containers of such lines outside articles
        chosen = set(region[content & (region > 0)].tolist())
        outside = content & ~links & (region == 0)
        if not chosen and not outside.any():
            chosen = {int(np.argmax(np.bincount(region, np.where(region > 0, lengths, 0))))}
        keep = outside | np.isin(region, list(chosen))
        if outside.any():
            held = [lines[i][5] for i in np.flatnonzero(outside)]
            # lines of different parts of the page have no container in common but the page
            around = _around(containers, held)
            within = _within(containers, {around} if around else set(held) - {0})
            keep |= (region == 0) & ~links & np.array([x[5] in within for x in lines])
    else:
        # the innermost element around all content lines, without its lists of links
        within = _within(blocks, {_around(blocks, [lines[i][4] for i in np.flatnonzero(content)])})
        keep = np.array([x[4] in within for x in lines]) & (content | ~links)
    return "\n\n".join(x[0] for x, k in zip(lines, keep) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text string, n_chars long; one row per input row.

    Null and empty pages, and pages without a content region, have an empty text.  White
    space inside a block becomes one space.  Repeated rows and null ids each give a row;
    other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
