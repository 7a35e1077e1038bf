"""Main text of web pages by text-to-tag ratios.

The events of the standard library's streaming parser are cut into lines at block elements. A line's ratio is its
text length over its number of tags; ratios are smoothed with a Gaussian along the page and clustered into content
and the rest by a threshold. The content lines point out the region of the page that holds them: the smallest element
around all of them, or the article or main element around that. All lines of that region are kept, but for the parts
that are no article text.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formgrain.llm import common

#: Elements by what they do on a page.
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select
summary table tbody td tfoot th thead title tr ul""".split())
REGIONS = frozenset("article main section div body td".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title textarea select option button svg math canvas iframe object audio video".split())
OUTSIDE = frozenset("nav aside footer form menu dialog".split())
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
LISTS = frozenset("ul ol dl table".split())
CONTROLS = frozenset("input select textarea button".split())
#: A form is around the content, and not a form to fill in, if it has more characters than this for each of its controls.
CHARACTERS_A_CONTROL = 40
#: What closes without an end tag: a new element ends an open one of these, up to the nearest region.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
ENDS_P = frozenset("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header
hr main menu nav ol p pre section table ul""".split())
#: Words whose whole class, id or role (alone, or with words that only say what they are) names parts which are no article text.
NAMES = r"""(?:
    ads?|advert\w*|adsense|adbox|adslot|adunit|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscri\w+|paywall|popup|modal|overlay|
    navigation|nav|navbar|menu|breadcrumbs?|pagination|pager|toc|sidebar|aside|complementary|contentinfo|search|
    footer|header|masthead|comments?|commentlist|disqus|replies|respond|discussion|
    share|sharing|social|related|recommend\w*|widget|login|signup|skip|hidden
)"""
PLAIN = r"(?:site|box|slot|unit|bar|block|list|item|area|section|links?|buttons?|posts?|articles?|form|wrapper|container|inner|top|bottom|left|right|\d+)"
NOT_ARTICLE = re.compile(rf"(?xi)(?:{PLAIN}-)*{NAMES}(?:-(?:{NAMES}|{PLAIN}))*")


def not_article(value: str) -> bool:
    return any(NOT_ARTICLE.fullmatch(name) for name in value.replace("_", "-").split())


class Line(NamedTuple):
    """A line of a page; elements are told by their numbers, which rise in page order (0: none)."""

    text: str
    tags: int
    at: int  # innermost element
    named: int  # innermost element that seems to be no article
    article: int  # innermost article


class Lines(HTMLParser):
    """Lines of a page. Elements whose tags, names or roles say that they are no article text are noted, as it takes the
    whole page to tell whether that holds; lines in hidden ones are left out. An element holds the numbers from its own
    to that of the last one inside, so no line lists the elements around it and deep pages cost no more than flat ones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int, int]] = []  # element, number, hidden, innermost named, innermost article
        self.open_at: dict[str, list[int]] = defaultdict(list)  # places of a tag in ``open``
        self.barriers: list[int] = []  # places of regions and lists in ``open``
        self.parents, self.last = [0], [0]
        self.kinds: dict[int, str] = {}  # elements of REGIONS
        self.outer_named: dict[int, int] = {}  # named elements with the named one around
        self.around: set[int] = set()  # named elements with main inside
        self.kept_out: set[int] = set()  # named elements that most of the content being inside does not lift
        self.controls: Counter[int] = Counter()  # controls by innermost named element
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[Line] = []

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            _, at, hidden, named, article = self.open[-1] if self.open else ("", 0, False, 0, 0)
            if not hidden:
                self.lines.append(Line(line, self.tags, at, named, article))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCKS:
            self.end_line()
        if tag in ENDS_P:
            self.pop({"p"})
        if tag in CLOSES:
            self.pop(CLOSES[tag])
        self.tags += 1
        if tag in CONTROLS and self.open:
            self.controls[self.open[-1][3]] += 1
        if tag in EMPTY:
            return
        _, parent, outer, named, article = self.open[-1] if self.open else ("", 0, False, 0, 0)
        number = len(self.parents)
        self.parents.append(parent)
        self.last.append(0)
        told = tag not in ("html", "body", "article", "main") and any(k in ("class", "id", "role") and v and not_article(v) for k, v in attrs)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
        in_article = article or self.open_at["main"]
        if told or tag in OUTSIDE or tag == "header" and not in_article:
            self.outer_named[number] = named
            named = number
            if not told and tag != "form":
                self.kept_out.add(number)
        out = outer or tag in HIDDEN or hidden
        if tag in REGIONS:
            self.kinds[number] = tag
        if tag == "article":
            article = number
        if tag == "main" and not out:
            n = named
            while n and n not in self.around:
                self.around.add(n)
                n = self.outer_named[n]
        if tag in REGIONS or tag in LISTS:
            self.barriers.append(len(self.open))
        self.open_at[tag].append(len(self.open))
        self.open.append((tag, number, out, named, article))

    def handle_startendtag(self, tag, attrs):
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1

    def close_from(self, k: int) -> None:
        """Ends the k-th open element and all inside."""
        while len(self.open) > k:
            tag, number, _, _, _ = self.open.pop()
            self.last[number] = len(self.parents) - 1
            self.open_at[tag].pop()
        while self.barriers and self.barriers[-1] >= k:
            self.barriers.pop()

    def end_head(self) -> None:
        """What cannot stand in a head ends it, as its end tag may be left out."""
        if self.open and self.open[-1][0] == "head":
            self.end_line()
            self.close_from(len(self.open) - 1)

    def pop(self, tags) -> None:
        """Ends the innermost open element of these, unless a region or a list lies between."""
        k = max((self.open_at[t][-1] for t in tags if self.open_at[t]), default=-1)
        if k >= 0 and (not self.barriers or k >= self.barriers[-1]):
            self.close_from(k)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if self.open_at[tag]:
            self.close_from(self.open_at[tag][-1])

    def handle_data(self, data):
        if not data.isspace():
            self.end_head()
        if not (self.open and self.open[-1][0] in HIDDEN):
            self.text.append(data)

    def holds(self, n: int, line: Line) -> bool:
        return not n or n <= line.at <= self.last[n]


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian mean along the page; lines beyond its ends count for nothing."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    weights = np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach:reach + len(ratios)] / weights


def content(ratios: np.ndarray) -> np.ndarray:
    """Which smoothed ratios are content: the threshold is moved to the middle of the two clusters' means till it stays."""
    cut = float(ratios.mean())
    for _ in range(50):
        high = ratios >= cut
        if high.all() or not high.any():
            break
        new = (float(ratios[high].mean()) + float(ratios[~high].mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return ratios >= min(cut, float(ratios.max()))


def region_of(parser: Lines, lines: list[Line]) -> int:
    """The smallest region around all these lines; the outermost article around it, or else main, if there is one, and
    never a table cell alone. 0: the whole page."""
    first, last = min(x.at for x in lines), max(x.at for x in lines)
    shared, n = [], first
    while n:
        if parser.last[n] >= last and n in parser.kinds:
            shared.append(n)
        n = parser.parents[n]
    for kind in ("article", "main"):
        for n in reversed(shared):
            if parser.kinds[n] == kind:
                return n
    return next((n for n in shared if parser.kinds[n] != "td"), 0)


def ratios_of(lines: list[Line]) -> np.ndarray:
    return np.log1p(np.array([len(x.text) for x in lines]) / np.maximum(1, [x.tags for x in lines]))


def sure_content(lines: list[Line]) -> list[Line]:
    """Content lines, but for those that only their neighbours lift: they may stand just outside of the region."""
    ratios = ratios_of(lines)
    smooth = smoothed(ratios)
    chosen = content(smooth)
    sure = chosen & (ratios >= smooth[chosen].min())
    return [x for x, good in zip(lines, sure if sure.any() else chosen, strict=True) if good]


def kept_lines(parser: Lines) -> list[Line]:
    """Lines but for those in elements noted as no article. A note says nothing where main stands inside, and, unless
    an article stands outside of all noted elements, where an article does, or most of the content in an element noted
    for its name or a form with few controls."""
    lines = parser.lines
    if not any(x.named for x in lines):
        return lines
    lifted = set(parser.around)
    if not any(x.article and not x.named for x in lines):
        good = content(ratios_of(lines))
        total, size = int(good.sum()), sum(len(x.text) for x, high in zip(lines, good, strict=True) if high)
        # Content lines, their characters and the innermost article of each noted element, with what lifted ones inside leave.
        held: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0])
        controls = parser.controls.copy()
        for x, high in zip(lines, good, strict=True):
            own = held[x.named]
            held[x.named] = [own[0] + bool(high), own[1] + len(x.text) * bool(high), max(own[2], x.article)]
        for n in sorted(parser.outer_named, reverse=True):
            own = held[n]
            controls[parser.outer_named[n]] += controls[n]
            most = 2 * own[0] > total and 2 * own[1] > size and own[1] > CHARACTERS_A_CONTROL * controls[n]
            if n in lifted or most and n not in parser.kept_out or own[2] > n:
                lifted.add(n)
                outer = held[parser.outer_named[n]]
                held[parser.outer_named[n]] = [outer[0] + own[0], outer[1] + own[1], max(outer[2], own[2])]
    clear = {0: True}
    for n in sorted(parser.outer_named):
        clear[n] = n in lifted and clear[parser.outer_named[n]]
    return [x for x in lines if clear[x.named]]


def main_text(html: str) -> str:
    parser = Lines()
    # A tag that the page's end cuts off is no text.
    parser.feed(html[:html.rfind("<")] if re.fullmatch(r"<[A-Za-z/!][^>]*", html[html.rfind("<"):]) else html)
    parser.close()
    parser.end_line()
    parser.close_from(0)
    lines = kept_lines(parser)
    if not lines:
        return ""
    region = region_of(parser, sure_content(lines))
    return " ".join(x.text for x in lines if parser.holds(region, x))


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text((h or b"").decode("utf-8", "replace")) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    Blocks are trimmed, their white space is turned into single spaces, and they are joined in page order by one
    space. A null or empty page, and one without text, has an empty text. Pages are read whole, whatever their length;
    repeated rows and null ids are handled like any others; other columns are ignored; an empty table gives an empty
    result. No shuffle.
    """
    common.on_workers(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").cast("binary").alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(extracted, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
