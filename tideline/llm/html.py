"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; they are folded into lines (one for each
block of running text) with counts of text, tags and link text. A line's ratio of text
outside links to tags (its square root, so that a few long lines don't outweigh all) is smoothed with a Gaussian over its
neighbours. Two clusters, around the origin and around a mean that is worked out, set the
threshold between sparse and dense lines. Runs of dense lines, from one that is dense by
itself to another, are content, and so is what belongs to these regions: sparse lines
between dense ones of the same container, and at its ends too, but for lists of links;
of the page's body itself only what is between dense lines.

Elements, roles and names are evidence on the ratio. Lines of menus, headers, footers, side bars, notices, adverts,
forms and reader comments get a ratio below all others, so that they are neither dense nor of a dense region. Names
are weak evidence, for they tell of layouts too (``has-sidebar``): all lines are clustered first without any, and
an element that holds most of the dense text keeps its ratios whatever it is named, and so does
a form. Scripts, styles, controls and hidden elements have no lines.

Defined results: null or empty html gives an empty text, and so does a page whose lines
are all excluded; unclosed and stray tags are tolerated; white space (as ``str.split``
sees it) becomes one space; equal rows are kept; other columns are ignored. Time and memory
are linear in the page.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.session import ship_package
from tideline.llm.store import small_batches

# Elements of HTML by the part they play here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
SKIPPED = frozenset("script style noscript template title button select textarea iframe object svg canvas audio video map datalist option".split())
BESIDE = frozenset("nav header footer aside dialog menu".split())
CLOSED_BY_BLOCK = frozenset(("p", "dt", "dd"))
SCOPES = frozenset("article main body html nav header footer aside form table section dialog".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
SKIPPED_NAMES = frozenset(
    "ad ads adbox adslot adunit advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar sidenav aside rail menu nav navbar"
    " navigation breadcrumb breadcrumbs topbar masthead header footer foot share sharing social related recommended recommendations trending"
    " comment comments commentlist discussion reply replies respond disqus feedback widget toolbar pagination pager skip copyright legal"
    " disclaimer form search hidden responses reactions guestbook announcement toast cta adsbygoogle adsense taboola outbrain".split()
)
#: words that names of containers of articles have beside those
WHOLE_NAMES = frozenset("article body content entry has layout main no page post story with without wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th caption".split())
WITHIN = LISTS | HEADINGS | frozenset("p blockquote pre figure figcaption center details summary hgroup address".split())
PAGE = frozenset(("html", "body", ""))
ROOTS = ("article", "main")
#: shares of the dense text from which an element counts as the article's, whatever its name says
MOST, NEARLY_ALL, NEVER = 0.5, 0.8, 2.0
SIGMA = 1.0
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _excluded(tag: str, attrs: list[tuple[str, str | None]]) -> float | None:
    """None if the element has no lines; else 0, or the share of the dense text from which it isn't beside the article after all."""
    if tag in SKIPPED:
        return None
    beside = NEVER if tag in BESIDE else MOST if tag == "form" else 0.0
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
            return None
        if name == "role" and value.lower() in SKIPPED_ROLES:
            beside = NEVER
        if name in ("class", "id") and tag not in ("body", "html", "main"):
            words = {w.lower() for w in _NAME.findall(value)}
            if not SKIPPED_NAMES.isdisjoint(words - {"header"} if tag in HEADINGS else words):
                beside = max(beside, NEARLY_ALL if WHOLE_NAMES.isdisjoint(words) and tag not in ROOTS else MOST)
    return beside


class Lines(HTMLParser):
    """Folds parser events into ``lines``: (text, tags, link characters, element that holds it).

    Elements are numbered as they open: ``kinds``, ``parents`` and ``beside`` tell of each;
    number 0 stands for the page. What has no lines is left out here.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.kinds, self.parents, self.beside = [""], [0], [0.0]
        self._open: list[tuple[str, int, bool]] = []
        self._places: dict[str, list[int]] = {}
        self._scopes: list[int] = []
        self._skipping = 0
        self._doubtful: list[int] = []
        self._text: list[str] = []
        self._tags = 0
        self._links = 0
        self._anchors = 0
        self._seen, self._known, self._within, self._found = 0, 1, [False], False

    def _break(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append((text, self._tags, min(self._links, len(text)), self._open[-1][1] if self._open else 0))
            self._tags = 0
        self._text.clear()
        self._links = 0

    def _push(self, tag: str, excluded: float | None) -> None:
        self._places.setdefault(tag, []).append(len(self._open))
        if tag in SCOPES:
            self._scopes.append(len(self._open))
        self.parents.append(self._open[-1][1] if self._open else 0)
        self.kinds.append(tag)
        self.beside.append(excluded or 0.0)
        self._open.append((tag, len(self.kinds) - 1, excluded is None))
        self._skipping += excluded is None
        if excluded != 0:
            self._doubtful.append(len(self._open) - 1)

    def _pop_to(self, place: int) -> None:
        while self._doubtful and self._doubtful[-1] >= place:
            self._doubtful.pop()
        for tag, _, skipped in self._open[place:]:
            self._skipping -= skipped
            self._places[tag].pop()
            if tag in SCOPES:
                self._scopes.pop()
        del self._open[place:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += not self._skipping
        if tag == "br" or (tag in VOID and tag not in INLINE):
            self._break()
            return
        if tag == "a":
            self._anchors = 1
        if tag in INLINE:
            if tag not in VOID and (excluded := _excluded(tag, attrs)) != 0:
                self._break()
                self._push(tag, excluded)
            return
        self._break()
        self._anchors = 0
        closed = CLOSED_BY_BLOCK | {tag} if tag in ("li", "tr", "td", "th", "option") else CLOSED_BY_BLOCK
        while self._open and self._open[-1][0] in closed:
            self._pop_to(len(self._open) - 1)
        if tag in ROOTS and self._doubtful and not self._clean:
            # what leads up to the content was left open: it ends here
            self._pop_to(self._doubtful[0])
        self._push(tag, _excluded(tag, attrs))

    @property
    def _clean(self) -> bool:
        """Whether there is a line already that nothing excludes."""
        while self._seen < len(self.lines):
            element = self.lines[self._seen][3]
            while self._known < len(self.kinds):
                self._within.append(self.beside[self._known] > 0 or self._within[self.parents[self._known]])
                self._known += 1
            self._seen += 1
            if not self._within[element]:
                self._found = True
        return self._found

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += not self._skipping
        if tag == "a":
            self._anchors = 0
        if tag not in INLINE:
            self._break()
        place = (self._places.get(tag) or [-1])[-1]
        if place < 0:
            return
        if tag in INLINE:
            if place == len(self._open) - 1:
                self._break()
                self._pop_to(place)
        elif tag in SCOPES or not self._scopes or place > self._scopes[-1]:
            self._pop_to(place)

    def handle_data(self, data: str) -> None:
        if self._skipping:
            return
        self._text.append(data)
        if self._anchors:
            self._links += len(data)

    def close(self) -> None:
        super().close()
        self._break()


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing over neighbours; weights are normalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    found = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        part = weights[low - i + reach : high - i + reach]
        found.append(sum(v * w for v, w in zip(values[low:high], part, strict=True)) / sum(part))
    return found


def threshold(ratios: list[float]) -> float:
    """The boundary of two clusters of ratios.

    One centre stays at the origin, the other starts at the largest ratio and moves to the
    mean of the ratios that are nearer to it, which lowers the boundary between the two.
    """
    centre, count = max(ratios, default=0.0), 0
    while True:
        near = [value for value in ratios if 2 * value >= centre]
        if len(near) == count:
            return centre / 2
        count = len(near)
        centre = sum(near) / count


def dense(ratios: list[float]) -> list[bool]:
    """Which lines are in dense regions: runs over the threshold, smoothed, that start and end with lines over it themselves.

    A line with a ratio below 0 is in none.
    """
    soft = smoothed([max(0.0, value) for value in ratios])
    least = threshold(soft)
    found = [value >= least and own >= 0 for value, own in zip(soft, ratios, strict=True)]
    for order in (range(len(ratios)), range(len(ratios) - 1, -1, -1)):
        inside = False
        for i in order:
            inside = found[i] and (inside or ratios[i] >= least)
            found[i] = inside
    return found


def ratios_of(lines: list[tuple[str, int, int, int]], beside: list[bool]) -> list[float]:
    """Text outside links to tags, its square root; below 0 in elements that are beside the article."""
    return [-1.0 if beside[element] else math.sqrt((len(text) - links) / max(1, tags)) for text, tags, links, element in lines]


def put_aside(parser: Lines) -> list[bool]:
    """Which elements are beside the article: by what they are, unless they hold the dense text."""
    if not any(parser.beside):
        return [False] * len(parser.kinds)
    size, nothing = [0] * len(parser.kinds), [False] * len(parser.kinds)
    for (text, _, _, element), held in zip(parser.lines, dense(ratios_of(parser.lines, nothing)), strict=True):
        size[element] += held * len(text)
    for element in range(len(size) - 1, 0, -1):
        size[parser.parents[element]] += size[element]
    return [share > 0 and size[element] < share * max(1, size[0]) for element, share in enumerate(parser.beside)]


def content(parser: Lines) -> list[bool]:
    """Which lines are content: the dense ones, and the sparse ones of their regions."""
    lines, kinds, parents, aside = parser.lines, parser.kinds, parser.parents, put_aside(parser)
    beside, container, listed = list(aside), [0] * len(kinds), [False] * len(kinds)
    for element in range(1, len(kinds)):
        beside[element] = aside[element] or beside[parents[element]]
        inside = not aside[element] and (kinds[element] in WITHIN or kinds[element] in INLINE)
        container[element] = container[parents[element]] if inside else element
        listed[element] = inside and (kinds[element] in LISTS or listed[parents[element]])
    marked = dense(ratios_of(lines, beside))
    first: dict[int, int] = {}
    last: dict[int, int] = {}
    for i, line in enumerate(lines):
        if marked[i]:
            first.setdefault(container[line[3]], i)
            last[container[line[3]]] = i
    kept = []
    for i, (text, _, links, element) in enumerate(lines):
        holder = container[element]
        between = holder in first and first[holder] < i < last[holder]
        ends = holder in first and kinds[holder] not in PAGE and not (listed[element] and links >= 0.9 * len(text))
        kept.append(marked[i] or between or ends)
    return kept


def main_text(page: str | None) -> str:
    """The text of the page's content regions; blocks joined by one space."""
    if not page:
        return ""
    parser = Lines()
    parser.feed(page)
    parser.close()
    return " ".join(line[0] for line, held in zip(parser.lines, content(parser), strict=True) if held)


def extract_text(pages: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """``id_cols..., text``: each page's main text."""
    ship_package(pages.sparkSession)
    small_batches(pages.sparkSession)
    chosen = pages.select(*id_cols, pages[html_col].alias("page_source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(id_cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(id_cols)], pa.array(texts, pa.string())], names=[*id_cols, "text"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, `text` string")
