"""Main text of HTML pages from parser events and smoothed text-to-tag ratios.

The standard library's parser streams events; block-level tags cut the page into
lines.  A line's ratio is its characters over its tags.  The ratios are smoothed
with a Gaussian, and lines over a threshold cluster into content regions (Weninger,
Hsu, Han 2010).  The article is all article and main elements where these hold most
of the regions' text.  Otherwise it grows from the largest region: from the lowest
container (never a paragraph, heading, list or cell) that holds nearly all of it to the
one around that, as long as that adds text of regions alone, or at least half as such and
a quarter of what there is.  Its lines are kept, the short ones too, without what stands in elements that are no article text by their
tag, role, class or id (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm._common import table

SIGMA = 1.0
#: Share of the mean smoothed ratio that a content line must reach.
LEVEL = 0.5
#: Share of the regions' text that article and main elements must hold to be the article; share of
#: the largest region, which smoothing may widen, in the container that it grows from; share of its
#: regions' text that a container with other text too must add to be part of it.
MOST, CORE, SHARE = 0.5, 0.8, 0.25
CHUNK = 1 << 16

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_NO_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video head title".split())
_NOT_ARTICLE = frozenset("nav footer aside button select textarea option datalist dialog menu fieldset input".split()) | _NO_TEXT
_MAIN = frozenset(("article", "main"))
#: Elements that may be the article where no tag names it.
_CONTAINERS = frozenset("html body div section center".split()) | _MAIN
#: A new one of these ends an open one, back to the nearest element of the second set.
_ENDS = {t: frozenset(x.split()) for t, x in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
_WALLS = frozenset("table ul ol dl article main section div body html aside nav header footer form blockquote select".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: A class or id marks what is no article text if one of its tokens, as a whole, is made of
#: these words and of places and shapes ("cookie-banner", "sidebar-left"; not "has-sidebar").
_NOISE = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promos banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar menu navbar navigation nav breadcrumb breadcrumbs "
    "masthead footer comment comments commentlist disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login pagination pager toolbar widget skip".split()
)
_PLACES = frozenset("main site page top bottom left right primary secondary global bar box list links link buttons button icons area container wrapper wrap slot unit block widgets posts articles stories form items item side".split())
#: Of an article or main element only these are believed; and these also of what holds most of a page.
_APART = frozenset("ad ads advert adverts advertisement sponsor sponsored promo promos related recommended".split())
_READERS = frozenset("comment comments commentlist disqus respond replies reply".split())
_PARTS = re.compile(r"[_-]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marks(named: str, within: bool) -> frozenset[str]:
    """The words by which a class or id says that an element is no article text."""
    out: frozenset[str] = frozenset()
    for token in named.lower().replace("side-bar", "sidebar").split():
        parts = frozenset(_PARTS.split(token.strip("_-")))
        noise = parts & _NOISE if within else parts & (_NOISE | {"header"})
        if noise and parts - noise <= _PLACES and parts != {"skip"}:
            out |= noise
    return out


class _Lines(HTMLParser):
    """Cuts a page into lines: (text, tags, inside something that is no article text, element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, element, no article text, within an article
        self.count: Counter[str] = Counter()  # of open tags
        self.parent, self.main, self.tag = [-1], [False], [""]
        self.marks: dict[int, frozenset[str]] = {}  # elements that may be no article text, and why
        self.lines: list[tuple[str, int, bool, int]] = []
        self.text: list[str] = []
        self.tags = 0

    def _cut(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            top = self.open[-1] if self.open else ("", 0, False, False)
            self.lines.append((text, self.tags, top[2], top[1]))
            self.tags = 0
        self.text.clear()

    def _pop(self, at: int) -> None:
        if any(x[0] not in _INLINE for x in self.open[at:]):
            self._cut()
        elif any(x[2] for x in self.open[at:]) and not (at and self.open[at - 1][2]) or any(x[1] in self.marks for x in self.open[at:]) and self.open[-1][1] != (self.open[at - 1][1] if at else 0):
            self._cut()
        self._close(at)

    def _close(self, at: int) -> None:
        self.count.subtract(x[0] for x in self.open[at:])
        del self.open[at:]

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag == "hr":
            self._cut()
            return
        if tag in _VOID:
            return
        if tag not in _INLINE:
            self._cut()
            if tag in _MAIN or tag == "body":  # the article never stands in a menu that was left open
                while self.open and self.open[-1][2] and self.open[-1][0] not in _MAIN and tag != "article" or self.open and self.open[-1][0] in ("p", "head", "nav"):
                    self._close(len(self.open) - 1)
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p" or self.open[i][0] in _ENDS.get(tag, ()):
                    self._close(i)
                elif self.open[i][0] in _WALLS:
                    break
        a = {k: v or "" for k, v in attrs}
        outer, within = (self.open[-1][2], self.open[-1][3]) if self.open else (False, False)
        bad = outer or tag in _NOT_ARTICLE or tag == "header" and not within or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden") == "true"
        marks: frozenset[str] = frozenset()
        if not bad and tag not in ("html", "body"):
            bad = bool(_HIDDEN.search(a.get("style", "")))
            marks = _marks(f"{a.get('class', '')} {a.get('id', '')}", within)
            if tag == "form":
                marks |= {"form"}
        if (bad and not outer or marks) and tag in _INLINE:
            self._cut()
        if tag in _INLINE and not marks:
            element = self.open[-1][1] if self.open else 0
        else:
            self.parent.append(self.open[-1][1] if self.open else 0)
            self.main.append(tag in _MAIN or a.get("role", "").lower() == "main")
            self.tag.append(tag)
            element = len(self.parent) - 1
            if marks:
                self.marks[element] = marks
        self.open.append((tag, element, bad, within or tag in _MAIN))
        self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1) if self.count[tag] else ():  # an end tag without a start is no reason to search
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if tag in _INLINE and self.open[i][0] not in _INLINE:
                return
        if tag not in _INLINE and tag not in _VOID:
            self._cut()

    def handle_data(self, data):
        if not (self.open and self.open[-1][0] in _NO_TEXT):
            self.text.append(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights of what is there add up to one."""
    reach = max(1, round(3 * sigma))
    k = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    full = np.convolve(ratios, k)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), k)[reach : reach + len(ratios)]


def regions(size: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Lines whose smoothed text-to-tag ratio reaches the threshold: runs of them are the content regions."""
    near = smooth(size / np.maximum(1, tags))
    return near >= LEVEL * near.mean()


def _grown(p: _Lines, size: np.ndarray, good: np.ndarray, content: np.ndarray) -> int:
    """The container that the largest region grows to."""
    of = np.array([e for *_, e in p.lines])
    known, extra = np.zeros(len(p.parent)), np.zeros(len(p.parent))
    np.add.at(known, of, np.where(content, size, 0))
    np.add.at(extra, of, np.where(good & ~content, size, 0))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], content.astype(int), [0]]))).reshape(-1, 2)
    a, b = max(edge.tolist(), key=lambda r: (size[r[0] : r[1]][content[r[0] : r[1]]].sum(), -r[0]))
    core = np.zeros(len(p.parent))
    np.add.at(core, of[a:b], size[a:b])
    whole = core.sum()
    for total in (known, extra, core):
        for e in range(len(total) - 1, 0, -1):
            total[p.parent[e]] += total[e]
    at = max(e for e in range(len(core)) if core[e] >= CORE * whole and (e == 0 or p.tag[e] in _CONTAINERS))
    up = p.parent[at]
    while up >= 0:
        if up == 0 or p.tag[up] in _CONTAINERS:
            gain, rest = known[up] - known[at], extra[up] - extra[at]
            if not rest or gain >= max(rest, SHARE * known[at]):
                at = up
        up = p.parent[up]
    return at


def _marked(p: _Lines, size: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Elements in one that its name marks as no article text; names of what holds the article don't count."""
    out = np.zeros(len(p.parent), bool)
    if not p.marks:
        return out
    total = np.zeros(len(out))
    np.add.at(total, [e for *_, e in p.lines], np.where(good, size, 0))
    for e in range(len(total) - 1, 0, -1):
        total[p.parent[e]] += total[e]
    # the largest article and all around it
    believed = np.ones(len(out), bool)
    main = max((e for e in range(1, len(out)) if p.main[e] and total[e] > 0), key=lambda e: (total[e], -e), default=0)
    e = main
    while e > 0:
        believed[e] = False
        e = p.parent[e]
    for e, marks in p.marks.items():
        if p.main[e]:
            believed[e] &= bool(marks & (_APART | _READERS))
        elif not main and total[e] >= MOST * total[0]:
            believed[e] &= bool(marks & _READERS)
    for e in range(1, len(out)):
        out[e] = out[p.parent[e]] or e in p.marks and believed[e]
    return out


def main_text(html: str | None) -> str:
    """The article's blocks, one per line; empty for null, empty and textless pages."""
    if not html:
        return ""
    p = _Lines()
    for i in range(0, len(html), CHUNK):
        p.feed(html[i : i + CHUNK])
    p.close()
    p._cut()
    if not p.lines:
        return ""
    size = np.array([len(t) for t, *_ in p.lines], float)
    good = np.array([not bad for _, _, bad, _ in p.lines])
    if not good.any():
        return ""
    marked = _marked(p, size, good)
    unmarked = good & ~marked[[e for *_, e in p.lines]]
    good = unmarked if unmarked.any() else good  # a name alone never empties a page
    content = good & regions(size, np.array([n for _, n, _, _ in p.lines]))
    if not content.any():
        content = good
    content |= good & np.array([p.tag[e] == "h1" for *_, e in p.lines])
    # text of the regions by element, and in all that is inside it
    own = np.zeros(len(p.parent))
    np.add.at(own, [e for *_, e in p.lines], np.where(content, size, 0))
    total = own.copy()
    for e in range(len(total) - 1, 0, -1):
        total[p.parent[e]] += total[e]
    inside = np.zeros(len(total), bool)
    for e in range(1, len(total)):
        inside[e] = p.main[e] and total[e] > 0 or inside[p.parent[e]]
    if own[inside].sum() <= MOST * total[0]:
        article = _grown(p, size, good, content)
        inside[:] = False
        for e in range(len(total)):
            inside[e] = e == article or e > 0 and inside[p.parent[e]]
    return "\n".join(t for (t, *_, e), kept in zip(p.lines, good) if inside[e] and kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) in place of ``html`` and of columns of
    those names. One row per row, repeated ones too; null html has an empty text."""
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py()) for x in b.column(len(names))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=[*names, "text", "n_chars"])

    kept = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in names)
    return pages.select(*[F.col(f"`{c}`") for c in names], F.col(html)).mapInArrow(run, f"{kept}text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
