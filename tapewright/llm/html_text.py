"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped to lines, one a block-level element.  Parts of the page's frame (menus,
headers, footers and the like) leave empty lines behind, adverts and forms nothing, and link
text outside the article doesn't count.  The lengths of the lines are summed over sliding
windows: text surges where a window's sum leaves zero and dives where it comes back.  A
stretch between a surge and a dive holds text if its largest window reaches ``SURGE``
characters; on a page whose windows all stay below, every stretch does.  The article is all there is from the first such surge
to the last such dive.  An article or main element with at least half of the page's text
adds ``SURGE`` to each of its lines, so all of it belongs to the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines in a window, and characters in the largest window of a stretch that counts as text by itself.
WINDOW, SURGE = 3, 80

#: Elements whose contents are never text; those of ``_RAW`` hold no markup and last to the page's end if they aren't closed.
_HIDDEN = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
_RAW = frozenset("script style iframe textarea title".split())
_END = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in _HIDDEN}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements that begin a line; those that hold no article text.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
_OTHER = frozenset("aside button dialog fieldset footer form head label menu nav".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that need no end tag: marked ones without it last to the next line.
_OPEN = frozenset("p li dt dd tr td th option optgroup".split())
#: Whole class, id and role names, in lower case with - for _.  Of them those that interrupt an article without ending a
#: stretch, those whose own articles aren't the page's, and those that within an article mark its headline.
_INTERRUPT = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense ad-slot ad-container ad-wrapper ad-banner ad-box ad-unit google-ad sponsor sponsors "
    "sponsored sponsorship promo promos promotion promotions share sharing social share-buttons social-share social-links social-icons newsletter "
    "newsletter-signup subscribe subscription signup login".split()
)
_NESTED = frozenset(
    "comment comments commentlist comment-list comments-area comments-section respond replies disqus disqus-thread related related-posts related-articles recommended".split()
)
_MASTHEAD = frozenset("header banner masthead".split())
_MARKED = _INTERRUPT | _NESTED | _MASTHEAD | frozenset(
    "cookie cookies cookie-notice cookie-banner cookie-bar cookie-consent consent gdpr notice alert popup modal overlay sidebar side-bar menu main-menu nav navbar "
    "nav-bar nav-menu main-nav site-nav site-navigation main-navigation navigation breadcrumb breadcrumbs footer site-footer page-footer site-header page-header "
    "topbar top-bar search search-form pagination pager toolbar widget widget-area skiplink skip-link contentinfo complementary dialog toc".split()
)
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Line:
    text: str
    weight: int  # characters; outside articles those outside links
    article: int  # number of the article element around it, from 1; 0 outside


class _Page:
    """Lines of one page, from one pass over its tags."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.linked = 0
        self.articles, self.article = 0, 0
        self.skip, self.depth, self.links = "", 0, 0
        self.firm = False  # the part skipped keeps articles within it

    def end_line(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split())
        if text:
            inside = self.articles > 0
            self.lines.append(Line(text, len(text) if inside else max(0, len(text) - self.linked), self.article if inside else 0))
        self.parts, self.linked = [], 0

    def gap(self) -> None:
        self.end_line()
        self.lines += [Line("", 0, 0)] * WINDOW

    def text(self, s: str) -> None:
        if not self.skip and s:
            self.parts.append(s)
            if self.links:
                self.linked += len(" ".join(html.unescape(s).split()))

    def tag(self, closing: bool, name: str, attributes: str, closed: bool) -> None:
        """``closed``: the element has an end tag."""
        article = name in ("article", "main")
        if self.skip:
            if article and not closing and not self.firm and not self._other(name, attributes):
                self.skip = ""  # an unclosed part before the article
            elif self.depth < 0 and name in _BLOCKS | {"td", "th"}:
                self.skip = ""
            elif name == self.skip:
                self.depth += -1 if closing else 1
                if self.depth == 0:
                    self.skip = ""
                return
            else:
                return
        if not closing and name not in _VOID and (other := self._other(name, attributes)):
            if other == "frame":
                self.gap()
            self.end_line()
            self.skip, self.depth = name, 1 if closed or name not in _OPEN else -1
            self.firm = closed and (other == "nested" or name == "aside")
            return
        if name in _BLOCKS:
            self.end_line()
        elif name in ("br", "td", "th"):
            self.parts.append(" ")
        if article:
            if not closing:
                self.gap()
                self.article += not self.articles
            else:
                self.end_line()
            self.articles = max(0, self.articles + (-1 if closing else 1))
            if closing:
                self.gap()
        elif name == "a":
            self.links = 0 if closing else 1

    def _other(self, name: str, attributes: str) -> str:
        """What an element holds other than article text: an "interrupt", something "nested", a part of the "frame", or ""."""
        if name in _OTHER or name == "header" and not self.articles:
            return "interrupt" if name in ("button", "fieldset", "form", "label") else "frame"
        if not attributes or name in ("html", "body"):
            return ""
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or key == "style" and _NOT_SHOWN.search(value):
                return "interrupt"
            if key in ("class", "id", "role") and name not in ("article", "main", "header") and name not in _HEADINGS:
                found = _MARKED.intersection(value.lower().replace("_", "-").split())
                if self.articles:
                    found -= _MASTHEAD
                if found:
                    return "nested" if found & _NESTED else "interrupt" if found <= _INTERRUPT else "frame"
        return ""


def _tags(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of each piece of markup; a hidden element is one piece without a name."""
    out, at, unclosed = [], 0, set()
    while m := _TOKEN.search(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        if name in _HIDDEN and not m[1] and not (name in ("svg", "math") and m[3].endswith("/")):
            end = None if name in unclosed else _END[name].search(page, at)
            if end:
                at = end.end()
            elif name in _RAW:
                at = len(page)
            else:
                unclosed.add(name)
        out.append((m.start(), at, bool(m[1]), "" if name in _HIDDEN else name, m[3] or ""))
    return out


def lines_of(page: str) -> list[Line]:
    """The lines of a page."""
    p, at = _Page(), 0
    tags = _tags(page)
    closed: set[int] = set()
    opened: dict[str, list[int]] = {}
    for i, (_, _, closing, name, _) in enumerate(tags):
        if not closing:
            opened.setdefault(name, []).append(i)
        elif opened.get(name):
            closed.add(opened[name].pop())
    for i, (start, end, closing, name, attributes) in enumerate(tags):
        p.text(page[at:start])
        at = end
        if name:
            p.tag(closing, name, attributes, i in closed)
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!][^<>]*\Z", rest)  # a page that ends within a tag
    p.text(rest[: cut.start()] if cut else rest)
    p.end_line()
    return p.lines


def stretches(lines: list[Line]) -> list[tuple[int, int, int]]:
    """(surge, dive, largest window) of each stretch: lines[surge:dive] hold its text."""
    weights = [x.weight for x in lines]
    windows = [sum(weights[i : i + WINDOW]) for i in range(len(lines))]
    out, i = [], 0
    while i < len(lines):
        if not weights[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and windows[j]:
            j += 1
        out.append((i, j, max(windows[i:j])))
        i = j
    return out


def main_text(page: str | None) -> str:
    """The blocks of the article in page order, two line breaks between them; "" if there is none."""
    if not page:
        return ""
    lines = lines_of(page)
    size = Counter()
    for x in lines:
        size[x.article] += x.weight
    largest = max((a for a in size if a), key=lambda a: (size[a], -a), default=0)
    if largest and size[largest] * 2 >= size.total():
        lines = [replace(x, weight=x.weight + SURGE) if x.text and x.article == largest else x for x in lines]
    found = stretches(lines)
    kept = [s for s in found if s[2] >= SURGE] or found
    return "\n\n".join(x.text for x in lines[kept[0][0] : kept[-1][1]] if x.text) if kept else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; no shuffle.

    A null or empty page, or one without text, has the text "".  Nulls in page_id and url
    stay; repeated rows give repeated results; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x if isinstance(x, str) else None) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})

    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return rows.withColumn("page_id", F.col("page_id").cast("long"))
