"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser streams events; each block element starts a line.  Elements that never hold main text
(scripts, forms, navigation, elements whose class or id names them so) are left out while streaming.  Of the lines
left, the ratio of text outside links to tags is smoothed with a Gaussian and clustered by a threshold; lines above it
select content.  The container (article, main, or a block) with most of the selected text is the content region.  In it
the lines of the upper cluster are kept, and of the lower one those that are text and not links (a short paragraph, a
heading); lists of links between paragraphs go.  Selected lines elsewhere stay only while there is no article.

White space in a line becomes one space, references are decoded, lines are joined by an empty line.  A malformed
declaration is a comment up to the next ``>``, as in HTML5, and a page is read to its end.  Null and empty pages have
an empty text; pages of any length are read whole.  Each row is judged by itself: ties, repeated rows, null ids and
urls, and further columns, whatever their names, change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 3
#: The threshold as a share of the mean smoothed ratio.
CLUSTER = 0.5
#: A line with more of its text in links than this is not content.
MOST_LINKED = 0.6

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title nav footer aside form button select textarea iframe svg object canvas menu dialog label input".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies discussion share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search pagination pager widget widgets skip".split()
)
NOT_WITH = frozenset("has with no without".split())
#: Words that leave a name what it is: a part of an article is named by others only if it is main text.
PLAIN = frozenset("area bar block bottom box button buttons container content form group icons inline inner item items left line link links list panel post posts right section slot text top unit wrap wrapper".split())
#: A header that is named after one of these holds a title.
TITLED = frozenset("article content entry post story title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
#: References that int() may refuse; beyond the last character, as these are, they decode to U+FFFD.
_LONG = re.compile(r"&#0*[1-9][0-9]{7,};?")
_ZEROS = re.compile(r"&#0{9,}(?=[0-9])")


def _named(value: str | None, in_article: bool) -> bool:
    """Whether a class or id names a part that is not main text: by its first or last word, in an article by all its words."""
    for name in (value or "").lower().split():
        words = [w for w in _SPLIT.split(name) if w]
        named = NAMES.intersection(words)
        if not named or NOT_WITH.intersection(words) or named == {"header"} and (in_article or TITLED.intersection(words)):
            continue
        if all(w in NAMES or w in PLAIN or w.isdigit() for w in words) if in_article else words[0] in NAMES or words[-1] in NAMES:
            return True
    return False


class _Lines(HTMLParser):
    """Collects lines: [text parts, characters, characters in links, tags, container]."""

    def __init__(self, by_name: bool):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.open: list[tuple[str, int]] = []  # element, 0: content, 1: left out by its name, 2: by its kind
        self.skipping, self.links, self.in_article = 0, 0, 0
        self.containers: list[tuple[int, str]] = [(0, "body")]
        self.made, self.lines = 0, []
        self.line: list | None = None
        self.headings = 0

    def parse_html_declaration(self, i: int) -> int:
        """A marked section, known or not, is a comment up to the next ``>``; a closed CDATA section up to its end."""
        raw = self.rawdata
        if not raw.startswith("<![", i):
            return super().parse_html_declaration(i)
        if raw[i + 3 : i + 9].upper() == "CDATA[" and (end := raw.find("]]>", i + 9)) >= 0:
            return end + 3
        end = raw.find(">", i + 3)
        return end + 1 if end >= 0 else len(raw)

    def _break(self) -> None:
        self.line = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("article", "main") and self.skipping and not any(x == "head" for x, _ in self.open):
            # Main text can't be inside; what should have been closed was not.
            if not self._excluded(tag, attrs):
                self.open = [(x, 0) for x, _ in self.open]
                self.skipping = 0
        if tag == "body":
            self.open, self.skipping = [], 0
        if tag in BLOCKS:
            self._break()
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            if self.line is not None:
                self.line[3] += 1
            return
        why = self._excluded(tag, attrs) if not self.skipping else 0
        if tag == "head" and self.lines:
            why = 0
        self.open.append((tag, why))
        self.skipping += why > 0
        if self.skipping and not why:
            self.open[-1] = (tag, 3)
            self.skipping += 1
        if self.skipping:
            return
        if tag in CONTAINERS:
            self.made += 1
            self.containers.append((self.made, tag))
            self.in_article += tag in ("article", "main")
        if tag == "a":
            self.links += 1
        if self.line is not None:
            self.line[3] += 1

    def _excluded(self, tag: str, attrs: list) -> int:
        if tag in SKIPPED:
            return 2
        if tag == "header":
            return 0 if self.in_article else 2
        if tag in ("html", "body"):
            return 0
        if self.by_name or tag == "article":
            for key, value in attrs:
                if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and (value or "").lower() in ROLES):
                    return 1
                if key in ("class", "id") and tag != "main" and _named(value, self.in_article > 0) and not (tag in _HEADINGS and self.in_article):
                    return 1
        return 0

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag == "p" and not any(x == "p" for x, _ in self.open):
            self._break()
            return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        if tag in BLOCKS:
            self._break()
        # A closing inline element does not close the blocks around it.
        if tag not in BLOCKS and any(x in BLOCKS for x, _ in self.open[at + 1 :]):
            closed = [self.open.pop(at)]
        else:
            closed, self.open = self.open[at:], self.open[:at]
        for name, why in reversed(closed):
            if why:
                self.skipping -= 1
                continue
            if name == "a":
                self.links = max(0, self.links - 1)
            if name in CONTAINERS and len(self.containers) > 1:
                self.containers.pop()
                self.in_article -= name in ("article", "main")

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.line is None:
            if not data.strip():
                return
            if any(x == "header" for x, _ in self.open) and not any(x in _HEADINGS for x, _ in self.open):
                return
            article = next((c for c in reversed(self.containers) if c[1] in ("article", "main")), None)
            self.line = [[], 0, 0, 0, article or self.containers[-1]]
            self.lines.append(self.line)
        n = len(data.strip())
        self.line[0].append(data)
        self.line[1] += n
        self.line[2] += n * (self.links > 0)


_KERNEL = [exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]


def _smoothed(ratios: list[float]) -> list[float]:
    n, out = len(ratios), []
    for i in range(n):
        low, high = max(0, i - RADIUS), min(n, i + RADIUS + 1)
        weights = _KERNEL[low - i + RADIUS : high - i + RADIUS]
        out.append(sum(w * r for w, r in zip(weights, ratios[low:high], strict=True)) / sum(weights))
    return out


def _select(lines: list[list]) -> list[list]:
    if not lines:
        return []
    ratios = [(x[1] - x[2]) / (1 + x[3]) for x in lines]
    smooth = _smoothed(ratios)
    threshold = CLUSTER * sum(smooth) / len(smooth)
    linked = [x[2] > MOST_LINKED * max(1, x[1]) for x in lines]
    chosen = [s >= threshold and r >= threshold and not k for s, r, k in zip(smooth, ratios, linked, strict=True)]
    weight: dict[tuple[int, str], int] = {}
    for x, c in zip(lines, chosen, strict=True):
        weight[x[4]] = weight.get(x[4], 0) + (x[1] if c else 0)
    top = max(weight.values())
    articles = {k for k, v in weight.items() if k[1] in ("article", "main")}
    inside = sum(weight[k] for k in articles)
    if articles and inside * 4 >= sum(weight.values()):
        best = max(weight[k] for k in articles)
        region = {k for k in articles if weight[k] * 4 >= best}
        beside = [a or b for a, b in zip([False, *linked[:-1]], [*linked[1:], False], strict=True)]  # another line of links
        return [x for x, s, k, b in zip(lines, smooth, linked, beside, strict=True) if x[4] in region and (not k or s >= threshold and not b)]
    region = {k for k, v in weight.items() if v * 2 >= top} if top else set()
    return [x for x, c, k in zip(lines, chosen, linked, strict=True) if (x[4] in region and not k) or c]


def main_text(html: str | None) -> str:
    for by_name in (True, False):
        parser = _Lines(by_name)
        parser.feed(_ZEROS.sub("&#", _LONG.sub("&#x110000;", html or "")))
        parser.close()
        text = "\n\n".join(t for x in _select(parser.lines) if (t := " ".join("".join(x[0]).split())))
        if text:
            return text
    return ""


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
