"""Main text of HTML pages from streaming parser events.

The standard library's parser emits events; block-level tags end a *line*. Each line has a text-to-tag ratio
(characters of text outside links per tag). The ratios are smoothed with a Gaussian; runs of lines above a threshold
(the ratios' standard deviation) are the *clusters*. A cluster's lines are content. The other lines are short
paragraphs, headings and list items, which a ratio alone would lose, or boilerplate: such a line is content if it
stands in the region that the clusters name (``region``) and is not part of a list or table of links.
Elements that HTML itself marks as something else (nav, footer, aside, form, script ...), or that carry a whole
class name known for it, are never content.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header"
    " hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("head title script style noscript template iframe object svg math canvas audio video nav aside footer form select option button textarea input label dialog menu search".split())
HOLDERS = frozenset("article main section div td body".split())
GROUPS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(("html", "body", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Whole class names and ids of what is never the article, wherever it stands.
NAMES = frozenset(
    "ad ads advert advertisement adsbygoogle sponsored promo nav navbar menu sidebar breadcrumb breadcrumbs pagination toolbar popup modal newsletter newsletter-signup"
    " share sharing share-buttons social social-share comments comment comment-list commentlist comment-section disqus_thread respond related-posts related-articles"
    " cookie-notice cookie-banner consent skip-link".split()
)
#: Words that mark an element outside article and main as boilerplate: the whole of a class name or id, or its first or last word.
MARKS = frozenset("ad ads advert advertisement sponsor banner nav navbar navigation menu sidebar footer header masthead topbar cookie cookies consent newsletter subscribe popup modal share social breadcrumb breadcrumbs comments comment pagination widget".split())
#: The same inside article and main, where few words are free of doubt.
STRONG = frozenset("ad ads advert advertisement sidebar cookie newsletter comments breadcrumb breadcrumbs pagination".split())
#: An open element of the first kind ends where one of its second kind begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
LINKED = 0.5
_WORDS = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marked(tag: str, attrs: list[tuple[str, str | None]], in_content: bool) -> bool:
    """Whether an element is not the article. Of an article element, only whole names count."""
    if tag in WHOLE or ("role", "main") in attrs:
        return False
    if tag in DROPPED or (tag == "header" and not in_content):
        return True
    for k, v in attrs:
        v = v or ""
        if k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "role" and v.lower() in ROLES) or (k == "style" and _HIDDEN.search(v)):
            return True
        if k == "class" or (k == "id" and tag not in HEADINGS):  # a heading's id is its title
            known = STRONG if in_content or tag == "article" else MARKS
            for name in v.split():
                words = [w for w in _WORDS.split(_HUMP.sub(r"\1 \2", name).lower()) if w]
                if name.lower() in NAMES or (words and (words[0] in known or words[-1] in known)):
                    return True
    return False


class Line(NamedTuple):
    text: str
    plain: int  # characters outside links
    tags: int
    holder: int
    content: int  # the outermost article or main, -1 if none
    group: int  # the innermost list or table, -1 if none
    heading: bool


class Open(NamedTuple):
    tag: str
    dropped: bool
    holder: int
    content: int
    group: int
    heading: bool


class Lines(HTMLParser):
    """The lines of a page, and its holders: ``parent`` and ``shape`` (tag and class) of each; number 0 is the page itself.

    Text of dropped elements is in no line. Time is linear in the page: an end tag, or a tag that closes others, walks the
    stack only if an element to close is open in its scope, and whatever the walk passes is closed by it.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.parent, self.shape = [-1], [("body", None)]
        self.groups = self.links = self.tags = self.plain = 0
        self.here: list[Counter[str]] = [Counter()]  # open tags by scope: since the last holder, list or table
        self.tops = [""]  # the tag that opened the scope
        self.inline: list[Counter[str]] = [Counter()]  # open tags since the last block
        self.count: Counter[str] = Counter()
        self.parts: list[str] = []
        self.lines: list[Line] = []

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            o = self.open[-1] if self.open else Open("", False, 0, -1, -1, False)
            self.lines.append(Line(text, self.plain, self.tags, o.holder, o.content, o.group, o.heading))
        self.parts, self.plain, self.tags = [], 0, 0

    def push(self, o: Open) -> None:
        self.open.append(o)
        self.count[o.tag] += 1
        self.here[-1][o.tag] += 1
        self.inline[-1][o.tag] += 1
        if o.tag in HOLDERS or o.tag in GROUPS:
            self.here.append(Counter())
            self.tops.append(o.tag)
        if o.tag in BLOCK:
            self.inline.append(Counter())
        self.links += o.tag == "a"

    def pop(self) -> str:
        tag = self.open.pop().tag
        self.count[tag] -= 1
        if tag in HOLDERS or tag in GROUPS:
            self.here.pop()
            self.tops.pop()
        if tag in BLOCK:
            self.inline.pop()
        self.here[-1][tag] -= 1
        self.inline[-1][tag] -= 1
        self.links -= tag == "a"
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
            ends = CLOSES.get(tag, set()) | {"p"}
            if self.tops[-1] in ends or any(self.here[-1][t] for t in ends):
                while self.pop() not in ends:
                    pass
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        up = self.open[-1] if self.open else Open("", False, 0, -1, -1, False)
        dropped = up.dropped or _marked(tag, attrs, up.content >= 0)
        main = tag in ("article", "main") or ("role", "main") in attrs
        holder, group = up.holder, up.group
        if tag in HOLDERS or main:
            self.parent.append(holder)
            self.shape.append((tag, dict(attrs).get("class")))
            holder = len(self.parent) - 1
        if tag in GROUPS:
            self.groups += 1
            group = self.groups
        self.push(Open(tag, dropped, holder, up.content if up.content >= 0 or not main else holder, group, up.heading or tag in HEADINGS))

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self.end_line()
        if (self.count if block else self.inline[-1])[tag]:
            self.tags += 1
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].dropped:
            return
        self.parts.append(data)
        if not self.links:
            self.plain += len(data.strip())


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over the neighbours within two sigma; the ends are continued."""
    r = max(1, int(np.ceil(2 * sigma)))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
    return np.convolve(np.pad(x, r, mode="edge"), k / k.sum(), mode="valid")


def clusters(lines: list[Line], sigma: float = 1.0, spread: float = 1.0) -> np.ndarray:
    """Whether each line is in a cluster: its smoothed text-to-tag ratio reaches the threshold and it has text of its own.

    If no line does, all lines with text outside links are.
    """
    ratio = np.array([x.plain / max(1, x.tags) for x in lines], float)
    level = smooth(ratio, sigma)
    own = np.array([bool(x.text) and x.plain > 0 for x in lines])
    seeds = own & (level >= spread * level.std())
    return seeds if seeds.any() else own


def region(page: Lines, seeds: np.ndarray) -> np.ndarray:
    """Whether each line stands in the region that the clusters name.

    If most of the clusters' text is inside article or main elements, the region is those elements. Else it is
    the holders of the clusters with what they hold, the holders beside them of the same tag and class, all lines from the
    first of these to the last, and headings right before.
    """
    lines = page.lines
    inside: Counter[int] = Counter()
    for i in np.flatnonzero(seeds).tolist():
        inside[lines[i].content] += lines[i].plain
    if 2 * (inside.total() - inside[-1]) >= inside.total():
        return np.array([x.content >= 0 and x.content in inside for x in lines])
    own = {lines[i].holder for i in np.flatnonzero(seeds).tolist()}
    like = {(page.parent[h], page.shape[h]) for h in own}
    held = [False] * len(page.parent)
    for h, (up, shape) in enumerate(zip(page.parent, page.shape, strict=True)):  # a parent comes before its children
        held[h] = h in own or (up, shape) in like or (up > 0 and held[up] and page.shape[up][0] != "body")
    at = [i for i, x in enumerate(lines) if held[x.holder] and x.text]
    first = at[0]
    while first > 0 and (lines[first - 1].heading or not lines[first - 1].text):
        first -= 1
    return np.array([first <= i <= at[-1] for i in range(len(lines))])


def main_text(html: str | None, sigma: float = 1.0, spread: float = 1.0) -> str:
    """The article of a page, its blocks joined by newlines; empty if there is none. Null is empty."""
    p = Lines()
    p.feed(html or "")
    p.close()
    p.end_line()
    if not p.lines:
        return ""
    seeds = clusters(p.lines, sigma, spread)
    if not seeds.any():
        return ""
    size: Counter[tuple[str, int]] = Counter()
    plain: Counter[tuple[str, int]] = Counter()
    for x in p.lines:
        for part in (("group", x.group), ("holder", x.holder)):
            size[part] += len(x.text)
            plain[part] += x.plain
    menu = {part for part in size if part[1] >= 0 and plain[part] < LINKED * size[part]}  # inside article and main, links are text
    near = region(p, seeds)
    return "\n".join(x.text for x, seed, ok in zip(p.lines, seeds.tolist(), near.tolist(), strict=True) if x.text and ok and (seed or x.content >= 0 or not menu & {("group", x.group), ("holder", x.holder)}))


def _extract(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(h) for h in pages], dtype=object)


_extract.__annotations__ = {}


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: id, url, text (the article, empty if none), n_chars (its code points).

    Null or empty html gives empty text. Ids and urls are passed on as they are, null or repeated; extra
    columns are not read.
    """
    text = F.pandas_udf(_extract, "string")(F.col(html))
    return pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), text.alias("text")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
