"""Main text of web pages by line-block distribution.

Markup is stripped to rows, one for each block of text (a line break inside a block is white space). A row's length is that
of its text less the text of links. Zones that are never main text (menus, footers, adverts, forms, reader
comments and the like, by tag or by the head word of a class, id or role) have length 0: a row where the zone begins, and one for each block in it.
A form or an element with such a word that holds nearly all of the page's text is the page's frame and no zone; a zone without an
end does not reach beyond the article that begins in it.

Lengths are summed over a sliding window of rows. The page's own distribution of these sums sets the threshold: a share
of the largest one. A block surges at the first window that reaches it and dives after the last one that
does so without a break; the rows of its windows are its text, with short lines, titles say, next to long ones. An article
or main element around such a block is known by its author to begin and end there, so its borders take the place of
the surge and the dive. Of several, and of the blocks outside of any, that with the largest sum is the page's text and what
lies outside of it is not; but the blocks outside of articles, which may be what zones have left over, count only if they have a
paragraph's length and twice the sum of the largest article, which is a card or a teaser then.

Defined results: a null or empty page gives the empty text; so does a page without a row that has a length, except
that an article of nothing but links has its links; of articles with equal sums the first is
taken; pages of any length are read whole, in time that grows with their length; a tag that the page's end cuts off
is no text; from a tag on that quotes keep from ending, they are ordinary characters; repeated rows are extracted alike; an empty table gives an empty
one; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is skipped unread.
RAW = frozenset("script style title textarea template noscript iframe svg math object canvas audio video".split())
# Elements that are never main text.
ZONES = frozenset("nav footer aside form button select dialog menu fieldset".split())
# Words in class, id or role that mark such a zone.
ZONE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo cookie cookies consent gdpr notice notices alert menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer header masthead topbar toolbar comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe subscription "
    "popup modal overlay login signup search searchbox pagination pager widget complementary contentinfo".split()
)
# Words that an article element carries for the layout around it, and first words of names that only tell about it.
LAYOUT_WORDS = frozenset("banner breadcrumb breadcrumbs footer header masthead menu nav navbar navigation share sharing sidebar social topbar toolbar".split())
TELLING = frozenset("has no with without".split())
# Last words of names that tell about a zone's shape; the word before them is the head.
SHAPES = frozenset(
    "area articles bar block body bottom box buttons container content form group icons inner inline item items left link links list main module outer panel post posts primary region right row secondary "
    "section slot text thread title top unit widgets wrap wrapper".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ARTICLES = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# A start of these ends an open paragraph.
CLOSES_P = BLOCKS

# Window of rows, and share of the largest window sum that a block has to reach.
WINDOW, SHARE = 3, 0.01
# Share of the page's text beyond which a zone by its name, or a form, is the page's frame; what blocks outside of articles need to be the main text: characters, and times the largest article.
FRAME, PARAGRAPH, TIMES = 0.9, 200, 2
FRAMES = frozenset(["form", "fieldset"])

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
# The rest of a tag; an attribute's value may hold > in quotes.
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_ON_ARTICLE, _IN_ARTICLE = ZONE_WORDS - LAYOUT_WORDS, ZONE_WORDS - {"header"}


@dataclass
class Row:
    text: str
    noise: bool
    article: int  # number of the outermost article element around it, 0 for none
    linked: int


@dataclass
class _Zone:
    parent: int
    judged: bool  # by its share of the text
    closed: bool = False
    limit: int | None = None  # the row from which it does not hold if it is never closed


@dataclass
class _Stripper:
    rows: list[Row] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    link: bool = False
    zones: list[_Zone] = field(default_factory=lambda: [_Zone(0, False)])  # the first stands for none
    of: list[int] = field(default_factory=list)  # each row's innermost zone
    begins: list[bool] = field(default_factory=list)  # whether a row stands for its zone's begin
    unbounded: list[int] = field(default_factory=list)
    # open articles and zones and what is open in them: name, zone and whether it is an article; and how many by name
    open: list[tuple[str, int, bool]] = field(default_factory=list)
    count: dict[str, int] = field(default_factory=dict)
    articles: int = 0
    inside: int = 0  # open articles

    def text(self, part: str) -> None:
        if part:
            self.parts.append(part)
            if self.link:
                self.linked += len(part.strip())

    def row(self, text: str, linked: int, begins: bool = False) -> None:
        self.rows.append(Row(text, False, self.articles if self.inside else 0, linked))
        self.of.append(self.zone())
        self.begins.append(begins)

    def zone(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        text = " ".join(html.unescape("".join(self.parts)).split()) if self.parts else ""
        if text:
            self.row(text, self.linked)
        self.parts, self.linked = [], 0

    def push(self, name: str, zone: int, article: bool = False) -> None:
        self.open.append((name, zone, article))
        self.count[name] = self.count.get(name, 0) + 1
        self.inside += article

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
        elif name == "br":
            self.parts.append(" ")
        elif name == "a":
            self.link = True
        if name in VOID:
            return
        words = _ON_ARTICLE if name in ARTICLES else _IN_ARTICLE if self.inside else ZONE_WORDS
        named = bool(attributes) and name not in ("html", "body") and _marked(attributes, words)
        marked = name in ZONES or name == "header" and not self.inside or named
        if name in ARTICLES and not marked and not (self.zone() and self.inside):
            self.flush()
            for z in self.unbounded:
                self.zones[z].limit = len(self.rows)
            self.unbounded = []
            self.articles += not self.inside
            self.push(name, self.zone(), True)
            return
        if self.zone() and self.open[-1][0] == "p" and name in CLOSES_P:
            self.end("p")
        if marked:
            self.flush()
            self.zones.append(_Zone(self.zone(), name in FRAMES or name not in ZONES and named))
            self.unbounded.append(len(self.zones) - 1)
            self.push(name, len(self.zones) - 1)
            self.row("", 0, True)
        elif self.zone():
            self.push(name, self.zone())

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        elif name == "a":
            self.link = False
        if not self.count.get(name):
            return
        zone, inner = self.zone(), None
        while inner != name:
            inner, own, article = self.open.pop()
            self.count[inner] -= 1
            self.inside -= article
            if own != self.zone():
                if own == zone and self.parts:  # what is pending belongs to the zone
                    self.open.append((inner, own, article))
                    self.flush()
                    self.open.pop()
                self.zones[own].closed = inner == name

    def judged(self) -> list[Row]:
        """The rows, and which of them lie in zones."""
        limits = [-1] + [len(self.rows) if z.closed or z.limit is None else z.limit for z in self.zones[1:]]
        always = [-1] * len(limits)
        for i, z in enumerate(self.zones[1:], 1):
            always[i] = max(always[z.parent], -1 if z.judged else limits[i])
        mass, place = [0] * len(limits), list(range(len(limits)))
        for i, (row, z) in enumerate(zip(self.rows, self.of)):
            if i >= always[z]:
                path = []
                while z and i >= limits[z]:  # a zone that has ended for good
                    path.append(z)
                    z = place[z] if place[z] != z else self.zones[z].parent
                for x in path:
                    place[x] = z
                mass[z] += max(0, len(row.text) - row.linked)
        for i in range(len(mass) - 1, 0, -1):
            mass[self.zones[i].parent] += mass[i]
        until = [-1] * len(limits)
        for i, z in enumerate(self.zones[1:], 1):
            frame = z.judged and mass[i] > FRAME * mass[0]
            until[i] = max(until[z.parent], -1 if frame else limits[i])
        out = []
        for i, (row, z, begins) in enumerate(zip(self.rows, self.of, self.begins)):
            row.noise = i < until[z]
            if not begins or row.noise and i >= until[self.zones[z].parent]:
                out.append(row)
        return out


def _marked(attributes: str, words: frozenset[str]) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _WORD.findall(name)
            while len(parts) > 1 and parts[-1] in SHAPES:
                parts.pop()
            if parts and parts[0] not in TELLING and parts[-1] in words:
                return True
    return False


def rows_of(page: str) -> list[Row]:
    """The page's blocks of text in order, and a row without text where a zone begins."""
    out, at, low, last, quotes = _Stripper(), 0, None, page.rfind(">"), True
    while (begin := page.find("<", at)) >= 0:
        out.text(page[at:begin])
        at = begin + 1
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = len(page) if end < 0 else end + 3
            continue
        found = _NAME.match(page, at)
        if not found and page[at : at + 1] not in ("!", "?", "/"):
            out.text("<")
            continue
        if begin > last:  # a tag that the page's end cuts off
            at = len(page)
            break
        if not found:
            at = page.index(">", begin) + 1
            continue
        end = _REST.match(page, found.end()) if quotes else None
        quotes = quotes and end is not None
        at = end.end() if end else page.index(">", found.end()) + 1
        name, attributes = found[0].lower(), page[found.end() : at - 1]
        if name[0] == "/":
            out.end(name[1:])
        elif name not in RAW:
            out.start(name, attributes)
        elif not attributes.endswith("/"):
            low = page.lower() if low is None else low
            close = low.find(f"</{name}", at) if len(low) == len(page) else -1
            if close < 0 and len(low) != len(page):  # lower-casing moved the characters
                moved = re.compile(f"</{name}", re.I).search(page, at)
                close = moved.start() if moved else -1
            at = len(page) if close < 0 else close
    out.text(page[at:])
    out.flush()
    return out.judged()


def surges(lengths: list[int], window: int = WINDOW, share: float = SHARE) -> list[tuple[int, int]]:
    """(begin, end) of the blocks: runs of windows whose sums reach the share of the largest one, with all their rows."""
    total = [0, *accumulate(lengths)]
    sums = [total[min(i + window, len(lengths))] - total[i] for i in range(len(lengths))]
    least, out = max([1.0, *(s * share for s in sums)]), []
    for i, s in enumerate(sums):
        if s >= least:
            end = min(i + window, len(lengths))
            if out and i <= out[-1][1] and sums[i - 1] >= least:
                out[-1] = (out[-1][0], end)
            else:
                out.append((i, end))
    return out


def extract_main_text(page: str | None, window: int = WINDOW, share: float = SHARE) -> str:
    rows = rows_of(page or "")
    plain = [0 if x.noise else max(0, len(x.text) - x.linked) for x in rows]
    if not any(n for n, x in zip(plain, rows) if x.article) and any(x.article and x.text and not x.noise for x in rows):
        # articles of nothing but links: those are their text
        plain = [len(x.text) if x.article and not x.noise else 0 for x in rows]
    blocks = surges(plain, window, share)
    mass: dict[int, int] = {}
    free, seen = 0, 0  # blocks may share rows at their ends
    for a, b in blocks:
        for i in range(max(a, seen), b):
            if rows[i].article:
                mass[rows[i].article] = mass.get(rows[i].article, 0) + plain[i]
            else:
                free += plain[i]
        seen = b
    best = max(mass, key=lambda article: (mass[article], -article), default=0)
    if best and mass[best] and not free > max(PARAGRAPH, TIMES * mass[best]):
        kept = [x for x in rows if x.article == best]
    else:
        kept, end = [], 0
        for a, b in blocks:
            kept += (x for x in rows[max(a, end) : b] if not x.article)
            end = b
    return "\n".join(x.text for x in kept if x.text and not x.noise)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract_main_text(v.as_py()) for v in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
