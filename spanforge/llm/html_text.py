"""HTML extraction by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by its length, the density of links
and the density of stop words; short and middling blocks stay open. In the second pass an open block takes the
label of its nearest decided neighbours. Where <article> or <main> holds most of the good text, a block in it
that has few stop words is open too, and what is open outside is bad. Elements that are no article by their tag,
role or class name are left out before. Pages are read whole, in one scan each, by a pattern without backtracking.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# Thresholds of the rules, in characters and shares.
SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.30, 0.32, 0.2

# Frequent function words by language.
STOP_WORDS = {
    "en": set("a about after all also an and any are as at be been but by can could do for from had has have he her his how i if in into is it its just like more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were what when which who will with would you your".split()),
    "de": set("aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat haben ich ihr ihre im in ist ja kann kein mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur".split()),
    "fr": set("à au aux avec avoir ce cette comme dans de des du elle en est et être il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur très tu un une vous y".split()),
    "es": set("a al así como con de del desde donde el ella en entre era es esta este fue ha han hasta la las le lo los más me mi muy no o para pero por porque que se ser si sin sobre son su sus también tiene un una uno y ya yo".split()),
}
ALL_STOP_WORDS = set().union(*STOP_WORDS.values())

# Elements by role.
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title"
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set("nav footer aside form button menu dialog".split())
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Parts of class names. A name counts if a part is in HINTS and the others in HINTS or BESIDE.
HINTS = set(
    """ad ads advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion banner banners nav navbar navigation
    menu menus footer sidebar sidebars cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup
    login share shares sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets masthead topbar toolbar skip
    skiplink comment comments commentlist disqus reply replies respond""".split()
)
COMMENTS = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
BESIDE = set(
    """site page main primary secondary top bottom left right header global user box block bar button buttons list item items link links wrap wrapper container
    area section inner outer panel form message text body slot unit icons media post posts article articles story stories sticky mobile desktop""".split()
)
NAME_PART = re.compile(r"[a-z]+|\d+", re.I)
# Scripts written without spaces; a character tells about as much as three letters.
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
PER_CHARACTER = 3
TOKEN = re.compile(
    rf"<!--(?:[^-]++|-(?!->))*+(?:-->|\Z)|<({RAW})\b[^>]*+>(?:[^<]++|<(?!/\1\b))*+(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+|[^>]*+)>|<[!?][^>]*+>",
    re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)
HREF = re.compile(r"\bhref\b", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}


def hinted(name: str) -> str:
    """What a class name or id says of its element: "comments", "other", or nothing."""
    parts = [p.lower() for p in NAME_PART.findall(name) if not p.isdigit()]
    if "site" in parts or "page" in parts:
        if parts[-1] == "header":
            return "other"
    if not any(p in HINTS for p in parts) or not all(p in HINTS or p in BESIDE for p in parts):
        return ""
    return "comments" if any(p in COMMENTS for p in parts) else "other"


def boilerplate(tag: str, attributes: str) -> str:
    """"out" if an element's name, role or state, or a class of comments, marks it as no article, whatever it stands in;
    "hint" if only a class name does; else nothing."""
    if tag in BOILERPLATE:
        return "out"
    found = ""
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value, name = "".join(values), name.lower()
        if name in ("class", "id") and tag not in ("body", "html"):
            hints = {hinted(x) for x in value.split()}
            if "comments" in hints:
                return "out"
            # an article's or main part's own name speaks of its content
            if "other" in hints and tag not in MAIN:
                found = "hint"
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "out"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "out"
    return found


class Block:
    """One block of text: its words, characters in links, and where it stands."""

    __slots__ = ("text", "linked", "bad", "main", "heading", "label")

    def __init__(self, text: str, linked: int, bad: bool, main: bool, heading: bool):
        self.text, self.linked, self.bad, self.main, self.heading, self.label = text, linked, bad, main, heading, ""


class Page:
    """Scans a page into blocks with text, in order, and its language."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.lang = ""
        self.stack: list[tuple[str, str, bool]] = []  # name, "out" or "hint" if in boilerplate, in the main part
        self.parts: list[tuple[str, bool]] = []
        self.link = -1  # open elements around the open link, or none
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                self.parts.append((page[at : m.start()], self.link >= 0))
            at = m.end()
            if m[3]:
                self.tag(m[3].lower(), bool(m[2]), m[4])
        if at < len(page):
            self.parts.append((page[at:], self.link >= 0))
        self.flush()

    def where(self) -> tuple[str, bool]:
        return self.stack[-1][1:] if self.stack else ("", False)

    def flush(self) -> None:
        if self.parts:
            text = " ".join(entities.unescape("".join(p for p, _ in self.parts)).split())
            if text:
                linked = sum(len("".join(entities.unescape(p).split())) for p, link in self.parts if link)
                bad, main = self.where()
                self.blocks.append(Block(text, linked, bool(bad), main, any(s[0] in HEADINGS for s in self.stack[-2:])))
            self.parts.clear()

    def pop(self) -> str:
        name = self.stack.pop()[0]
        if self.link > len(self.stack):  # the link's element is closed
            self.link = -1
        return name

    def push(self, tag: str, bad: str) -> None:
        around, main = self.where()
        if tag in MAIN and not main and around == "hint":
            around = ""  # the class name of a wrapper doesn't reach into the main part
        self.stack.append((tag, "out" if "out" in (around, bad) else around or bad, main or tag in MAIN))

    def tag(self, tag: str, closing: bool, attributes: str) -> None:
        if tag == "a":
            # a link may hold blocks
            self.link = -1 if closing or not HREF.search(attributes) else len(self.stack)
        elif tag == "br":
            self.parts.append((" ", False))
        elif tag not in INLINE:
            self.flush()
            if closing:
                if any(s[0] == tag for s in self.stack):
                    while self.pop() != tag:
                        pass
            elif tag not in VOID and not attributes.endswith("/"):
                if tag == "html" and not self.lang and (found := LANG.search(attributes)):
                    self.lang = found[1].lower()
                if tag in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and self.stack and self.stack[-1][0] == tag:
                    self.pop()
                site_header = tag == "header" and not self.where()[1]
                self.push(tag, "out" if site_header else boilerplate(tag, attributes))
        elif attributes and not closing and tag not in VOID and (bad := boilerplate(tag, attributes)):
            # a hidden or advertising inline element becomes a block of its own
            self.flush()
            self.push(tag, bad)
        elif closing and self.stack and self.stack[-1][0] == tag:
            self.flush()
            self.pop()


def blocks(page: str) -> list[Block]:
    """The blocks of a page with text, in order."""
    return Page(page).blocks


def link_density(b: Block) -> float:
    return b.linked / max(1, len(b.text.replace(" ", "")))


def text_label(b: Block, density: float, stop_words: set[str]) -> str:
    """good, bad, near or short, by the density of links, the length and the density of stop words.

    Words of scripts without spaces can't be told, so such a block is judged by links and length alone.
    """
    if density > LINKS:
        return "bad"
    unspaced = 0 if b.text.isascii() else len(UNSPACED.findall(b.text))
    length = len(b.text) + (PER_CHARACTER - 1) * unspaced
    if length < SHORT:
        return "bad" if b.linked or b.text[0] == "\xa9" else "short"
    if 2 * unspaced >= len(b.text):
        return "good" if length > LONG else "near"
    words = b.text.lower().split()
    stops = sum(w.strip(".,;:!?\"'()") in stop_words for w in words) / len(words)
    if stops >= STOP_HIGH:
        return "good" if length > LONG else "near"
    return "near" if stops >= STOP_LOW else "bad"


def first_pass(found: list[Block], stop_words: set[str]) -> list[Block]:
    """Label blocks good, bad, near or short; returns the blocks that the second pass has to look at together.

    Every block outside boilerplate is judged by its text. Where <article> or <main> holds most of the good text, a
    block in it with few links is good or near, and what is open outside is bad. A page without any good text is its
    <article> or <main>, but for blocks of links.
    """
    for b in found:
        b.label = "bad" if b.bad else text_label(b, link_density(b), stop_words)
    inside = [b for b in found if b.main and not b.bad]
    size = lambda main: sum(len(b.text) for b in found if b.label == "good" and b.main == main)
    if not inside or size(True) < size(False):
        return found
    alone = not size(True)
    for b in inside:
        density = link_density(b)
        if density <= LINKS or b.heading:
            b.label = "good" if alone or b.label == "good" else "near"
        else:
            b.label = "short" if density <= 0.5 else "bad"
    for b in found:
        if not b.main and b.label != "good":
            b.label = "bad"
    return inside


def second_pass(found: list[Block], edge: str = "bad") -> None:
    """Give open blocks the label of their nearest decided neighbours.

    Between two neighbours of one label a block takes it. Otherwise a middling block is good, a heading goes
    with what follows it, and any other short block is good only if the good neighbour is the nearer one.
    edge: what the page's ends, or those of the main part, count as; if empty, the other neighbour decides, and
    where there is none the block is good.
    """
    labels = [b.label for b in found]
    n = len(found)
    before, last = [(None, 0)] * n, (edge, -1)
    for i, x in enumerate(labels):
        before[i] = last
        if x in ("good", "bad"):
            last = (x, i)
    last = (edge, n)
    for i in range(n - 1, -1, -1):
        if labels[i] in ("good", "bad"):
            last = (labels[i], i)
            continue
        (left, l_at), (right, r_at) = before[i], last
        if left == right or not left or not right:
            found[i].label = left or right or "good"
        elif labels[i] == "near":
            found[i].label = "good"
        elif found[i].heading:
            found[i].label = right
        else:
            found[i].label = left if i - l_at < r_at - i else right if r_at - i < i - l_at else "bad"


def extract(page: str | None) -> str:
    """The main text of a whole page, one space between blocks; empty for null or a page without any."""
    if not page:
        return ""
    scanned = Page(page)
    found = scanned.blocks
    together = first_pass(found, STOP_WORDS.get(scanned.lang, ALL_STOP_WORDS))
    second_pass(together, "bad" if together is found else "")
    return " ".join(b.text for b in found if b.label == "good")


def main_text(page: Column) -> Column:
    """The main text of an HTML column."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([extract(p) for p in pages], dtype=object)

    return texts(page)


def extract_pages(pages: DataFrame, html: str = "html", column: str = "text") -> DataFrame:
    """pages with the main text in a last column, with an underscore before its name if pages has it.

    Null pages have an empty text; repeated rows stay repeated. A page of any length is read whole, in memory of a
    few times its size. An empty table gives no rows.
    """
    return pages.withColumn(fresh(pages, column)[0], main_text(F.col(html)))
