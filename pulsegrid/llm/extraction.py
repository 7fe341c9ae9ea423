"""Main text of web pages by two-pass block rules: blocks are classed by stop-word density, length and link density, unclear ones inherit from their neighbours."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import others

#: Function words by language; other languages can be given to main_text().
STOP_WORDS = {
    "en": "the of and to a in is it that for was on are with as be at this by from or an have not but his her they which you we he she had were been their has its who will would there what so if no when can all".split(),
    "fr": "de la le et les des en un une du que est dans qui pour au sur pas par plus il elle ce ne se sont avec son sa ses ou mais nous vous leur aux cette comme on été ont".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde".split(),
    "it": "di che è la il un a per in una mi sono ho non ma lo ha le si ti i con cosa se io come da ci no questo bene tu sei del della dei nel alla al più gli delle anche".split(),
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até".split(),
    "nl": "de van een het en in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door over ze zich hij naar heeft hebben worden deze wordt dit was".split(),
}

#: Elements whose content isn't text of the page.
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video select button textarea title head datalist noembed noframes xmp map applet".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold what stands around an article.
AROUND = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar banner form".split())
#: Words in class and id names of what stands around an article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup"
    " sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments disqus replies respond share sharing social related recommended recommendations widget widgets toolbar pagination pager login search copyright disclaimer".split()
)
#: Those of elements that may hold article elements which aren't the page's.
READER = frozenset("comment comments disqus replies respond related recommended ad ads advert promo sponsored".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What an element's start closes, unless one of the others stands between.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[A-Za-z][^>]*\Z", re.DOTALL)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text between two block boundaries, its links' characters, and the element it stands in."""

    parent: int
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0
    heading: bool = False
    first: bool = False  # the page's first h1
    text: str = ""
    label: str = ""
    density: float = 0.0


@dataclass
class Page:
    """Elements (parent, tag, kind) in the order they open, and the blocks of text."""

    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: ["#page"])
    kinds: list[str] = field(default_factory=lambda: [""])
    guarded: set[int] = field(default_factory=set)
    blocks: list[Block] = field(default_factory=list)


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """How an element counts: silent (no text of the page), around, hinted (around unless it holds the article), reader (around unless it holds the main heading), head (a header), or nothing."""
    if tag in SILENT:
        return "silent"
    if tag in AROUND:
        return "around"
    if attributes and not attributes.isspace():
        named = {m[0].lower(): m[1] or m[2] or m[3] or "" for m in (x.groups() for x in _ATTRIBUTE.finditer(attributes))}
        style = named.get("style", "").replace(" ", "").lower()
        if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            return "silent"
        words = {w.lower() for w in _NAME.findall(f"{named.get('class', '')} {named.get('id', '')}")} & HINTS
        if in_article:
            words.discard("header")
        if tag == "article":
            return "around" if words & READER else ""
        if tag not in ("html", "body", "main") and (words or named.get("role", "").lower() in ROLES):
            return "reader" if words & READER else "hinted"
    if tag == "form":
        return "hinted"
    return "head" if tag == "header" else ""


def parse(html: str) -> Page:
    """Elements and blocks of a page; tags may be left open, closed twice, or broken off."""
    page = Page()
    stack = [0]
    opened: dict[str, int] = {}
    links = breaks = articles = heads = 0
    found_article = False
    block = Block(0)

    def close_block() -> None:
        nonlocal block
        if block.pieces:
            block.text = " ".join("".join(block.pieces).split())
            if block.text:
                page.blocks.append(block)
        if block.pieces:
            block = Block(stack[-1])

    def pop() -> None:
        nonlocal links, articles, heads
        tag = page.tags[stack.pop()]
        opened[tag] -= 1
        links -= tag == "a"
        articles -= tag == "article"
        heads -= tag in HEADINGS

    def pop_to(tags: tuple[str, ...], stops: tuple[str, ...] = ()) -> None:
        """Closes the innermost of these elements and all that is open in it, unless a stop comes first."""
        at = len(stack) - 1
        while at and page.tags[stack[at]] not in tags:
            if page.tags[stack[at]] in stops:
                return
            at -= 1
        while at and len(stack) > at:
            pop()

    at, end = 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else end]
        if piece:
            if "&" in piece:
                piece = unescape(piece)
            block.pieces.append(piece)
            if not piece.isspace():
                breaks = 0
                if links:
                    block.link_chars += len("".join(piece.split()))
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            block.pieces.append(" ")
            if breaks == 2:
                close_block()
            continue
        if tag not in INLINE:
            close_block()
        if closing:
            if opened.get(tag):
                pop_to((tag,))
        else:
            if tag in INLINE and tag != "a" and not attributes:
                continue
            if tag not in INLINE and opened.get("p"):
                pop_to(("p",), ("table", "td", "th", "button", "object"))
            if tag in CLOSES:
                names, stops = CLOSES[tag]
                if any(opened.get(t) for t in names):
                    pop_to(names, stops)
            if tag == "a" and links:
                pop_to(("a",), ("table", "td"))
            if tag in VOID:
                continue
            kind = _kind(tag, attributes, articles > 0)
            if tag == "article" and articles:
                kind = "around"  # inside an article these are its comments, or other articles
            if tag in ("h1", "main"):
                page.guarded.update(stack)
            elif tag == "article" and not kind and not found_article:
                found_article = all(page.kinds[e] != "reader" for e in stack)
                page.guarded.update(stack if found_article else ())
            page.parents.append(stack[-1])
            page.tags.append(tag)
            page.kinds.append(kind)
            if not attributes.rstrip().endswith("/") or tag not in ("svg", "math", "path"):
                stack.append(len(page.tags) - 1)
                opened[tag] = opened.get(tag, 0) + 1
                links += tag == "a"
                articles += tag == "article"
                heads += tag in HEADINGS
            if tag in RAW:
                over = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
                at = over.start() if over else end
        if tag not in INLINE:
            block.parent, block.heading = stack[-1], heads > 0
    close_block()
    return page


class BlockRules:
    """The two passes over the blocks of a page."""

    def __init__(self, stop_words: dict[str, list[str]], long: int = 200, short: int = 70, dense: float = 0.2, sparse: float = 0.1, links: float = 0.25) -> None:
        self.lists = {k: frozenset(w) for k, w in stop_words.items()}
        self.long, self.short, self.dense, self.sparse, self.links = long, short, dense, sparse, links

    def candidates(self, page: Page) -> tuple[list[Block], bool]:
        """Blocks that aren't in an element around the article, and whether they are those of article or main elements: so if these hold at least half of the letters."""
        n = len(page.tags)
        out, head, core = [False] * n, [False] * n, [False] * n
        for e in range(1, n):
            parent, kind = page.parents[e], page.kinds[e]
            core[e] = core[parent] or page.tags[e] in ("article", "main")
            head[e] = head[parent] or kind == "head"
            out[e] = out[parent] or kind in ("silent", "around") or kind in ("hinted", "reader") and e not in page.guarded or kind == "head" and e not in page.guarded and not core[e]
        left = [b for b in page.blocks if not out[b.parent] and (b.heading or not head[b.parent])]
        inside = [b for b in left if core[b.parent]]
        if inside and 2 * sum(len(b.text) for b in inside) >= sum(len(b.text) for b in left):
            return inside, True
        h1 = next((b for b in left if b.heading and page.tags[b.parent] == "h1"), None)
        if h1:
            h1.first = True
        return left, False

    def first_pass(self, blocks: list[Block], core: bool) -> None:
        """good, bad or unclear, for each block by itself; a page's first h1, if it isn't links, is where its text begins, so it is good.

        Stop words are those of the language that fits the page best; if none fits (less than `sparse` of all words),
        density decides nothing. Links beyond `links` of a block's letters make it bad, a copyright sign a short one, and few stop words
        a block of at least `short` characters outside an article element. Many stop words make a block of that length good.
        """
        words = [_LETTERS.findall(b.text.lower()) for b in blocks]
        total = sum(map(len, words))
        counts: Counter[str] = Counter()
        for ws in words:
            counts.update(ws)
        hits = {k: sum(counts[w] for w in s & counts.keys()) for k, s in self.lists.items()}
        best = max(hits, key=hits.get, default="")
        stops, known = self.lists.get(best, frozenset()), total > 0 and hits.get(best, 0) >= self.sparse * total
        for b, ws in zip(blocks, words):
            size = len(b.text)
            b.density = sum(map(stops.__contains__, ws)) / len(ws) if ws else 0.0
            if b.link_chars > self.links * len("".join(b.text.split())) or "©" in b.text and size < self.long:
                b.label = "bad"
            elif b.first:
                b.label = "good"
            elif size < self.short:
                b.label = ""
            elif not known:
                b.label = "good" if size >= self.long or core else ""
            elif b.density >= self.dense or size >= self.long and b.density >= self.sparse:
                b.label = "good"
            else:
                b.label = "" if core or b.density >= self.sparse else "bad"

    def second_pass(self, blocks: list[Block], core: bool) -> None:
        """Unclear blocks take the label of their nearest decided neighbours.

        Where the two differ, the nearer decides; at equal distance a heading goes with what follows it, another block is good if its
        stop words make it a sentence. Outside an article element the ends of the page count as bad neighbours (the end of a page with an h1 as none); with no neighbour at all a block is good.
        """
        n = len(blocks)
        edge = (-1, "") if core else (-1, "bad")
        before, after = [edge] * n, [edge] * n
        seen = edge
        for i, b in enumerate(blocks):
            before[i] = seen
            if b.label:
                seen = (i, b.label)
        seen = (n, "") if core or any(b.first for b in blocks) else (n, "bad")
        for i in range(n - 1, -1, -1):
            after[i] = seen
            if blocks[i].label:
                seen = (i, blocks[i].label)
        for i, b in enumerate(blocks):
            if b.label:
                continue
            (p, left), (q, right) = before[i], after[i]
            if left == right or not left or not right:
                label = left or right or "good"
            elif i - p != q - i:
                label = left if i - p < q - i else right
            else:
                label = right if b.heading else "good" if b.density >= self.dense else "bad"
            before[i] = (p, label)
        for i, b in enumerate(blocks):
            b.label = b.label or before[i][1]

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        blocks, core = self.candidates(parse(html))
        self.first_pass(blocks, core)
        self.second_pass(blocks, core)
        return "\n".join(b.text for b in blocks if b.label == "good")


def main_text(df: DataFrame, html: str = "html", stop_words: dict[str, list[str]] | None = None, **rules) -> DataFrame:
    """Columns of df without the page itself (and without columns named text or n_chars), text: its main text, and n_chars, its code points.

    A page is cut into blocks at tags that aren't inline and at double line breaks; character references are decoded, white space in a
    block becomes one space, blocks are joined by one newline in page order. Elements around an article (menus, footers, forms,
    scripts, hidden ones, and those whose class or id names them) go first, unless they hold the page's main heading or first article;
    then the two passes of BlockRules decide. If article or main elements hold at least half of what is left, only they are read.

    A null or empty page, and one without text, gives an empty text. Broken markup is read as far as it goes; nothing is cut off,
    however long. Equal pages give equal texts. Each page is read by itself: no shuffle.
    """
    judge = BlockRules(stop_words or STOP_WORDS, **rules)

    @F.pandas_udf("string")
    def extract(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(judge.text)

    kept = others(df, "text", "n_chars", html)
    return df.select(*kept, extract(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
