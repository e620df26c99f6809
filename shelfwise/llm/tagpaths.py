"""Main text of HTML pages by tag-path ratios.

A page is read into text nodes, each with the path of its elements from the root: block-level tags
with their class, id and role names (inline tags belong to their block, unless they carry a name that
speaks of boilerplate). A block that is mostly links has a path of its own below that. Per path,
text length and punctuation are added up: length per block and punctuation per block are the two
ratios. They are fused by their geometric mean together with the share of text that is no link,
smoothed over neighbouring paths (those below the same parent), and paths whose fused value
reaches a part of the best one are content.

Lists of names only lower a path's ratio. Elements that are boilerplate by their tag, role, or by
a name that begins like it (navigation, header, footer, sidebar, form, advert, notice, comments)
have their ratios divided by ``1 / LOWERED``. A name with such a word further back (`has-sidebar`,
`category-legal`) does the same, unless that element holds most of the page's text outside of links.
A header inside an article or main element is not the page's. Only what is no text at all (scripts,
styles, the head, options and the like) is left out before.

The page's blocks are the texts between block-level tags. Defined cases: a null or empty page
and a page without content nodes give an empty text; unclosed and stray tags are tolerated; a
tag that never ends is text; repeated rows are pages of their own; input columns named like a
result are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import put

#: A path is content if its fused ratio reaches this part of the best path's.
SHARE = 0.05
#: What the names of boilerplate leave of a ratio, and what a path keeps of it if all is links.
LOWERED = 0.002
LINKED = 0.05
#: A block with more linked text than this is a block of links; an element with more of the page's
#: unlinked text than this is no boilerplate because of a word inside one of its names.
MOSTLY = 0.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NO_TEXT = frozenset(
    "script style noscript template head title iframe svg canvas button select option textarea "
    "input object audio video math".split()
)
NO_ARTICLE = frozenset("nav header footer aside form label menu dialog".split())
RAW = "script|style|noscript|template|iframe|textarea|svg|title"
NO_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
NO_ARTICLE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner "
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget "
    "cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe "
    "subscription signup login comment comments respond disqus replies reply share sharing social "
    "related recommended pagination pager copyright legal disclaimer toolbar tags skip".split()
)
#: These open tags end an open paragraph; li, dt, dd, tr, td, th, option end one of their kind.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "head", "body"}
SIBLINGS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPE = frozenset("html body article section div main table td th ul ol dl blockquote figure form".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    rf"|<({RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z0-9]+")
MARKS = re.compile(r"[.,;:!?…。，、；：！？]")


def judged(tag: str, attributes: str, in_article: bool) -> tuple[str, str]:
    """The element's step in a path, and what its names say: `none`, `weak`, `strong`, `no text`."""
    if tag in NO_TEXT:
        return tag, "no text"
    verdict = "strong" if tag in NO_ARTICLE and not (tag == "header" and in_article) else "none"
    if "=" not in attributes and "hidden" not in attributes:
        return tag, verdict
    names = []
    for kind, a, b, c in NAMED.findall(attributes):
        value = (a or b or c).lower()
        names.append(" ".join(value.split()))
        if tag in ("body", "html"):
            continue
        if kind.lower() == "role":
            if value in NO_ARTICLE_ROLES:
                verdict = "strong"
            continue
        for token in value.split():
            parts = PARTS.findall(token)
            if parts and parts[0] in NO_ARTICLE_NAMES and tag not in ("article", "main"):
                verdict = "strong"
            elif verdict == "none" and any(p in NO_ARTICLE_NAMES for p in parts):
                verdict = "weak"
    if "hidden" in attributes and re.search(r"\bhidden\b(?!\s*=)", attributes):
        verdict = "strong"
        names.append("hidden")
    return ".".join([tag, *sorted(names)]).replace("/", "|"), verdict


class Page:
    """Text nodes of a page: (block number, path, text, linked).

    ``strong`` holds the paths lowered by a name, ``weak`` the elements (as paths) whose names may
    lower a path.
    """

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, str, bool]] = []
        self.strong: set[str] = set()
        self.weak: dict[str, tuple[str, ...]] = {}
        self.block = 0
        self.stack: list[str] = []
        self.places: list[tuple[str, bool, tuple[str, ...]]] = [("", False, ())]
        self.off = 0  # open elements without text
        self.links = 0
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self.text(source[at: m.start()])
            at = m.end()
            if m[3]:
                (self.close if m[2] else self.start)(m[3].lower(), m[4] or "")
            elif m[1] and m[1].lower() in BLOCKS:
                self.block += 1
        if at < len(source):
            self.text(source[at:])

    def text(self, raw: str) -> None:
        if self.off:
            return
        if not raw.strip():
            self.text_space()
            return
        path, strong, weak = self.places[-1]
        if strong:
            self.strong.add(path)
        if weak:
            self.weak[path] = weak
        self.nodes.append((self.block, path, entities.unescape(raw), self.links > 0))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.stack.pop()
            self.places.pop()
            self.off -= tag in NO_TEXT
            self.links -= tag == "a"

    def end_open(self, names, stop=SCOPE) -> None:
        """Close the innermost open element of these names, if no scope lies in between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] in names:
                self.pop_to(i)
                return
            if self.stack[i] in stop:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if tag == "br":
            self.text_space()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self.end_open({"p"})
        if tag in SIBLINGS:
            names = SIBLINGS[tag]
            self.end_open(names, SCOPE - names)
        if attributes.rstrip().endswith("/") and tag not in BLOCKS and "=" not in attributes[-2:]:
            return
        step, verdict = judged(tag, attributes, "article" in self.stack or "main" in self.stack)
        path, strong, weak = self.places[-1]
        if tag in BLOCKS or verdict in ("weak", "strong"):
            path = f"{path}/{step}"
        self.places.append((path, strong or verdict == "strong", (*weak, path) if verdict == "weak" else weak))
        self.stack.append(tag)
        self.off += tag in NO_TEXT
        self.links += tag == "a"

    def text_space(self) -> None:
        if self.nodes and self.nodes[-1][0] == self.block and not self.off:
            self.nodes.append((self.block, self.nodes[-1][1], " ", False))

    def close(self, tag: str, _: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i] == tag:
                self.pop_to(i)
                return
            if self.stack[i] in SCOPE and tag not in BLOCKS:
                return


def of_links(nodes: list[tuple[int, str, str, bool]]) -> set[tuple[int, str]]:
    """The blocks (and their paths) that are mostly links."""
    whole, linked = defaultdict(int), defaultdict(int)
    for block, path, text, in_link in nodes:
        n = len(text.strip())
        whole[block, path] += n
        linked[block, path] += n * in_link
    return {at for at, n in whole.items() if linked[at] > MOSTLY * n}


def content_paths(page: Page, share: float = SHARE) -> set[str]:
    """Paths whose fused, smoothed ratio reaches a part of the best path's.

    The path of a block of links ends in `/a`.
    """
    length, marks, linked = (defaultdict(float) for _ in range(3))
    blocks, links = defaultdict(set), of_links(page.nodes)
    own = {}
    for block, path, text, in_link in page.nodes:
        n = len(text.strip())
        if n:
            p = f"{path}/a" if (block, path) in links else path
            own[p] = path
            length[p] += n
            marks[p] += len(MARKS.findall(text))
            linked[p] += n * in_link
            blocks[p].add(block)
    free = {p: n - linked[p] for p, n in length.items()}
    inside = defaultdict(float)
    for p, n in free.items():
        for element in page.weak.get(own[p], ()):
            inside[element] += n
    most = MOSTLY * sum(free.values())

    def weight(p: str) -> float:
        lowered = own[p] in page.strong or any(inside[e] <= most for e in page.weak.get(own[p], ()))
        return (LOWERED if lowered else 1.0) * (LINKED + (1 - LINKED) * free[p] / length[p])

    weights = {p: weight(p) for p in length}
    ratio = {p: weights[p] * ((length[p] / len(blocks[p])) * (1.0 + marks[p] / len(blocks[p]))) ** 0.5
             for p in length}
    parent = lambda p: p.rpartition("/")[0]
    near = defaultdict(float)
    for p, r in ratio.items():
        near[parent(p)] = max(near[parent(p)], r)
        near[p] = max(near[p], r)
    fused = {p: 0.5 * r + 0.5 * weights[p] * max(
        near[parent(p)], near[p], near.get(parent(parent(p)), 0.0)) for p, r in ratio.items()}
    best = max(fused.values(), default=0.0)
    return {p for p, v in fused.items() if v >= share * best}


def main_text(source: str | None, share: float = SHARE) -> str:
    """The article of a page, one line per block."""
    page = Page(source or "")
    chosen, links = content_paths(page, share), of_links(page.nodes)
    blocks: dict[int, list[str]] = {}
    for block, path, text, _ in page.nodes:
        if (f"{path}/a" if (block, path) in links else path) in chosen:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extracted(page: Column, share: float = SHARE) -> Column:
    @F.pandas_udf("string")
    def extract(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, share) for x in batch], dtype=object)

    return extract(page)


def extract_articles(pages: DataFrame, html: str = "html", share: float = SHARE) -> DataFrame:
    """All rows with text (the article) and n_chars (its code points)."""
    found = put(pages, {"text": extracted(F.col(f"`{html}`"), share)})
    return put(found, {"n_chars": F.length("text").cast("bigint")})
