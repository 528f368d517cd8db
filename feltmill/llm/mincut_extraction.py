"""Main text of web pages: a minimum cut separates content blocks from boilerplate.

A page is cut into blocks of text at its block-level tags. Each block gets two costs, of being called content and of
being called boilerplate, from its place (landmark elements, telling words in class, id and role) and its text (share
of linked characters, length, sentence marks). Telling words, and forms, count for all blocks in their element but those
in an `<article>` or `<main>` further in. Names that speak of the layout (`has-sidebar`, `post-social`) do not count where
the element holds most of the page's text; names of a part of the page (`sidebar`, `comments-area`, `cookie-notice`) count
also inside the main text, for the articles in them, and however long they are, unless nothing else is left. An article in an
article is a comment. The costs are the capacities of its edges to sink and source. Neighbouring blocks, and consecutive blocks of the same parent, are joined by smoothness edges that get stronger the closer the
blocks lie in the element tree. The maximum flow through this graph finds the cheapest labelling, and the blocks on
the source's side, in page order, are the text.

The cost weights are fixed, there being no labels to learn them from.

The flow takes time near linear in the blocks: most blocks outweigh their edges and are settled before it.

Defined cases: a null, empty or textless page gives the empty string; markup that is cut off at the end is dropped;
unclosed elements end with their parent, an unclosed script or style with the page, an unclosed title at the next tag; `<br>` is a blank; repeated rows stay; an empty table gives an empty result;
other columns pass through untouched.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is no text of the page; one that never ends is skipped alone, but for scripts and styles.
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style noscript template textarea title iframe svg select canvas audio video xmp".split()}
#: A quote belongs to a tag only behind an equals sign; any other one is part of a name or of a bare value.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|([^<]+|<)",
    re.S,
)
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data dfn em font i img ins del kbd label mark math meter object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br"
    " mfrac mi mn mo mover mroot mrow ms mspace msqrt msub msubsup msup mtext munder munderover semantics".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
BARRED = set("nav footer aside button menu dialog head noframes fieldset".split())
MAIN = {"article", "main"}
#: An end tag is implied when one of these begins inside another of the same kind.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BREAKS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TELLING = set(
    "ad ads advert adverts advertisement advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies sidebar widget menu nav navbar navigation"
    " breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager skip search tags copyright legal disclaimer contentinfo complementary hidden byline".split()
)
ADVERTS = set("ad ads advert adverts advertisement advertorial sponsor sponsored promo promotion".split())
#: Words that name a part of the page in whatever name they stand, unless one of `STATE` stands beside them.
PARTS = ADVERTS | set("comment comments disqus replies sidebar cookie cookies consent gdpr newsletter breadcrumb breadcrumbs navbar".split())
STATE = set("has no with without non not show shows hide hides on off enabled disabled free open closed layout page".split())
#: Words that say nothing of what a part holds; names of a telling word and these alone name a part, too.
PLAIN = set("area list section box block item items body text left right top bottom bar button buttons link links thread inner outer container wrapper wrap group panel footer".split())
#: Class names of an element that holds the page; its other names tell of the layout.
WHOLE = {"content", "main", "page", "layout", "site"}
NEVER, LEAN = 1e6, 6.0
#: Costs of content under a telling word, and under a form or a word of advertising.
TOLD, SOLD = 8.0, 12.0
NEAR = 1.2


def telling(attributes: str) -> tuple[float, bool, bool]:
    """(cost of content, whether a name is that of a part of the page, whether the element is hidden) by a tag's attributes."""
    told, part, hidden, whole = 0.0, False, False, False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "style" and "display:none" in value.lower().replace(" ", ""):
            hidden = True
        elif key in ("class", "id", "role", "aria-label"):
            for name in value.split():
                words = {w.lower() for w in WORD.findall(name)}
                whole = whole or key == "class" and name.lower() in WHOLE
                if not TELLING.isdisjoint(words):
                    told = max(told, TOLD if ADVERTS.isdisjoint(words) else SOLD)
                    if key != "aria-label" and STATE.isdisjoint(words):
                        part = part or not PARTS.isdisjoint(words) or words <= TELLING | PLAIN
    return told, part and not whole, hidden


class _Element:
    __slots__ = ("name", "parent", "depth", "barred", "main", "linked", "told", "part", "teller", "outer", "block")

    def __init__(self, name: str, attributes: str, parent: _Element | None) -> None:
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.block = parent.block if parent and name in INLINE else self  # the nearest element that is no inline one
        self.told, self.part, hidden = telling(attributes) if attributes else (0.0, False, False)
        inside = parent.main if parent else False
        if name == "form":
            self.told, self.part = SOLD, False
        elif name == "article" and inside and not self.told and self.within("article"):
            self.told = SOLD  # an article in an article is a comment on it, unless it holds most of the page
        header = name == "header" and not inside
        self.barred = bool(parent and parent.barred) or name in BARRED or header or hidden and name not in ("html", "body", *MAIN)
        # the innermost element around that tells of boilerplate; a main text in it is not meant, unless it tells the same,
        # or is an article in what is named a part of the page: comments and teasers are articles, too
        self.outer = parent.teller if parent else None
        if name == "main" or name == "article" and not self.told and not (self.outer and self.outer.part):
            self.outer = None
        self.teller = self if self.told and name not in ("html", "body", "main") else self.outer
        self.main = (inside or name in MAIN) and not self.barred
        self.linked = name == "a" or bool(parent and parent.linked and name in INLINE)

    def within(self, name: str) -> bool:
        at = self.parent
        while at is not None and at.main and at.name != name:
            at = at.parent
        return at is not None and at.name == name


class _Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: _Element, linked: float) -> None:
        self.text, self.element, self.linked = text, element, linked


def blocks_of(page: str) -> list[_Block]:
    """Text blocks in page order, with their element and share of linked characters."""
    here = _Element("", "", None)
    out: list[_Block] = []
    parts: list[str] = []
    owner, linked, total = here, 0, 0

    def close() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(_Block(text, owner, linked / max(1, total)))
            parts.clear()
            linked = total = 0

    at, opened, endless = 0, set(), set()
    while at < len(page):
        found = TOKEN.match(page, at)
        at = found.end()
        slash, name, attributes, text = found.groups()
        if text is not None:
            if not parts:
                owner = here.block
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            size = len(text) if not text.isspace() else 0
            total += size
            linked += size if here.linked else 0
            continue
        if name is None:
            continue  # comments and declarations
        name = name.lower()
        if name in RAW:
            if not slash and not attributes.endswith("/") and name not in endless:
                end = RAW[name].search(page, at)
                if end is None:
                    endless.add(name)
                after = page.find("<", at)  # the head goes on behind the words of an endless title
                rest = {"script": len(page), "style": len(page), "title": after if after >= 0 else len(page)}
                at = end.end() if end else rest.get(name, at)
            continue
        if name == "br":
            if parts:
                parts.append(" ")
            continue
        if name not in INLINE:
            close()
        if slash:
            up: _Element | None = here if name in opened else None
            while up is not None and up.name != name:
                # an inline end tag does not reach beyond the block that it stands in
                up = None if name in INLINE and up.name not in INLINE else up.parent
            if up is not None and up.parent is not None:
                here = up.parent
        elif name not in VOID and not attributes.endswith("/"):
            ends = SIBLINGS.get(name)
            if name not in INLINE:
                up = here.block
                if ends and up.name in ends or up.name == "p" and name in BREAKS_P:
                    here = up.parent
                else:
                    here = up  # a block ends the inline elements left open before it
            here = _Element(name, attributes, here)
            opened.add(name)
    close()
    return out


def wrappers(blocks: list[_Block], parts: bool = False) -> set[_Element]:
    """Telling elements that hold most of the page's text: there the words mean the layout.

    Words of advertising and names of a part (a long notice, a long list of comments) stay what they are; a part counts as
    layout only where it holds a lone article with most of the text, or, with `parts`, most of the text itself.
    """
    held: dict[_Element, int] = {}
    articles: dict[_Element, int] = {}
    total = 0
    for block in blocks:
        if not block.element.barred:
            total += len(block.text)
            teller = block.element.teller
            while teller is not None:
                held[teller] = held.get(teller, 0) + len(block.text)
                teller = teller.outer
            at = block.element if block.element.main else None
            while at is not None and at.main:
                if at.name == "article" and not at.told and at.outer is not None:
                    articles[at] = articles.get(at, 0) + len(block.text)
                at = at.parent
    lifted = {e for e, n in held.items() if 2 * n > total and (parts or not e.part and (e.told < SOLD or e.name in ("form", "article")))}
    for article, n in articles.items():
        around = article.outer if 2 * n > total else None
        while around is not None:
            lifted.add(around)
            around = around.outer
    return lifted


def costs(block: _Block, lifted: set[_Element] = frozenset()) -> tuple[float, float]:
    """(cost of boilerplate, cost of content): the capacities from the source and to the sink. `lifted`: elements whose words do not count."""
    if block.element.barred:
        return 0.0, NEVER
    text, good, bad, main = block.text, 0.0, 0.0, block.element.main
    teller = block.element.teller
    while teller is not None:
        if teller not in lifted:
            bad = max(bad, teller.told)
            main = main and teller.main and not teller.part and teller.name != "article"
        teller = teller.outer
    if main:
        good += LEAN
    bad += 5.0 * block.linked
    length = len(text)
    good += min(3.0, length / 60)
    if length < 25:
        bad += 1.0
    if text[-1] in ".!?:;…»\"'”)":
        good += 0.8
    if block.element.name in ("p", "blockquote", "pre", "h1", "h2", "h3"):
        good += 0.8
    if "©" in text or "all rights reserved" in text.lower():
        bad += 4.0
    return good, bad


def distance(one: _Element, two: _Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while one is not two:
        if one.depth >= two.depth:
            one = one.parent
        else:
            two = two.parent
        steps += 1
    return steps


def source_side(good: list[float], bad: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: which nodes stay with the source (the fewest, of cuts of equal cost).

    A node whose terminal edge outweighs all its other edges is on that side in every such cut; it is settled at once, and
    its edges become terminal edges of its neighbours. What is left is solved by blocking flows along shortest paths.
    """
    n, least = len(good), 1e-12
    excess = [g - b for g, b in zip(good, bad, strict=True)]  # what is left of either terminal edge
    room: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        room[a][b] = room[a].get(b, 0.0) + w
        room[b][a] = room[b].get(a, 0.0) + w
    around = [sum(r.values()) for r in room]
    side: list[bool | None] = [None] * n
    line = deque(range(n))
    while line:
        i = line.popleft()
        if side[i] is None and (excess[i] > around[i] + least or -excess[i] >= around[i] - least):
            side[i] = excess[i] > around[i] + least
            for j, w in room[i].items():
                del room[j][i]
                around[j] -= w
                excess[j] += w if side[i] else -w
                line.append(j)
            room[i] = {}
    left = [i for i in range(n) if side[i] is None]
    while True:
        level = {i: 0 for i in left if excess[i] > least}
        starts, front, ends = list(level), list(level), False
        while front and not ends:
            after = []
            for i in front:
                for j, w in room[i].items():
                    if w > least and j not in level:
                        level[j] = level[i] + 1
                        ends = ends or excess[j] < -least
                        after.append(j)
            front = after
        if not ends:
            return [bool(side[i]) if side[i] is not None else i in level for i in range(n)]
        arcs, tried = {i: list(room[i]) for i in level}, dict.fromkeys(level, 0)
        for start in starts:
            path = [start]
            while path and excess[start] > least:
                here = path[-1]
                if excess[here] < -least:
                    steps = list(zip(path, path[1:], strict=False))
                    flow = min(excess[start], -excess[here], *(room[a][b] for a, b in steps))
                    excess[start] -= flow
                    excess[here] += flow
                    for a, b in steps:
                        room[a][b] -= flow
                        room[b][a] += flow
                    full = next((k for k, (a, b) in enumerate(steps) if room[a][b] <= least), len(steps))
                    del path[full + 1 :]
                    if full < len(steps) or excess[here] < -least:
                        continue
                while tried[here] < len(arcs[here]):
                    j = arcs[here][tried[here]]
                    if level.get(j) == level[here] + 1 and room[here][j] > least:
                        path.append(j)
                        break
                    tried[here] += 1
                else:  # nothing leads on from here: not tried again before the next levels
                    path.pop()
                    if path:
                        tried[path[-1]] += 1


def main_blocks(page: str | None) -> list[str]:
    found = blocks_of(page or "")
    if not found:
        return []
    kept = _kept(found, wrappers(found))
    return kept or _kept(found, wrappers(found, parts=True))


def _kept(found: list[_Block], lifted: set[_Element]) -> list[str]:
    good, bad = zip(*(costs(b, lifted) for b in found), strict=True)
    edges, last = [], {}
    for i, block in enumerate(found):
        if i:
            edges.append((i - 1, i, NEAR / (1 + distance(found[i - 1].element, block.element))))
        over = id(block.element.parent)
        if over in last and last[over] < i - 1:
            edges.append((last[over], i, NEAR / 3))
        last[over] = i
    keep = source_side(list(good), list(bad), edges)
    return [b.text for b, k in zip(found, keep, strict=True) if k]


@F.pandas_udf(T.StringType())
def main_text(page: pd.Series) -> pd.Series:
    return pd.Series(["\n\n".join(main_blocks(p)) for p in page], dtype=object)


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """The rows with the main text of their page in column `into`."""
    return pages.withColumn(into, main_text(F.col(column)))
