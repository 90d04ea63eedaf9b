"""Main text of web pages by minimum cut.

A page is cut into blocks: runs of text between block-level tags, in page order. What is labelled,
content or boilerplate, are the blocks and the elements around them that say anything by tag, class, id,
role or label. A linear classifier gives each block a cost for either label from its own text
alone: words, share of link text, its own tag. An element's costs come from its tag and names, for
each block in it; what a name such as "sidebar" costs is finite, and much text with few links in it, also in
proportion to the rest of the page, outweighs it; names never speak against headings, nor against
articles but those named as a comment. These costs are the capacities of edges from the source and to the sink.

Smoothness edges hold what is near together: a block and the nearest such element around it, less the deeper
the block lies in it; an element and the next around it, for each block; blocks that follow each other, less the
farther apart they are in the tree; and blocks next to each other in one container. So a line
too short to tell is content in an article or between paragraphs, and long text in a sidebar is not. A
maximum flow finds the labelling of least cost; blocks on the source's side are content.

Text in head, script, style, comments and the like is no block, nor is what inline elements that are hidden or named
as adverts hold. Character references are decoded, white space inside a block becomes one space, blocks
are trimmed and joined by a newline. A null, empty or contentless page has an empty text. Repeated rows
stay; an empty table gives no rows; columns other than page_id, url and html are left out.
"""

from __future__ import annotations

import heapq
import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
_TELLING = frozenset("class id role itemprop aria-label hidden aria-hidden style".split())
_WORDS = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title iframe noembed noframes xmp svg math object canvas audio video select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What a tag says about the text in it: above 0, content.
TAGS = {"article": 3.0, "main": 2.5, "nav": -9.0, "menu": -7.0, "header": -6.0, "footer": -9.0, "aside": -9.0, "button": -9.0, "dialog": -9.0, "fieldset": -9.0, "label": -2.0, "address": -1.0}
#: What its own tag adds to a block's text.
OWN = {"p": 0.5, "blockquote": 0.3, "pre": 0.5, "h1": 0.4, "h2": 0.3, "h3": 0.3, "h4": 0.2, "figcaption": 0.2}
#: And a word of a class, id or role: what names boilerplate on most pages, and what also names a subject.
SURE, LOOSE, ANCHOR = -12.0, -6.0, -4.0
NAMES = {
    **dict.fromkeys("nav navbar menu breadcrumb breadcrumbs footer sidebar sidenav advert adverts advertisement ad ads adsbygoogle sponsored cookie gdpr popup modal overlay newsletter signup login comment comments commentlist disqus widget toolbar masthead pagination pager complementary contentinfo topbar paywall".split(), SURE),
    **dict.fromkeys("navigation aside advertising sponsor promo promotion banner cookies consent notice notices alert subscribe subscription form search reply replies respond discussion related recommended share sharing social copyright dialog toc tags skip".split(), LOOSE),
    **dict.fromkeys("header meta byline author tag hidden teaser more".split(), -2.5),
    **dict.fromkeys("article articlebody post entry story main content body text page blog mainarticle".split(), 1.5),
}
#: Tags that names can't make boilerplate, and words before a subject's own, as in "category-search".
_NEVER = frozenset("article main h1 h2 h3 h4 h5 h6".split())
_SUBJECT = frozenset("category cat tag topic term keyword".split())
#: A header or the like inside an article may hold its headline.
_SOFT_IN_ARTICLE = frozenset(["header"])
#: Words that make a name tell of a layout, such as "has-sidebar", rather than of what is in it.
_LAYOUT = frozenset("has no with without layout wrap wrapper columns open closed".split())
#: What names an article as a reader's, and an inline element as no text of the page.
_READERS = frozenset("comment comments reply replies respond".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsored sponsor promo".split())
BIAS, MOST, SMOOTH_NEXT, SMOOTH_NEAR = -0.2, 2.4, 0.7, 0.5
#: How many units of a tag's or name's score are one of a block's cost.
UNIT = 2.4
#: Smoothness of a block and its element; of an element and the next around it, for each block: firm, loose, across kinds.
HOLD, FIRM, LOOSELY, ACROSS = 3.0, 6.0, 1.0, 0.3


class _Node:
    """An element. up is the nearest one around it that says anything, itself included; firm, that a tag or being hidden settles it."""

    __slots__ = ("tag", "parent", "depth", "own", "name", "article", "firm", "up", "open_p", "items")

    def __init__(self, tag, parent, own=0.0, name=0.0):
        self.tag, self.parent, self.own, self.name = tag, parent, own, name
        self.depth = parent.depth + 1 if parent else 0
        self.article = (parent.article if parent else False) or tag in ("article", "main")
        self.firm = own <= -5 or (parent.firm if parent else False)
        self.up = self if own or name else parent.up if parent else None
        # Open paragraphs and items that a tag in this element can end.
        inside = parent is not None and tag not in _SCOPES
        self.open_p = self if tag == "p" else parent.open_p if inside else None
        self.items = parent.items if inside else {}
        if tag in _ENDS_OWN:
            self.items = {**self.items, tag: self}


def _told(name: str, words: list[str]) -> list[float]:
    """What each word of a token of this attribute says."""
    told = [NAMES.get(w, 0.0) for w in words]
    if name == "role":
        return [SURE if x <= ANCHOR else x for x in told]
    if len(words) > 1 and words[0] in _SUBJECT:
        return [max(0.0, x) for x in told]
    if name == "id":  # often the slug of a heading
        unknown = sum(w.isalpha() and w not in NAMES for w in words)
        slug = unknown > 1 and unknown > sum(w in NAMES for w in words)
        return [max(x, ANCHOR) if slug or x >= LOOSE else x for x in told]
    return told


def _attributes(raw: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw) if m[1].lower() in _TELLING]


def _hidden(name: str, value: str) -> bool:
    return name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()


def _no_text(raw: str) -> bool:
    """Whether an inline element is hidden, or an advert by name."""
    for name, value in _attributes(raw):
        if _hidden(name, value) or name in ("class", "id") and any(_ADVERTS.intersection(_WORDS.findall(_CAMEL.sub(r"\1 \2", t).lower())[:1]) for t in value.split()):
            return True
    return False


def _says(tag: str, raw: str, parent) -> tuple[float, float]:
    """What an element's tag and mild names say, and the cost of its worst name."""
    own, cost = TAGS.get(tag, 0.0), 0.0
    if tag == "form":  # which may be wrapped around a whole page
        cost = LOOSE
    if tag in _SOFT_IN_ARTICLE and parent.article:
        own = -0.5
    if raw and tag not in ("html", "body"):
        worst = best = 0.0
        for name, value in _attributes(raw):
            if _hidden(name, value):
                return -9.0, 0.0
            if name in ("style", "aria-hidden"):
                continue
            for token in value.split():
                words = _WORDS.findall(_CAMEL.sub(r"\1 \2", token).lower())
                if not _LAYOUT.intersection(words):
                    told = _told(name, words)
                    worst, best = min([worst, *told]), max([best, *told])
                    if tag == "article" and name == "class" and _READERS.intersection(words[:1]):
                        cost = SURE
        if tag in _NEVER:
            own += best
        elif worst <= ANCHOR:
            cost = min(cost, worst)
        else:  # A container named for its content, such as "post-content", is not undone by a mild word beside it.
            own += worst + best
    return own, cost


#: Tags that end an open paragraph; items end open items alike.
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS_OWN = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_SCOPES = frozenset("ul ol table article aside div section nav footer header main form body html".split())


def blocks_of(page: str) -> list[tuple[str, float, int, int, _Node]]:
    """(text, share of link text, characters, words, node) of each block, in page order."""
    root = node = _Node("html", None, 0.0)
    out: list = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    at = 0
    skipped, nested = "", 0  # an inline element without text, and how many of its name are open
    opened: Counter = Counter()

    def close():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((text, min(1.0, linked / len(text)), len(text), text.count(" ") + 1, node))
        linked = 0

    end = len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not skipped:
            piece = page[at:stop]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if skipped:
            if tag in INLINE:
                nested += (1 if not m[1] else -1) * (tag == skipped)
                if not nested:
                    skipped = ""
                continue
            skipped = ""
        if not m[1]:
            if tag in INLINE and tag not in VOID and m[3] and not m[3].endswith("/") and _no_text(m[3]):
                skipped, nested = tag, 1
                continue
            if tag in RAW:
                shut = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
                if tag not in ("svg", "math") or shut:
                    at = shut.end() if shut else end
                if tag not in INLINE and tag not in ("svg", "math"):
                    close()
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link += 1
                elif tag == "br":
                    parts.append(" ")
                continue
            close()
            if tag in VOID:
                continue
            ended = node.open_p if tag in _ENDS_P else None
            for other in _ENDS_OWN.get(tag, "").split():
                item = node.items.get(other)
                if item is not None and (ended is None or item.depth > ended.depth):
                    ended = item
            while ended is not None and node is not ended.parent:
                opened[node.tag] -= 1
                node = node.parent
            in_link = 0
            node = _Node(tag, node, *_says(tag, m[3], node))
            opened[tag] += 1
        elif tag in INLINE:
            if tag == "a" and in_link:
                in_link -= 1
        else:
            close()
            in_link = 0
            if opened[tag] > 0:
                while node.tag != tag:
                    opened[node.tag] -= 1
                    node = node.parent
                opened[tag] -= 1
                node = node.parent
    close()
    return out


def elements_of(blocks) -> dict[_Node, tuple[int, float]]:
    """The elements that say anything around the blocks, innermost first: how many blocks each has, and what it says for one."""
    held: dict[_Node, list[float]] = {}
    total = 0.0
    for _, share, _, words, node in blocks:
        plain = words * (1 - share)
        total += plain * (not node.firm)
        if node.up is not None:
            own = held.setdefault(node.up, [0, 0.0, 0, 0.0])
            own[0] += 1
            own[1] += plain
            own[2] += words
            own[3] += plain * (not node.firm)
    out, waiting = {}, [(-e.depth, i, e) for i, e in enumerate(held)]
    heapq.heapify(waiting)
    while waiting:
        e = heapq.heappop(waiting)[2]
        n, plain, words, counted = held[e]
        cost = 0.0
        if e.name:
            mostly = max(0.0, 2 * plain / words - 1)
            speaks = math.log2(1 + counted / 60) + max(0.0, math.log2((counted + 1e-9) / (total - counted + 20)))
            cost = min(0.0, e.name + mostly * speaks)
        out[e] = n, (max(-9.0, min(4.0, e.own)) + cost) / UNIT
        around = e.parent.up if e.parent else None
        if around is not None:
            if around not in held:
                held[around] = [0, 0.0, 0, 0.0]
                heapq.heappush(waiting, (-around.depth, len(held), around))
            held[around] = [x + y for x, y in zip(held[around], held[e])]
    return out


def logit(share: float, chars: int, words: int, node: _Node) -> float:
    """How much likelier a block is content than boilerplate by its own text, as a logarithm of odds."""
    score = BIAS + min(1.6, 0.35 * math.log1p(words)) + OWN.get(node.tag, 0.0) - 2.5 * share * (share > 0.3) - 0.6 * (words < 4)
    return max(-MOST, min(MOST, score))


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source's side of a minimum cut; edges hold in both directions.

    Flow that passes straight through a node is taken first; what is left goes along shortest
    paths in a level graph until none leads to the sink.
    """
    n = len(source)
    spare = [s - t for s, t in zip(source, sink)]
    around: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        around[a].append(len(to))
        to.append(b)
        room.append(c)
        around[b].append(len(to))
        to.append(a)
        room.append(c)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if spare[i] > 1e-12)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            if spare[i] < -1e-12:
                reached = True
                continue
            for e in around[i]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        used = [0] * n
        for start in range(n):
            while spare[start] > 1e-12:
                path, i = [], start
                while not (spare[i] < -1e-12):
                    while used[i] < len(around[i]):
                        e = around[i][used[i]]
                        if room[e] > 1e-12 and level[to[e]] == level[i] + 1:
                            break
                        used[i] += 1
                    if used[i] < len(around[i]):
                        path.append(around[i][used[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        used[i] += 1
                    else:
                        break
                if not path:
                    break
                push = min(spare[start], -spare[i], min(room[e] for e in path))
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                spare[start] -= push
                spare[i] += push


def _apart(a: _Node, b: _Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def labels_of(page: str | None) -> tuple[list, list[float], list[bool]]:
    """A page's blocks, the classifier's odds of each, and whether the cut calls it content."""
    blocks = blocks_of(page or "")
    odds = [logit(*b[1:]) for b in blocks]
    elements = elements_of(blocks)
    at = {e: len(blocks) + i for i, e in enumerate(elements)}
    weights = odds + [n * says for n, says in elements.values()]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        node = b[4]
        if node.up is not None:
            edges.append((i, at[node.up], FIRM if node.firm else HOLD / (1 + 0.1 * math.log2(1 + node.depth - node.up.depth))))
        if i:
            edges.append((i - 1, i, SMOOTH_NEXT / (1 + _apart(blocks[i - 1][4], node))))
        box = node.parent or node
        if box in last and last[box] != i - 1:
            edges.append((last[box], i, SMOOTH_NEAR))
        last[box] = i
    for e, (n, says) in elements.items():
        around = e.parent.up if e.parent else None
        if around is not None:
            against = elements[around][1]
            if against <= -0.8:  # an article may stand in a container by its name alone
                hold = LOOSELY if e.tag in ("article", "main") and not e.name and not around.firm else FIRM
            elif (says < 0) == (against < 0) or around.article and SURE < e.name < 0:
                hold = LOOSELY
            else:
                hold = ACROSS
            edges.append((at[e], at[around], hold * n))
    content = minimum_cut([max(0.0, x) for x in weights], [max(0.0, -x) for x in weights], edges)
    return blocks, odds, content[: len(blocks)]


def main_text(page: str | None) -> str:
    blocks, _, content = labels_of(page)
    return "\n".join(b[0] for b, keep in zip(blocks, content) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
