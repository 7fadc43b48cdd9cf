"""Main text of web pages by a minimum cut.

A page is read into blocks: runs of text between block-level tags, with the open
elements around them.  A linear classifier gives each block its log odds of being
content: evidence of its own text (length, marks, share of links), bounded by
``TEXT``, and of the elements around it (their tags, names and roles).  The odds
become the capacities to the two terminals.  Neighbouring blocks are joined by
smoothness edges, stronger the more of the element tree they share, and so is each
block to the one before it that has the same parent.  Edges between siblings are
about as strong as what text alone can say, so a paragraph that is all link stays
with the paragraphs around it, and a sentence in a list of links goes with the
links; named elements (a menu, an advert) are borders that smoothness hardly crosses.
The maximum flow separates content from boilerplate with the least total cost.

What a name says is read token by token of class and id.  A token that says what a
page has or lacks (``with-sidebar``, ``no-comments``) or in which state it is
(``comment-open``) says nothing of the text inside; nor do ``html`` and ``body``, nor
the heading of an article (``entry-header``).  An element around the page's core (an
article, a main or a content element with half of the page's text or more) is no
boilerplate, whatever its name.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by a line end in page order.  Null and empty pages
give an empty text.  Reading takes time in proportion to the page, for deep,
unclosed and malformed markup too: an element keeps what its ancestors say, open
elements are found by name, and the flow works on bounded integers.  Rows with a null
page_id, ties and repeated rows are each treated alone.  Extra columns are left out.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
BLOCK = frozenset(["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "select", "head"])  # scripts, styles, form fields, what is not shown
ENDLESS = frozenset(["script", "style", "textarea", "title", "xmp"])  # of RAW: without a closing tag, these reach to the end of the page
HEADING = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
PLAIN = frozenset(["p", "pre", "blockquote", "li", "dd", "dt", "td", "figcaption"])
CLOSES_P = BLOCK - frozenset(["html", "body"])
ENDS = {"li": ["li"], "dt": ["dd", "dt"], "dd": ["dd", "dt"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"]}

# Capacities of the classifier; integers, so that the flow is exact.
TEXT = 45  # the most that text alone says, either way
SMOOTH = (40, 36, 32, 16, 9, 6, 4)  # by the elements to climb from one block to the other
SIBLING, BORDER = 16, 1
TAG_COST = {"nav": -90, "footer": -90, "aside": -70, "form": -80, "menu": -80, "dialog": -80, "button": -80, "fieldset": -60, "label": -60, "header": -50, "article": 60, "main": 45}
NAME_COST = [
    (-75, ["nav", "navbar", "navigation", "menu", "submenu", "breadcrumb", "breadcrumbs", "footer", "foot", "sidebar", "aside", "rail", "toolbar", "pagination", "pager"]),
    (-75, ["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "outbrain", "taboola"]),
    (-75, ["cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "toast", "newsletter", "subscribe", "subscription", "signup", "login", "paywall"]),
    (-75, ["comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion"]),
    (-65, ["share", "sharing", "social", "related", "recommended", "recommendations", "widget", "tags", "byline", "search", "skip", "copyright", "legal", "masthead", "header", "topbar"]),
    (25, ["article", "articlebody", "content", "main", "post", "entry", "story", "text", "body", "hentry", "maincontent"]),
]
NAMES = {w: c for c, words in NAME_COST for w in words}
ROLES = {"navigation": -90, "banner": -60, "contentinfo": -90, "complementary": -70, "search": -80, "form": -80, "dialog": -80, "alert": -70, "main": 45, "article": 60}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
LAST = re.compile(r"<!--.*|<!\[CDATA\[.*|<[!?].*", re.S)  # what can begin after the last >
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
LACKS = frozenset(["no", "not", "has", "with", "without", "hide", "is"])
STATES = frozenset(["open", "opened", "closed", "enabled", "disabled", "active", "inactive", "on", "off", "visible", "collapsed", "expanded", "left", "right"])
NAME = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


def token_cost(token: str) -> int:
    """What one name of an element says about the text inside it."""
    words = [w.lower() for w in NAME.findall(token)]
    for i, w in enumerate(words):
        if w in LACKS:
            words = words[:i]
            break
    if len(words) > 1 and words[-1] in STATES:
        return 0
    found = {NAMES[w] for w in words if w in NAMES}
    if "header" in words and max(found, default=0) > 0:  # the heading of an article
        return 0
    return min(found, default=0) if min(found, default=0) < 0 else max(found, default=0)


def name_cost(tag: str, attributes: str) -> int:
    """What an element says about the text inside it."""
    cost = TAG_COST.get(tag, 0)
    if not attributes or tag in ("html", "body") or "=" not in attributes and "hidden" not in attributes.lower():
        return cost
    seen = set()
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in seen:  # the first of an attribute counts
            continue
        seen.add(key)
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            cost -= 90
        elif key == "role":
            cost += ROLES.get(value.lower(), 0)
        elif key in ("class", "id"):
            found = [token_cost(t) for t in value.split()]
            low, high = min(found, default=0), max(found, default=0)
            cost += low if low < 0 else high
    return cost


class Element:
    """An element, with what it and its ancestors say."""

    __slots__ = ("best", "block", "cost", "depth", "holds", "inside", "parent", "size", "tag", "worst")

    def __init__(self, tag: str, parent: Element | None, cost: int):
        self.tag, self.parent, self.cost, self.size, self.holds = tag, parent, cost, 0, False
        self.depth = parent.depth + 1 if parent else 0
        self.worst, self.best, self.inside = 0, 0, False
        self.block = self if parent is None or tag in BLOCK else parent.block

    def inherit(self) -> None:
        """Adds up what the ancestors say; parents come first."""
        if self.holds:
            self.cost = max(self.cost, 0)
        if self.parent:
            self.worst, self.best, self.inside = self.parent.worst, self.parent.best, self.parent.inside
        # a heading group at the head of an article is the article's own
        if self.cost < 0 and not (self.tag == "header" and self.cost == TAG_COST["header"] and self.inside):
            self.worst = min(self.worst, self.cost)
        self.best = max(self.best, self.cost)
        self.inside = self.inside or self.tag in ("article", "main")


def weigh(elements: list[Element]) -> None:
    """What elements say, given where the page's text is; ``elements`` in page order, own text in ``size``."""
    for e in reversed(elements):
        if e.parent:
            e.parent.size += e.size
    for e in elements:
        if (e.cost > 0 or e.tag in ("article", "main")) and e.size and 2 * e.size >= elements[0].size:
            at: Element | None = e
            while at and not at.holds:
                at.holds = True
                at = at.parent
    for e in elements:
        e.inherit()


class Block:
    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


class Stack:
    """The open elements, found by name."""

    def __init__(self) -> None:
        self.open = [Element("html", None, 0)]
        self.all = [*self.open]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]  # places of the block-level ones

    def push(self, tag: str, cost: int) -> None:
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(Element(tag, self.open[-1], cost))
        self.all.append(self.open[-1])

    def cut(self, place: int) -> None:
        """Closes the elements from ``place`` on."""
        while len(self.open) > place:
            self.at[self.open.pop().tag].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def last(self, tags: Iterable[str]) -> int:
        """The place of the last open element of these tags, or 0."""
        return max((places[-1] for places in map(self.at.get, tags) if places), default=0)


def blocks_of(html: str) -> list[Block]:
    """The blocks of a page in order."""
    stack = Stack()
    blocks: list[Block] = []
    parts: list[str] = []
    unclosed: set[str] = set()
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(stack.open[-1].block, text, linked))
                blocks[-1].element.size += len(text)
            parts.clear()
            linked = 0

    at, n, tags_end = 0, len(html), html.rfind(">")
    while at < n:
        m = (TOKEN if at <= tags_end else LAST).search(html, at)
        end = m.start() if m else n
        if end > at:
            parts.append(html[at:end])
            if stack.at.get("a"):
                linked += end - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if m.re is TOKEN else ""
        if not tag:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if closing:
            place = stack.last([tag])
            if tag in BLOCK:
                flush()
            if place and (tag in BLOCK or stack.blocks[-1] < place):  # a block ends an inline element, not the other way about
                stack.cut(place)
            continue
        if tag in RAW and not attributes.rstrip().endswith("/"):
            close = None
            if tag not in unclosed:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>" + (r"|(?=<body\b)" if tag == "head" else ""), re.I).search(html, at)
            if close:
                at = close.end()
            else:
                unclosed.add(tag)
                at = n if tag in ENDLESS else at
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:  # an open paragraph ends here, and an item where the next begins
                stops = ("ul", "ol", "dl", "table") if tag in ENDS else ("div", "section", "article", "li", "td", "th", "blockquote")
                place = stack.last([*ENDS.get(tag, ()), "p"])
                if place > stack.last(stops):
                    stack.cut(place)
        if tag in VOID or attributes.rstrip().endswith("/"):
            continue
        stack.push(tag, name_cost(tag, attributes))
    flush()
    weigh(stack.all)
    return blocks


def score(block: Block) -> int:
    """Log odds: above 0 content is likelier, below boilerplate."""
    e, n = block.element, len(block.text)
    density = min(1.0, block.linked / n)
    marks = sum(map(block.text.count, ".,;:!?"))
    value = min(TEXT - 5, n // 8) + min(20, 2 * marks) + 2
    if e.tag in HEADING:
        value = max(value, 6)
    if e.tag in PLAIN:
        value += 8
    value -= round(90 * density) if not e.inside or n > 40 and density > 0.6 else round(20 * density)
    value = max(-TEXT, min(TEXT, value))
    return e.worst * 2 + min(value, 0) if e.worst else value + e.best


def closeness(a: Element, b: Element) -> int:
    """Smoothness of two neighbours: by the elements to climb to the one that holds both.

    An element on the way that says what it is (a menu, an advert) is a border.
    """
    climbs = 0
    while a is not b:
        low = a if a.depth >= b.depth else b
        climbs += 1
        if climbs >= len(SMOOTH) or low.cost:
            return BORDER
        if low is a:
            a = a.parent or a
        else:
            b = b.parent or b
    return SMOOTH[climbs]


def min_cut(sources: list[int], sinks: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node stays with the source, in the cut of least capacity.

    Blocking flows over level graphs; edges have the same capacity both ways.
    """
    n = len(sources)
    s, t = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def link(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        both = min(sources[i], sinks[i])  # this much always flows
        if sources[i] > both:
            link(s, i, sources[i] - both, 0)
        if sinks[i] > both:
            link(i, t, sinks[i] - both, 0)
    for a, b, c in edges:
        link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for k in head[a]:
                if room[k] and level[to[k]] < 0:
                    level[to[k]] = level[a] + 1
                    queue.append(to[k])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                least = min(room[k] for k in path)
                keep = len(path)
                for j, k in enumerate(path):
                    room[k] -= least
                    room[k ^ 1] += least
                    if not room[k]:
                        keep = min(keep, j)
                del path[keep:]
                a = to[path[-1]] if path else s
                continue
            while at[a] < len(head[a]):
                k = head[a][at[a]]
                if room[k] and level[to[k]] == level[a] + 1:
                    break
                at[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                path.pop()
                a = to[path[-1]] if path else s
                continue
            path.append(k)
            a = to[k]


def main_blocks(html: str | None) -> list[str]:
    """The texts of the blocks that the cut leaves with the content."""
    blocks = blocks_of(html or "")
    scores = [score(b) for b in blocks]
    edges = [(i, i + 1, closeness(blocks[i].element, blocks[i + 1].element)) for i in range(len(blocks) - 1)]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        parent = id(b.element.parent)
        if parent in last and last[parent] != i - 1 and not b.element.cost:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    stays = min_cut([max(0, s) for s in scores], [max(0, -s) for s in scores], edges)
    return [b.text for b, keep in zip(blocks, stays, strict=True) if keep]


def main_text(html: str | None) -> str:
    return "\n".join(main_blocks(html))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = dict(src.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long").withColumnRenamed("page_id", id_col)
