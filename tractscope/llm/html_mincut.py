"""Main-text extraction from HTML by minimum-cut labelling.

1. The page is cut into tags, text and raw elements by one regular expression;
   open elements are tracked with the implied ends of HTML (a ``p`` ends at the
   next block, list items end each other, a missing end closes with its parent).
   Text between two block boundaries is one block, with its chain of ancestors.
2. A classifier scores every block as log odds of content: evidence of its
   ancestors (element names, words of class, id and role), link share, length
   and sentence marks.  The positive or negative part becomes the capacity
   towards source or sink.  Names on ``html`` and ``body`` say nothing, nor
   does the penalty of a page-wide wrapper: an element that holds nearly all
   text, with no content of any length outside.
3. Smoothness edges: neighbours in page order, the stronger the fewer elements
   part them in the tree, and blocks of one parent with the next of that parent.
   Capacities are integers.
4. Maximum flow (shortest augmenting paths, level by level) gives the minimum
   cut; blocks left reachable from the source are content.

Blocks inside scripts, styles, heads, forms and other raw or invisible elements
are never text.  No length cap; whole pages.

Defined cases: a null, empty or text-free page gives "" and 0; a page without
any markup is one block of content; unclosed or truncated markup is closed at
the end, an unclosed raw or boilerplate inline element at the next block
boundary (script, style, textarea and title at the end); formulas (``math``)
are text; an unfinished tag is dropped; repeated rows give repeated results;
other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .common import map_rows

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript textarea title svg iframe object canvas select button option datalist "
                "annotation annotation-xml".split())
TO_THE_END = frozenset("script style textarea title".split())  # unclosed, these hold the rest of the page
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "title"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
            "option": {"option"}}
SCOPES = frozenset("ul ol dl table html body article section div aside nav header footer main td th".split())

# Classifier: log odds per piece of evidence (integers; a unit is 1/10).
ELEMENT = {"article": 60, "main": 60, "nav": -90, "footer": -90, "aside": -80, "form": -90, "header": -40, "menu": -80,
           "dialog": -80, "address": -30, "figcaption": -10, "blockquote": 15, "p": 10, "pre": 15, "h1": 5, "h2": 5, "h3": 5,
           "li": -10, "label": -40, "fieldset": -60, "legend": -40, "summary": -10, "noscript": -90}
HINTS = (
    (re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|popup|modal|newsletter|subscri\w*|cookies?|consent|gdpr|notice|alert"
                r"|comments?|comment-?list|disqus|respond|reply|replies|discussion|sidebar|side-?bar|widget|related|recommend\w*|share|sharing|social"
                r"|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|foot|copyright|login|signup|search|toolbar|skip|tags?|meta|byline"
                r"|complementary|contentinfo|disclaimer|overlay|teaser)(?:$|[\s_-])"), -90),
    (re.compile(r"(?:^|[\s_-])(?:article|content|entry|post|story|main|body|text|maincontent)(?:$|[\s_-])"), 40),
    (re.compile(r"(?:^|[\s_-])(?:header|masthead|head|top|site-?header)(?:$|[\s_-])"), -50),
)
PRIOR, LINKED, SENTENCE, LONG, SHORT = -5, -60, 10, 20, -5
PAGE_WIDE, OUTSIDE = 0.9, 120            # share of the text in a wrapper, and content (characters) outside that makes it none
OWN_KIND = frozenset("nav footer menu".split())  # never a wrapper by name
NEAR, APART, SAME_PARENT = 12, 3, 8     # smoothness capacities
FIRM = 4                                # weight of evidence against smoothness

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S)
_TOKEN_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)", re.S)
_BOUNDARY = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS, key=len, reverse=True))})(?=[\s/>])", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)[^>]*>")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$|/)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_UNFINISHED = re.compile(r"<(?:[A-Za-z/!?][^>]*)?\Z", re.S)
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")


@dataclass
class Element:
    name: str
    parent: "Element | None"
    depth: int
    own: int          # evidence of its name
    hint: int         # and of its class, id and role
    hidden: bool
    evidence: int = 0  # with its ancestors'


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _evidence(name: str, attrs: str, parent: Element) -> tuple[int, int, bool]:
    """What an element says of the text in it, by its name and by its class, id
    and role, and whether it is hidden."""
    own, hint = ELEMENT.get(name, 0), 0
    if attrs:
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)).lower()
        if names and name not in ("html", "body"):
            hint = next((s for p, s in HINTS if p.search(names)), 0)
        if "hidden" in attrs or "none" in attrs:
            return own, hint, parent.hidden or bool(_HIDDEN.search(attrs))
    return own, hint, parent.hidden


def _weigh(elements: list[Element], blocks: list[Block]) -> None:
    """Sum the evidence over ancestors, without the penalties of page-wide wrappers.

    ``elements``: parents before their children."""
    def total() -> None:
        for e in elements:
            e.evidence = (e.parent.evidence if e.parent else 0) + e.own + e.hint

    def within(weights: list[int]) -> dict[int, int]:
        held = dict.fromkeys(map(id, elements), 0)
        for b, w in zip(blocks, weights):
            held[id(b.element)] += w
        for e in reversed(elements):
            if e.parent:
                held[id(e.parent)] += held[id(e)]
        return held

    total()
    if not any(e.own < 0 or e.hint < 0 for e in elements):
        return
    chars = [len(b.text) for b in blocks]
    held, content = within(chars), within([n if log_odds(b) > 0 else 0 for n, b in zip(chars, blocks)])
    root = id(elements[0])
    for e in elements[1:]:
        if held[id(e)] >= PAGE_WIDE * held[root] and content[root] - content[id(e)] < OUTSIDE:
            e.hint = max(e.hint, 0)
            if e.name not in OWN_KIND:
                e.own = max(e.own, 0)
    total()


def _ends(page: str, end: int) -> dict[int, tuple[int, int]]:
    """Where each element that has its own end tag begins -> its end tag's place, in one pass over the page."""
    found: dict[int, tuple[int, int]] = {}
    opened: dict[str, list[int]] = {}
    for m in _TAG.finditer(page, 0, end):
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                found[opened[name].pop()] = m.span()
        elif not m[0].endswith("/>"):
            opened.setdefault(name, []).append(m.start())
    return found


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, each with its element."""
    root = Element("#root", None, 0, 0, 0, False)
    elements = [root]
    at, link, block = root, 0, None
    out: list[Block] = []

    def add(raw: str) -> None:
        nonlocal block
        if not raw or at.hidden or at.name == "head":
            return
        if block is None:
            if raw.isspace():
                return
            block = Block(at)
            out.append(block)
        text = html.unescape(raw) if "&" in raw else raw
        block.parts.append(text)
        if link:
            block.linked += len(text)

    # the open elements of each name, so that an end tag without one costs nothing however deep the page is
    opened: dict[str, list[Element]] = {}

    def enter(e: Element) -> None:
        nonlocal at
        at = e
        opened.setdefault(e.name, []).append(e)

    def leave() -> None:
        nonlocal at
        opened[at.name].pop()
        at = at.parent or root

    def nearest(names: frozenset[str] | set[str]) -> Element | None:
        return max((opened[n][-1] for n in names if opened.get(n)), key=lambda e: e.depth, default=None)

    def close_to(names: frozenset[str] | set[str], stop: frozenset[str] | set[str]) -> bool:
        """Close the nearest open element of ``names``, unless one of ``stop`` is nearer."""
        nonlocal block
        target = nearest(names)
        if target is None:
            return False
        barrier = nearest(stop - names)
        if barrier is not None and barrier.depth > target.depth:
            return False
        while at is not target:
            leave()
        leave()
        block = None
        return True

    known: dict[int, tuple[int, int]] | None = None

    def closing(name: str, lt: int) -> tuple[int, int]:
        """(end of what is in it, where the page goes on) of the raw or inline element that begins at ``lt``."""
        nonlocal known
        if name in TO_THE_END:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, pos, end)
            return close.span() if close else (end, end)
        if known is None:
            known = _ends(page, min(end, last_gt + 1))
        if lt in known:
            return known[lt]
        edge = _BOUNDARY.search(page, pos, end)
        return (edge.start(), edge.start()) if edge else (end, end)

    pos, end = 0, len(page)
    last_gt = page.rfind(">")  # no tag that begins later is finished
    tail = _UNFINISHED.search(page, max(page.rfind("<"), 0)) if "<" in page else None
    if tail and page[tail.start():tail.start() + 4] != "<!--" and tail.end() - tail.start() > 1:
        end = tail.start()
    # an unpaired quote inside a tag would swallow the page: such pages use the loose form
    token = _TOKEN
    while pos < end:
        lt = page.find("<", pos, end)
        if lt < 0:
            add(page[pos:end])
            break
        m = token.match(page, lt, end) if lt < last_gt or page[lt + 1:lt + 2] in ("!", "?") else None
        if m is None and lt < last_gt:
            m = _TOKEN_LOOSE.match(page, lt, end)
        if m is None:  # a bare "<" is text
            add(page[pos:lt + 1])
            pos = lt + 1
            continue
        add(page[pos:lt])
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                link = max(0, link - 1)
            elif name in BLOCKS:
                close_to({name}, set())
                block = None
            continue
        if name == "a":
            link = min(link + 1, 1)
            continue
        if name in RAW and not m[3].endswith("/"):
            pos = closing(name, lt)[1]
            if name == "title":
                block = None
            continue
        if name not in BLOCKS:
            if name == "br":
                add(" ")
            elif name not in VOID and (score := _evidence(name, m[3], at)) and (score[0] + score[1] <= -50 or score[2] and not at.hidden):
                # an inline element that hides or marks boilerplate: its own block
                inner_end, after = closing(name, lt)
                inner, pos = page[pos:inner_end], after
                if not score[2]:
                    keep, at = at, Element(name, at, at.depth + 1, *score)
                    elements.append(at)
                    block = None
                    add(re.sub(r"<[^>]*>", " ", inner))
                    at, block = keep, None
            continue
        if name in ENDS_P:
            close_to({"p"}, SCOPES | {"button"})
        if name in SIBLINGS:
            close_to(SIBLINGS[name], {"ul", "ol", "dl", "table"})
        block = None
        if name in VOID:
            continue
        if name == "body" or name not in ("head", "html"):
            if at.name == "head":
                leave()
        enter(Element(name, at, at.depth + 1, *_evidence(name, m[3], at)))
        elements.append(at)
    for b in out:
        b.text = " ".join("".join(b.parts).split())
    out = [b for b in out if b.text]
    _weigh(elements, out)
    return out


def log_odds(block: Block) -> int:
    """The classifier: evidence for (positive) or against content."""
    n = len(block.text)
    score = PRIOR + block.element.evidence + LINKED * min(block.linked, n) // n
    if _SENTENCE.search(block.text):
        score += SENTENCE
    return score + (LONG if n >= 120 else SHORT if n < 25 else 0)


def _tree_distance(a: Element, b: Element) -> int:
    d = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        d += 1
    return d


def maximum_flow(n: int, source: int, sink: int, arcs: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which nodes the source still reaches after a maximum flow.

    ``arcs``: (from, to, capacity, capacity back).  Levels by breadth-first
    search, augmenting along level-increasing arcs without recursion."""
    head: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, there, back in arcs:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in head[v]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        nxt = [0] * n
        path: list[int] = []
        v = source
        while True:
            if v == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                k = next(i for i, e in enumerate(path) if not room[e])
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            own = head[v]
            while nxt[v] < len(own) and not (room[own[nxt[v]]] and level[to[own[nxt[v]]]] == level[v] + 1):
                nxt[v] += 1
            if nxt[v] < len(own):
                path.append(own[nxt[v]])
                v = to[own[nxt[v]]]
            elif path:
                e = path.pop()
                v = to[e ^ 1]
                nxt[v] += 1
            else:
                break


def content_blocks(blocks: list[Block]) -> list[Block]:
    """The blocks on the content side of the minimum cut."""
    if len(blocks) == 1 and blocks[0].element.parent is None:
        return blocks
    n = len(blocks)
    arcs = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        odds = log_odds(b) * FIRM
        arcs.append((n, i, odds, 0) if odds > 0 else (i, n + 1, -odds, 0))
        if i:
            near = max(APART, NEAR - 2 * _tree_distance(blocks[i - 1].element, b.element))
            arcs.append((i - 1, i, near, near))
        own = id(b.element.parent)
        if last.get(own, i - 1) < i - 1:
            arcs.append((last[own], i, SAME_PARENT, SAME_PARENT))
        last[own] = i
    side = maximum_flow(n + 2, n, n + 1, arcs)
    return [b for i, b in enumerate(blocks) if side[i]]


def main_text(page: str | None) -> str:
    """The main text of a page: content blocks in page order, an empty line between."""
    return "\n\n".join([b.text for b in content_blocks(blocks_of(page))]) if page else ""


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        texts = [main_text(p) for p in cols[html_col]]
        return {id_col: cols[id_col], url_col: cols[url_col], "text": texts, "n_chars": [len(t) for t in texts]}

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    return map_rows(pages.select(id_col, url_col, html_col), run, f"{kinds}, text string, n_chars long")
