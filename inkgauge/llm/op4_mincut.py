"""HTML extraction by minimum cuts: each text block is content or boilerplate.

A page's block gets two costs from a logistic classifier over its tags, names and
words; they are the capacities of its edges to the two terminals.  Blocks that
follow each other and blocks of one parent or near in the tree are joined by
smoothness edges.  The minimum cut, found by augmenting paths, is the cheapest
labelling; blocks on the content side are the text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Elements whose content is not text of the page.
SILENT = frozenset("script style template noscript svg math iframe object canvas select textarea button head title".split())
#: Elements that are read up to their own end tag, whatever stands in them.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Elements that can stand in a head; any other, and text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open paragraph ends where one of these begins.
ENDS_P = BLOCKS - frozenset("body html td th tr caption tbody thead tfoot legend".split())
#: Elements that end an open one of the same kind.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements an open one of the same kind is not looked for beyond.
FENCE = frozenset("ul ol dl table article section div body main nav aside footer header form".split())

BAD_TAGS = {"nav": 6.0, "footer": 6.0, "aside": 5.0, "form": 5.0, "menu": 5.0, "dialog": 5.0, "fieldset": 4.0, "header": 3.0, "address": 1.5}
GOOD_TAGS = {"article": 4.0, "main": 2.5}
BAD_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|adv|sponsor\w*|promo\w*|banner|side-?bar|menu\w*|nav\w*|foot\w*|masthead|cookies?\w*|consent|gdpr|"
    r"notices?|alert|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social\w*|related|recommend\w*|"
    r"comments?|comment-?list|disqus|replies|reply|respond|breadcrumbs?|crumbs|pagination|pager|toolbar|widget\w*|copyright|legal|tags?)(?:$|[-_\s\d])"
)
GOOD_NAMES = re.compile(r"(?:^|[-_\s])(?:article\w*|content|post|entry\w*|story\w*|main|body-?text|body|text|post-?body)(?:$|[-_\s\d])")
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar alertdialog".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Weights of the classifier: log odds of content.
BIAS, PER_LOG_WORD, LINK_SHARE, ENDS_SENTENCE, PARAGRAPH, HEADING, LIST_ITEM, NAMED_BAD, NAMED_GOOD, HIDDEN_WEIGHT = (
    -1.2, 0.45, -3.0, 0.8, 0.8, 0.2, -0.6, -5.0, 1.5, -9.0,
)
#: Smoothness between neighbours in the page, and between siblings, by distance in the tree.
NEXT, SIBLING = 0.6, 0.5
#: Capacities are whole numbers of this part of a unit.
UNIT = 1000

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w:]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SENTENCE_END = (".", "!", "?", "…", '"', "”", "»", "。", ":")


class Element:
    __slots__ = ("tag", "parent", "depth", "odds", "link", "silent", "in_article", "holder")

    def __init__(self, tag: str, parent: Element | None, odds: float, link: bool, silent: bool, in_article: bool):
        self.tag, self.parent, self.odds, self.link, self.silent, self.in_article = tag, parent, odds, link, silent, in_article
        self.depth = parent.depth + 1 if parent else 0
        # the nearest element that text is a block of
        self.holder = self if tag in BLOCKS or parent is None else parent.holder


class Block:
    __slots__ = ("element", "parts", "linked")

    def __init__(self, element: Element):
        self.element, self.parts, self.linked = element, [], 0


def element_odds(tag: str, attributes: str, parent: Element) -> float:
    """What an element adds to the log odds of all blocks in it."""
    # a header in an article holds its title
    odds = -0.5 if parent.in_article and tag in ("header", "address") else -BAD_TAGS.get(tag, 0.0)
    odds += GOOD_TAGS.get(tag, 0.0)
    if attributes and tag not in ("body", "html"):
        found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if BAD_NAMES.search(names):
            odds += NAMED_BAD
        elif GOOD_NAMES.search(names):
            odds += NAMED_GOOD
        if found.get("role") in BAD_ROLES:
            odds += NAMED_BAD
        if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")):
            odds += HIDDEN_WEIGHT
    return odds


def blocks_of(page: str) -> list[tuple[Block, str]]:
    """The text blocks of a page in order, with white space already made single."""
    here = Element("#page", None, 0.0, False, False, False)
    blocks, block, at, n = [], None, 0, len(page)
    # the open elements of every name, the innermost last: no end tag walks to the root for nothing
    names: dict[str, list[Element]] = {}

    def leave(to: Element) -> None:
        """Ends the open elements inside ``to``."""
        nonlocal here
        while here is not to:
            names[here.tag].pop()
            here = here.parent

    def text(raw: str) -> None:
        nonlocal block
        if here.tag == "head" and not raw.isspace():
            leave(out_of_head(here))
        if here.silent or not raw:
            return
        if block is None:
            if raw.isspace():
                return
            block = Block(here.holder)
            blocks.append(block)
        plain = entities.unescape(raw) if "&" in raw else raw
        block.parts.append(plain)
        if here.link:
            block.linked += len(plain)

    while at < n:
        open_ = page.find("<", at)
        if open_ < 0:
            text(page[at:])
            break
        if open_ > at:
            text(page[at:open_])
        if page.startswith("<!--", open_):
            end = page.find("-->", open_ + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), open_):
            end = page.find(">", open_)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, open_)
        if not m:
            # a lone angle bracket is text; a tag that never ends is not
            if open_ + 1 < n and (page[open_ + 1].isalpha() or page[open_ + 1] == "/"):
                end = page.find(">", open_)
                at = n if end < 0 else end + 1
            else:
                text("<")
                at = open_ + 1
            continue
        at = m.end()
        closing, tag, attributes = (m[1], m[2].lower(), m[3]) if m[2] else (m[4], m[5].lower(), m[6])
        if closing:
            if names.get(tag):
                leave(names[tag][-1].parent)
            if tag in BLOCKS:
                block = None
            continue
        if tag not in IN_HEAD:
            leave(out_of_head(here))
        if tag in BLOCKS:
            block = None
        if tag == "br" and block is not None and not here.silent:
            block.parts.append(" ")
        if tag in VOID or (attributes or "").endswith("/") and tag not in BLOCKS and tag not in RAW and tag != "a":
            continue
        if tag in ENDS_P:
            leave(closed(here, names, ("p",)))
        if tag in SAME:
            leave(closed(here, names, SAME[tag]))
        here = Element(
            tag, here, here.odds + element_odds(tag, attributes, here), here.link or tag == "a", here.silent or tag in SILENT,
            here.in_article or tag in ("article", "main"),
        )
        names.setdefault(tag, []).append(here)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            if end is None:
                at = n
            elif here.silent:
                at = end.start()
    found = ((b, " ".join("".join(b.parts).split())) for b in blocks)
    return [(b, t) for b, t in found if t]


def out_of_head(here: Element) -> Element:
    """The place after an open head, whose end tag may be left out."""
    while here.tag == "head" and here.parent is not None:
        here = here.parent
    return here


def closed(here: Element, names: dict[str, list[Element]], tags: Iterable[str]) -> Element:
    """The place after the nearest open element of these tags has ended, if no fence is nearer."""
    top = max((names[t][-1] for t in tags if names.get(t)), key=lambda e: e.depth, default=None)
    if top is None or any(names.get(t) and names[t][-1].depth > top.depth for t in FENCE):
        return here
    return top.parent


def block_odds(block: Block, text: str) -> float:
    element = block.element
    words = text.count(" ") + 1
    linked = min(1.0, block.linked / len(text))
    odds = BIAS + element.odds + PER_LOG_WORD * math.log1p(words) + LINK_SHARE * linked
    if text.endswith(SENTENCE_END):
        odds += ENDS_SENTENCE
    if element.tag in ("p", "blockquote", "pre"):
        odds += PARAGRAPH
    elif element.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        odds += HEADING
    elif element.tag == "li":
        odds += LIST_ITEM
    return odds


def tree_distance(a: Element, b: Element) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def graph_of(blocks: list[tuple[Block, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Capacities to the content and boilerplate terminal of each block, and the smoothness edges."""
    costs, edges, last = [], [], {}
    for i, (block, text) in enumerate(blocks):
        odds = max(-30.0, min(30.0, block_odds(block, text)))
        # cut off from content costs -log P(boilerplate), and the other way round
        costs.append((round(UNIT * math.log1p(math.exp(odds))), round(UNIT * math.log1p(math.exp(-odds)))))
        if i:
            edges.append((i - 1, i, round(UNIT * NEXT / (1 + tree_distance(blocks[i - 1][0].element, block.element)))))
        parent = id(block.element.parent)
        if parent in last and last[parent] != i - 1:
            edges.append((last[parent], i, round(UNIT * SIBLING / (1 + tree_distance(blocks[last[parent]][0].element, block.element)))))
        last[parent] = i
    return costs, [e for e in edges if e[2] > 0]


def minimum_cut(costs: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the content side of a minimum cut.

    ``costs`` are a node's capacities from the content and to the boilerplate
    terminal.  Flow through one node alone goes first; the rest is Dinic's
    blocking flows.  Among minimum cuts the one with the fewest content nodes.
    """
    n = len(costs)
    supply, demand = [], []
    for a, b in costs:
        through = min(a, b)
        supply.append(a - through), demand.append(b - through)
    if not any(supply):
        return [False] * n
    graph: list[list[int]] = [[] for _ in range(n)]
    to, room = [], []
    for a, b, c in edges:
        graph[a].append(len(to)), to.append(b), room.append(c)
        graph[b].append(len(to)), to.append(a), room.append(c)
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if supply[i] > 0)
        for i in queue:
            level[i] = 0
        ends = False
        while queue:
            i = queue.popleft()
            ends |= demand[i] > 0
            for e in graph[i]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not ends:
            return [x >= 0 for x in level]
        step = [0] * n
        for source in range(n):
            while supply[source] > 0:
                # one path in the level graph, by a stack of edges
                path, i = [], source
                while demand[i] <= 0:
                    while step[i] < len(graph[i]):
                        e = graph[i][step[i]]
                        if room[e] > 0 and level[to[e]] == level[i] + 1:
                            break
                        step[i] += 1
                    if step[i] < len(graph[i]):
                        path.append(e)
                        i = to[e]
                    elif path:
                        i = to[path.pop() ^ 1]
                        step[i] += 1
                    else:
                        i = -1
                        break
                if i < 0:
                    break
                flow = min([supply[source], demand[i], *(room[e] for e in path)])
                supply[source] -= flow
                demand[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def extract_blocks(page: str | None) -> list[str]:
    """The content blocks of a page, in order."""
    blocks = blocks_of(page or "")
    if not blocks:
        return []
    side = minimum_cut(*graph_of(blocks))
    return [t for (_, t), content in zip(blocks, side) if content]


def extract_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with an array ``blocks`` of the content blocks of each page.

    Null, empty and blank pages and pages without content have no blocks.  Broken
    markup never fails: open elements end with the page, unknown tags are inline.
    Pages are judged alone, so equal rows get equal results; an empty table gives
    no rows; a column named ``blocks`` is replaced.  Pages of any length and depth are
    read whole, in time that grows with their length.
    """

    def call(column: pa.Array) -> pa.Array:
        return pa.array([extract_blocks(p) for p in column.to_pylist()], pa.list_(pa.string()))

    return pages.withColumn("blocks", F.arrow_udf(call, "array<string>").asNondeterministic()(F.col(f"`{html_col}`")))


@base.query("op4_html_mincut")
def op4_html_mincut(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    out = extract_html(base.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    text = F.array_join("blocks", " ")
    return out.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"))
