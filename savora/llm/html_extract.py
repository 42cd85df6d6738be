"""HTML extraction by minimum-cut labelling.

A page's text blocks are the nodes of a graph. A classifier over a block's structure (marks of the
elements around it, links) and text (length, punctuation) gives log-odds of being content, which
become a capacity from the source (content) or to the sink (boilerplate), at most ``MOST``.
Smoothness edges tie neighbours in page order, the stronger the nearer they are in the DOM, and
successive blocks of one kind under one parent; they are of the same order as the capacities, so
that a block the classifier gets wrong goes with its neighbours. The minimum cut labels all blocks
at once; the source side is content.

The classifier is a logistic regression, fitted where it is used on the labelled example pages of
``examples`` (a few hundred blocks, made by rule); nothing of a corpus goes into it.

Defined results: null or empty html, and pages without content, give an empty text; unclosed,
misnested and truncated markup is read as browsers do (a tag cut off at the end is dropped); pages
are independent, so repeated rows get equal texts; very long pages are worked on whole; an empty
table gives no rows; a column named like the output is replaced, others are left alone.
"""

from __future__ import annotations

import random
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from savora.llm.common import read_table

#: Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template iframe object svg math canvas audio video select option textarea button datalist head title".split())
RAW = set("script style textarea title noscript iframe template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
ENDS_P = BLOCK - set("td th tr tbody thead tfoot body html".split())

#: Elements and words of class, id or role that mark what surrounds an article; the weak ones also name articles' own parts.
AWAY_ELEMENTS = set("nav aside footer form fieldset dialog menu".split())
WRAPPERS = {"form", "fieldset"}
WORDS_AWAY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|aside|widget\w*|footer|masthead|site-?header|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|paywall|newsletter|subscribe|signup|login|search|share|sharing|comments?|comment-?\w+|disqus|respond|replies|reply|discussion|pagination|pager|skip-?link|toolbar|copyright|legal|disclaimer|tags?-?(?:list|cloud)|contentinfo|complementary|dialog)(?=$|[\s_-])",
    re.I,
)
WORDS_WEAK = re.compile(r"(?:^|[\s_-])(?:related|recommend\w*|trending|popular|more-?posts|social)(?=$|[\s_-])", re.I)
WORDS_HERE = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|prose|markdown)(?=$|[\s_-])", re.I)
#: Words of class that tell a layout's state, not what the element is: has-sidebar, no-comments, menu-open, ad-free.
STATES = re.compile(r"^(?:has|no|not|with|without|is|show|hide|toggle|off)[_-]|[_-](?:free|open|opened|closed|enabled|disabled|on|off|less|active|visible|hidden)$", re.I)
NONE, WEAK, STRONG = 0, 1, 2
MOST_WORDS = 25
NEARLY_ALL, MOST_OVERRULED = 0.9, 4
#: The largest capacity of a block, and the weights of edges.
MOST = 3.0
NEAR, SAME_KIND = 1.5, 1.2

#: Comments; tags with sound quotes; tags with broken ones; declarations; a tag that the end cuts off.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|$)|<(?:/?[a-zA-Z][^>]*)?$", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


@dataclass
class Element:
    name: str
    parent: Element | None
    depth: int
    away: int  # the strongest mark of surroundings that counts
    inside: bool  # that mark lies inside content
    here: bool  # a mark of content counts
    hidden: bool
    linked: bool
    in_article: bool
    number: int
    holder: Element | None = None  # the block element it lies in, or is
    named_away: bool = False  # its own class, id or role marks surroundings strongly


@dataclass
class Block:
    parent: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(source: str) -> dict[str, str]:
    return {k.lower(): unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(source)}


def inside_article(element: Element | None) -> bool:
    while element is not None and element.name != "article":
        element = element.parent
    return element is not None


def _named(about: str, words: re.Pattern) -> bool:
    return any(words.search(w) for w in about.split() if not STATES.search(w))


def _opened(name: str, source: str, parent: Element | None, number: int, overruled: frozenset[int] = frozenset()) -> Element:
    if parent is None:
        return Element(name, None, 0, NONE, False, False, False, False, False, number)
    away, inside, here = parent.away, parent.inside, parent.here
    hidden = parent.hidden or name in HIDDEN
    content = name in ("article", "main")
    mark = STRONG if name in AWAY_ELEMENTS or (name == "header" and not parent.in_article and not content) else NONE
    named = named_away = False
    if source.strip():
        a = _attributes(source)
        about = f"{a.get('class', '')} {a.get('id', '')} {a.get('role', '')}".strip()
        if about and name not in ("html", "body"):
            named = WORDS_HERE.search(about) is not None
            # the element that is the page's content may name its surroundings, as in main.has-sidebar
            own = name == "main" or (name == "article" and named and away != STRONG and not inside_article(parent))
            if not own:
                named_away = number not in overruled and _named(about, WORDS_AWAY)
                mark = max(mark, STRONG if named_away else WEAK if _named(about, WORDS_WEAK) else NONE)
        hidden |= "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", a.get("style", "")) is not None
    if mark:
        inside |= here or parent.in_article
        away, here = max(away, mark), here and mark != STRONG
    elif content and away and not inside and (name == "main" or _wrapped(parent)):
        away, here = NONE, True  # a form or the like around the whole page says nothing about its content
    elif (content or named) and away != STRONG:
        here = True
    element = Element(name, parent, parent.depth + 1, away, inside, here, hidden, parent.linked or name == "a", parent.in_article or content, number, parent.holder, named_away)
    if name in BLOCK:
        element.holder = element
    return element


def _wrapped(element: Element) -> bool:
    """All strong marks above come from elements that may wrap a whole page."""
    while element.parent is not None and element.away == STRONG:
        if element.parent.away != STRONG and element.name not in WRAPPERS:
            return False
        element = element.parent
    return True


def _said(block: Block) -> int:
    """The words of a block that isn't made of links."""
    return block.text.count(" ") + 1 if block.linked < 0.3 * len(block.text) else 0


def blocks_of(html: str) -> list[Block]:
    """The visible text blocks in page order, white space collapsed.

    A class, id or role is evidence, not a verdict: where nearly all that a page says lies in elements that are named
    like surroundings, the outermost one that holds most of it is read again as if it had no such name.
    """
    overruled: frozenset[int] = frozenset()
    for _ in range(MOST_OVERRULED):
        found = _parsed(html, overruled)
        said = [(b, n) for b in found if (n := _said(b))]
        total, marked = sum(n for _, n in said), [(b, n) for b, n in said if b.parent.away == STRONG]
        if sum(n for _, n in marked) < NEARLY_ALL * total or not marked:
            return found
        held: dict[int, int] = {}
        for b, n in marked:
            named = None
            element: Element | None = b.parent
            while element is not None:
                named, element = element.number if element.named_away else named, element.parent
            if named is not None:
                held[named] = held.get(named, 0) + n
        if not held or max(held.values()) < 0.5 * total:
            return found
        overruled |= {max(held, key=lambda k: (held[k], -k))}
    return _parsed(html, overruled)


def _parsed(html: str, overruled: frozenset[int]) -> list[Block]:
    top = _opened("html", "", None, 0)
    top.holder = top
    stack, found, current, at, number = [top], [], None, 0, 0
    open_ = Counter()

    def text(piece: str) -> None:
        nonlocal current
        if not piece or stack[-1].hidden:
            return
        if current is None:
            if not piece.strip():
                return
            current = Block(stack[-1].holder)
            found.append(current)
        piece = unescape(piece)
        current.pieces.append(piece)
        if stack[-1].linked:
            current.linked += len(piece.strip())

    def close(names: set[str], within: set[str]) -> None:
        if not any(open_[name] for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                open_.subtract(e.name for e in stack[k:])
                del stack[k:]
                return
            if stack[k].name in within:
                return

    while True:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        ending, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name in BLOCK:
            current = None
        if ending:
            if name == "br":
                text(" ")
            elif name in BLOCK:
                close({name}, {"table"} if name not in ("table", "body", "html", "article", "main") else set())
            else:  # an inline element does not end the blocks around it
                close({name}, BLOCK)
            continue
        if name == "br":
            text(" ")
        if name in VOID:
            continue
        if name in ENDS_P:
            close({"p"}, {"button", "table", "td", "th", "object"})
        if name in CLOSES:
            close(CLOSES[name], SCOPES[name])
        if name in ("html", "body"):
            continue
        number += 1
        element = _opened(name, rest, stack[-1], number, overruled)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if not rest.rstrip().endswith("/") or name in BLOCK:
            stack.append(element)
            open_[name] += 1
    for block in found:
        block.text = " ".join("".join(block.pieces).split())
    return [b for b in found if b.text]


def features(block: Block) -> list[float]:
    """1, strong mark, weak mark, mark of content, share in links, words, ends a sentence, heading, short and without an end."""
    words = block.text.count(" ") + 1
    linked, ends = min(1.0, block.linked / len(block.text)), block.text[-1] in ".!?…。！？"
    heading = block.parent.name in ("h1", "h2", "h3", "h4")
    at = block.parent
    return [1.0, float(at.away == STRONG), float(at.away == WEAK), float(at.here), linked, min(words, MOST_WORDS) / MOST_WORDS, float(ends), float(heading), float(words < 4 and not ends and not heading)]


def examples() -> list[str]:
    """Pages for the classifier: texts that begin with K are content, all others aren't."""
    draw = random.Random(17)

    def words(n: int, first: str) -> str:
        return " ".join([first, *["w" * draw.randint(2, 9) for _ in range(n - 1)]])

    def paragraph(first: str, least: int = 8, most: int = 60) -> str:
        return f"<p>{words(draw.randint(least, most), first)}.</p>"

    def article() -> str:
        parts = [f"<h2>{words(4, 'K')}</h2>", *[paragraph("K") for _ in range(draw.randint(2, 6))]]
        parts.insert(2, draw.choice([f"<p>{words(3, 'K')}</p>", f"<ul><li>{words(5, 'K')}</li><li>{words(7, 'K')}</li></ul>", f"<blockquote>{words(12, 'K')}</blockquote>", f'<div class="related-work">{paragraph("K", 20)}</div>']))
        return "".join(parts)

    def links(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href=x>{words(draw.randint(1, 5), 'B')}</a></li>" for _ in range(n)) + "</ul>"

    around = ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="post-content">{}</div>', '<div id="story">{}</div>', "<div>{}</div>", "<section>{}</section>"]
    pages = []
    for k in range(70):
        inner = article()
        if k % 3 == 0:
            inner += draw.choice(['<div class="comments">{}</div>', "<aside>{}</aside>", '<div class="ad">{}</div>', "<form>{}</form>"]).format(paragraph("B", 3) + paragraph("B", 3, 40))
        body = around[k % len(around)].format(inner)
        head = f"<header><h1>{words(2, 'B')}</h1></header><nav>{links(draw.randint(2, 6))}</nav>"
        side = draw.choice(['<div class="sidebar">{}</div>', '<div class="related">{}</div>', "<aside>{}</aside>", "<div>{}</div>"]).format(links(4))
        notice = f'<div class="cookie-notice">{paragraph("B", 5, 30)}</div>'
        foot = f"<footer><p>{words(6, 'B')}.</p>{links(2)}</footer><div><span>{words(2, 'B')}</span></div>"
        pages.append(head + draw.choice(["", notice]) + body + side + draw.choice(["", f'<div id="comments">{paragraph("B", 3)}</div>']) + foot)
    return pages


@lru_cache(maxsize=1)
def classifier() -> np.ndarray:
    """Weights of the features: a logistic regression on the example pages, by Newton's steps with an L2 penalty."""
    blocks = [b for page in examples() for b in blocks_of(page)]
    x = np.array([features(b) for b in blocks])
    y = np.array([b.text[0] == "K" for b in blocks], dtype=np.float64)
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ weights))
        slope = x.T @ (y - p) - 0.3 * weights
        weights += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.3 * np.eye(len(weights)), slope)
    return weights


def unary(block: Block) -> float:
    return float(np.clip(features(block) @ classifier(), -MOST, MOST))


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree."""
    steps = 0
    while a is not b:
        steps += 1
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return steps


def edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    out = []
    last: dict[tuple, int] = {}
    for i, block in enumerate(blocks):
        if i:
            out.append((i - 1, i, NEAR / (1 + distance(blocks[i - 1].parent, block.parent))))
        at = block.parent
        kind = ((at.parent or at).number, at.name, at.away)
        if (j := last.get(kind)) is not None:
            out.append((j, i, SAME_KIND))
        last[kind] = i
    return out


def minimum_cut(costs: list[float], smooth: list[tuple[int, int, float]]) -> list[bool]:
    """Max-flow by shortest augmenting levels; True for nodes left on the source's side."""
    n = len(costs)
    spare = [max(0.0, c) for c in costs]  # from the source
    room = [max(0.0, -c) for c in costs]  # to the sink
    graph: list[list[int]] = [[] for _ in range(n)]
    head, capacity = [], []
    for a, b, w in smooth:
        graph[a].append(len(head))
        graph[b].append(len(head) + 1)
        head += [b, a]
        capacity += [w, w]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if spare[i] > tiny)
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached |= room[i] > tiny
            for e in graph[i]:
                j = head[e]
                if level[j] < 0 and capacity[e] > tiny:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in [i for i in range(n) if spare[i] > tiny]:
            path: list[int] = []
            i = start
            while spare[start] > tiny:
                if room[i] > tiny:
                    flow = min([spare[start], room[i], *(capacity[e] for e in path)])
                    spare[start] -= flow
                    room[i] -= flow
                    for e in path:
                        capacity[e] -= flow
                        capacity[e ^ 1] += flow
                    path, i = [], start
                    continue
                while turn[i] < len(graph[i]):
                    e = graph[i][turn[i]]
                    if capacity[e] > tiny and level[head[e]] == level[i] + 1:
                        break
                    turn[i] += 1
                if turn[i] < len(graph[i]):
                    path.append(graph[i][turn[i]])
                    i = head[path[-1]]
                elif path:
                    i = head[path.pop() ^ 1]
                    turn[i] += 1
                else:
                    break


def main_text(html: str | None) -> str:
    blocks = blocks_of(html or "")
    content = minimum_cut([unary(b) for b in blocks], edges(blocks))
    return "\n\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, the main text of html_col."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn(text_col, text(F.col(f"`{html_col}`")))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
