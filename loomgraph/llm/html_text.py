"""Main text of HTML pages by minimum cut.

A page becomes blocks of text with their place in the element tree. A linear classifier's log-odds of each block are capacities from
the source (content) or to the sink (boilerplate); edges between neighbouring blocks and between blocks of one parent, weaker the
more elements lie between them, make labels smooth. The minimum cut separates content from boilerplate.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import chunks

#: Elements without text of their own, elements that stand inside a line, elements without an end.
DROPPED = frozenset("script style noscript template svg math iframe object embed head title select option datalist canvas audio video map textarea".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What marks boilerplate and content in names of elements, roles, classes and ids.
BAD_TAGS = frozenset("nav aside footer form button dialog menu fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar side rail menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar "
    "toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "pagination pager copyright legal disclaimer skip hidden".split(),
)
TALK_WORDS = frozenset("comment comments disqus reply replies respond discussion responses".split())
GOOD_TAGS = frozenset(["article", "main"])
GOOD_WORDS = frozenset("article content post entry story main body text maintext".split())
#: The classifier's weights, and the edges': strength and the elements between two blocks that halve it.
GOOD, BAD, TITLE, WORDS, LINKS, SHORT, SENTENCE, BIAS = 5.0, -9.0, 1.0, 0.5, 4.0, -0.6, 0.6, -1.2
EDGE, HALF = 1.2, 2.0
#: Flow below this counts as none.
LEAST = 1e-12

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*>)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Dropped elements that never stay open; one that a new paragraph doesn't close; elements of svg and math that hold HTML; what a head holds.
POINTS, SCOPE, HTML_INSIDE, METADATA = frozenset(["embed", "option"]), "object", frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split()), frozenset("meta link base".split())
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.IGNORECASE) for t in RAW}


@dataclass
class Element:
    tag: str
    parent: int
    depth: int
    bad: bool = False
    talk: bool = False
    good: bool = False
    holds: bool = False  # an article or a main element below it


@dataclass
class Block:
    text: str
    element: int
    words: int = 0
    links: float = 0.0
    heading: str = ""
    parts: list[str] = field(default_factory=list)


def _marks(e: Element, tag: str, attributes: str) -> None:
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes or "hidden" in attributes else {}
    names = {x.lower() for k in ("class", "id") if k in a for x in NAME.findall(a[k])}
    role = a.get("role", "").lower()
    e.talk = bool(names & TALK_WORDS)
    e.bad = tag in BAD_TAGS or role in BAD_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""))) or (bool(names & BAD_WORDS) and tag not in ("html", "body"))
    e.good = tag in GOOD_TAGS or role in ("main", "article") or bool(names & GOOD_WORDS)


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """Blocks in page order, and the elements that they stand in."""
    elements = [Element("", -1, 0)]
    blocks: list[Block] = []
    stack, inline, standing, heads = [0], Counter(), Counter(), []  # open elements; how many stand open by name, inside a line and else; places of open headings in the stack
    dropped: list[tuple[str, int]] = []  # open dropped elements by name, and the elements of the stack around each
    parts: list[str] = []
    linked = 0

    def close() -> None:
        nonlocal linked
        if parts:
            if text := " ".join(html.unescape("".join(parts)).split()):
                tag = elements[stack[heads[-1]]].tag if heads else ""
                blocks.append(Block(text, stack[-1], len(text.split()), min(1.0, linked / len(text)), tag))
            parts.clear()
        linked = 0

    def cut(n: int) -> None:
        """Closes all open elements but the first n."""
        standing.subtract(elements[i].tag for i in stack[n:])
        del stack[n:]
        while heads and heads[-1] >= n:
            heads.pop()

    def leave(k: int) -> None:
        """Closes the k-th open dropped element, and what stands in it."""
        if len(stack) > dropped[k][1]:
            close()
            cut(dropped[k][1])
        del dropped[k:]

    def outlive() -> None:
        """Closes the dropped elements whose enclosing element is closed."""
        while dropped and dropped[-1][1] > len(stack):
            dropped.pop()

    at, size = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    if (rest := page.find("<!--", last)) >= 0:
        size = rest
    while at < size:
        m = TAG.search(page, at, last) if at < last else None
        if text := page[at : m.start() if m else size]:
            if not dropped:
                parts.append(text)
                if inline["a"]:
                    linked += len(text)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end
            if tag in DROPPED:
                k = next((k for k in range(len(dropped) - 1, -1, -1) if dropped[k][0] == tag), -1)
                if k >= 0:
                    leave(k)
            elif tag in INLINE:
                inline[tag] = max(0, inline[tag] - 1)
            elif standing[tag]:
                close()
                n = len(stack) - 1
                while elements[stack[n]].tag != tag:
                    n -= 1
                cut(n)
                outlive()
            elif tag == "p":
                close()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else size
            continue
        if dropped:
            top, depth = dropped[-1]
            if top == "head" and tag not in METADATA or top == "select" == tag:
                leave(len(dropped) - 1)
            elif top in ("svg", "math") and tag in CLOSES_P and not any(elements[i].tag in HTML_INSIDE for i in stack[depth:]):
                leave(len(dropped) - 1)
        if tag in DROPPED:
            if tag not in POINTS and not m[3].rstrip(">").endswith("/"):
                dropped.append((tag, len(stack)))
        elif tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            inline[tag] += 1
        elif tag == "body":
            dropped.clear()
        elif tag in VOID:
            if tag == "hr":
                close()
        else:
            close()
            inline.clear()
            inside = dropped and dropped[-1] == (SCOPE, len(stack))
            if tag in CLOSES_P and elements[stack[-1]].tag == "p" and not inside:
                cut(len(stack) - 1)
            if elements[stack[-1]].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th") and not inside:
                cut(len(stack) - 1)
            outlive()
            e = Element(tag, stack[-1], len(stack))
            _marks(e, tag, m[3])
            elements.append(e)
            stack.append(len(elements) - 1)
            standing[tag] += 1
            if tag in HEADINGS:
                heads.append(len(stack) - 1)
            if tag in GOOD_TAGS and not e.talk:
                i = e.parent
                while i > 0 and not elements[i].holds:
                    elements[i].holds = True
                    i = elements[i].parent
    close()
    return blocks, elements


def inherited(elements: list[Element]) -> list[tuple[bool, bool, bool]]:
    """For each element whether it stands in (or is) something bad, something good, or a header that nothing good stands in between."""
    out = [(False, False, False)]
    for e in elements[1:]:
        bad, good, header = out[e.parent]
        out.append((bad or e.talk or (e.bad and not e.holds), good or e.good, (header and not e.good) or (e.tag == "header" and not e.holds)))
    return out


def log_odds(b: Block, marks: list[tuple[bool, bool, bool]]) -> float:
    """Of content against boilerplate."""
    z = BIAS + WORDS * math.log2(1 + b.words) - LINKS * b.links + (SHORT if b.words < 4 else 0.0)
    z += SENTENCE if b.text[-1] in ".!?…\"'»”)" else 0.0
    bad, good, header = marks[b.element]
    if bad or (header and not (good and b.heading in ("h1", "h2"))):
        return z + BAD
    return z + (GOOD if good else 0.0) + (TITLE if b.heading else 0.0)


def distance(a: int, b: int, elements: list[Element]) -> int:
    """Elements on the way from one element to another."""
    n = 0
    while a != b:
        if elements[a].depth >= elements[b].depth:
            a = elements[a].parent
        else:
            b = elements[b].parent
        n += 1
    return n


def edges_of(blocks: list[Block], elements: list[Element]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, EDGE * 0.5 ** (distance(blocks[i - 1].element, b.element, elements) / HALF)))
        parent = elements[b.element].parent
        j = last.get(parent, i)
        if j < i - 1:
            out.append((j, i, EDGE * 0.5 ** (2 / HALF)))
        last[parent] = i
    return out


def min_cut(z: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The source's side of the minimum cut: z is a node's capacity from the source or, below 0, to the sink.

    Nodes whose terminal outweighs all their edges have their label for sure and are folded into their neighbours; a maximum flow
    in each connected piece of the rest settles that. A tie goes to the sink.
    """
    z, near = list(z), [{} for _ in z]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * len(z)
    wait = deque(range(len(z)))
    while wait:
        i = wait.popleft()
        if label[i] is None and abs(z[i]) >= sum(near[i].values()):
            label[i] = z[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                z[j] += w if label[i] else -w
                wait.append(j)
            near[i] = {}
    for first in range(len(z)):
        if label[first] is None:
            label[first], piece = False, [first]
            for i in piece:  # grows while it is gone through
                for j in near[i]:
                    if label[j] is None:
                        label[j] = False
                        piece.append(j)
            for i in source_side({i: z[i] for i in piece}, {i: near[i] for i in piece}):
                label[i] = True
    return [bool(x) for x in label]


def layers(spare: dict[int, float], flow: dict[int, dict[int, float]]) -> tuple[dict[int, int], bool]:
    """Steps from the nodes with flow left over to all others that these reach, up to the first that still take some; whether there are such."""
    level = {i: 0 for i, x in spare.items() if x > LEAST}
    layer = list(level)
    while layer:
        after = []
        for i in layer:
            for j, c in flow[i].items():
                if c > LEAST and j not in level:
                    level[j] = level[i] + 1
                    after.append(j)
        if any(spare[j] < -LEAST for j in after):
            return level, True
        layer = after
    return level, False


def source_side(spare: dict[int, float], flow: dict[int, dict[int, float]]) -> set[int]:
    """Nodes on the source's side after a maximum flow; spare and flow are changed.

    Each round fills all shortest ways at once, so rounds are no more than there are lengths of ways: a few, as capacities are
    bounded and only nodes of nearly no capacity let flow pass on.
    """
    while True:
        level, found = layers(spare, flow)
        if not found:
            return set(level)
        arcs = {i: iter(flow[i]) for i in level}
        now: dict[int, int] = {}  # the arc that a node tries; those before it lead nowhere in this round
        for first in [i for i, n in level.items() if not n]:
            way = [first]
            while way and spare[first] > LEAST:
                i = way[-1]
                j = now.get(i, -1)
                if spare[i] < -LEAST:
                    push = min(spare[first], -spare[i], *(flow[a][b] for a, b in pairwise(way)))
                    spare[first] -= push
                    spare[i] += push
                    for a, b in pairwise(way):
                        flow[a][b] -= push
                        flow[b][a] += push
                    way = [first]
                elif j >= 0 and flow[i][j] > LEAST and level.get(j) == level[i] + 1:
                    way.append(j)
                elif (j := next(arcs[i], -1)) >= 0:
                    now[i] = j
                else:  # a dead end
                    level[i] = -1
                    way.pop()


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks, elements = blocks_of(page)
    if not blocks:
        return ""
    marks = inherited(elements)
    keep = min_cut([log_odds(b, marks) for b in blocks], edges_of(blocks, elements))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    Null, empty and text-free pages have an empty text; repeated rows stay; other columns are not read. White space in a block,
    line breaks too, becomes one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "html"):
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")
