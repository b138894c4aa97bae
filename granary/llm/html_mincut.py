"""Main text of web pages by minimum-cut labelling.

A page becomes a row of text blocks. A classifier adds up the evidence of a block's text and place as log-odds, whose
size is the capacity between the block and one of the two terminals (content, boilerplate); neighbours in page order and
siblings in the document tree are joined by edges that a cut has to pay for, the less the farther apart they are in the
tree. Text alone gives costs of the edges' size, so that a block of doubt (a title, a short line, a list, a line of
links) follows its surroundings. The maximum flow separates the two labels at least cost.

There are no labels for pages: the weights are stated constants. What names a part of a page by its element or by a whole
class or id outweighs the text, as a long comment or advert reads like an article; but a class that holds nearly all of
the page's prose costs no more than an edge, and so does the id of an article's section.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized

#: Names of HTML elements and of usual roles and classes of page parts.
SKIPPED = "template iframe select button noscript video audio"
#: What holds no markup, and ends with the page at the latest; what may close itself; whose end tag may be left out.
RAW, FOREIGN, OPTION = "script style textarea", "svg", "option optgroup"
#: The elements that a head may hold: another one ends it, with or without an end tag.
IN_HEAD = "base basefont bgsound link meta noscript script style template title"
BLOCKS = "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
OUTER = "nav footer aside form menu dialog".split()
HINTS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs footer sidebar widget cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription share sharing social related recommended comments comment commentlist reply replies disqus login signup search form copyright legal toolbar masthead pagination complementary contentinfo alert dialog header topbar hidden".split()
)

_ATTRS = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
_names = lambda words: "|".join(words.split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    rf"|<(?P<raw>{_names(RAW)})(?=[\s/>]){_ATTRS}>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    rf"|<(?:{_names(FOREIGN)})(?=[\s/>])(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*/>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
#: The end tags of what is skipped with all that it holds.
CLOSES = re.compile(rf"</({_names(SKIPPED)}|{_names(FOREIGN)})\s*>", re.I)
NAMED = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Words that say where or what shape a part is; beside a word of HINTS they don't name another thing.
NEUTRAL = set("site page main top bottom left right list item items box bar block wrap wrapper container section inner outer area text body content links link post entry article global primary secondary fixed sticky inline js module component".split())
RIGHTS = re.compile(r"©|\bcopyright\b|\ball rights reserved\b", re.I)
#: Subjects that sections of an article have, and name by their id: such an id mentions a part beside the article only.
SUBJECTS = set("form social search legal copyright notice header dialog alert popup menu share sharing banner related recommended promo hidden subscribe subscription consent cookie cookies".split())
STOP = re.compile(r"[.!?…。][\"'”’)]*$")
#: Log-odds of content. In an article, or outside one on a page that has one; in an element or class that names another
#: part; in a class that only mentions one; share of linked text; a line of rights. Then what the text alone says: a
#: full stop, a heading, no stop and under 40 characters, and up to LONG for 200 characters.
BASE, IN_ARTICLE, OUTSIDE, BESIDE, MENTIONED, LINKED, RIGHTS_LINE = -0.3, 2.5, -2.5, -8.0, -1.0, -2.0, -3.0
SENTENCE, HEADING, SHORT, LONG = 0.8, 0.3, -0.3, 1.5
#: Capacities between neighbours in page order, over one more than the steps between their parents in the tree; between
#: siblings that aren't neighbours; and what is left of both where one block is in a part beside the article.
ADJACENT, SIBLING, ACROSS = 1.0, 0.6, 0.2
#: The share of a page's prose from which an element can't be beside the rest, whatever its class says.
WHOLE = 0.9
#: Open elements within each other: what is nested deeper stands beside the deepest, as in browsers (which allow 512).
DEEPEST = 64
#: What hides an element.
GONE = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
#: Blocks of a run are not evidence apart from each other: they count for so many at most.
RUN = 2


@dataclass
class Block:
    text: str
    score: float
    path: tuple[int, ...]
    beside: bool = False
    hints: tuple[int, ...] = ()


#: These name a part beside the article only outside of it; within it they hold its title.
HEADS = {"header", "masthead", "topbar"}


def hinted(attrs: str, inside: bool) -> float:
    """The evidence of an element's attributes (inside an article or not): BESIDE if they hide it, or if a whole class or id
    names a part beside the article; MENTIONED if one only holds such a word."""
    found = 0.0
    for name, *values in NAMED.findall(attrs):
        value = next((v for v in values if v), "").lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return BESIDE
        if name in ("class", "id", "role"):
            for whole in value.split():
                parts = {x for x in re.split(r"[^a-z]+", whole) if x}
                if named := parts & (HINTS - HEADS if inside else HINTS):
                    if parts <= named | NEUTRAL and not (inside and name == "id" and named <= SUBJECTS):
                        return BESIDE
                    found = MENTIONED
    return found


def tokens(page: str) -> Iterator[re.Match]:
    """The page's tags and texts in order, without what is skipped. The end of a skipped element is looked for only where
    there is one, so that the time is in proportion to the page, whatever is left open; one that has no end skips nothing
    but its tag."""
    ends: dict[str, list[int]] = {}
    for m in CLOSES.finditer(page):
        ends.setdefault(m[1].lower(), []).append(m.end())
    for found in ends.values():
        found.reverse()  # the next one is last
    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        if m is None:
            at += 1
            continue
        at = m.end()
        if m["tag"] is not None and not m["close"] and (left := ends.get(m["tag"].lower())):
            while left and left[-1] <= at:
                left.pop()
            if left:
                at = left.pop()
                continue
        yield m


def blocks(page: str) -> list[Block]:
    """The text blocks in page order, with their scores and the number of the element that they stand in."""
    out: list[Block] = []
    # Open elements: (tag, number, in an article, evidence of what it is beside, in a heading); an anchor's depth counts links.
    stack: list[tuple[str, int, bool, float, bool]] = [("", 0, False, 0.0, False)]
    # Elements that only their class or id names as beside the article.
    named: set[int] = set()
    made, anchors = 0, 0
    parts: list[str] = []
    within: list[bool] = []
    linked = 0
    in_head, in_title, in_option = False, False, False
    doubtful: list[tuple[Block, tuple[int, ...]]] = []

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, _, inside, beside, heading = stack[-1]
                leaf = stack[-1][0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td") and len(stack) > 1
                stop = bool(STOP.search(text))
                score = BASE + IN_ARTICLE * inside + beside + LINKED * min(1.0, linked / len(text)) + LONG * min(1.0, len(text) / 200)
                score += SENTENCE * stop + HEADING * heading + SHORT * (not stop and not heading and stack[-1][0] != "li" and len(text) < 40)
                score += RIGHTS_LINE * (not inside and len(text) < 300 and bool(RIGHTS.search(text)))
                hints = tuple(x[1] for x in stack if x[1] in named)
                out.append(Block(text, score, tuple(x[1] for x in (stack[:-1] if leaf else stack)), beside <= BESIDE, hints if stop else ()))
                if hints and not any(x[0] in _OUTER for x in stack):
                    doubtful.append((out[-1], hints))
                within.append(inside)
            parts.clear()
        linked = 0

    for m in tokens(page):
        if (text := m["text"]) is not None:
            if in_option:
                continue
            if in_head and (in_title or not text.strip()):
                continue
            in_head = False
            text = html.unescape(text)  # before it is joined: a reference doesn't span tags
            parts.append(text)
            if anchors:
                linked += len(text.strip())
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if tag in _OPTION:  # ends with the next one, the list, or a block
            in_option = not m["close"]
            continue
        if tag == "select" or tag in _BLOCK:
            in_option = False
        if tag == "head":
            flush()
            in_head = not m["close"]
        elif in_head and tag not in _IN_HEAD:
            in_head = False
        in_title = in_head and tag == "title" and not m["close"]
        if in_head or tag == "head":
            continue
        if tag == "a":
            anchors = max(0, anchors - 1) if m["close"] else anchors + (not m["attrs"].endswith("/"))
        elif tag == "br":
            parts.append("\n")
        elif tag in _BLOCK:
            flush()
            if m["close"]:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if at:
                    del stack[at:]
                    if tag != "p":
                        anchors = 0
            elif tag not in _VOID:
                if stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (stack[-1][0] == tag and tag in ("li", "td", "th", "tr", "dt", "dd")):
                    stack.pop()  # such an element ends where the next block starts
                if len(stack) == DEEPEST:
                    stack.pop()
                made += 1
                _, _, inside, beside, _ = stack[-1]
                off = BESIDE if tag in _OUTER or (tag == "header" and not inside) else hinted(m["attrs"], inside) if m["attrs"] and tag not in ("body", "html", "article", "main") else 0.0
                if off <= BESIDE and tag not in _OUTER and tag != "header" and not GONE.search(m["attrs"]):
                    named.add(made)
                stack.append((tag, made, (inside or tag in ("article", "main")), max(beside + off, BESIDE), tag[0] == "h" and tag[1:].isdigit()))
    flush()
    # A class word costs no more than an edge where what it names holds nearly all prose of the page.
    prose = sum(len(b.text) for b in out if STOP.search(b.text))
    held: dict[int, int] = {}
    for b in out:
        for k in b.hints:
            held[k] = held.get(k, 0) + len(b.text)
    for b, hints in doubtful:
        if all(held.get(k, 0) > WHOLE * prose for k in hints):
            b.score, b.beside = b.score - BESIDE + MENTIONED, False
    if any(within):
        for b, inside in zip(out, within, strict=True):
            b.score += 0.0 if inside else OUTSIDE
    return out


_BLOCK, _VOID, _OUTER, _IN_HEAD, _OPTION = frozenset(BLOCKS), frozenset(VOID), frozenset(OUTER), frozenset(IN_HEAD.split()), frozenset(OPTION.split())


def max_flow_side(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For nodes 0 to n - 1: whether a node is on the source's side of a minimum cut (Dinic's algorithm)."""
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, c: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        cap.append(c)
        at[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in range(n):
        if source[i] > 0:
            add(s, i, source[i], 0.0)
        if sink[i] > 0:
            add(i, t, sink[i], 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        used = [0] * (n + 2)
        while True:  # one augmenting path at a time, without recursion
            path: list[int] = []
            a = s
            while a != t:
                while used[a] < len(at[a]):
                    e = at[a][used[a]]
                    if cap[e] > 1e-9 and level[to[e]] == level[a] + 1:
                        break
                    used[a] += 1
                else:
                    if not path:
                        break
                    level[a] = -1
                    a = to[path.pop() ^ 1]
                    used[a] += 1
                    continue
                path.append(e)
                a = to[e]
            if a != t:
                break
            flow = min(cap[e] for e in path)
            for e in path:
                cap[e] -= flow
                cap[e ^ 1] += flow


def labels(found: list[Block]) -> list[bool]:
    """Whether each block is content. A run of blocks of one parent that pull the same way is one node of the graph."""
    runs: list[list[Block]] = []
    of: list[int] = []
    for b in found:
        if runs and runs[-1][-1].path == b.path and runs[-1][-1].beside == b.beside and (runs[-1][-1].score > 0) == (b.score > 0):
            runs[-1].append(b)
        else:
            runs.append([b])
        of.append(len(runs) - 1)
    scores = [sum(b.score for b in run) * min(1.0, RUN / len(run)) for run in runs]
    if all(x > 0 for x in scores) or all(x <= 0 for x in scores):
        return [scores[k] > 0 for k in of]
    edges = []
    last: dict[tuple[int, ...], int] = {}
    for i, run in enumerate(runs):
        b = run[0]
        if i:
            a = runs[i - 1][0]
            shared = next((k for k, (x, y) in enumerate(zip(a.path, b.path, strict=False)) if x != y), min(len(a.path), len(b.path)))
            edges.append((i - 1, i, ADJACENT / (1 + len(a.path) + len(b.path) - 2 * shared) * (ACROSS if a.beside != b.beside else 1.0)))
        before = last.get(b.path, i)
        if before < i - 1:
            edges.append((before, i, SIBLING * (ACROSS if runs[before][0].beside != b.beside else 1.0)))
        last[b.path] = i
    side = max_flow_side(len(runs), [max(x, 0.0) for x in scores], [max(-x, 0.0) for x in scores], edges)
    return [side[k] for k in of]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by newlines; empty if none."""
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, labels(found), strict=True) if keep) if found else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: (page_id, url, text, n_chars).

    The whole html is read, however long; a null one counts as empty. Markup may be broken: unclosed and stray tags are taken as they
    come. A page without a content block has the empty text. Null ids and urls are kept, repeated rows give equal rows,
    and an empty table an empty result; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sized(batch, "html", rows=1000):
                texts = [main_text(x.as_py()) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
