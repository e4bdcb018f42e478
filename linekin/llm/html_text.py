"""Main text of web pages by minimum-cut labelling of their blocks.

A page is scanned once for tags; text between the edges of block elements is a block (inline tags vanish, ``<br>`` is
white space). A logistic classifier, trained on the small table of labelled blocks below, prices each block as content or
boilerplate, by the elements and names around it, its length, links and last character, by phrases that notices, menus
and comment sections have, by headings of such sections above it, and by whether the page has any other text. The prices become
terminal capacities. Neighbouring blocks, and blocks of one parent, are joined by smoothness edges whose capacity grows with their
DOM proximity. A max-flow separates content from boilerplate.

Blocks that no label can make readable text (scripts, styles, form controls, the head) are never nodes. Only an ``<a>`` with an
``href`` is a link; one that is never closed ends with the next one or with the element that holds it. Closing tags of
elements that are skipped are found once a page, so scanning is linear in the page.

A null page counts as empty and has an empty text; a page without tags, or with nothing but short text, is text; character
references are decoded; a page of any length is one row, its graph linear in its blocks; repeated rows each give a row;
extra columns are carried by ``main_text`` (but ``html``, ``text`` and ``n_chars``); an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title button".split())
#: Of these, the ones that run to the end of the page when they are never closed.
OPEN_ENDED = frozenset("script style title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag that ends an open element of the listed kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INNERMOST = frozenset("ul ol dl table div section article main aside nav footer header form body blockquote".split())

#: Contexts that an element gives to the text in it, by tag and by the words of class, id and role.
BY_TAG = {"nav": "menu", "menu": "menu", "footer": "foot", "header": "head", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice", "article": "article", "main": "article"}
BY_WORD = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs toc skip",
    "foot": "footer foot copyright colophon legal",
    "head": "header masthead banner topbar siteheader",
    "side": "sidebar side widget aside related recommended recommendations popular trending complementary rail",
    "notice": "cookie cookies consent notice notices alert gdpr popup modal overlay toast disclaimer paywall",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion adsense dfp banner-ad",
    "form": "newsletter subscribe subscription signup login search searchbox form",
    "comment": "comment comments usercomments commentlist reply replies respond disqus discussion reader-comments feedback reviews",
    "share": "share sharing social follow tags byline-meta",
    "article": "article content main post entry story body maincontent articlebody post-content entry-content text",
}
_CONTEXT = {w: c for c, words in BY_WORD.items() for w in words.split()}
CONTEXTS = ("menu", "foot", "head", "side", "notice", "ad", "form", "comment", "share", "article", "hidden")
FEATURES = (*CONTEXTS, "heading", "item", "links", "words", "stop", "bare", "article_links", "cue", "under", "alone")

#: Phrases of short blocks (``SHORT_WORDS`` at most) outside of articles, and headings of sections that are none.
SHORT_WORDS = 14
CUE = re.compile(
    r"\b(?:we use cookies|uses cookies|accept (?:all )?cookies|cookie (?:policy|settings)|privacy policy|terms of (?:use|service)|all rights reserved|copyright|subscribe|sign up|log ?in|newsletter|"
    r"advertisement|sponsored|share (?:this|on)|follow us|read more|back to top|skip to (?:main )?content|leave a (?:comment|reply)|post a comment|comments? (?:are|is) (?:open|closed)|"
    r"[0-9]+ comments?|filed under|related (?:posts|articles|stories)|you may also like|add to cart)\b|\u00a9",
    re.I,
)
SECTION = re.compile(
    r"(?:related|related (?:posts|articles|stories|links|content|news|reading)|comments?|[0-9]+ (?:comments?|responses?|replies)|leave a (?:reply|comment)|(?:customer|user|reader) (?:reviews|comments)|"
    r"share this|newsletter|advertisement|sponsored(?: content)?|more (?:from|stories|posts)[^.]{0,30}|you may also like|recommended for you|most read|recent (?:posts|comments))[:!]?",
    re.I,
)
#: Labelled blocks: features with value 1 (or name=value), then whether such a block is content.
LABELLED = """
article words=3 stop | 1
article words=2 | 1
article heading words=2 | 1
article heading words=1 | 1
article words=1 stop | 1
article words=0.5 | 1
article item words=2 | 1
article item words=1 links=0.5 | 1
article head heading words=2 | 1
article words=4 stop links=0.2 | 1
words=4 stop bare | 1
words=3 stop bare | 1
words=3.5 stop links=0.1 bare | 1
words=2.5 stop bare | 1
heading words=2 bare | 1
menu item links=1 words=0.5 | 0
menu words=1 links=1 | 0
menu words=2 stop | 0
article menu item links=1 words=0.7 | 0
foot words=2.5 stop | 0
foot words=4 stop | 0
foot words=1 | 0
article foot words=2 | 0
head words=1 | 0
head words=3 stop | 0
head heading words=1.5 | 0
side words=2 | 0
side words=4 stop | 0
side heading words=1 | 0
side article words=3 stop | 0
side item links=1 words=1 | 0
notice words=3 stop | 0
notice words=4 stop | 0
notice article words=3 stop | 0
ad words=3 stop | 0
ad words=2 | 0
ad article words=3 stop | 0
form words=1 | 0
form words=3 stop | 0
form article words=2 | 0
comment words=3 stop | 0
comment words=4 stop | 0
comment article words=3 stop | 0
comment article words=4 stop | 0
comment article heading words=1 | 0
share article words=1 links=1 | 0
share item links=1 words=0.5 | 0
hidden words=3 stop | 0
hidden article words=3 stop | 0
links=1 words=1 bare | 0
links=1 words=0.5 item bare | 0
words=0.7 bare | 0
words=1 links=0.8 bare | 0
article words=2 stop links=1 article_links=1 | 1
article words=3 stop links=0.9 article_links=0.9 | 1
article words=2 links=1 article_links=1 | 1
article item words=1.5 links=1 article_links=1 | 1
article item words=2.5 stop links=0.7 article_links=0.7 | 1
article words=1 | 1
article words=0.7 | 1
article cue heading words=1 | 0
article cue heading words=0.7 | 0
article under words=2 stop | 0
article under words=3 stop | 0
article under item words=1.5 links=1 article_links=1 | 0
article under words=4 stop | 0
under words=3 stop bare | 0
under words=2 bare | 0
under item links=1 words=1.5 bare | 0
cue words=2 stop bare | 0
cue words=1.5 bare | 0
cue words=2 bare alone | 0
cue heading words=1 bare | 0
alone words=0.7 bare | 1
alone words=1 bare | 1
alone words=2 bare | 1
alone words=2 stop bare | 1
alone heading words=1 bare | 1
alone links=1 words=1 bare | 0
alone links=1 words=0.7 item bare | 0
alone item words=1 bare | 1
heading words=1 bare | 1
words=2 stop bare | 1
item words=2 stop bare | 1
item words=2.5 stop links=0.2 bare | 1
"""

#: Capacities are whole numbers: so many units a nat.
UNIT = 100
#: Smoothness between neighbours with one parent; halved for each step that the parents are apart.
SMOOTH = 60


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    rows, marks = [], []
    for line in LABELLED.strip().splitlines():
        left, _, mark = line.partition(" | ")
        row = np.zeros(len(FEATURES))
        for part in left.split():
            name, _, value = part.partition("=")
            row[FEATURES.index(name)] = float(value or 1)
        rows.append(row)
        marks.append(float(mark))
    return np.array(rows), np.array(marks)


def train(rounds: int = 60, shrink: float = 0.01) -> np.ndarray:
    """Weights (the last one constant) of a logistic regression on the labelled contexts, by Newton steps."""
    x, y = labelled_table()
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + shrink * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - shrink * w)
    return w


def _context(tag: str, attributes: str) -> tuple[str, ...]:
    found = [BY_TAG[tag]] if tag in BY_TAG else []
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            value = value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                found.append("hidden")
            elif name in ("class", "id", "role", "itemprop") and tag not in ("body", "html"):
                for word in re.split(r"[\s_]+", value):
                    if word in _CONTEXT:
                        found.append(_CONTEXT[word])
                    elif "-" in word:
                        found += [c for part in word.split("-") if (c := _CONTEXT.get(part)) and c != "article"]
    return tuple(found)


ROOT: tuple[str, frozenset[str], int, int, str] = ("", frozenset(), 0, 0, "")


class Block:
    """``heading`` is 1 to 6, or 0 for other blocks; groups are numbered in page order, ``last`` is the last one inside ``parent``."""

    __slots__ = ("parts", "contexts", "parent", "depth", "heading", "item", "linked", "last")

    def __init__(self, contexts: frozenset[str], parent: int, depth: int, heading: int, item: bool) -> None:
        self.parts: list[str] = []
        self.contexts, self.parent, self.depth, self.heading, self.item, self.linked = contexts, parent, depth, heading, item, 0
        self.last = parent

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def blocks(page: str) -> list[tuple[Block, str]]:
    """The non-empty blocks of a page with their texts, in page order."""
    # Open elements: tag, contexts in it, number and depth of the innermost group, tag of the innermost block.
    stack: list[tuple[str, frozenset[str], int, int, str]] = []
    open_: Counter[str] = Counter()
    out: list[tuple[Block, str]] = []
    now: Block | None = None
    number, link, at, n = 0, -1, 0, len(page)  # link: how many elements were open when the open link began
    last = page.rfind(">")
    closing: dict[str, list[tuple[int, int]]] = {}
    lasts: dict[int, int] = {}

    def cut(k: int) -> None:
        nonlocal link
        for s in stack[k:]:
            open_[s[0]] -= 1
            lasts[s[2]] = number
        del stack[k:]
        if link > k:
            link = -1

    def end_of(tag: str, after: int) -> int | None:
        """The end of the first closing tag of that kind; all of them are found at the first question."""
        if tag not in closing:
            closing[tag] = [m.span() for m in re.finditer(rf"</{re.escape(tag)}\s*>", page, re.I)]
        k = bisect_left(closing[tag], (after, after))
        return closing[tag][k][1] if k < len(closing[tag]) else None

    def end() -> None:
        nonlocal now
        if now is not None:
            text = now.text()
            if text:
                out.append((now, text))
            now = None

    def say(part: str) -> None:
        nonlocal now
        if now is None:
            _, contexts, group, depth, tag = stack[-1] if stack else ROOT
            now = Block(contexts, group, depth, int(tag[1]) if tag in HEADINGS else 0, tag in ("li", "td", "th", "dd", "dt"))
        now.parts.append(part)
        if link >= 0:
            now.linked += len(part)

    while at < n:
        edge = page.find("<", at)
        if edge < 0:
            say(page[at:])
            break
        if edge > at:
            say(page[at:edge])
        # After the last ">" nothing but an open comment can be markup.
        m = _TOKEN.match(page, edge) or _LOOSE.match(page, edge) if edge < last or page.startswith("<!--", edge) else None
        if not m:
            say("<")
            at = edge + 1
            continue
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = -1
            if tag in BLOCK:
                end()
            for k in range(len(stack) - 1, -1, -1) if open_[tag] else ():
                if stack[k][0] == tag:
                    cut(k)
                    break
                if tag not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag in RAW:
            if m[3].endswith("/"):
                continue
            if tag in BLOCK:
                end()
            close = end_of(tag, at)
            at = close if close is not None else n if tag in OPEN_ENDED else at
            continue
        if tag in BLOCK:
            end()
            ends = CLOSES.get(tag, ())
            for k in range(len(stack) - 1, -1, -1) if open_["p"] or any(open_[t] for t in ends) else ():
                if stack[k][0] == "p" or stack[k][0] in ends:
                    cut(k)
                    break
                if stack[k][0] in INNERMOST:
                    break
        if tag in VOID:
            continue
        if tag == "a":
            link = len(stack) if _HREF.search(m[3]) else -1
            continue
        own = _context(tag, m[3])
        if tag in BLOCK or own:
            _, above, group, depth, holder = stack[-1] if stack else ROOT
            if tag in INNERMOST:
                number += 1
                group, depth = number, depth + 1
            stack.append((tag, above.union(own) if own else above, group, depth, tag if tag in BLOCK else holder))
            open_[tag] += 1
    end()
    cut(0)
    lasts[0] = number
    for block, _ in out:
        block.last = lasts[block.parent]
    return out


def features(found: list[tuple[Block, str]]) -> np.ndarray:
    """A row for each block, the last column constant."""
    at = {name: k for k, name in enumerate(FEATURES)}
    x = np.zeros((len(found), len(FEATURES) + 1))
    x[:, -1] = 1
    sections: list[tuple[int, int, int]] = []  # open sections that are no article: group of the heading, its last group, level
    for row, (block, text) in zip(x, found, strict=True):
        for c in block.contexts:
            row[at[c]] = 1
        words = text.count(" ") + 1
        section = bool(block.heading and words <= SHORT_WORDS and SECTION.fullmatch(text))
        while sections and not sections[-1][0] <= block.parent <= sections[-1][1]:
            sections.pop()
        if block.heading:
            while sections and sections[-1][0] == block.parent and sections[-1][2] >= block.heading:
                sections.pop()
        row[at["under"]] = bool(sections)
        if section:
            sections.append((block.parent, block.last, block.heading))
        row[at["heading"]] = block.heading > 0
        row[at["item"]] = block.item
        row[at["links"]] = min(1.0, block.linked / max(1, sum(map(len, block.parts))))
        row[at["words"]] = min(4.0, np.log1p(words))
        row[at["stop"]] = text[-1] in ".!?:;\"')]"
        row[at["bare"]] = not block.contexts
        row[at["article_links"]] = row[at["links"]] * row[at["article"]]
        row[at["cue"]] = section or words <= SHORT_WORDS and "article" not in block.contexts and CUE.search(text) is not None
    bare = x[:, at["bare"]] > 0
    # A page that has neither an article nor a longer text of its own: what there is may be all.
    longer = (x[:, at["article"]] > 0) | bare & (x[:, at["words"]] >= np.log1p(12)) & (x[:, at["links"]] < 0.5)
    if not longer.any():
        x[bare, at["alone"]] = 1
    return x


def costs(found: list[tuple[Block, str]], weights: np.ndarray) -> list[int]:
    """Units by which each block is rather content (above 0) or boilerplate."""
    return [int(v) for v in np.rint(np.clip(features(found) @ weights, -20, 20) * UNIT)]


def edges(found: list[tuple[Block, str]]) -> list[tuple[int, int, int]]:
    """Smoothness edges: neighbours in page order, and the next block of the same parent where others lie between."""
    out = []
    last: dict[int, int] = {}
    for i, (block, _) in enumerate(found):
        if i:
            before = found[i - 1][0]
            apart = 0 if before.parent == block.parent else 1 + abs(before.depth - block.depth)
            if (units := SMOOTH >> apart) > 0:
                out.append((i - 1, i, units))
        k = last.get(block.parent)
        if k is not None and k < i - 1:
            out.append((k, i, SMOOTH // 2))
        last[block.parent] = i
    return out


def content_side(prices: list[int], joins: list[tuple[int, int, int]]) -> list[bool]:
    """Minimum cut: which blocks stay with the content terminal.

    The terminal arcs of a block are already cancelled against each other in its price. Where no price has another
    sign than its neighbours', nothing can flow; else breadth-first levels and blocking flows (Dinic).
    """
    n = len(prices)
    if n < 2 or not joins or min(prices) > 0 or max(prices) < 0:
        return [p > 0 for p in prices]
    source, sink = n, n + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + 2)]  # arcs: to, capacity, place of the reverse arc

    def arc(a: int, b: int, there: int, back: int) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i, p in enumerate(prices):
        if p > 0:
            arc(source, i, p, 0)
        elif p < 0:
            arc(i, sink, -p, 0)
    for a, b, units in joins:
        arc(a, b, units, units)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for to, room, _ in graph[v]:
                if room and level[to] < 0:
                    level[to] = level[v] + 1
                    queue.append(to)
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[list[int]] = []
        v = source
        while True:
            if v == sink:
                flow = min(a[1] for a in path)
                for a in path:
                    a[1] -= flow
                    graph[a[0]][a[2]][1] += flow
                cut = next(k for k, a in enumerate(path) if not a[1])
                v = graph[path[cut][0]][path[cut][2]][0]
                del path[cut:]
                continue
            arcs = graph[v]
            while turn[v] < len(arcs) and not (arcs[turn[v]][1] and level[arcs[turn[v]][0]] == level[v] + 1):
                turn[v] += 1
            if turn[v] < len(arcs):
                path.append(arcs[turn[v]])
                v = arcs[turn[v]][0]
            elif path:
                a = path.pop()
                v = graph[a[0]][a[2]][0]
                turn[v] += 1
            else:
                break


def extract(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = content_side(costs(found, weights), edges(found))
    return "\n".join(text for (_, text), k in zip(found, keep, strict=True) if k)


def main_text(pages: DataFrame) -> DataFrame:
    """The pages' columns but ``html``, with ``text`` and ``n_chars``, its code points."""
    weights = train()
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [extract(h, weights) for h in part.column(0).to_pylist()]
                columns = [*part.columns[1:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*others, "text", "n_chars"])

    return pages.select("html", *others).mapInArrow(run, f"{fields}, text string, n_chars long")
