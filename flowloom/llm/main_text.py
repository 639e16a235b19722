"""Main text of web pages by minimum cuts.

A page is read in one pass into blocks (runs of text between block-level tags) and the containers
that hold them. Two things say whether a block is content: a naive Bayes classifier over what the
block looks like (length, links, punctuation, tag), and landmarks (article and main against nav,
header, footer, aside, form, and names of classes, ids and roles). Their sum is a terminal capacity:
towards the source for content, towards the sink for boilerplate. Smoothness edges join neighbours in
page order, less the farther apart they are in the tree, and each block or container to the container
around it. The minimum cut, found by blocking flows, labels the blocks. A block whose terminal outweighs
all its edges is fixed beforehand, which changes no minimum cut and leaves small graphs.

The classifier is trained here: its labels are blocks inside landmarks, of SAMPLE pages with the least
hashes of id and html; PRIOR counts stand for what such blocks look like where pages have no
landmarks. Landmarks are no features. Blocks of all pages are labelled.

Script, style, form controls and what is hidden are never text. Character references are decoded, white
space inside a block is one space, blocks are joined by one newline. A row's text depends on its html
and on the classifier alone.

Defined cases: null, empty and text-free pages give ''. A page without any content block gives ''. Text
outside of any tag is a block of the page. Rows are independent, repeated rows and null ids come back
as they are. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_batches, table

#: Pages that the classifier learns from, at most.
SAMPLE = 2000
#: Log-odds of a block's features count so much at most, either way.
MOST = 6.0
#: Capacities of landmarks: against content, for it, and against what lies outside of all articles.
AGAINST, FOR, OUTSIDE = 30.0, 12.0, 9.0
#: Capacities of edges: to the neighbour in one container, to a neighbour elsewhere, to the container, between containers.
BESIDE, APART, INSIDE, NESTED = 2.0, 1.0, 1.0, 1.0
#: Flow below this is none.
TINY = 1e-9

#: Elements whose text is never read.
SKIPPED = frozenset(
    "script style noscript template svg math iframe object embed head title select option optgroup button textarea datalist canvas audio video map input label".split()
)
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that part blocks.
BLOCKS = frozenset(
    "html body main article section div nav header footer aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre p "
    "h1 h2 h3 h4 h5 h6 figure figcaption address details summary dialog menu center hgroup legend search hr".split()
)
#: Start tags that end an open element of the same kind in the same container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Containers beyond which a start tag ends nothing.
BOUNDS = frozenset("ul ol dl table menu body html".split())
#: Elements that hold the article, and that never do.
CONTENT_TAGS = frozenset(["article", "main"])
FOREIGN_TAGS = frozenset("nav footer aside dialog menu search".split())
#: Words of class, id and role that name parts beside the article.
FOREIGN = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer contentinfo sidebar aside complementary widget widgets ad ads advert adverts advertisement "
    "advertising adsense banner sponsor sponsored promo promotion related recommended recommendations recirc share sharing social cookie cookies consent gdpr "
    "notice alert popup modal overlay dialog newsletter subscribe subscription signup login search comment comments commentlist disqus respond reply replies "
    "pagination pager toolbar copyright legal disclaimer masthead topbar skip outbrain taboola".split()
)
#: Of these, words that name reader comments whatever they hold.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Whole names of class, id or role that mark the article.
ARTICLE = frozenset(
    "main article content post entry story article-body article-content article-text post-body post-content entry-content story-body main-content "
    "page-content body-content articlebody mw-content-text".split()
)
#: Phrases that notices and footers hold.
NOTICES = re.compile(r"©|\(c\) ?\d|all rights reserved|cookie|privacy policy|terms of (?:use|service)|subscribe|sign up|log in|advertisement", re.I)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|math|iframe|textarea|title)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<more>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-z/!?][^>]*\Z",
    re.I | re.S,
)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])(?!\s*=\s*[\"']?until)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Pseudo-counts of the classifier: feature, blocks of content, blocks of boilerplate. They are what decides on pages without landmarks.
PRIOR = {
    "words 0": (2, 20), "words 1": (4, 24), "words 2": (8, 16), "words 3": (16, 12), "words 4": (30, 6), "words 5": (40, 2),
    "links 0": (80, 30), "links 1": (18, 8), "links 2": (1, 12), "links 3": (1, 30),
    "stop no": (20, 60), "stop yes": (80, 20),
    "tag p": (52, 12), "tag h1": (12, 0.5), "tag h": (12, 6), "tag li": (8, 6), "tag link": (1, 36), "tag td": (6, 8), "tag quote": (6, 1), "tag other": (3, 10),
    "notice no": (98, 60), "notice yes": (2, 20),
}


class Block:
    __slots__ = ("inside", "links", "tag", "text")

    def __init__(self, text: str, links: int, tag: str, inside: int) -> None:
        self.text, self.links, self.tag, self.inside = text, links, tag, inside


class Page:
    """Blocks of a page, and its containers: parent, kind of landmark (1, 0, -1) and whether that can be overruled."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.parent, self.mark, self.soft, self.depth = [-1], [0], [False], [0]
        self._read(html)
        self._overrule()

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int]] = [("", 0)]  # open block-level elements and their containers
        names = [""]
        text, links, linked, hidden, at = [], 0, 0, None, 0

        def flush() -> None:
            nonlocal links
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                if joined:
                    self.blocks.append(Block(joined, links, stack[-1][0], stack[-1][1]))
                text.clear()
            links = 0

        for m in TAG.finditer(html):
            if m.start() > at and hidden is None:
                part = html[at : m.start()]
                text.append(part)
                if linked:
                    links += len(part.strip())
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if hidden is not None:  # inside of an element that isn't read: wait for its end
                if name == hidden[0]:
                    hidden[1] += -1 if m["end"] else name not in VOID
                    if not hidden[1]:
                        hidden = None
                        if name not in BLOCKS:
                            text.append(" ")
                continue
            if name == "a":
                linked = 0 if m["end"] else 1
            elif name == "br":
                text.append(" ")
            elif name in BLOCKS or "-" in name:
                flush()
                if m["end"]:
                    if name in names:
                        while names.pop() != name:
                            stack.pop()
                        stack.pop()
                    linked = 0
                    continue
                self._imply(name, names, stack)
                more = m["more"]
                if HIDDEN.search(more):
                    hidden = [name, 1]
                    continue
                if name == "hr" or more.endswith("/") and "-" in name:
                    continue
                mark, soft = self._mark(name, more, len(stack) < 3 and name in ("html", "body"), names)
                self.parent.append(stack[-1][1])
                self.mark.append(mark)
                self.soft.append(soft)
                self.depth.append(self.depth[stack[-1][1]] + 1)
                stack.append((name, len(self.parent) - 1))
                names.append(name)
            elif not m["end"] and name not in VOID and (name in SKIPPED or m["more"] and HIDDEN.search(m["more"])):
                if name != "head":
                    hidden = [name, 1]
        if hidden is None:
            text.append(html[at:])
        flush()

    @staticmethod
    def _imply(name: str, names: list[str], stack: list) -> None:
        """A start tag ends an open paragraph or heading, and the list item or cell beside it."""
        if names[-1] == "p" or names[-1] in ("h1", "h2", "h3", "h4", "h5", "h6") and name == names[-1]:
            names.pop()
            stack.pop()
        if ends := ENDS.get(name):
            for k in range(len(names) - 1, 0, -1):
                if names[k] in ends:
                    del names[k:], stack[k:]
                    if name != "tr" or names[-1] != "tr":
                        break
                elif names[k] in BOUNDS:
                    break

    @staticmethod
    def _mark(name: str, more: str, whole: bool, names: list[str]) -> tuple[int, bool]:
        """Landmark of a container: 1 article, -1 something beside it; and whether that is soft, a matter of names."""
        if name in CONTENT_TAGS:
            mark = 1
        elif name in FOREIGN_TAGS:
            mark = -1
        elif name == "header":
            mark = 0 if not CONTENT_TAGS.isdisjoint(names) else -1
        elif name == "form":
            return -1, True
        else:
            mark = 0
        if mark < 0 or whole or not more:
            return mark, False
        for m in NAMES.finditer(more):
            value = m[1] or m[2] or m[3] or ""
            if any(not READERS.isdisjoint(map(str.lower, WORDS.findall(x))) for x in value.split()):
                return -1, False
            if mark == 0 and not FOREIGN.isdisjoint(map(str.lower, WORDS.findall(value))):
                return -1, True
            if not ARTICLE.isdisjoint(value.lower().split()):
                mark = 1
        return mark, False

    def _overrule(self) -> None:
        """A form, or a container of such a name, that holds an article or most of the page's plain text is no landmark."""
        if not any(self.soft):
            return
        size, article = [0] * len(self.parent), [x > 0 for x in self.mark]
        for b in self.blocks:
            size[b.inside] += max(0, len(b.text) - b.links) if b.tag not in ("li", "td") else 0
            article[b.inside] |= b.tag == "h1"
        for c in range(len(self.parent) - 1, 0, -1):  # children come after their parents
            size[self.parent[c]] += size[c]
            article[self.parent[c]] |= article[c]
        for c, soft in enumerate(self.soft):
            if soft and (article[c] or 10 * size[c] > 6 * size[0]):
                self.mark[c] = 0

    def landmarks(self) -> list[int]:
        """For each block: -1 inside of something beside the article, 1 inside of an article, else 0."""
        of = [0] * len(self.parent)
        for c in range(1, len(of)):
            up = of[self.parent[c]]
            of[c] = -1 if up < 0 or self.mark[c] < 0 else max(up, self.mark[c])
        return [of[b.inside] for b in self.blocks]


#: The classifier's name of a tag; of all others it is "other".
KINDS = {"p": "p", "pre": "p", "h1": "h1", "li": "li", "dt": "li", "dd": "li", "td": "td", "th": "td", "blockquote": "quote", "figcaption": "quote"} | {
    f"h{k}": "h" for k in range(2, 7)
}


def features(b: Block) -> tuple[str, ...]:
    text, n, share = b.text, b.text.count(" ") + 1, b.links / len(b.text)
    kind = KINDS.get(b.tag, "other")
    return (
        f"words {min(5, (n // 2).bit_length())}",
        "links 0" if not b.links else "links 1" if share < 0.33 else "links 2" if share < 0.66 else "links 3",
        "stop yes" if text[-1] in ".!?…。！？:;\"'”»" else "stop no",
        f"tag {'link' if share >= 0.66 and kind != 'p' else kind}",
        "notice yes" if n < 60 and NOTICES.search(text) else "notice no",
    )


def log_odds(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Naive Bayes: what each feature says for content. Counts are taken as shares of PRIOR's weight, so neither label's number of blocks decides."""
    out = {}
    for kind in dict.fromkeys(f.split()[0] for f in PRIOR):
        own = [f for f in PRIOR if f.split()[0] == kind]
        seen = [sum(counts.get(f, (0, 0))[k] for f in own) for k in (0, 1)]
        prior = [sum(PRIOR[f][k] for f in own) for k in (0, 1)]
        # the sample may weigh as much as the prior does, however large it is
        scale = [min(1.0, p / s) if s else 0.0 for p, s in zip(prior, seen, strict=True)]
        share = lambda f, k: (PRIOR[f][k] + scale[k] * counts.get(f, (0, 0))[k]) / (prior[k] + scale[k] * seen[k])  # noqa: B023, E731
        out |= {f: math.log(share(f, 0) / share(f, 1)) for f in own}
    return out


class Graph:
    """A graph of capacities and its minimum cut by blocking flows. Node 0 is the source, 1 the sink."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n + 2)]
        self.to: list[int] = []
        self.room: list[float] = []

    def edge(self, u: int, v: int, there: float, back: float) -> None:
        self.out[u].append(len(self.to))
        self.to.append(v)
        self.room.append(there)
        self.out[v].append(len(self.to))
        self.to.append(u)
        self.room.append(back)

    def levels(self) -> list[int]:
        level, queue = [-1] * len(self.out), deque([0])
        level[0] = 0
        while queue:
            u = queue.popleft()
            for e in self.out[u]:
                if self.room[e] > TINY and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def cut(self) -> list[bool]:
        """For each node: can the source still reach it when the flow is at its most?"""
        to, room, out = self.to, self.room, self.out
        while (level := self.levels())[1] >= 0:
            at, path, u = [0] * len(out), [], 0
            while True:
                if u == 1:
                    flow = min(room[e] for e in path)
                    for k, e in enumerate(path):
                        room[e] -= flow
                        room[e ^ 1] += flow
                    k = next(k for k, e in enumerate(path) if room[e] <= TINY)
                    u = to[path[k] ^ 1]
                    del path[k:]
                    continue
                while at[u] < len(out[u]):
                    e = out[u][at[u]]
                    if room[e] > TINY and level[to[e]] == level[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(out[u]):
                    path.append(e)
                    u = to[e]
                elif path:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
                else:
                    break
        return [x >= 0 for x in level]


def min_cut(terminal: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: True costs a node max(0, -terminal), False max(0, terminal); an edge whose ends differ costs its weight.

    Of several such labellings, the one with the fewest True. Nodes whose terminal outweighs their edges are fixed first.
    """
    n = len(terminal)
    cost, weight = list(terminal), [0.0] * n
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for u, v, w in edges:
        near[u].append((v, w))
        near[v].append((u, w))
        weight[u] += w
        weight[v] += w
    label: list[bool | None] = [None] * n
    ready = [u for u in range(n) if abs(cost[u]) > weight[u]]
    while ready:
        u = ready.pop()
        if label[u] is not None:
            continue
        label[u] = cost[u] > 0
        for v, w in near[u]:
            if label[v] is None:
                cost[v] += w if label[u] else -w
                weight[v] -= w
                if abs(cost[v]) > weight[v] + TINY:
                    ready.append(v)
    rest = [u for u in range(n) if label[u] is None]
    if rest:
        node = {u: k + 2 for k, u in enumerate(rest)}
        graph = Graph(len(rest))
        for u in rest:
            if cost[u] > 0:
                graph.edge(0, node[u], cost[u], 0.0)
            elif cost[u] < 0:
                graph.edge(node[u], 1, -cost[u], 0.0)
        for u, v, w in edges:
            if label[u] is None and label[v] is None:
                graph.edge(node[u], node[v], w, w)
        found = graph.cut()
        for u in rest:
            label[u] = found[node[u]]
    return [bool(x) for x in label]


def labelled(page: Page, odds: dict[str, float], marks: list[int] | None = None) -> list[bool]:
    """Is each block content?"""
    marks, blocks = marks if marks is not None else page.landmarks(), page.blocks
    n, article = len(blocks), 1 in marks
    terminal = []
    for b, mark in zip(blocks, marks, strict=True):
        said = max(-MOST, min(MOST, sum(map(odds.__getitem__, features(b)))))
        terminal.append(said + (FOR if mark > 0 else -AGAINST if mark < 0 else -OUTSIDE if article else 0.0))
    # containers that hold blocks, and those around them, are nodes without a terminal
    node: dict[int, int] = {}
    edges = []
    for k, b in enumerate(blocks):
        c, below, weight = b.inside, k, INSIDE
        while c >= 0:
            known = c in node
            if not known:
                node[c] = len(terminal)
                terminal.append(0.0)
            edges.append((below, node[c], weight))
            if known:
                break
            below, c, weight = node[c], page.parent[c], NESTED
        if k:
            before = blocks[k - 1]
            together = before.inside == b.inside or page.parent[before.inside] == page.parent[b.inside]
            edges.append((k - 1, k, BESIDE if together else APART))
    return min_cut(terminal, edges)[:n]


def main_text(html: str | None, odds: dict[str, float]) -> str:
    if not html:
        return ""
    page = Page(html)
    return "\n".join(b.text for b, keep in zip(page.blocks, labelled(page, odds), strict=True) if keep)


def _rows(pages: DataFrame) -> DataFrame:
    python_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Log-odds of features from blocks inside landmarks, of at most `sample` pages."""
    key = F.xxhash64("page_id", "html")
    last = pages.select(key.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if last is None:
        return log_odds({})
    rows = _rows(pages).where(key <= last).limit(sample)  # the limit is for repeated rows alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for html in batch.column("html").to_pylist():
                page = Page(html or "")
                for b, mark in zip(page.blocks, page.landmarks(), strict=True):
                    if mark:
                        counts.update((f, mark) for f in features(b))
            columns = [[f for f, _ in counts], [m for _, m in counts], list(counts.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["feature", "mark", "n"])

    found = rows.mapInArrow(run, "feature string, mark int, n bigint").groupBy("feature", "mark").agg(F.sum("n").alias("n")).collect()  # two rows a feature
    counts = {(r.feature, r.mark): r.n for r in found}
    return log_odds({f: (counts.get((f, 1), 0), counts.get((f, -1), 0)) for f in PRIOR})


def extract(pages: DataFrame, odds: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row."""
    odds = odds or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, odds) for h in batch.column("html").to_pylist()]
            arrays = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return _rows(pages).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
